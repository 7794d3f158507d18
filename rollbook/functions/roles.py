"""Role lists: aliases, low-signal roles and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alias -> role codes searched together.
ROLE_ALIASES = {
    "gp": ["RO76", "RO227", "RO315"],
    "dentist": ["RO110", "RO65"],
}

#: Container and subtype roles shown last.
LOW_SIGNAL_ROLES = ["RO177", "RO101", "RO15", "RO31", "RO57"]

#: Relationship types in display order.
RELATIONSHIP_ORDER = {
    "RE2": "sub-division of",
    "RE3": "directed by",
    "RE4": "commissioned by",
    "RE5": "in the geography of",
    "RE6": "operated by",
    "RE8": "partner to",
    "RE9": "nominated payee for",
    "RE10": "covid nominated payee for",
    "RE11": "constituent of",
}

COMMISSIONED_BY, GEOGRAPHY_OF, OPERATED_BY = "RE4", "RE5", "RE6"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def low_signal(code) -> Column:
    return code.isin(LOW_SIGNAL_ROLES)


def all_low_signal(codes) -> Column:
    """Every role of the entity is low-signal (and it has at least one)."""
    return (F.size(codes) > 0) & F.forall(codes, low_signal)


def role_display(codes, names, verbose: bool = False) -> Column:
    """``"Practice +1"``: descriptive names first, low-signal ones folded into a count."""
    codes, names = _col(codes), _col(names)
    if verbose:
        return F.array_join(names, ", ")
    pairs = F.slice(F.arrays_zip(codes.alias("code"), names.alias("name")), F.lit(1),
                    F.least(F.size(codes), F.size(names)))
    telling = F.transform(F.filter(pairs, lambda p: ~low_signal(p["code"])), lambda p: p["name"])
    folded = F.size(pairs) - F.size(telling)
    plus = lambda shown, n: F.when(n > 0, F.concat(shown, F.lit(" +"), n.cast("string"))).otherwise(shown)
    first = F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))
    return (F.when(F.size(telling) > 0, plus(F.array_join(telling, ", "), folded))
            .otherwise(plus(first, F.size(names) - 1)))


def any_role(codes, primary, names, want_codes, want_names) -> Column:
    """Holds any wanted code or name; an empty code list falls back to the primary role."""
    codes, names = _col(codes), _col(names)
    held = F.when(F.size(codes) > 0, codes).otherwise(F.array(_col(primary)))
    upper = lambda a: F.transform(a, lambda x: F.upper(x))
    hit = F.arrays_overlap(upper(held), F.array(*[F.lit(c.upper()) for c in want_codes]).cast("array<string>"))
    if want_names:
        hit = hit | F.arrays_overlap(upper(names), F.array(*[F.lit(n.upper()) for n in want_names]))
    return F.coalesce(hit, F.lit(False))


def relationship_rank(code) -> Column:
    """Position of a relationship type in display order; unknown types last."""
    out = F.lit(len(RELATIONSHIP_ORDER))
    for rank, known in enumerate(RELATIONSHIP_ORDER):
        out = F.when(F.upper(code) == known, F.lit(rank)).otherwise(out)
    return out


def relationship_phrase(code) -> Column:
    out = F.lit("related to")
    for known, phrase in RELATIONSHIP_ORDER.items():
        out = F.when(F.upper(code) == known, F.lit(phrase)).otherwise(out)
    return out
