"""The four tables' contract: columns in order, types, keys and required columns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _L = T.StringType(), T.DateType(), T.BooleanType(), T.ArrayType(T.StringType())
_INTERVALS = [("legal_start", _D), ("legal_end", _D), ("operational_start", _D), ("operational_end", _D)]


def _table(*fields, required=()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields])


ORGS = _table(
    ("ods_code", _S), ("name", _S), ("status", _S), ("record_class", _S), ("role_codes", _L), ("role_names", _L),
    ("primary_role_code", _S), ("address", _S), ("town", _S), ("county", _S), ("postcode", _S), ("country", _S),
    ("uprn", _S), ("telephone", _S), ("website", _S), ("predecessor_codes", _L), ("successor_codes", _L),
    *_INTERVALS, ("last_changed", _D), ("publication_date", _D),
    required=("ods_code", "name", "status", "record_class", "role_codes", "role_names", "primary_role_code",
              "predecessor_codes", "successor_codes", "publication_date"),
)
ROLES = _table(
    ("ods_code", _S), ("role_code", _S), ("role_name", _S), ("is_primary", _B), ("role_status", _S), *_INTERVALS,
    ("role_id", _S), ("publication_date", _D),
    required=("ods_code", "role_code", "role_name", "is_primary", "role_status", "role_id", "publication_date"),
)
RELATIONSHIPS = _table(
    ("source_code", _S), ("target_code", _S), ("rel_code", _S), ("rel_name", _S), ("rel_status", _S), *_INTERVALS,
    ("rel_id", _S), ("publication_date", _D),
    required=("source_code", "target_code", "rel_code", "rel_name", "rel_status", "rel_id", "publication_date"),
)
SUCCESSIONS = _table(
    ("predecessor_code", _S), ("successor_code", _S), ("legal_start", _D), ("succession_id", _S),
    ("publication_date", _D),
    required=("predecessor_code", "successor_code", "succession_id", "publication_date"),
)

TABLES = {"orgs": ORGS, "roles": ROLES, "relationships": RELATIONSHIPS, "successions": SUCCESSIONS}

PRIMARY_KEYS = {"orgs": "ods_code", "roles": "role_id", "relationships": "rel_id", "successions": "succession_id"}

FOREIGN_KEYS = {
    "roles": ["ods_code"],
    "relationships": ["source_code", "target_code"],
    "successions": ["predecessor_code", "successor_code"],
}

#: Row order inside the written files; it makes Parquet statistics selective.
SORT_KEYS = {
    "orgs": ["status", "ods_code"],
    "roles": ["ods_code", "role_code", "role_id"],
    "relationships": ["source_code", "target_code", "rel_code", "rel_id"],
    "successions": ["predecessor_code", "successor_code", "succession_id"],
}

#: Older column names still accepted on read.
COLUMN_ALIASES = {"rel_type_code": "rel_code", "rel_type_name": "rel_name"}
