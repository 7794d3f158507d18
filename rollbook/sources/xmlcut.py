"""Records cut out of XML text that many tasks read at once, without losing or inventing any.

Files are cut before every closing entity tag, so a large file feeds many tasks. Such a cut may lie inside a comment, a CDATA
section or a processing instruction, and whether it does depends on all text before it. A chunk is therefore a function from
the state at its start to the state at its end, which needs no earlier text. The functions of a split compose to one
function, those of a file are composed in order, and then every chunk knows the state it starts in.

Nearly all files hold comments only between cuts. They need none of this: a chunk that starts in plain text and
ends in it tells so by itself, and only files with another chunk are threaded through their splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States: plain text, comment, CDATA section, processing instruction; and what ends all but the first.
STATES, ENDS = "tcdp", {"c": "-->", "d": "]]>", "p": "?>"}
_WHOLE = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
_OPEN = r"<!--|<!\[CDATA\[|<\?"
_STATE_OF = {"<!--": "c", "<![CDATA[": "d", "<?": "p", "": "t"}
#: CDATA sections stay; comments and instructions go, also unfinished ones.
_CLEAN = r"(<!\[CDATA\[.*?(?:\]\]>|\z))|<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)"
_SLOT = ["path", "split"]


def _marked(text: Column) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in ("<!", "<?", "-->", "]]>", "?>")])


def _exit_from_text(text: Column) -> Column:
    """The state after ``text`` that starts in plain text: the first section without an end decides."""
    rest = F.regexp_replace(text, f"(?s){_WHOLE}", " ")
    opened = F.regexp_extract(rest, f"({_OPEN})", 1)
    return F.when(opened == "<!--", "c").when(opened == "<![CDATA[", "d").when(opened == "<?", "p").otherwise("t")


def exits(text: Column) -> Column:
    """The state after ``text`` for each state at its start, as four letters in the order of ``STATES``."""
    def leaving(state: str) -> Column:
        at = F.instr(text, ENDS[state])
        return F.when(at == 0, state).otherwise(_exit_from_text(F.substr(text, at + len(ENDS[state]))))

    return F.when(_marked(text), F.concat(_exit_from_text(text), *[leaving(s) for s in STATES[1:]])).otherwise(STATES)


def without_comments(text: Column) -> Column:
    """``text`` that starts in plain text, without comments and processing instructions."""
    return F.when(_marked(text), F.regexp_replace(text, f"(?s){_CLEAN}", "$1")).otherwise(text)


def _cleaned(text: str, state: str) -> str:
    """The same for text that starts in ``state``."""
    if state in "cp":
        _, end, text = text.partition(ENDS[state])
    head = "<![CDATA[" if state == "d" else ""
    return re.sub(_CLEAN.replace(r"\z", r"\Z"), lambda m: m.group(1) or "", head + text, flags=re.S)[len(head):]


def chunks(spark: SparkSession, paths, before: str) -> DataFrame:
    """(path, file_name, split, row, value): text cut before every ``before``, in the order of ``row`` within a split."""
    rows = spark.read.option("lineSep", before).text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
                       F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


def _split_functions(rows: DataFrame) -> DataFrame:
    """For each split and state at its start: the state at its end, and its last chunk that starts in plain text (-1: none)."""
    def compose(own: pd.DataFrame) -> pd.DataFrame:
        steps = own.sort_values("row")["f"].tolist()
        now, last = list(STATES), [-1] * len(STATES)
        for at, f in enumerate(steps):
            last = [at if s == "t" else n for s, n in zip(now, last, strict=True)]
            now = [f[STATES.index(s)] for s in now]
        return pd.DataFrame({"path": [own["path"].iloc[0]], "split": [own["split"].iloc[0]], "f": ["".join(now)], "last": [last]})

    return rows.select(*_SLOT, "row", exits(F.col("value")).alias("f")).groupBy(*_SLOT).applyInPandas(
        compose, "path string, split long, f string, last array<long>")


def _split_entries(functions: DataFrame) -> DataFrame:
    """For each split: the state it starts in, and the chunk (split, place) to which text before its first true cut belongs."""
    def follow(own: pd.DataFrame) -> pd.DataFrame:
        state, begun, out = "t", (0, 0), []
        for r in own.sort_values("split").itertuples():
            out.append((r.path, r.split, state, *begun))
            last = r.last[STATES.index(state)]
            begun = (r.split, int(last)) if last >= 0 else begun
            state = r.f[STATES.index(state)]
        return pd.DataFrame(out, columns=["path", "split", "state", "in_split", "in_place"])

    return functions.groupBy("path").applyInPandas(follow, "path string, split long, state string, in_split long, in_place long")


def _rejoined(rows: DataFrame, before: str) -> DataFrame:
    """Chunks of files in which sections cross cuts, cleaned and put together again where a cut was not one."""
    entries = _split_entries(_split_functions(rows)).withColumnsRenamed({"path": "at_path", "split": "at_split"})
    placed = rows.join(entries, (F.col("path") == F.col("at_path")) & (F.col("split") == F.col("at_split"))).withColumn("f", exits(F.col("value")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, state, begun, at = None, "t", (0, 0), 0
        for own in batches:  # the chunks of a split follow each other, maybe over several batches
            out = []
            for r in own.itertuples():
                if (r.path, r.split) != slot:
                    slot, state, begun, at = (r.path, r.split), r.state, (int(r.in_split), int(r.in_place)), 0
                if state == "t":
                    begun = (int(r.split), at)
                text = _cleaned(r.value, state)
                state = r.f[STATES.index(state)]
                out.append((r.path, r.file_name, *begun, int(r.split), at, text + (before if state == "d" else "")))
                at += 1
            yield pd.DataFrame(out, columns=["path", "file_name", "in_split", "in_place", "split", "place", "value"])

    ordered = placed.select(*_SLOT, "row", "file_name", "value", "f", "state", "in_split", "in_place").repartition(*_SLOT).sortWithinPartitions(*_SLOT, "row")
    pieces = ordered.mapInPandas(cut, "path string, file_name string, in_split long, in_place long, split long, place long, value string")
    parts = F.array_sort(F.collect_list(F.struct("split", "place", "value")))
    return (pieces.where("value <> ''").groupBy("path", "file_name", "in_split", "in_place")
            .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value")).select("file_name", "value"))


def true_chunks(spark: SparkSession, paths, before: str) -> DataFrame:
    """(file_name, value): text between true occurrences of ``before``, without comments and processing instructions.

    One cheap pass looks for sections that cross a cut; where no file has any, the chunks are read as they are.
    """
    rows = chunks(spark, paths, before)
    text = F.col("value")
    crossing = (rows.where(F.contains(text, F.lit("<!")) | F.contains(text, F.lit("<?"))).where(_exit_from_text(text) != "t")
                .select(F.col("path").alias("crossed")).distinct())
    plain = rows.select("path", "file_name", without_comments(text).alias("value"))
    if crossing.isEmpty():
        return plain.drop("path")
    same = F.col("path") == F.col("crossed")
    return plain.join(crossing, same, "left_anti").drop("path").unionByName(_rejoined(rows.join(crossing, same, "left_semi"), before))
