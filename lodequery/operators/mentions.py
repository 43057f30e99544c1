"""Names of a dictionary in texts: one automaton for many names reads each text once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the names in one automaton (some 100 bytes each in a worker), and of the texts that meet a block of names in one task.
NAME_CHARS, TEXT_CHARS = 2_000_000, 64_000_000


def automaton(names: Iterable[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, len(name))
    made.make_automaton()
    return made


def _found(read: ahocorasick.Automaton, keys: pd.Series, texts: pd.Series) -> Iterator[list[tuple]]:
    """The names of each text with the place where they first begin, some texts at a time."""
    for at in range(0, len(texts), 64):
        rows = []
        for k, text in zip(keys.iloc[at : at + 64], texts.iloc[at : at + 64], strict=True):
            first: dict[str, int] = {}
            for end, size in read.iter(text):
                first.setdefault(text[end - size + 1 : end + 1], end - size + 2)
            rows += [(k, name, place) for name, place in first.items()]
        yield rows


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name_chars: int = NAME_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """(key, name, first): names that each row's text contains, in any case, and where they first begin (from 1, in lower case).

    names: a column `name`; repeated names count once, those that differ in case are found together. Null and empty names and
    texts are in no result; a key that is repeated has its rows again. The work is linear in the texts. A dictionary of up to
    name_chars characters is sent to all tasks; a larger one is cut into blocks of about that size, and each block meets the
    texts slice by slice.
    """
    listed = names.where(F.coalesce("name", F.lit("")) != "").select("name", F.lower("name").alias("low")).distinct()
    low = listed.select("low").distinct()
    rows = texts.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(key).cast("string").alias("key"), F.lower(F.col(text)).alias("body"))
    out = "key string, low string, first int"  # keys as strings, as pandas has no null integers
    blocks = -(-(low.agg(F.sum(F.length("low"))).first()[0] or 0) // name_chars)
    if blocks <= 1:
        sent = texts.sparkSession.sparkContext.broadcast([r[0] for r in low.collect()])

        def read_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if sent.value:
                made = automaton(sent.value)
                for f in frames:
                    for part in _found(made, f["key"], f["body"]):
                        yield pd.DataFrame(part, columns=["key", "low", "first"])

        found = rows.mapInPandas(read_all, out)
    else:
        slices = -(-(rows.agg(F.sum(F.length("body"))).first()[0] or 1) // text_chars)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = rows.withColumn("slice", F.pmod(F.xxhash64("key", "body"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
        parts = low.withColumn("block", F.pmod(F.xxhash64("low"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))

        def read_block(f: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            parts_of = _found(automaton(part["low"]), f["key"], f["body"]) if len(f) and len(part) else ()
            return pd.DataFrame([r for p in parts_of for r in p], columns=["key", "low", "first"])

        found = dealt.groupBy("block", "slice").cogroup(parts.groupBy("block", "slice")).applyInPandas(read_block, out)
    return found.join(listed, "low").select(F.col("key").cast(texts.schema[key].dataType).alias(key), "name", "first")
