"""Chat formatting by rotating perspectives: for every participant, the dialogue with that speaker as assistant.

A row is one turn in one perspective. Rows of a perspective in order make up its text; `start` is where the turn stands in
it, and the mask of a turn is the part to learn from: what the speaker in the assistant's place says, with the end mark.

Where a block of turns begins follows from counts and lengths by speaker alone; texts are shuffled once, to their block,
where running sums give the rest. So a conversation of any length needs no task to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

#: Turn numbers in a block, and rows beyond which a block is divided by turn, speaker and the first characters of the text.
BLOCK, CROWDED, FIRST = 1000, 20_000, 16
#: Rows up to which the list of crowded blocks is broadcast.
BROADCAST_ROWS = 100_000
#: Speakers of these roles set the scene; they aren't participants and keep their role in every perspective.
SCENE = ("system",)
START, END = "<|im_start|>", "<|im_end|>\n"


def unmarked(text: Column) -> Column:
    """Text in which no mark stands: `<|` is parted by a space."""
    return F.replace(text, F.lit("<|"), F.lit("<| "))


def _head(name: Column, mine: Column) -> Column:
    return F.when(mine, F.lit("assistant")).when(name.isin(*SCENE), name).otherwise(F.concat(F.lit("user name="), name))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker_role, segment, start, mask_start, mask_end (code points; equal where nothing is learned).

    Names are roles: a null or blank role speaks as `unknown`, line ends in a role become spaces. A null text is empty, and rows
    without a conv_id are left out; a null turn is turn 0. Neither text nor role can open or close a turn, as marks within
    them are parted by a space. Turns that share a number follow each other by role, then text; equal rows stay apart and keep
    their count. Other columns, whatever their names, are not read.
    """
    role = F.regexp_replace(unmarked(F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))), "[\r\n]", " ")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    said = turns.where("conv_id is not null").select("conv_id", turn.alias("turn"), role.alias("name"), unmarked(F.coalesce("text", F.lit(""))).alias("text")).withColumn("part", F.floor(F.col("turn") / BLOCK))
    crowded = small(said.groupBy("conv_id", "part").count().where(F.col("count") > CROWDED).select("conv_id", "part", F.lit(True).alias("crowded")), BROADCAST_ROWS)
    divided = lambda value, none: F.when(F.col("crowded"), value).otherwise(none)
    rows = said.join(crowded, ["conv_id", "part"], "left").withColumns(
        {"at_turn": divided(F.col("turn"), F.lit(0).cast("long")), "at_name": divided(F.col("name"), F.lit("")), "at_text": divided(F.left("text", F.lit(FIRST)), F.lit(""))}
    )
    order = ["part", "at_turn", "at_name", "at_text"]
    block = ["conv_id", *order]
    marks = len(START) + 1 + len(END)
    counts = rows.groupBy(*block, "name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sized = counts.withColumn("as_other", F.col("n") * (marks + F.length(_head(F.col("name"), F.lit(False)))) + F.col("chars"))
    more = F.col("n") * (len("assistant") - F.length(_head(F.col("name"), F.lit(False))))
    own = sized.where(~F.col("name").isin(*SCENE)).select(*block, F.col("name").alias("perspective"), more.alias("more"))
    totals = sized.groupBy(*block).agg(F.sum("as_other").alias("total")).join(own.select("conv_id", "perspective").distinct(), "conv_id").join(own, [*block, "perspective"], "left")
    earlier = Window.partitionBy("conv_id", "perspective").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("total") + F.coalesce("more", F.lit(0))).over(earlier), F.lit(0))
    places = totals.select(*block, "perspective", before.alias("before"))
    met = rows.select(*block, "turn", "name", "text").join(places.hint("merge"), block)
    mine = F.col("name") == F.col("perspective")
    spoken = met.withColumns({"mine": mine, "segment": F.concat(F.lit(START), _head(F.col("name"), mine), F.lit("\n"), F.col("text"), F.lit(END))})
    inner = Window.partitionBy(*block, "perspective").orderBy("turn", "name", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = spoken.withColumn("start", (F.col("before") + F.coalesce(F.sum(F.length("segment")).over(inner), F.lit(0))).cast("long"))
    body, end = F.col("start") + len(START) + len("assistant") + 1, F.col("start") + F.length("segment") - 1
    return placed.select(
        "conv_id", "perspective", "turn", F.when(F.col("mine"), "assistant").when(F.col("name").isin(*SCENE), F.col("name")).otherwise("user").alias("speaker_role"), "segment", "start",
        F.when(F.col("mine"), body).otherwise(F.col("start")).cast("long").alias("mask_start"), F.when(F.col("mine"), end).otherwise(F.col("start")).cast("long").alias("mask_end"),
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole texts, for conversations that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    whole = perspectives(turns).groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    masks = F.filter("parts", lambda p: p["mask_end"] > p["mask_start"])
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), F.array_join(F.transform(masks, lambda p: F.concat_ws(":", p["mask_start"].cast("string"), p["mask_end"].cast("string"))), ",").alias("masks"))


#: The same for DuckDB.
SQL = """
WITH said AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, regexp_replace(replace(coalesce(nullif(trim(role), ''), 'unknown'), '<|', '<| '), '[\\r\\n]', ' ', 'g') AS name, replace(coalesce(text, ''), '<|', '<| ') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, name AS perspective FROM said WHERE name <> 'system'),
rows AS (
  SELECT conv_id, perspective, turn, name, text, name = perspective AS mine,
    '<|im_start|>' || CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN name ELSE 'user name=' || name END || chr(10) || text || '<|im_end|>' || chr(10) AS segment
  FROM said JOIN people USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, name, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows)
SELECT conv_id, perspective, CAST(turn AS BIGINT) AS turn, CASE WHEN mine THEN 'assistant' WHEN name = 'system' THEN name ELSE 'user' END AS speaker_role, segment,
  CAST(start AS BIGINT) AS start, CAST(CASE WHEN mine THEN start + 22 ELSE start END AS BIGINT) AS mask_start, CAST(CASE WHEN mine THEN start + length(segment) - 1 ELSE start END AS BIGINT) AS mask_end
FROM placed
"""
