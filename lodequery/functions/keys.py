"""Fingerprints, ids and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import BLANK, stripped

HASH_DIMS = 512


def fingerprint(content: Column) -> Column:
    """md5 of the first 500 characters with white space collapsed."""
    return F.md5(F.substring(stripped(F.regexp_replace(content, f"{BLANK}+", " ")), 1, 500).cast("binary"))


def content_key(content: Column, prefix: int = 80) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.substring(F.coalesce(content, F.lit("")), 1, prefix).cast("binary"), 256), 1, 16))


def chunk_id(doc: Column, index: Column, content: Column) -> Column:
    doc, index = doc.cast("string"), index.cast("string")
    return F.concat_ws(":", doc, index, F.substring(F.sha2(F.concat_ws("|", doc, index, content).cast("binary"), 256), 1, 12))


def row_digest(*columns: str, n: int = 12) -> Column:
    """Of the columns as JSON in the order of their names; comparable within this engine."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256), 1, n)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """At unit length; a zero vector stays as it is. The sum of squares is made once, then shared by all numbers."""
    scaled = lambda total: F.transform(v, lambda x: F.when(total > 0, x.cast("double") / F.sqrt(total)).otherwise(x.cast("double")))
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"), scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def hash_embedding(text: Column) -> Column:
    """The 16 bytes of the text's md5, repeated to HASH_DIMS and normalised: a stand-in where no model is given."""
    hex_ = F.md5(text.cast("binary"))
    sixteen = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(hex_, 2 * i + 1, F.lit(2)), 16, 10).cast("double"))
    return normalised(F.flatten(F.array_repeat(sixteen, HASH_DIMS // 16)))


def path_id(nodes: Column) -> Column:
    """`n0->n1->n2@d2` for an array of node ids."""
    return F.concat(F.array_join(nodes, "->"), F.lit("@d"), (F.size(nodes) - 1).cast("string"))


def path_hit_id(nodes: Column) -> Column:
    return F.concat(F.lit("kg:"), F.element_at(nodes, 1), F.lit("->...->"), F.element_at(nodes, -1), F.lit("@d"), (F.size(nodes) - 1).cast("string"))


def rendered_path(nodes: Column, rels: Column) -> Column:
    """`A —[REL]→ B …` for arrays of names and relation types."""
    tails = F.zip_with(rels, F.slice(nodes, 2, F.size(nodes)), lambda r, n: F.concat(F.lit(" —["), r, F.lit("]→ "), n))
    return F.concat(F.element_at(nodes, 1), F.array_join(tails, ""))


def rendered_triple(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(head, F.lit(" -["), relation, F.lit("]-> "), tail)
