"""Invariants of records as boolean columns, and access by key."""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PLAIN_NAME, TOOL_NAME = "^[a-z][a-z0-9_]*$", "^[a-z][a-z0-9_]{2,63}$"
REASONING, DESCRIPTION, REWRITES = (10, 2000), (10, 500), (0, 2)


def path_fits(depth: Column, nodes: Column, rels: Column) -> Column:
    """A path of depth n has n relations and n + 1 nodes."""
    return (F.size(rels) == depth) & (F.size(nodes) == depth + 1)


def plain_name(name: Column) -> Column:
    """Lower-case letters, digits and underscores, a letter first."""
    return F.coalesce(name.rlike(PLAIN_NAME), F.lit(False))


def tool_name(name: Column) -> Column:
    """A plain name of 3 to 64 characters."""
    return F.coalesce(name.rlike(TOOL_NAME), F.lit(False))


def unit_score(score: Column) -> Column:
    return F.coalesce(score.between(0.0, 1.0) & ~F.isnan(score), F.lit(False))


def rewrites_fit(n: Column) -> Column:
    return F.coalesce(n.between(*REWRITES), F.lit(False))


def reasoning_fits(text: Column) -> Column:
    return F.coalesce(F.length(text).between(*REASONING), F.lit(False))


def description_fits(text: Column) -> Column:
    return F.coalesce(F.length(text).between(*DESCRIPTION), F.lit(False))


def asserted(rows: DataFrame, fits: Column, what: str) -> DataFrame:
    """rows; an action on them fails at the first one that doesn't fit."""
    return rows.where(F.assert_true(fits, F.lit(what)).isNull())


def key_digests(listed: str | None) -> list[str]:
    """Digests of the keys in a comma-separated list, blanks around them and empty ones aside."""
    return [sha256(k.encode()).hexdigest() for k in re.findall(r"[^,\s](?:[^,]*[^,\s])?", listed or "")]


def access(key: Column, enabled: bool, listed: str | None) -> Column:
    """(status, key): 200 without checks or for a listed key; 503 if checks are on and no key is listed; else 401.

    Digests are compared, so that no listed key stands in a plan, where the UI and logs show it.
    """
    digests = key_digests(listed)
    if not enabled:
        return F.struct(F.lit(200).alias("status"), F.lit("auth_disabled").alias("key"))
    if not digests:
        return F.struct(F.lit(503).alias("status"), F.lit(None).cast("string").alias("key"))
    known = F.coalesce(F.sha2(key.cast("binary"), 256).isin(*digests), F.lit(False))
    return F.struct(F.when(known, 200).otherwise(401).alias("status"), F.when(known, key).alias("key"))
