"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Leaves are range-sorted by group and key. Of each partition only the counts of its first and last group meet on the driver:
all others lie within it. So every partition knows the place of its first leaf in its group, and builds the aligned subtrees
that it holds whole. What is left of a partition are its boundary nodes, two a level at most; these are shuffled by their
coordinates (group, level, index), LEVELS levels a round, each round in blocks of bounded size, up to the root. The way back
down hands every boundary node the siblings above it, and a partition adds them to the siblings that it knows itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, named, small, written

#: Leaves of a partition, about, and levels that a round finishes.
LEAVES, LEVELS = 50_000, 8
#: Groups up to which their proofs are broadcast.
BROADCAST_GROUPS = 10_000
#: A step of a proof is a mark and the sibling's digest; a node without sibling is hashed alone.
LEFT, RIGHT, ALONE = "<", ">", "-"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value `-` for null, else its length in UTF-8 bytes, a colon and itself."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said)).cast("binary"), 256)


class Node(NamedTuple):
    """A node whose parent isn't made where the node is. total: nodes of its level; home: the partition that made it, -1 for a round."""

    group: str | None
    total: int
    level: int
    index: int
    digest: str
    home: int


class Share(NamedTuple):
    """What a partition must know: the place of its first leaf in its group, and the sizes of its first and last group."""

    offset: int
    first: int
    last: int


def shares(ends: list[tuple[int, list[tuple[str | None, int]]]]) -> dict[int, Share]:
    """From (partition, [(group, rows)]) of the first and the last group of each partition that has rows, in order."""
    runs: list[list] = []  # of a group: its name, rows so far, and (partition, whether first) of its parts
    out: dict[int, dict[str, int]] = {}
    for p, groups in ends:
        out[p] = {}
        for at, (group, n) in enumerate(groups):
            if at == 0:
                if not runs or runs[-1][0] != group:
                    runs.append([group, 0, []])
                out[p]["offset"] = runs[-1][1]
            else:
                runs.append([group, 0, []])
            runs[-1][1] += n
            runs[-1][2].append((p, at == 0, at == len(groups) - 1))
    for _, total, parts in runs:
        for p, first, last in parts:
            out[p] |= {"first": total} if first else {}
            out[p] |= {"last": total} if last else {}
    return {p: Share(**x) for p, x in out.items()}


def climb(digests: list[str], start: int, total: int) -> tuple[list[tuple[int, list[str]]], dict[tuple[int, int], str]]:
    """The levels (first index, digests) over neighbours from place `start` of `total`, and the nodes that need others to go on.

    A node's sibling is elsewhere if the node is a right one at the start or a left one at the end; a root has none.
    """
    levels, tops, level = [], {}, 0
    while digests:
        levels.append((start, digests))
        end = start + len(digests)
        if total == 1:
            tops[level, 0] = digests[0]
            break
        low, high = start + start % 2, end if end % 2 == 0 or end == total else end - 1
        if low > start:
            tops[level, start] = digests[0]
        if high < end:
            tops[level, end - 1] = digests[-1]
        digests = [hashed(*digests[i - start : min(i + 2, high) - start]) for i in range(low, high, 2)]
        start, total, level = low // 2, (total + 1) // 2, level + 1
    return levels, tops


def parts_of(p: int, rows: Iterator[tuple], share: Share | None) -> Iterator[tuple[str | None, list[tuple], int, int]]:
    """(group, rows, place of the first one, rows of the whole group) for each group of a partition. rows: group, digest, others."""
    part = [(group, list(members)) for group, members in groupby(rows, key=lambda r: r[0])]
    for i, (group, members) in enumerate(part):
        total = share.first if i == 0 else share.last if i == len(part) - 1 else len(members)
        yield group, members, share.offset if i == 0 else 0, total


def at_level(total: int, level: int) -> int:
    return -(-total >> level) if level else total


def block_of(node: Node, rounds: int, levels: int) -> tuple:
    return node.group, rounds, node.index >> ((rounds + 1) * levels - node.level)


def finished(nodes: list[Node], rounds: int, levels: int) -> tuple[dict[tuple[int, int], str], int, int]:
    """All nodes of a block by (level, index), from those that reached it; the block's upper level, and the group's size."""
    total = nodes[0].total
    known = {(n.level, n.index): n.digest for n in nodes}
    upper = (rounds + 1) * levels
    for level in range(rounds * levels, upper):
        if (of := at_level(total, level)) == 1:
            return known, level, total
        for i in sorted({index // 2 for at, index in known if at == level}):
            pair = [known[level, j] for j in (2 * i, 2 * i + 1) if j < of]
            known[level + 1, i] = hashed(*pair)
    return known, upper, total


def steps(known: dict[tuple[int, int], str], level: int, index: int, upper: int, total: int) -> list[str]:
    """The siblings of a node from its level up to below another."""
    out = []
    for at in range(level, upper):
        of, other = at_level(total, at), index ^ 1
        out.append(ALONE if other >= of else (LEFT if index % 2 else RIGHT) + known[at, other])
        index >>= 1
    return out


def forest(rows: DataFrame, group: str, digest: str, order: list[str], kept: list[str]) -> tuple[RDD, RDD]:
    """Trees by group, leaves in order: an RDD of (kept columns, root, proof) for each row, and one of (group, root).

    rows must be cheap to read more than once (a written table). Rows that agree in all of `order` have any order among them.
    """
    spark, high = rows.sparkSession, LEVELS
    partitions = max(1, -(-rows.count() // LEAVES))
    plain = rows.repartitionByRange(partitions, named(group).asc_nulls_first(), *map(F.asc_nulls_first, order))
    ordered = plain.sortWithinPartitions(named(group).asc_nulls_first(), *map(F.asc_nulls_first, order)).select(named(group), named(digest), *map(named, kept)).rdd.map(tuple)
    partitions = ordered.getNumPartitions()

    def ends(p: int, it: Iterator[tuple]) -> Iterator[tuple]:
        first = last = None
        for g, members in groupby(it, key=lambda r: r[0]):
            last = (g, sum(1 for _ in members))
            first = first or last
        if first:
            yield p, [first] + [last] * (last is not first)

    # two counts for each partition
    plan = shares(sorted(ordered.mapPartitionsWithIndex(ends).collect()))
    most = max((max(s.first, s.last) for s in plan.values()), default=0)
    sent = spark.sparkContext.broadcast(plan)

    def boundary(p: int, it: Iterator[tuple]) -> Iterator[Node]:
        for g, members, start, total in parts_of(p, it, sent.value.get(p)):
            for (level, index), d in climb([r[1] for r in members], start, total)[1].items():
                yield Node(g, total, level, index, d, p)

    nodes = ordered.mapPartitionsWithIndex(boundary)
    whole = lambda n: at_level(n.total, n.level) == 1
    roots = nodes.filter(whole).map(lambda n: (n.group, n.digest))
    rest = nodes.filter(lambda n: not whole(n))
    width = max(1, min(partitions, 200))
    blocks: list[RDD] = []
    for r in range(-(-max(most - 1, 0).bit_length() // high)):
        below = rest.filter(lambda n, r=r: n.level < (r + 1) * high).map(lambda n, r=r: (block_of(n, r, high), n))
        blocks.append(below.groupByKey(width).mapValues(list))

        def top(item: tuple, r: int = r) -> Node:
            known, upper, total = finished(item[1], r, high)
            return Node(item[0][0], total, upper, item[0][2] if upper == (r + 1) * high else 0, known[max(known)], -1)

        made = blocks[-1].map(top)
        roots = roots.union(made.filter(whole).map(lambda n: (n.group, n.digest)))
        rest = rest.filter(lambda n, r=r: n.level >= (r + 1) * high).union(made.filter(lambda n: not whole(n)))

    ways = spark.sparkContext.emptyRDD()
    above = spark.sparkContext.emptyRDD()
    for r in reversed(range(len(blocks))):

        def down(item: tuple, r: int = r) -> Iterator[tuple]:
            (g, _, _), (members, way) = item
            known, upper, total = finished(members, r, high)
            root, upward = way or (known[upper, 0], [])
            for n in members:
                found = root, steps(known, n.level, n.index, upper, total) + upward
                yield (n.home, (g, n.level, n.index, *found)) if n.home >= 0 else ((g, r - 1, n.index), found)

        # the rows of a round below are named by their block, those of partitions by a number
        handed = blocks[r].leftOuterJoin(above, width).flatMap(down)
        ways = ways.union(handed.filter(lambda x: isinstance(x[0], int)))
        above = handed.filter(lambda x: isinstance(x[0], tuple))

    def proofs(pair: tuple[list, list], p: int) -> Iterator[tuple]:
        members_of, handed = pair
        up = {(g, level, index): (root, way) for _, (g, level, index, root, way) in handed}
        for g, members, start, total in parts_of(p, iter(members_of), sent.value.get(p)):
            levels, tops = climb([r[1] for r in members], start, total)
            for i, row in enumerate(members):
                index, way, of = start + i, [], total
                for level, (low, digests) in enumerate(levels):
                    if (level, index) in tops:
                        root, upward = up.get((g, level, index), (tops[level, index], ()))
                        way += upward
                        break
                    other = index ^ 1
                    way.append(ALONE if other >= of else (LEFT if index % 2 else RIGHT) + digests[other - low])
                    index, of = index >> 1, (of + 1) // 2
                yield (*row[2:], root, way)

    # a partition meets what was handed to it; both sides have a list for each partition, and as many partitions
    at_home = ways.partitionBy(partitions, int)
    more = at_home.getNumPartitions() - partitions
    leaves = ordered.union(spark.sparkContext.parallelize([], more)) if more else ordered
    met = leaves.glom().zip(at_home.glom()).mapPartitionsWithIndex(lambda p, it: (x for pair in it for x in proofs(pair, p)))
    return met, roots


def siblings(proof: Column) -> Column:
    """The digests of a proof, in order."""
    return F.transform(F.filter(proof, lambda s: s != ALONE), lambda s: F.substring(s, 2, 64))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    both = lambda acc, s: F.when(F.startswith(s, F.lit(LEFT)), F.concat(F.substring(s, 2, 64), acc)).when(s == ALONE, acc).otherwise(F.concat(acc, F.substring(s, 2, 64)))
    return F.aggregate(proof, start, lambda acc, s: F.sha2(both(acc, s).cast("binary"), 256))


def manifest(rows: DataFrame, group: str = "lang", order: tuple[str, ...] = ("doc_id",), digest: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, *order, digest, *keep, subroot, root, proof) for each of rows, which hold a digest each.

    In a tree every two neighbours become their digest; a last one without neighbour is hashed alone; one node is a root. The
    roots of the groups (null first, then by UTF-8 bytes) are the leaves of the last tree. A proof names the siblings from leaf
    to root, each behind `<` (it stands left) or `>`; `-` is a node that is hashed alone. Rows that agree in `order` are sorted
    by digest; equal rows all have proofs, in any order. A null group is a group. Without rows there is no root and no row.
    """
    spark = rows.sparkSession
    names = [group, *order, digest, *keep]
    plain = rows.select(*(named(n).alias(f"c{i}") for i, n in enumerate(names)), F.monotonically_increasing_id().alias("n"))
    stored = written(plain, "leaves")
    keys = [f"c{1 + i}" for i in range(len(order))]
    of_digest = f"c{1 + len(order)}"
    cols = [f"c{i}" for i in range(len(names))]
    made, roots = forest(stored, "c0", of_digest, [*keys, of_digest, "n"], cols)
    proof = [T.StructField("root", T.StringType()), T.StructField("proof", T.ArrayType(T.StringType()))]
    leaves = spark.createDataFrame(made, T.StructType([*(stored.schema[c] for c in cols), *proof]), verifySchema=False)
    kind = stored.schema["c0"].dataType
    groups = written(spark.createDataFrame(roots, T.StructType([T.StructField("g", kind), T.StructField("subroot", T.StringType())]), verifySchema=False), "roots")
    upper, _ = forest(groups.withColumn("all", F.lit(0)), "all", "subroot", ["g"], ["g", "subroot"])
    top = spark.createDataFrame(upper, T.StructType([T.StructField("g", kind), T.StructField("subroot", T.StringType()), T.StructField("top", T.StringType()), T.StructField("upward", T.ArrayType(T.StringType()))]), verifySchema=False)
    met = leaves.join(small(written(top, "tops"), BROADCAST_GROUPS), F.col("c0").eqNullSafe(F.col("g")))
    return met.select(*cols, "subroot", F.col("top").alias("root"), F.concat("proof", "upward").alias("proof")).toDF(*names, "subroot", "root", "proof")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each document, trees by lang.

    A leaf covers doc_id, source, lang, n_chars and the whole text; nulls in any of them count as `-`. Where 7 divides the crc32 of
    doc_id, the leaf that is folded has n_chars + 1. A null doc_id comes first in its language and is not tampered with; equal
    documents each have a leaf; other columns don't matter; without documents there are no rows.
    """
    changed = [(F.col(c).cast("decimal(38,0)") + 1).cast("string") if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(fold("doc_id", 7) == 0, leaf(*changed)).alias("tampered"))
    back = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    done = manifest(leaves, keep=("tampered",)).withColumn("folded_root", back)
    return done.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings(F.col("proof"))).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The crc32 of a number's digits is taken bit by bit, from its definition.
SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
           CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
           CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END) AS head,
    n_chars, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS tail,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT *, sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END, tail)) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen((n_chars + 1)::VARCHAR), ':', n_chars + 1) END, tail)) END AS tampered
  FROM rows_),
placed AS (
  SELECT doc_id, coalesce('l' || lang, '') AS grp, leaf, tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
tree(lvl, grp, idx, n, digest) AS (
  SELECT 0, grp, i, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, grp, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lvl, grp, idx // 2, n),
subs AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
tops(lvl, idx, n, digest) AS (
  SELECT 0, i, n, subroot FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n),
low(doc_id, grp, lvl, idx, n, acc, proof) AS (
  SELECT doc_id, grp, 0, i, n, coalesce(tampered, leaf), '' FROM placed
  UNION ALL
  SELECT l.doc_id, l.grp, l.lvl + 1, l.idx // 2, (l.n + 1) // 2,
    sha256(CASE WHEN l.idx % 2 = 1 THEN concat(t.digest, l.acc) ELSE concat(l.acc, t.digest) END), concat(l.proof, t.digest)
  FROM low l LEFT JOIN tree t ON t.grp = l.grp AND t.lvl = l.lvl AND t.idx = xor(l.idx, 1) WHERE l.n > 1),
high(doc_id, lvl, idx, n, acc, proof) AS (
  SELECT l.doc_id, 0, s.i, s.n, l.acc, l.proof FROM low l JOIN subs s USING (grp) WHERE l.n = 1
  UNION ALL
  SELECT h.doc_id, h.lvl + 1, h.idx // 2, (h.n + 1) // 2,
    sha256(CASE WHEN h.idx % 2 = 1 THEN concat(t.digest, h.acc) ELSE concat(h.acc, t.digest) END), concat(h.proof, t.digest)
  FROM high h LEFT JOIN tops t ON t.lvl = h.lvl AND t.idx = xor(h.idx, 1) WHERE h.n > 1)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.acc AS folded_root, h.acc = r.digest AS verified
FROM placed p JOIN subs s USING (grp) JOIN (SELECT * FROM high WHERE n = 1) h USING (doc_id) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) r
"""
