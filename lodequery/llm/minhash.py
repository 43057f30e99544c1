"""Near-duplicate documents by b-bit MinHash: bands of minima propose, packed low bits estimate, full sets confirm.

1. Every text becomes its set of shingle hashes and HASHES minima over it. The set's digest, the low BITS bits of the
   minima packed into words, and a hash for each band of ROWS minima are written; sets and texts are not.
2. Texts with equal sets are one class. Band buckets with two classes or more propose pairs. The sets of their classes are
   made and written once; all that follows reads these.
3. In each of the first rounds a class is paired with one leader of its buckets (from the second round on, buckets choose
   theirs at random): the one that the packed signatures hold most similar. Pairs whose estimate, corrected for chance
   agreement of the low bits, is too low for the threshold are dropped; the others are confirmed on full sets. A round's
   links join the components of the rounds before.
4. Buckets whose classes are all connected by now need no more pairs, which settles large groups of near copies with a
   number of pairs in proportion to their size. What remains is compared pair by pair: buckets are cut into blocks of about
   BLOCK classes and pairs of blocks are dealt out, so that no task holds a bucket. Pairs that aren't connected and pass
   the estimate, and then a closer one by WIDE minima of these few documents, are confirmed where their blocks meet, each
   in the first bucket that both share. Only links that connect what wasn't connected leave a meeting, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, forget, free_name, same_columns, slices, small, written
from .components import connected

WORDS, THRESHOLD = 5, 75
ROWS, BANDS, BITS = 5, 40, 4
HASHES = ROWS * BANDS
PACKED = -(-HASHES * BITS // 64)
#: Leaves out pairs of at least the threshold with a probability of about 1e-5 (4 standard deviations).
MIN_ESTIMATE = 0.62
LEADER_ROUNDS = 3
#: Classes of a bucket in a block, about.
BLOCK = 256
#: Pairs of one document that meet its set in one place.
SPLIT = 500
#: Minima of the closer estimate, and its bound (4 standard deviations again).
WIDE, MIN_WIDE = 1024, 0.693
#: Rows up to which lists of documents (id and digest, 24 bytes) are broadcast.
BROADCAST_IDS = 500_000
#: Word hashes that a task remembers.
REMEMBERED = 100_000
#: The low bit of each group of BITS bits.
_LOWEST = np.uint64(sum(1 << i for i in range(0, 64, BITS)))


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


_BANDED, _WIDE = _functions(HASHES, 20240229), _functions(WIDE, 20240301)
_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, memo: dict) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; with fewer than WORDS words, one for the whole; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone is lower-cased, and only space and \\t to \\r part
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = h[:n].copy()
    for k in range(1, WORDS):
        out *= _STEP
        out += h[k : k + n]
    return np.unique(_mix(out))


def minima(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _BANDED) -> np.ndarray:
    a, b = functions
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        block = np.multiply.outer(a, hashes[i : i + 512])
        block += b[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 64 // BITS in a word."""
    words = -(-len(least) * BITS // 64)
    low = np.zeros(words * (64 // BITS), np.uint64)
    low[: len(least)] = least & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(words, -1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    out = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        out = _mix(out * _STEP + rows[:, k])
    return out


SIGNED = "n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>"


def signed(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs' columns but the text, with size and digest of the set, packed signature and bands."""
    names = [c for c in docs.columns if c != text]
    kept = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`"))

    def run(batches):
        memo = _Memo()
        for batch in slices(batches, text):
            sizes, digests, sigs, keys, ends = [], [], [], [], [0]
            for t in batch.column(len(names)).to_pylist():
                s = shingles(t, memo)
                least = minima(s)
                sizes.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                sigs.append(pack(least))
                if len(s):
                    keys.append(bands(least))
                ends.append(ends[-1] + (BANDS if len(s) else 0))
            d = np.array(digests)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * PACKED, PACKED, dtype=np.int32)), pa.array(np.concatenate(sigs).view(np.int64)))]
            lists.append(pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *lists], names=[*names, "n_shingles", "d1", "d2", "sig", "bands"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), SIGNED])
    return kept.mapInArrow(run, ddl)


def sets_of(docs: DataFrame) -> DataFrame:
    """(rep, hashes) from (rep, d1, d2, text), for texts whose set has that digest."""

    def run(batches):
        memo = _Memo()
        for batch in slices(batches, "text", 4 << 20):
            found = [shingles(t, memo).view(np.int64) for t in batch.column(3).to_pylist()]
            same = [np.array_equal(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64), d) for x, d in zip(found, zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True), strict=True)]
            found = [x for x, ok in zip(found, same, strict=True) if ok]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], names=["rep", "hashes"])

    return docs.mapInArrow(run, "rep long, hashes array<long>")


def wide_of(sets: DataFrame) -> DataFrame:
    """(rep, wide): the packed wide signature of each set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [pack(minima(h.values.to_numpy().view(np.uint64), _WIDE)).tobytes() for h in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["rep", "wide"])

    return sets.select("rep", "hashes").mapInArrow(run, "rep long, wide binary")


def _differ(x: Column, y: Column) -> Column:
    """In how many of its groups of BITS bits a packed word differs: XOR, each group folded onto its lowest bit, bits counted."""
    lowest = sum(1 << i for i in range(0, 64, BITS))
    lowest -= (1 << 64) if lowest >> 63 else 0
    odd = x.bitwiseXOR(y)
    folded = reduce(Column.bitwiseOR, (F.shiftrightunsigned(odd, k) for k in range(1, BITS)), odd)
    return F.bit_count(folded.bitwiseAND(F.lit(lowest)))


def _corrected(mismatches, n: int):
    """Similarity from the agreement of low bits, less the agreement that chance alone gives."""
    chance = 2.0**-BITS
    return ((n - mismatches) / n - chance) / (1 - chance)


def estimate(a: str, b: str) -> Column:
    return _corrected(reduce(Column.__add__, (_differ(F.col(f"{a}.s{i}"), F.col(f"{b}.s{i}")) for i in range(PACKED))), HASHES)


def similarity(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """As estimate(), for arrays of packed signatures of n minima (the last axis)."""
    odd = x ^ y
    for k in range(1, BITS):
        odd |= (x ^ y) >> np.uint64(k)
    return _corrected(np.bitwise_count(odd & _LOWEST).sum(axis=-1, dtype=np.int64), n)


def may_link(a: str, b: str) -> Column:
    """By sizes, then by the estimate."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= THRESHOLD * F.greatest(na, nb)) & (estimate(a, b) >= MIN_ESTIMATE)


def _with_set(pairs: DataFrame, sets: DataFrame, at: str) -> DataFrame:
    """pairs with the set of the document in column `at`. One with many pairs meets them in parts, each with a copy of its set."""
    many = pairs.groupBy(F.col(at).alias("many")).agg(F.ceil(F.count("*") / SPLIT).alias("parts")).where("parts > 1")
    many = small(many, BROADCAST_IDS)
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, F.col(at) == F.col("many"), "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts)).drop("many", "parts")
    copies = sets.join(many, F.col("rep") == F.col("many"), "left").select("rep", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("copy"), F.col("hashes").alias(f"{at}_set"))
    return dealt.join(copies, (F.col(at) == F.col("rep")) & (F.col("part") == F.col("copy"))).drop("part", "rep", "copy")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold on full sets, written."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    needed = sets.join(small(ids, BROADCAST_IDS), F.col("rep") == F.col("id"), "left_semi")
    both = F.size(F.array_intersect("a_set", "b_set"))
    held = _with_set(_with_set(pairs, needed, "a"), needed, "b").where(100 * both >= THRESHOLD * (F.size("a_set") + F.size("b_set") - both))
    done = written(held.select("a", "b").distinct(), "confirmed")
    drop_written(ids)
    return done


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after further links between the components so far; documents that occur in neither have no row."""
    if component is None:
        component = written(connected(links), "components")
        forget(links.sparkSession)
        return component
    of = lambda end: component.select(F.col("id").alias(f"{end}_id"), F.col("component").alias(f"{end}_c"))
    ends = links.join(of("a"), F.col("a") == F.col("a_id"), "left").join(of("b"), F.col("b") == F.col("b_id"), "left")
    step = written(connected(ends.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))), "steps")
    moved = component.join(step.select(F.col("id").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
    done = written(moved.union(step.join(component, "id", "left_anti")), "components")
    drop_written(step)
    drop_written(component)
    forget(links.sparkSession)
    return done


def _leader_pairs(proposed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): for each class (rep), of the leaders it was proposed with (lead) that it may link, the one with the highest estimate."""
    sigs = lambda x: classes.select(F.col("rep").alias(f"{x}r"), F.col("s").alias(f"{x}s"))
    scored = proposed.join(sigs("x"), F.col("a") == F.col("xr")).join(sigs("y"), F.col("b") == F.col("yr")).where(may_link("xs", "ys")).select("rep", "a", "b", estimate("xs", "ys").alias("e"))
    best = F.max_by(F.struct("a", "b"), F.struct("e", -F.col("a"), -F.col("b")))
    return scored.groupBy("rep").agg(best.alias("p")).select("p.a", "p.b").distinct()


def _open_links(open_: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes that share a bucket, in each meeting of two blocks only as many as connect its components c.

    Rows of a meeting ask for their sets if a pair of theirs passes both estimates there; the sets are sent to these alone.
    """
    reps = small(written(open_.select("rep").distinct(), "open-reps"), BROADCAST_IDS)
    wide = written(wide_of(sets.join(reps, "rep", "left_semi")), "wide")
    own = classes.join(reps, "rep", "left_semi").select("rep", "s", "bands").join(wide, "rep")
    sizes = open_.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = open_.join(sizes, "band").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # a block meets itself and every other one: as the first with later ones, as the second with earlier ones
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q"), (j < F.col("i")).alias("second")))
    rows = placed.select("band", "rep", "c", F.explode(meets).alias("m")).select("band", "m.*", "rep", "c").join(own, "rep")
    key = ["band", "p", "q"]
    cols = rows.select(*key, "second", "rep", "c", F.col("s.n").alias("n"), F.array(*(F.col("s")[f"s{i}"] for i in range(PACKED))).alias("sig"), "wide", "bands")
    asking = written(cols.repartition(*key).sortWithinPartitions(*key).mapInArrow(_asking, cols.schema), "asking")
    needed = sets.join(small(asking.select("rep").distinct(), BROADCAST_IDS), "rep", "left_semi").select("rep", "hashes")
    links = written(asking.join(needed, "rep").select(*cols.columns, "hashes").repartition(*key).sortWithinPartitions(*key).mapInArrow(_linking, "a long, b long"), "links")
    for df in (wide, asking):
        drop_written(df)
    return links


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each run of rows with equal band, p and q: rows of one block (p = q), or of two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [batch.column(k).to_numpy() for k in range(3)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(i, j - i)
            if held and j > i and any(held[-1].column(k)[-1].as_py() != part.column(k)[0].as_py() for k in range(3)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if j > i:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each meeting that have a near pair there."""
    for rows in _meetings(batches):
        asks = np.zeros(rows.num_rows, bool)
        for at, to in _near(rows):
            asks[at] = asks[to] = True
        if asks.any():
            yield from rows.filter(pa.array(asks)).combine_chunks().to_batches()


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for near pairs of each meeting that reach the threshold on full sets and whose components no link before connects."""
    for rows in _meetings(batches):
        lists = rows.column("hashes").chunk(0)
        ends, hashes = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        rep, c = (rows.column(k).to_numpy() for k in ("rep", "c"))
        _, root = np.unique(c, return_inverse=True)
        found: list[tuple[int, int]] = []
        for at, to in _near(rows):
            for i in np.unique(at).tolist():
                mine = hashes[ends[i] : ends[i + 1]]
                for j in to[at == i].tolist():
                    if root[i] == root[j]:
                        continue
                    theirs = hashes[ends[j] : ends[j + 1]]
                    both = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum())
                    if 100 * both >= THRESHOLD * (len(mine) + len(theirs) - both):
                        root[root == root[j]] = root[i]
                        found.append((i, j))
        if found:
            ends_of = rep[np.array(found)]
            yield pa.RecordBatch.from_arrays([pa.array(ends_of.min(axis=1)), pa.array(ends_of.max(axis=1))], names=["a", "b"])


def _near(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a meeting's rows (by number) that aren't in one component and may be similar by both estimates.

    Of the buckets that two classes share only the first one gives their pair.
    """
    own = rows.column("p")[0].as_py() == rows.column("q")[0].as_py()
    band = rows.column("band")[0].as_py()
    second = rows.column("second").to_numpy()
    rep, c, n = (rows.column(k).to_numpy() for k in ("rep", "c", "n"))
    sig, keys = (rows.column(k).chunk(0).flatten().to_numpy().reshape(len(rep), -1) for k in ("sig", "bands"))
    sig = sig.view(np.uint64)
    wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(len(rep), -1)
    first, other = (np.arange(len(rep)),) * 2 if own else (np.flatnonzero(~second), np.flatnonzero(second))
    for k in range(0, len(first), 64):
        x = first[k : k + 64]
        go = (rep[x][:, None] < rep[other][None, :]) if own else np.ones((len(x), len(other)), bool)
        go &= c[x][:, None] != c[other][None, :]
        least, most = np.minimum(n[x][:, None], n[other][None, :]), np.maximum(n[x][:, None], n[other][None, :])
        go &= 100 * least >= THRESHOLD * most
        at, to = np.nonzero(go)
        at, to = x[at], other[to]
        near = similarity(sig[at], sig[to], HASHES) >= MIN_ESTIMATE
        at, to = at[near], to[near]
        near = keys[at, (keys[at] == keys[to]).argmax(axis=1)] == band
        at, to = at[near], to[near]
        near = similarity(wide[at], wide[to], WIDE) >= MIN_WIDE
        if near.any():
            yield at[near], to[near]


def class_components(marks: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(d1, d2, component) for every set with a shingle: the smallest key reachable by links.

    marks: the table from signed(), written, with a long column `key` without nulls; docs: where to find the texts of keys.
    """
    firsts = marks.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(firsts.select("d1", "d2", "rep", F.struct("n", *(F.col("sig")[i].alias(f"s{i}") for i in range(PACKED))).alias("s"), "bands"), "classes")
    rows = classes.select("rep", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).where("c > 1").select("band", "lead")
    members = written(rows.join(shared, "band"), "members")
    wanted = written(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "d1", "d2"), "candidates")
    texts = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).join(small(wanted, BROADCAST_IDS), F.col("of") == F.col("rep"))
    sets = written(sets_of(texts.select("rep", "d1", "d2", "text")), "sets")
    used, tested, component = [members, wanted, sets], None, None
    for step in range(LEADER_ROUNDS):
        if step:
            open_ = _open_members(members, component)
            lead = open_.groupBy("band").agg(F.min_by(F.struct("rep", "c"), F.struct(F.xxhash64("band", "rep", F.lit(step)), "rep")).alias("l"))
            proposed = open_.join(lead, "band").where("c != l.c").select("rep", F.col("l.rep").alias("lead"))
        else:
            proposed = members.select("rep", "lead")
        proposed = proposed.where("rep != lead").select(F.greatest("rep", "lead").alias("b"), F.least("rep", "lead").alias("a"), "rep").distinct()
        if tested is not None:
            proposed = proposed.join(tested, ["a", "b"], "left_anti")
        pairs = written(_leader_pairs(proposed, classes), "pairs")
        links = _confirmed(pairs, sets)
        used += [pairs, links]
        tested = pairs if tested is None else tested.union(pairs)
        component = _merged(component, links)
    open_ = written(_open_members(members, component), "open")
    links = _open_links(open_, classes, sets)
    component = _merged(component, links)
    for df in (*used, open_, links):
        drop_written(df)
    return classes.join(component, F.col("rep") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))


def _open_members(members: DataFrame, component: DataFrame) -> DataFrame:
    """The members, with their component c, of buckets that aren't in one component yet."""
    now = members.select("band", "rep").join(component, F.col("rep") == F.col("id"), "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("band")
    return now.join(mixed, "band")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_shingles, component_id, kept. Only these two columns are read, whatever the others are called.

    A document without words (a null or blank text) has n_shingles 0 and is its own component. Rows that repeat an id share its
    class if their texts agree. A row with a null id links like any other, but is no component's name and isn't kept; a component
    of such rows alone has a null id. Ids lie below 2 ** 62. A text of any length is one set, and ties don't matter: a component's
    id is its smallest. A table without rows gives none.
    """
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    most = own.agg(F.max("id")).first()[0]
    most = -1 if most is None else max(most, -1)
    nameless = written(own.where("id is null").select((F.lit(most + 1) + F.monotonically_increasing_id()).alias("id"), "text"), "nameless")
    own = own.where("id is not null").union(nameless)
    marks = written(signed(own, "id", "text"), "signed")
    found = class_components(marks, own, "id", "text").select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), F.col("component").alias("smallest"))
    named = lambda c: F.when(F.col(c) <= most, F.col(c))
    out = marks.join(found, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2")), "left").withColumn("smallest", F.coalesce("smallest", "id"))
    return out.select(named("id").alias(key), "n_shingles", named("smallest").alias("component_id"), F.coalesce(named("id") == F.col("smallest"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", prefer: str = "doc_id") -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id, of equal ids any. Documents without words stay.

    A null id comes after all others. Repeated rows are documents of their own, of which one stays if their text has words.
    """
    row = free_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.col(row).alias("id"), F.col(f"`{prefer}`").alias("prefer"), F.col(f"`{text}`").alias("text"))
    marks = written(signed(own, "id", "text"), "signed")
    found = class_components(marks, own, "id", "text")
    grouped = marks.where("n_shingles > 0").join(found, ["d1", "d2"]).groupBy("component").agg(F.min(F.struct(F.col("prefer").isNull().alias("no_id"), "prefer", "id")).alias("first"))
    stay = grouped.select(F.col("first.id").alias("stays")).union(marks.where("n_shingles = 0").select("id"))
    kept = numbered.alias("n").join(stay.alias("s"), F.col(f"n.{row}") == F.col("s.stays"), "left_semi")
    return same_columns(kept.select("n.*"), docs)
