"""Approximate vector search: an inverted file over cells with product-quantised residuals, exact re-ranking.

Vectors go at unit length to the cell of their nearest centroid; what is left of a vector there is cut into `parts` pieces, each
replaced by the number of its nearest codeword, one byte a piece. The index is a Parquet table sorted by cell. A query probes
its nearest cells: codes of these cells alone are read, met by cell in a join and ranked by the sum of table look-ups; the best
`refine` times k of them are read whole and ranked by their cosine.

A query that probes all cells gets what the exact search finds: the k-th score so far and the length of the longest residual of a
cell tell which cells can hold more, and these are compared whole.

Centroids and codewords are fitted on a bounded sample, at most SAMPLE vectors by a hash of the key; every vector is indexed. A
cell that many vectors share (copies, say) is met in slices of SLICE rows, so it is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written
from .search import top

#: Vectors that are fitted on, rounds of fitting, cells at most, and rows of a cell that meet a query at a time.
SAMPLE, ROUNDS, MOST_CELLS, SLICE = 50_000, 12, 4096, 50_000
#: Scores are sums in different orders.
SLACK = 1e-8
#: Pieces of a vector, share of the cells that is probed, and candidates for each hit. Vectors that lie in all directions alike
#: need many cells for a recall of 0.9 (README has figures); those that gather in clusters need few.
PARTS, PROBED, REFINE = 16, 0.6, 10


def units(vectors: pd.Series, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a direction (and dims numbers), and these at unit length."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) and (dims is None or len(v) == dims)]
    if not good:
        return np.zeros(0, int), np.zeros((0, dims or 0))
    x = np.array([[np.nan if e is None else e for e in vectors.iloc[i]] for i in good], float)
    most = np.abs(x).max(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / most[:, None]
        x = x / np.sqrt((x**2).sum(axis=1))[:, None]
    fine = np.isfinite(most) & (most > 0) & np.isfinite(x).all(axis=1)
    return np.array(good)[fine], x[fine]


def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.argmin((points**2).sum(axis=1)[None, :] - 2 * x @ points.T, axis=1)


def means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k points that x gathers around (Lloyd's rounds from evenly spread rows); fewer if x has fewer different rows."""
    different = np.unique(x, axis=0)
    points = different[np.linspace(0, len(different) - 1, min(k, len(different))).astype(int)]
    for _ in range(rounds if len(points) < len(different) else 0):
        at = nearest(x, points)
        size = np.bincount(at, minlength=len(points))
        total = np.zeros_like(points)
        np.add.at(total, at, x)
        points = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], points)
    return points


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # cell, dimension
    words: list[np.ndarray]  # of each piece: codeword, dimension
    cuts: list[int]  # where pieces begin, and the end

    @property
    def dims(self) -> int:
        return self.cuts[-1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        return np.stack([nearest(rest[:, a:b], w) for w, a, b in zip(self.words, self.cuts, self.cuts[1:], strict=False)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """What each codeword adds to the inner product with a query: piece, codeword."""
        out = np.zeros((len(self.words), 256))
        for i, (w, a, b) in enumerate(zip(self.words, self.cuts, self.cuts[1:], strict=False)):
            out[i, : len(w)] = w @ q[a:b]
        return out


def fit(vectors: DataFrame, key: str, cells: int | None = None, parts: int = PARTS, sample: int = SAMPLE) -> Quantiser:
    """vectors (key, embedding). cells: about the square root of their number if it isn't given."""
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(key, "embedding")
    n = rows.count()
    dims = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = dims["n"] if dims else 0
    # at most `sample` rows
    taken = rows.where(F.size("embedding") == dims).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("ann")), key).limit(sample)
    _, x = units(pd.Series([list(r["embedding"]) for r in taken.collect()], dtype=object), dims)
    cuts = [int(c) for c in np.linspace(0, dims, min(parts, max(dims, 1)) + 1)]
    if not len(x):
        return Quantiser(np.zeros((0, dims)), [np.zeros((0, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)
    centroids = means(x, min(MOST_CELLS, cells or max(1, round(n**0.5))))
    rest = x - centroids[nearest(x, centroids)]
    return Quantiser(centroids, [means(rest[:, a:b], 256) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)


def encoded(vectors: DataFrame, key: str, quantiser: Quantiser) -> DataFrame:
    """(chunk_id, cell, codes, far: distance from the centroid, embedding at unit length); vectors without a direction or of other dimensions have no row."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = sent.value
        for f in frames:
            at, x = units(f["embedding"], q.dims)
            if len(at) and len(q.centroids):
                cell = q.cells(x)
                codes = q.codes(x, cell)
                yield pd.DataFrame({"chunk_id": f[key].to_numpy()[at], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "far": np.linalg.norm(x - q.centroids[cell], axis=1), "embedding": list(x)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "embedding").mapInPandas(run, f"chunk_id {kind}, cell int, codes binary, far double, embedding array<double>")


def _append(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell").write.mode("append").parquet(f"{path}/cells")


def build(vectors: DataFrame, path: str, key: str = "vec_id", cells: int | None = None, parts: int = PARTS) -> None:
    """A new index of (key, embedding) under a path. Repeated rows are all indexed; null keys too."""
    spark, q = vectors.sparkSession, fit(vectors, key, cells, parts)
    points = [("cell", 0, i, p.tolist()) for i, p in enumerate(q.centroids)]
    points += [("word", part, i, w.tolist()) for part, words in enumerate(q.words) for i, w in enumerate(words)]
    # the number of points has a fixed bound
    spark.createDataFrame(points, "kind string, part int, number int, point array<double>").coalesce(1).write.parquet(f"{path}/points")
    spark.createDataFrame([(q.cuts,)], "cuts array<int>").coalesce(1).write.parquet(f"{path}/cuts")
    _append(encoded(vectors, key, q), path)


def add(vectors: DataFrame, path: str, key: str = "vec_id") -> None:
    """More vectors for the index under a path; its centroids and codewords stay as they are."""
    _append(encoded(vectors, key, load(vectors.sparkSession, path).quantiser), path)


@dataclass(frozen=True)
class VectorIndex:
    quantiser: Quantiser
    rows: DataFrame

    def search(self, queries: DataFrame, k: int = 20, probed: float = PROBED, refine: int = REFINE) -> DataFrame:
        """The k best found for each of (query_id, embedding), as vector_search has them; scores are exact cosines. If all cells
        are probed, none is missing, however many vectors (copies, say) have like codes.

        Queries without a direction, and those of other dimensions, find nothing. Of equal scores the smallest ids come first.
        """
        spark, kind = self.rows.sparkSession, self.rows.schema["chunk_id"].dataType.simpleString()
        asked_kind = queries.schema["query_id"].dataType.simpleString()
        sent = spark.sparkContext.broadcast(self.quantiser)
        probes = max(1, int(np.ceil(probed * len(self.quantiser.centroids))))

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value
            for f in frames:
                at, x = units(f["embedding"], q.dims)
                if not len(at) or not len(q.centroids):
                    continue
                near = x @ q.centroids.T
                chosen = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                for i, cells in zip(range(len(at)), chosen, strict=True):
                    yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[[at[i]] * len(cells)], "cell": cells.astype(np.int32), "near": near[i, cells], "q": [x[i]] * len(cells)})

        sizes = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        slices = {r["cell"]: r["slices"] for r in sizes.collect()}  # a row for each cell, MOST_CELLS at most
        number = F.create_map(*(F.lit(x) for pair in slices.items() for x in pair)) if slices else F.create_map().cast("map<int,int>")
        asked = written(queries.select("query_id", "embedding").mapInPandas(probe, f"query_id {asked_kind}, cell int, near double, q array<double>"), "probes")
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most; the scan skips all others
        met = asked.withColumn("n", F.coalesce(F.element_at(number, F.col("cell")), F.lit(0))).where("n > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        inside = self.rows.where(F.col("cell").isin(wanted))
        sliced = inside.select("chunk_id", "cell", "codes").withColumn("slice", F.pmod(F.xxhash64("chunk_id", "codes"), F.element_at(number, F.col("cell"))).cast("int"))
        most = refine * k

        def meet(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out, quantiser = [], sent.value
            if len(codes):
                c = np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(len(codes), -1)
                ids, pieces = codes["chunk_id"].to_numpy(), np.arange(c.shape[1])
                for qid, near, q in zip(asked["query_id"], asked["near"], asked["q"], strict=True):
                    score = near + quantiser.tables(np.asarray(q))[pieces, c].sum(axis=1)
                    best = np.argsort(-score, kind="stable")[:most]
                    out.append(pd.DataFrame({"query_id": qid, "chunk_id": ids[best], "cell": codes["cell"].iloc[0] if len(codes) else 0, "score": score[best]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "cell": [], "score": []})

        guessed = sliced.groupBy("cell", "slice").cogroup(met.groupBy("cell", "slice")).applyInPandas(meet, f"query_id {asked_kind}, chunk_id {kind}, cell int, score double")
        chosen = top_guesses(guessed, most)
        exact = chosen.join(inside.select("chunk_id", "cell", "embedding"), ["cell", "chunk_id"]).join(asked.groupBy("query_id").agg(F.first("q").alias("q")), "query_id")
        cosine = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        best = top(exact.select("query_id", "chunk_id", F.round(cosine, 9).alias("score")), k, "vector")
        return best if probed < 1 else self._complete(best, met, number, k)

    def _complete(self, best: DataFrame, met: DataFrame, number: Column, k: int) -> DataFrame:
        """The k best of all vectors of the met cells, given the best so far.

        An inner product with a query is at most the centroid's and the distance from it; slices that can't reach the k-th score
        are left out, the others' k best that reach it leave their task.
        """
        kind, asked_kind = (df.schema[c].dataType.simpleString() for df, c in ((self.rows, "chunk_id"), (met, "query_id")))
        floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - SLACK).otherwise(-2.0).alias("floor"))
        reach = self.rows.groupBy("cell").agg(F.max("far").alias("reach"))  # a row for each cell, MOST_CELLS at most
        open_ = met.join(written(floor, "floors"), "query_id").join(F.broadcast(reach), "cell").where(F.col("near") + F.col("reach") >= F.col("floor"))
        rows = self.rows.select("chunk_id", "cell", F.pmod(F.xxhash64("chunk_id", "codes"), F.element_at(number, F.col("cell"))).cast("int").alias("slice"), "embedding")

        def compare(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(vectors) and len(asked):
                x, ids = np.stack(vectors["embedding"]), vectors["chunk_id"].to_numpy()
                for qid, floor, q in zip(asked["query_id"], asked["floor"], asked["q"], strict=True):
                    score = np.round(x @ np.asarray(q), 9)
                    near = np.flatnonzero(score >= floor)
                    near = near[np.lexsort((ids[near], -score[near]))[:k]]
                    out.append(pd.DataFrame({"query_id": qid, "chunk_id": ids[near], "score": score[near]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

        found = rows.groupBy("cell", "slice").cogroup(open_.groupBy("cell", "slice")).applyInPandas(compare, f"query_id {asked_kind}, chunk_id {kind}, score double")
        return top(found, k, "vector")


def top_guesses(guessed: DataFrame, most: int) -> DataFrame:
    """Different candidates of each query, best guesses first."""
    return top(guessed.groupBy("query_id", "cell", "chunk_id").agg(F.max("score").alias("score")), most, "guess", keep=("cell",)).select("query_id", "cell", "chunk_id")


def load(spark: SparkSession, path: str) -> VectorIndex:
    points = spark.read.parquet(f"{path}/points").orderBy("kind", "part", "number").collect()
    cuts = list(spark.read.parquet(f"{path}/cuts").first()["cuts"])

    def rows_of(kind: str, part: int, dims: int) -> np.ndarray:
        found = [p["point"] for p in points if p["kind"] == kind and p["part"] == part]
        return np.array(found, float).reshape(len(found), dims)

    words = [rows_of("word", i, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return VectorIndex(Quantiser(rows_of("cell", 0, cuts[-1]), words, cuts), spark.read.parquet(f"{path}/cells"))
