"""Shared plumbing: tables, tables written between jobs, held-out folds, batches of texts."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may do without, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/lodequery"
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    A lost executor costs a re-read of files, not a recomputation of what led to them. The files go when the session's
    folder is cleaned; each call has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodequery-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lodequery-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans, generated classes, broadcasts and shuffle files of jobs that are over stay until then."""
    gc.collect()
    spark._jvm.System.gc()


def fold(doc_id: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if it has at most so many rows, which executors count; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*map(named, like.columns))


def give_back() -> None:
    """Return memory that is free to the system: a Python worker lives on after its task, beside those of the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another libc
            pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named string column holds about `limit` bytes at most (a longer row is alone)."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    batch = sizes = None
    give_back()


def with_struct(docs: DataFrame, into: str, fields: str, make: Callable[[], Callable[[list], Iterable[list]]], text: str = "text") -> DataFrame:
    """docs with a struct column `into` computed from one text column in Arrow batches; all other columns pass through.

    make() runs once in each task and returns what turns a list of texts (None for null) into lists, one for each field.
    """
    rest = [f for f in docs.schema.fields if f.name != into]
    kept = [f.name for f in rest]
    place = kept.index(text)
    # by number in between, as names may hold any character
    plain = docs.select(*(named(n).alias(f"c{i}") for i, n in enumerate(kept)))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)] + [T.StructField("made", T.StructType.fromDDL(fields))])
    kinds = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in slices(batches, f"c{place}"):
            made = [pa.array(x, type=f.type) for x, f in zip(compute(batch.column(place).to_pylist()), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(made, fields=list(kinds))], names=[*batch.schema.names, "made"])

    return plain.mapInArrow(run, schema).toDF(*kept, into)
