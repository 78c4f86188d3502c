"""Helpers that the training-data operators share: tables, lineage cuts, components.

Tables cut from the lineage are written as Parquet below ``spark.checkpoint.dir``, the
folder that driver and executors share, so a lost executor never takes results with it.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and driver and
    executors are one machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="latticework-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Columns of ``df`` by exact name; others may differ from them by case only."""
    return numbered(df).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0, c1, ..``, beside which a column of any other name is new."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of :func:`numbered`; rows of one key and id are taken as the same row."""
    columns = [F.map_entries(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields]
    return F.xxhash64(*columns)


def rows_of(docs: DataFrame, chosen: DataFrame, copies: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, whose id and key are in ``chosen(doc_id, key)``, each
    once or with ``copies`` as often as its column ``n`` says.  Equal rows count as one."""
    names = docs.columns
    inner = numbered(docs)
    keyed = inner.select("*", F.col(f"c{names.index('doc_id')}").cast("long").alias("_d"), row_key(inner).alias("_h"))
    chosen = chosen.select(F.col("doc_id").alias("_kd"), F.col("key").alias("_kh"), *(["n"] if copies else []))
    # Both steps need equal rows together, so they share one exchange.
    keyed = keyed.dropDuplicates(["_d", "_h"])
    joined = keyed.join(chosen, F.col("_d").eqNullSafe(F.col("_kd")) & (F.col("_h") == F.col("_kh")), "inner" if copies else "left_semi")
    if copies:
        joined = joined.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return joined.select(*inner.columns).toDF(*names)


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, however long the texts are, and workers
    that give freed memory back after every few MB that they took and gave, and after each task.

    The bound is a setting of the session, which Spark reads when the query runs; it stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from trimmed(run, batches)
        finally:
            gc.collect()
            give_back()

    return df.mapInArrow(whole, schema)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``run(batches)``.  Freed memory is given back before it adds up: whenever
    ``BATCH_BYTES`` have been read and yielded since the last time."""
    passed = 0

    def counted() -> Iterator[pa.RecordBatch]:
        nonlocal passed
        for batch in batches:
            passed += batch.nbytes
            yield batch

    for out in run(counted()):
        passed += out.nbytes
        yield out
        del out
        if passed >= BATCH_BYTES:
            give_back()
            passed = 0


def give_back() -> None:
    """Return freed memory to the system; workers live on between batches and tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_blocks(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``size`` bytes together; a text is never cut."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which ``many`` may hold a hot key and ``one`` has a row per key.

    ``one`` usually comes from an aggregate on ``keys``.  The extra key, a function of the
    others, makes Spark exchange both sides anew for the join, and only such exchanges are
    split by the adaptive skew-join rule when a partition is far above the median.
    """
    extra = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)).alias("_x")
    joined = many.select("*", extra).join(one.select("*", extra), [*keys, "_x"], how)
    return joined.drop("_x")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star.

    Returns ``(node, root)`` for every node with at least one edge to another one; ``root``
    is the smallest node of its component; :func:`drop` takes the result.  Only minima are aggregated and joined, so no
    neighbourhood is ever gathered in one task; each round is a written table.
    """
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            skew_join(both, low, ["u"])
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            skew_join(large, low, ["u"])
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        small = cut(small, "small")
        drop(large)
        drop(now)
        now = small
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.cut_path = now.cut_path
            return out
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
