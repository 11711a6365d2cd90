"""Helpers that several operators share: staging tables, ordering a column in buckets, running sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a slim (text-free) table that one ordering bucket holds on average.
ROWS_PER_BUCKET = 20_000
#: Bounds that an expression carries; only beyond this times ROWS_PER_BUCKET rows do buckets grow.
MAX_BUCKETS = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Where a session of one machine names none (tests, local runs) a temporary folder is set once; on
    a cluster, whose executors could not see it, that is an error.
    """
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under a folder of this application that may be deleted after it."""
    return f"{shared_dir(spark)}/tracewell-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20


def batches_bounded(df: DataFrame) -> DataFrame:
    """``df`` unchanged; the session sends at most BATCH_BYTES at once to Python, where it was set to send more.

    Two tasks of an executor hold a few such batches each, outside of Spark's memory. A plan reads the
    setting when it runs, so it stays lowered; batches are no part of any result.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def memory_returned() -> None:
    """Gives what a task has freed back to the system: Python workers are kept for the tasks of later stages, whatever they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside give up their shuffle files when they end: only what they wrote is read later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str, rows: int = 2000) -> DataFrame:
    """``df`` through a Python function in each task, in Arrow batches of at most ``rows`` rows.

    ``make()`` is called once a task and returns a function from a batch to any number of batches
    (column name to list or Arrow array).
    """
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_returned()
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in f(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_pydict(out, schema=to)
        for out in getattr(f, "rest", tuple)():
            yield pa.RecordBatch.from_pydict(out, schema=to)
        del f
        memory_returned()

    return batches_bounded(df).mapInArrow(run, schema)


def in_tasks(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[dict]]], schema: str, rows: int = 2000) -> DataFrame:
    """Like ``in_arrow``, for functions of a dictionary of lists (nulls as None, integers exact).

    A function with an attribute ``rest`` is asked for more batches at the end of the task.
    """

    def listed():
        f = make()

        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            return f(batch.to_pydict())

        run.rest = getattr(f, "rest", tuple)
        return run

    return in_arrow(df, listed, schema, rows)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by a two-level search.

    With n bounds a row costs about 2*sqrt(n) comparisons. A null key is in bucket -1.
    """
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    outer = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    i = F.size(F.filter(outer, lambda b: b <= key))
    j = F.size(F.filter(F.element_at(inner, F.greatest(i, F.lit(1))), lambda b: b <= key))
    return F.when(key.isNull(), -1).otherwise(F.when(i > 0, (i - 1) * step + j).otherwise(0))


def order_bounds(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[int]:
    """Bounds that cut the order of the integer column ``key`` into buckets of about equal rows.

    At most MAX_BUCKETS numbers reach the driver, whatever the input. Rows with equal keys share
    a bucket.
    """
    n = df.count()
    k = min(MAX_BUCKETS, n // rows_per_bucket + 1)
    if k < 2:
        return []
    at = [i / k for i in range(1, k)]
    got = df.agg(F.percentile_approx(F.col(key).cast("long"), at, max(10_000, 20 * k))).first()[0]
    return sorted(set(got or []))


def running_start(df: DataFrame, order: list[str], value: str | list[str], out: str | list[str], group: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, in the order of ``order`` within ``group``.

    Lists of both give several sums at once. ``df`` must be slim and stable (a staged table). Its
    first order column is an integer; rows are dealt by ranges of it, summed per range, and only
    these sums (one row per group and range) are accumulated before each range is summed on its own.
    No group and no order meets in one task.
    """
    group, values, outs = group or [], [value] if isinstance(value, str) else value, [out] if isinstance(out, str) else out
    key = F.col(order[0])
    bounds = order_bounds(df, order[0])
    df = df.withColumn("_bucket", bucket_of(key, bounds)).withColumn("_sub", F.lit(0))
    if len(order) > 1:
        # a key of very many rows has a bucket of its own, cut further by the second column
        hot = [r[0] for r in df.groupBy(order[0]).count().where(F.col("count") > 2 * ROWS_PER_BUCKET).select(order[0]).collect()]
        if hot:
            own = sorted({*bounds, *(h + k for h in hot if h is not None for k in (0, 1))})
            many = key.isin([h for h in hot if h is not None]) | (key.isNull() if None in hot else F.lit(False))
            many = F.coalesce(many, F.lit(False))
            second = order_bounds(df.where(many), order[1])
            df = df.withColumns({"_bucket": bucket_of(key, own), "_sub": F.when(many, bucket_of(F.col(order[1]), second)).otherwise(0)})
    at = [*group, "_bucket", "_sub"]
    sums = df.groupBy(*at).agg(*[F.sum(v).alias(f"_sum{i}") for i, v in enumerate(values)])
    over = Window.partitionBy(*group).orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_at_{c}") for c in at], *[F.coalesce(F.sum(f"_sum{i}").over(over), F.lit(0)).alias(f"_before{i}") for i in range(len(values))])
    inner = Window.partitionBy(*at).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_own{i}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for i, v in enumerate(values)})
    on = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in at]
    df = df.join(sums, on, "left").withColumns({o: (F.col(f"_own{i}") + F.col(f"_before{i}")).cast("long") for i, o in enumerate(outs)})
    return df.drop("_bucket", "_sub", *[f"_at_{c}" for c in at], *[f"{p}{i}" for p in ("_own", "_before") for i in range(len(values))])
