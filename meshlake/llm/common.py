"""What the corpus operators share: Arrow stages, fixed byte classes and name-safe columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from meshlake.session import durable, table

__all__ = ["arrow_column", "arrow_stage", "ascii_lower", "bounded_batches", "durable", "free_name", "let", "release", "row_hash", "set_aside", "settle", "table"]

#: Rows and bytes of one Arrow batch that goes to a Python worker; long texts then can't fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Set the session's Arrow batch limits, unless the user has set their own."""
    conf = df.sparkSession.conf
    for key, default, mine in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", str(BATCH_BYTES)),
    ):
        if conf.get(key, default) in (default, "64MB", "256MB", "268435456", "9223372036854775807"):
            conf.set(key, mine)
    return df


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back: a Python worker is kept for later tasks beside the executor's heap, the driver's Python beside its own."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def settle(spark: SparkSession) -> None:
    """Between two large steps: free what the driver no longer uses, for which Spark's cleaner then drops shuffles and broadcasts.

    Else that waits for ``spark.cleaner.periodicGC.interval`` or for a full heap, in which plans of earlier steps lie. What the
    driver's JVM freed outside of its heap is given back as well: the C library keeps it, some 250 MB after a few steps.
    """
    release()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str | None:
    """Have the driver's JVM give memory that its C library holds unused back; what the JVM says to it, null if it can't (HotSpot on Linux can)."""
    sc = spark.sparkContext
    jvm, new = sc._jvm, sc._gateway.new_array
    args = new(jvm.Object, 4)
    args[0], args[1], args[2], args[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0)
    # By reflection on the interface, since the server's own class is not open to callers.
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def arrow_column(df: DataFrame, out: str, fn: Callable[..., pa.Array], kind: str, *columns: Column) -> DataFrame:
    """``df`` with ``out``, a function of Arrow arrays: only ``columns`` go to Python, the others stay where they are."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            yield fn(*(batch if isinstance(batch, tuple) else (batch,)))
            release()

    if len(columns) == 1:

        def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from run(batches)
    else:

        def f(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from run(batches)

    return bounded_batches(df).withColumn(out, arrow_udf(f, kind)(*columns))


def arrow_stage(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | Iterable[dict] | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from a batch to columns by name (or to several such), in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fn(batch)
            for got in [found] if isinstance(found, dict) else found or ():
                yield pa.RecordBatch.from_arrays(
                    [v.cast(f.type) if isinstance(v := got[f.name], pa.Array) else pa.array(v, f.type) for f in out], schema=out
                )
            found = got = None
            release()

    return bounded_batches(df).mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` doesn't have, by any case."""
    have, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` whose columns that are called like one of ``names``, by any case, are kept as ``<name>_input``."""
    wanted = {n.lower() for n in names}
    for c in [c for c in df.columns if c.lower() in wanted]:
        to, have = f"{c}_input", {x.lower() for x in df.columns}
        while to.lower() in have:
            to += "_"
        df = df.withColumnRenamed(c, to)
    return df


def row_hash(df: DataFrame) -> Column:
    """128 bits of a row's columns; which of them are null counts too."""
    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]
