"""Tables, stored steps and gapless numbers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.session import scratch_dir

CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Cuts the lineage so that a lost executor costs one step, not the chain, and
    frees the shuffle files of the step as soon as its rows are written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: gapless numbers from 0 within each combination of ``groups``.

    Numbers follow a hash of ``order``, which must tell the rows of a group
    apart. Every group is cut into buckets by that hash, so a group that holds
    most rows is numbered by many tasks; only bucket sizes are summed up.
    """
    buckets = 8 * shuffle_partitions(df.sparkSession)
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    marked = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    sizes = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per group and bucket: as many as there are buckets, whatever the input.
    listed = sizes.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("_bucket", "_rows"))).alias("_sizes"))
    first = F.aggregate(F.slice("_sizes", 1, F.col("_i")), F.lit(0).cast("long"), lambda a, x: a + x["_rows"])
    offsets = listed.select(*groups, "_sizes", F.posexplode("_sizes").alias("_i", "_at")).select(
        *groups, F.col("_at._bucket").alias("_bucket"), first.alias("_first")
    )
    within = F.expr(f"row_number() over (partition by {', '.join(keys)} order by {', '.join(order)}) - 1")
    ranked = marked.withColumn("_within", within)
    if groups:
        same = F.lit(True)
        for k in groups:
            same = same & ranked[k].eqNullSafe(offsets[k])
        joined = ranked.join(F.broadcast(offsets), same & (ranked["_bucket"] == offsets["_bucket"]))
    else:
        joined = ranked.join(F.broadcast(offsets), ranked["_bucket"] == offsets["_bucket"])
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_within") + F.col("_first")).cast("long").alias(name))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with the columns of ``ddl`` behind; a column of the same name gives way."""
    new = T.StructType.fromDDL(ddl)
    return T.StructType([f for f in schema.fields if f.name not in new.names] + new.fields)


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def batches_of(rows: Iterable, limit: int, weight) -> Iterator[list]:
    """Consecutive rows in lists whose weights sum to ``limit`` or less, or hold a single row."""
    held, total = [], 0
    for row in rows:
        w = weight(row)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over the batches of a task; what it has freed goes back to the system at the end.

    Workers live on from task to task, and would keep the most that any task has needed.
    """

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        # Only some C libraries have it.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
