"""Joins and rankings that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a plan's output. Only parallelism may depend on it."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as there are cores for an input that is too small to have them (one small file).

    At scale the scan already has many splits and the data stay where they are."""
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * split else df


def skew_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of a large, possibly skewed table with a table of few rows per key.

    Nothing is hinted: Spark broadcasts `other` where its size, measured at run time, allows it. Else both
    sides get an exchange of their own, which adaptive execution needs to split the tasks of hot keys by
    their bytes, however many rows a key has. The extra key, always 0, keeps a side that is already
    partitioned by the keys (an aggregate, say) from going without that exchange."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    apart = F.pmod(F.xxhash64(*keys), F.lit(1))
    joined = big.withColumn("_apart", apart).join(other.withColumn("_apart", apart), [*keys, "_apart"], how)
    return joined.drop("_apart")


def rank_in_group(
    df: DataFrame,
    group: list[str],
    order: str,
    ties: list[Column | str],
    out: str = "rank",
    ranges: int = RANGES,
) -> DataFrame:
    """row_number() over (group order by order, ties) without one task per group.

    The order column is cut into value ranges of about equal numbers of rows (a power of two of them). A
    row's rank is the number of rows of its group in earlier ranges (a pre-aggregated count) plus its
    rank inside its own range. The cuts are a one-row subquery of the same plan."""
    is_time = df.schema[order].dataType.typeName().startswith("timestamp")
    numeric = (F.col(order).cast("timestamp") if is_time else F.col(order)).cast("double")
    cuts = df.agg(F.percentile_approx(numeric, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c"))
    steps = F.array(*[F.lit(ranges >> i) for i in range(1, ranges.bit_length())])
    tagged = df.withColumn("_cuts", cuts.scalar()).withColumn("_value", numeric)
    below = F.aggregate(
        steps, F.lit(0), lambda at, s: at + F.when(F.get("_cuts", at + s - 1) < F.col("_value"), s).otherwise(0)
    )
    tagged = tagged.withColumn("_bucket", F.when(F.col("_value").isNull(), -1).otherwise(below)).drop("_cuts", "_value")
    key = [*group, "_bucket"]
    counts = tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*key).orderBy(F.col(order), *ties)
    return (
        tagged.join(offsets, key)
        .withColumn(out, (F.row_number().over(inside) + F.col("_offset")).cast("long"))
        .drop("_bucket", "_offset")
    )


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by `order`: an aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*")
