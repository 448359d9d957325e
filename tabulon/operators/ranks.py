"""Order statistics of columns of any size: running totals by ranges, never one sorted partition.

Distinct values are counted with map-side combining and dealt by range; a window adds up inside each range, another
over one row per range. Quantiles, medians, ranks and sums up to a bound are read off from that, so no task holds
more than its range of the distinct values, whatever the groups' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import checkpoint


def prefix_totals(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """One row per (keys, value): the sums, each also as ``upto_{name}``, its total over values up to this one.

    Null values come first; keys are compared with null equal to null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])
    rows = checkpoint(rows.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = rows.groupBy(*keys, "_part").agg(*[F.sum(n).alias(n) for n in sums])
    base = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    rows = rows.select("*", *[F.sum(n).over(inside).alias(f"_i_{n}") for n in sums])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_p")]
    return rows.join(base, same).select(*keys, value, *sums, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(f"upto_{n}") for n in sums])


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys and one column per place: the value at that 1-based place of each group's sorted values; null if none.

    A place is an expression of ``total``, the group's number of values. Null values are left out.
    """
    rows = prefix_totals(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, value, n=F.count(F.lit(1)))
    rows = checkpoint(rows)
    total = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    total = total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.lit(c).alias(f"_at_{n}") for n, c in places.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    rows = rows.join(total, same) if keys else rows.join(F.broadcast(total), how="inner")  # one row
    hit = lambda n: (F.col("upto_n") >= F.col(f"_at_{n}")) & (F.col("upto_n") - F.col("n") < F.col(f"_at_{n}"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(hit(n), F.col(value))).alias(n) for n in places])


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """keys and the exact quantile, interpolated between neighbours; q = 0.5 is the median."""
    at = F.lit(q) * (F.col("total") - 1)
    got = at_places(df, keys, value, {"lo": F.floor(at) + 1, "hi": F.ceil(at) + 1, "one": F.lit(1)} if q else {"lo": F.lit(1), "hi": F.lit(1), "one": F.lit(1)})
    if q == 0.5:
        return got.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias(name))
    total = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    total = total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (at - F.floor(at)).alias("part"))
    got = got.join(total, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else got.join(F.broadcast(total), how="inner")  # one row
    return got.select(*keys, (F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo"))).alias(name))
