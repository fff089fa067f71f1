"""Exact quantiles of groups of any size by histograms over order-preserving bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.sources.scratch import checkpointed

#: Bits that a pass looks at; a group's histogram has 2**BITS buckets at most.
BITS = 13
#: Values take no more passes than this.
PASSES = -(-64 // BITS)


def ordered_bits(value: Column) -> Column:
    """A double's 64 bits as a long that stands in the double's order, read as signed; 0.0 and -0.0 are one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def exact_quantiles(values: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """keys and ``quantiles``, an array of the linearly interpolated quantiles of each group's values, in the order asked for.

    A pass counts values by the next bits of those that share a wanted rank's leading bits, so that a group
    moves a bounded number of counts, however many rows or distinct values it has, and no task holds
    a group. A rank whose bucket has one value is done; most are before the last pass. Null values don't count;
    NaN must not occur. Groups without values have no row.
    """
    rows = values.where(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value)).alias("bits"), F.col(value).cast("double").alias("v"))
    # ranks: for each quantile the values at floor and ceil of (n - 1) * q, from 0
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in quantiles])))
    wanted = n.select(*keys, "n", F.explode(ranks).alias("rank"))
    # rest: the rank among the values whose leading bits are prefix
    open_ = wanted.select(*keys, "n", "rank", F.col("rank").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    found = None
    for step in range(PASSES):
        shift = max(0, 64 - BITS * (step + 1))
        width = 64 if step == 0 else 64 - BITS * step
        top = F.lit(0).cast("long") if step == 0 else F.shiftright("bits", width)
        near = rows.withColumn("prefix", top)
        if step:
            near = near.join(open_.select(*keys, "prefix").distinct(), [*keys, "prefix"])
        counts = near.groupBy(*keys, "prefix", F.shiftright("bits", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        listed = counts.groupBy(*keys, "prefix").agg(F.array_sort(F.collect_list(F.struct("bucket", "c", "low", "high"))).alias("buckets"))
        at = open_.join(listed, [*keys, "prefix"])
        zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("struct<bucket: bigint, c: bigint, low: double, high: double>").alias("hit"), F.lit(0).cast("long").alias("below"))

        def add(a, b):
            here = a["hit"].isNull() & (a["upto"] + b["c"] > F.col("rest"))
            return F.struct((a["upto"] + b["c"]).alias("upto"), F.when(here, b).otherwise(a["hit"]).alias("hit"), F.when(here, a["upto"]).otherwise(a["below"]).alias("below"))

        at = at.withColumn("x", F.aggregate("buckets", zero, add))
        at = checkpointed(at.select(*keys, "n", "rank", (F.col("rest") - F.col("x.below")).alias("rest"), F.col("x.hit.bucket").alias("prefix"), F.col("x.hit.low").alias("low"), F.col("x.hit.high").alias("high")))
        done = at.where("low = high").select(*keys, "n", "rank", F.col("low").alias("v"))
        found = done if found is None else found.unionByName(done)
        open_ = at.where("low <> high").select(*keys, "n", "rank", "rest", "prefix")
        if open_.isEmpty():
            break
    values_of = found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def one(q: float) -> Column:
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - place(q)) * a + (place(q) - low) * b)

    return values_of.select(*keys, F.array(*[one(q) for q in quantiles]).alias("quantiles"))
