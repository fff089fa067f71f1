"""Column functions with the exact semantics that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least positive normal double, a floor for logarithms.
TINY = 2.2250738585072014e-308


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Code points that full case folding changes, with the one that stands for each; and those that become several."""
    changed = [(c, f) for c in map(chr, range(0x110000)) if (f := c.casefold()) != c]
    single = [(c, f) for c, f in changed if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), [(c, f) for c, f in changed if len(f) > 1]


def casefolded(text: Column) -> Column:
    """Full Unicode case folding, as of this Python: one character may become several."""
    singles, folded, several = _folds()
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several])
    spread = F.aggregate(pairs, text, lambda a, p: F.replace(a, p["c"], p["f"]))
    whole = F.translate(F.when(text.rlike("[" + "".join(c for c, _ in several) + "]"), spread).otherwise(text), singles, folded)
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(whole)


def clean_numeric(value: Column) -> Column:
    """A double, or null for null, NaN, infinities and text that isn't a number. Booleans must not be passed."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the span from the first start to the last end; 0 for an empty span."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    span = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(span > 0, both / span).otherwise(0.0)


def overlap_coefficient(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the shorter interval's length; 0 for a length of 0."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    short = F.least(F.greatest(F.lit(0.0), a1 - a0), F.greatest(F.lit(0.0), b1 - b0))
    return F.when(short > 0, both / short).otherwise(0.0)


def stable_sigmoid(x: Column) -> Column:
    """The logistic function, with an exponent that is never positive."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def safe_ratio_db(top: Column, bottom: Column) -> Column:
    """10 log10 of a ratio, null unless both are positive."""
    return F.when((top > 0) & (bottom > 0), 10.0 * F.log10(top / bottom))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """Per group the first value, in ascending order, whose cumulative weight reaches q times the total; null if that isn't positive. Negative weights count as 0."""
    total = Window.partitionBy(*keys)
    rows = rows.select(*keys, F.col(value).alias("_v"), F.greatest(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum("_w").over(upto)).withColumn("_t", F.sum("_w").over(total))
    # the running sum may fall short of the total by rounding: the last value then stands
    reached = F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col("_v")))
    return rows.groupBy(*keys).agg(F.when(F.max("_t") > 0, F.coalesce(reached, F.max("_v"))).alias(name))
