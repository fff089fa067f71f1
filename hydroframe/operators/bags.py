"""Statistics over the bag of clips of an encounter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.columns import casefolded, clean_numeric
from hydroframe.operators.selection import exact_quantiles

#: Fixed names of the statistics, in order.
STATISTICS = ("mean", "std", "minimum", "q25", "median", "q75", "maximum")


#: The statistics that are quantiles.
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def statistic(name: str, x: Column) -> Column:
    return {"mean": F.avg, "std": F.stddev_pop, "minimum": F.min, "maximum": F.max}[name](x)


def _checked(clips: DataFrame, key: str, features: list[str], statistics: tuple[str, ...]) -> DataFrame:
    if unknown := sorted(set(statistics) - set(STATISTICS)):
        raise ValueError(f"unsupported statistics: {unknown}")
    kinds = dict(clips.dtypes)
    return clips.select(key, *[(F.lit(None).cast("double") if kinds[f] == "boolean" else clean_numeric(F.col(f))).alias(f) for f in features])


def _ordered(key: str, features: list[str], statistics: tuple[str, ...], missing_fraction: bool, quantile) -> list[Column]:
    """The output's columns in their order; ``quantile``: feature and its place among the wanted quantiles to a column."""
    wanted = [s for s in statistics if s in QUANTILES]
    out = [F.col(key)]
    for f in features:
        out += [(quantile(f, wanted.index(s)) if s in QUANTILES else F.col(f"{f}__{s}")).alias(f"{f}__{s}") for s in statistics]
        if missing_fraction:
            out.append(F.col(f"{f}__missing_fraction"))
    return out


def bag_statistics(clips: DataFrame, key: str, features: list[str], statistics: tuple[str, ...] = STATISTICS, missing_fraction: bool = True) -> DataFrame:
    """One row a bag: feature__statistic over finite values (null if there are none), and feature__missing_fraction.

    The quantiles of a feature come from one map of a bag's distinct values, which must fit a task; for bags
    without a bound see unbounded_bag_statistics.
    """
    clean = _checked(clips, key, features, statistics)
    wanted = [F.lit(QUANTILES[s]) for s in statistics if s in QUANTILES]
    made = []
    for f in features:
        made += [statistic(s, F.col(f)).alias(f"{f}__{s}") for s in statistics if s not in QUANTILES]
        made += [F.percentile(f, F.array(*wanted)).alias(f"{f}__quantiles")] if wanted else []
        made += [(1 - F.count(f) / F.count(F.lit(1))).alias(f"{f}__missing_fraction")] if missing_fraction else []
    grouped = clean.groupBy(key).agg(*made)
    return grouped.select(*_ordered(key, features, statistics, missing_fraction, lambda f, k: F.get(f"{f}__quantiles", F.lit(k))))


def unbounded_bag_statistics(clips: DataFrame, key: str, features: list[str], statistics: tuple[str, ...] = STATISTICS, missing_fraction: bool = True) -> DataFrame:
    """bag_statistics for bags of any size, a null key included: all sums are partial, and quantiles are selected by histograms of bits.

    Reads ``clips`` several times, so give a written table.
    """
    clean = _checked(clips, key, features, statistics)
    wanted = [QUANTILES[s] for s in statistics if s in QUANTILES]
    made = []
    for f in features:
        made += [statistic(s, F.col(f)).alias(f"{f}__{s}") for s in statistics if s not in QUANTILES]
        made.append((1 - F.count(f) / F.count(F.lit(1))).alias(f"{f}__missing_fraction"))
    grouped = clean.groupBy(key).agg(*made)
    if not wanted:
        return grouped.select(*_ordered(key, features, statistics, missing_fraction, None))
    name = F.struct(F.col(key).alias("key"))  # a null key is a group as others are
    long = clean.select(name.alias("bag"), F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f).alias("v")) for k, f in enumerate(features)])).alias("x")).select("bag", "x.*")
    chosen = exact_quantiles(long, ["bag", "feature"], "v", wanted).groupBy("bag").agg(F.map_from_entries(F.collect_list(F.struct("feature", "quantiles"))).alias("chosen"))
    rows = grouped.withColumn("bag", name).join(chosen, "bag", "left")
    return rows.select(*_ordered(key, features, statistics, missing_fraction, lambda f, k: F.get(F.try_element_at("chosen", F.lit(features.index(f))), F.lit(k))))


def long_form(wide: DataFrame, key: str) -> DataFrame:
    """(key, name, value), a row for each aggregate."""
    names = [c for c in wide.columns if c != key]
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select(key, "x.name", "x.value")


def bag_totals(clips: DataFrame, key: str, duration: str, rate: str) -> DataFrame:
    return clips.groupBy(key).agg(F.count(F.lit(1)).alias("clip_count"), F.sum(duration).alias("total_duration"), F.sort_array(F.collect_set(rate)).alias("rates"))


def recording_totals(recordings: DataFrame, key: str) -> DataFrame:
    """Number and whole duration of an encounter's recordings."""
    return recordings.groupBy(key).agg(F.count(F.lit(1)).alias("recording_count"), F.sum("duration_seconds").alias("total_recording_duration_seconds"))


def bag_fingerprint(clips: DataFrame, key: str, path: str, digest: str) -> DataFrame:
    """SHA-256 over the lines ``path<tab>hash`` in order of the case-folded path."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(casefolded(F.col(path)).alias("l"), F.col(path).alias("p"), F.col(digest).alias("h")))), lambda x: F.concat(x["p"], F.lit("\t"), x["h"], F.lit("\n")))
    return clips.groupBy(key).agg(F.sha2(F.array_join(lines, ""), 256).alias("input_set_sha256"))


def resolve_encounter_id(given: Column, stem: Column) -> Column:
    """The given identifier, else the path's stem, trimmed; null if that is blank."""
    name = F.trim(F.coalesce(F.nullif(given, F.lit("")), stem))
    return F.when(name != "", name)
