"""Quality rules with robust multivariate outliers.

Documents are described by a vector of transformed statistics. For each language and source the
minimum covariance determinant estimate gives a centre and a covariance that outliers can't pull:
from several starts by medians and absolute deviations, concentration steps keep the most central
share of the rows and estimate anew; the result with the least determinant counts. A document far
from its group's centre by Mahalanobis distance is rejected.
All of it is aggregates and joins on the narrow table of statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import BLANKS, materialize, release, table, text_of, words_of

WINDOW_WORDS = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of the rows that a concentration step keeps, number of steps of each start and after the choice.
CENTRAL, STEPS = 0.75, 3
#: Rows that the estimate of all groups weighs in each group's.
SHRINK_ROWS = 10
#: The group of all rows; other groups have a separator in their names.
EVERY = "*"
#: Probability under the normal model beyond which a document is rejected.
REJECT = 1e-3
#: The vector's entries with the least standard deviation that an estimate may have, so that a
#: statistic that hardly varies in a group doesn't make outliers of ordinary documents.
FEATURES = {"x_words": 0.5, "x_length": 0.08, "x_symbols": 0.35, "x_repeats": 0.25, "x_lines": 0.35}


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= y / (a + n)
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def text_statistics(documents: DataFrame) -> DataFrame:
    """Counts over every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text has no words. The repeated windows are compared by a 64-bit hash inside each text.
    """
    text = text_of()
    rows = documents.select("doc_id", "lang", "source", text.alias("text"), words_of(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n = F.size("w")
    windows = F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW_WORDS)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), windows.alias("h"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    again = F.size(F.array_distinct("h")) < F.size("h")
    # only texts with a repeated window sort their windows, each with its position
    rows = rows.withColumn("placed", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    hash_at = lambda i: F.get(F.col("placed"), i)["h"]
    paired = F.filter("placed", lambda x, i: x["h"].eqNullSafe(hash_at(i - 1)) | x["h"].eqNullSafe(hash_at(i + 1)))
    covered = F.aggregate(
        F.sort_array(F.transform(paired, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, i: F.struct((i + WINDOW_WORDS).alias("end"), (a["sum"] + i + WINDOW_WORDS - F.greatest(a["end"], i)).alias("sum")),
        lambda a: a["sum"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _vector(stats: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return stats.withColumns({
        "grp": F.concat(part("lang"), F.lit("\u0001"), part("source")),
        "x_words": F.log1p("n_words"),
        "x_length": F.log1p(F.col("word_chars") / words),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / words),
        "x_repeats": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / words))),
        "x_lines": F.log1p(100 * F.col("n_dup_lines") / words),
    })


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the estimates' columns m_* and w_i_j, the inverse Cholesky factor."""
    total = F.lit(0.0)
    for i in range(len(names)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}"))
        total = total + y * y
    return total


def _moments(rows: DataFrame, names: list[str], scale: float, keys: list[str]) -> DataFrame:
    """Rows, centre and covariance times ``scale`` of each group: n, m_i, c_i_j."""
    p = len(names)
    sums = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)]
    sums += [(scale * F.covar_pop(names[i], names[j])).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def _factor(est: DataFrame, p: int) -> DataFrame:
    """Adds the inverse Cholesky factor w_i_j and logdet of each covariance, with the least variances added to its diagonal."""
    floors = list(FEATURES.values())
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}") + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            est = est.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l_{j}_{j}"))
    for i in range(p):
        for j in range(i + 1):
            s = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            est = est.withColumn(f"w_{i}_{j}", s / F.col(f"l_{i}_{i}"))
    est = est.withColumn("logdet", sum(2 * F.log(F.col(f"l_{i}_{i}")) for i in range(p)))
    return est.drop(*[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _median(c: str | Column, share: float = 0.5) -> Column:
    """A quantile of values to three places: exact, alike in any order of the rows, and bounded in its table of counts."""
    return F.percentile(F.round(c, 3), share)


def _central(rows: DataFrame, distance: Column, share: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ``share`` of each group's rows with the least distance, and the written table of cuts."""
    rows = rows.withColumn("d2", F.log(distance + 1e-9))
    cut = materialize(rows.groupBy(*keys).agg(_median("d2", share).alias("cut")), "mcd-cut")
    return rows.join(cut, keys).where("round(d2, 3) <= cut"), cut


def robust_estimates(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Reweighted minimum covariance determinant estimates of each ``grp``: n, centre, covariance, its factor and logdet.

    Each of three starts, by different norms around the medians, gives a first central share of the rows, from which concentration steps go on; of
    the results the one with the least determinant is taken and concentrated further.
    """
    names = names or list(FEATURES)
    p, rows = len(names), rows.select("grp", *names)
    medians = materialize(rows.groupBy("grp").agg(*[_median(c).alias(f"m_{i}") for i, c in enumerate(names)]), "mcd-median")
    placed = rows.join(medians, "grp")
    spread = materialize(placed.groupBy("grp").agg(*[_median(F.abs(F.col(c) - F.col(f"m_{i}"))).alias(f"s_{i}") for i, c in enumerate(names)]), "mcd-spread")
    floors = list(FEATURES.values())
    z = [F.abs(F.col(c) - F.col(f"m_{i}")) / F.greatest(1.4826 * F.col(f"s_{i}"), F.lit(floors[i])) for i, c in enumerate(names)]
    # a truncated normal sample has too small a covariance: the usual factors set it right
    factor = lambda a: a / chi2_cdf(chi2_quantile(a, p), p + 2)
    starts = {"euclid": sum(x * x for x in z), "city": sum(z) * sum(z), "most": F.greatest(*z) ** 2}
    both = ["grp", "start"]
    first = placed.join(spread, "grp").select("grp", *names, F.explode(F.array(*[F.struct(F.lit(k).alias("start"), d.alias("d")) for k, d in starts.items()])).alias("x"))
    central, cut = _central(first.select("grp", *names, "x.start", "x.d"), F.col("d"), CENTRAL, both)
    est = materialize(_factor(_moments(central, names, factor(CENTRAL), both), p), "mcd-start")
    release(cut)

    def concentrate(est: DataFrame, keys: list[str], label: str) -> DataFrame:
        central, cut = _central(rows.join(est, "grp").select(*keys, *names, _distance(names).alias("d")), F.col("d"), CENTRAL, keys)
        out = materialize(_factor(_moments(central, names, factor(CENTRAL), keys), p), label)
        release(cut, est)
        return out

    for step in range(STEPS):
        est = concentrate(est, both, f"mcd-step{step}")
    best = est.groupBy("grp").agg(F.min(F.struct(F.round("logdet", 9).alias("d"), "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    least = materialize(est.join(best, both).drop("start"), "mcd-least")
    release(est, medians, spread)
    for step in range(STEPS):
        least = concentrate(least, ["grp"], f"mcd-last{step}")
    near = rows.join(least, "grp").where(_distance(names) <= chi2_quantile(0.975, p)).select("grp", *names)
    out = materialize(_factor(_moments(near, names, factor(0.975), ["grp"]), p), "mcd-final")
    release(least)
    return out


def _shrunk(est: DataFrame, p: int) -> DataFrame:
    """Each group's estimate mixed with that of all groups together, which weighs as SHRINK_ROWS rows: few rows, little say."""
    pooled = est.where(F.col("grp") == EVERY).select(*[F.col(c).alias(f"all_{c}") for c in est.columns if c[:2] in ("m_", "c_")])
    a = F.col("n") / (F.col("n") + SHRINK_ROWS)
    rows = est.crossJoin(F.broadcast(pooled))  # one row
    apart = [F.col(f"m_{i}") - F.col(f"all_m_{i}") for i in range(p)]
    centre = [(a * F.col(f"m_{i}") + (1 - a) * F.col(f"all_m_{i}")).alias(f"m_{i}") for i in range(p)]
    spread = [(a * F.col(f"c_{i}_{j}") + (1 - a) * F.col(f"all_c_{i}_{j}") + a * (1 - a) * apart[i] * apart[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return _factor(rows.select("grp", *centre, *spread), p)


def quality_rules(documents: DataFrame) -> DataFrame:
    """Per document the counts, base_failed, distance (squared, null where base_failed) and kept.

    Every language and source has its own estimate, mixed with that of all rows. Null languages and
    sources are values of their own. An empty table gives an empty result; a single document stays;
    repeated rows count each; other columns are ignored.
    """
    names = list(FEATURES)
    rows = materialize(_vector(text_statistics(documents)), "quality-statistics")
    sound = rows.where("NOT base_failed").select(F.explode(F.array("grp", F.lit(EVERY))).alias("grp"), *names)
    robust = robust_estimates(sound)
    est = materialize(_shrunk(robust, len(names)), "quality-estimates")
    release(robust)
    far = chi2_quantile(1 - REJECT, len(names))
    out = rows.join(est, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(names)))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= far)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
