"""Multilabel logistic heads over encoded aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.functions.columns import clean_numeric, stable_sigmoid

#: Fixed order of the labels.
LABELS = ("Feeding", "Travelling", "Milling", "Socializing")
#: Fixed name of the one kind of head.
HEAD_KIND = "logistic_regression"


def encoded_bags(aggregates: DataFrame, key: str, encoder: DataFrame) -> DataFrame:
    """key and encoded, an array (pos, name, value) by position: each aggregate standardised, after its missing values took the stored median, then its missing mark.

    ``aggregates``: key, name, value; ``encoder``: pos, name, median, mean, sd. An aggregate that the
    encoder names and a bag lacks counts as missing.
    """
    bags = aggregates.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", clean_numeric(F.col("value")).alias("value")))).alias("bag"))
    inputs = encoder.agg(F.sort_array(F.collect_list(F.struct("pos", "name", "median", "mean", "sd"))).alias("inputs"))  # one row

    def pair(e):
        value = F.try_element_at(F.col("bag"), e["name"])
        z = (F.coalesce(value, e["median"]) - e["mean"]) / e["sd"]
        return F.array(
            F.struct((2 * e["pos"]).alias("pos"), e["name"].alias("name"), z.alias("value")),
            F.struct((2 * e["pos"] + 1).alias("pos"), F.concat(e["name"], F.lit("__missing")).alias("name"), value.isNull().cast("double").alias("value")),
        )

    return bags.crossJoin(inputs).select(key, F.flatten(F.transform("inputs", pair)).alias("encoded"))


def encode(aggregates: DataFrame, key: str, encoder: DataFrame) -> DataFrame:
    """encoded_bags with a row for each position: key, pos, name, value."""
    return encoded_rows(encoded_bags(aggregates, key, encoder), key)


def encoded_rows(bags: DataFrame, key: str) -> DataFrame:
    return bags.select(key, F.explode("encoded").alias("x")).select(key, "x.*")


def score_bags(bags: DataFrame, key: str, heads: DataFrame) -> DataFrame:
    """(key, label_idx, label, score) of encoded_bags: the sigmoid of each head's weighted sum plus intercept.

    ``heads``: label_idx, label, pos, coef, intercept, a row for each encoded position. All of them join as
    one row, so bags stay where they are and sums run by position.
    """
    each = heads.groupBy("label_idx", "label").agg(F.first("intercept").alias("intercept"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "coef"))), lambda x: x["coef"]).alias("coefs"))
    every = each.agg(F.array_sort(F.collect_list(F.struct("label_idx", "label", "intercept", "coefs"))).alias("heads"))  # one row
    rows = bags.crossJoin(every).select(key, F.transform("encoded", lambda x: x["value"]).alias("values"), F.explode("heads").alias("h"))
    logit = F.aggregate(F.zip_with("values", "h.coefs", lambda v, c: v * c), F.col("h.intercept"), lambda a, x: a + x)
    return rows.select(key, "h.label_idx", "h.label", stable_sigmoid(logit).alias("score"))


def linear_heads(encoded: DataFrame, key: str, heads: DataFrame) -> DataFrame:
    """score_bags of encoded rows (key, pos, name, value), which are put together by bag first."""
    return score_bags(encoded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value"))).alias("encoded")), key, heads)


def rank_labels(scores: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "label_idx")
    return scores.withColumn("rank", F.row_number().over(order))


def score_pairs() -> Column:
    """The aggregate of an encounter's scores as a map in the labels' order."""
    return F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("label_idx", "label", "score"))), lambda x: F.struct(x["label"], x["score"])))


def score_map(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(score_pairs().alias("behavior_scores"))


def top_extremes(encoded: DataFrame, key: str, limit: float = 6.0, most: int = 10) -> DataFrame:
    """The standardised values beyond ``limit``, the ``most`` largest of each bag; ties in the encoder's order."""
    rows = encoded.where((F.col("pos") % 2 == 0) & (F.abs("value") > limit) & ~F.isnan("value") & (F.abs("value") < float("inf")))
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "pos")
    return rows.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most)


def validate_encoder(encoder: DataFrame) -> DataFrame:
    """One row for each rule that the encoder's rows break: rule, name."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rules = F.array(
        *[F.when(bad(c), F.lit(f"{c} is not finite")) for c in ("median", "mean", "sd")],
        F.when(F.col("sd") <= 0, F.lit("sd is not positive")),
    )
    return encoder.select("name", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")).select("rule", "name")


def validate_heads(heads: DataFrame, n_inputs: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row for each rule that the heads break: rule, name (the label). ``heads`` as of linear_heads, and kind."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kind = ~F.every(F.col("kind").eqNullSafe(F.lit(HEAD_KIND)))
    expected = F.array(*[F.lit(x) for x in labels])
    each = heads.groupBy("label_idx", "label").agg(F.count_distinct("pos").alias("n"), F.bool_or(bad("coef")).alias("coef"), F.bool_or(bad("intercept")).alias("intercept"), kind.alias("kind"))
    rules = F.array(
        F.when(~F.get(expected, F.col("label_idx")).eqNullSafe(F.col("label")), F.lit("label is out of order")),
        F.when(F.col("kind"), F.lit("head kind")),
        F.when(F.col("n") != n_inputs, F.lit("coefficient shape")),
        F.when(F.col("coef"), F.lit("coefficient is not finite")),
        F.when(F.col("intercept"), F.lit("intercept is not finite")),
    )
    found = each.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), F.col("label").alias("name"))
    count = each.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != len(labels)).select(F.lit("number of heads").alias("rule"), F.col("n").cast("string").alias("name"))
    return found.unionByName(count)


def validate_settings(settings: DataFrame, schema_id: str, features: tuple[str, ...], statistics: tuple[str, ...]) -> DataFrame:
    """One row for each rule that the model's settings break: rule, name (the model)."""
    names = F.col("encoder.numeric_features")
    same_length = F.lit(True)
    for part in ("numeric_medians", "numeric_means", "numeric_standard_deviations"):
        same_length = same_length & (F.size(names) == F.size(f"encoder.{part}")) & F.col(f"encoder.{part}").isNotNull()
    outputs = F.flatten(F.transform(names, lambda n: F.array(n, F.concat(n, F.lit("__missing")))))
    rules = F.array(
        F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_id)), F.lit("schema version")),
        F.when(~F.col("per_whistle_features").eqNullSafe(F.array(*[F.lit(x) for x in features])), F.lit("feature list")),
        F.when(~F.col("aggregation_statistics").eqNullSafe(F.array(*[F.lit(x) for x in statistics])), F.lit("statistic list")),
        F.when(~F.coalesce("add_missing_fraction", F.lit(False)), F.lit("missing fractions")),
        F.when(F.col("audit").isNull() | F.col("flags").isNull(), F.lit("audit settings")),
        F.when(F.col("encoder").isNull(), F.lit("encoder missing")),
        F.when(~F.coalesce("has_heads", F.lit(False)), F.lit("heads missing")),
        F.when(~F.coalesce(same_length, F.col("encoder").isNull()), F.lit("encoder lengths")),
        F.when(F.col("encoder").isNotNull() & ~outputs.eqNullSafe(F.col("encoder.output_feature_names")), F.lit("encoder output names")),
    )
    return settings.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), F.col("model_id").alias("name"))


def validate_encoded(encoded: DataFrame, key: str) -> DataFrame:
    """A row for each bag with an encoded value that is not finite: key, name."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return encoded.where(bad).select(key, "name")


def validate_model(encoder: DataFrame, heads: DataFrame, settings: DataFrame, schema_id: str, features: tuple[str, ...], statistics: tuple[str, ...]) -> DataFrame:
    """All rules that a model file's tables break: rule, name; no row for a model that may be used."""
    n_inputs = 2 * len(features) * (len(statistics) + 1)
    return validate_encoder(encoder).unionByName(validate_heads(heads, n_inputs)).unionByName(validate_settings(settings, schema_id, features, statistics))
