"""Mixing sources to target weights with histograms over hash thresholds.

Every document has a 48-bit hash. Each source sums its words by hash bucket, the bucket where the
running sum crosses the source's budget is split into finer buckets, and so on down to one hash value;
what lies below that threshold is taken once more. Documents are never sorted or collected: a source
has at most 4096 buckets a level, and the thresholds are one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.llm.shared import fresh_name, materialize, release, table, text_of, words_of

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and a source at most so many times its own.
SHARE, MOST = 1.5, 2.0
LEVELS, BITS = 4, 12


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of md5 over identifier and text, as a long."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size): the target of each source.

    Sources by code point, null last, take the weights in turn. With sources in order of what a unit
    of weight may cost them at most, a source stops at its limit if an equal split of what is left,
    by the weights left, would give it more; all others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))).withColumn("limit", most * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("full", F.col("weight") * F.col("level") >= F.col("limit"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level)).select("source", "source_size", "target")


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each source, its copies of every document and the hash below which one more is taken.

    ``sized``: source, size, hash; ``wanted``: from targets(). The document at the threshold is taken
    if that brings the sum at least as near to the target.
    """
    state = wanted.select(
        source_key(F.col("source")).alias("key"), "source_size", "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).alias("copies"),
    )
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    rows = sized.select(source_key(F.col("source")).alias("key"), "size", "hash")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        sums = (
            rows.withColumn("prefix", F.shiftright("hash", shift + BITS))
            .join(state.select("key", "prefix"), ["key", "prefix"])
            .groupBy("key", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        upto = Window.partitionBy("key").orderBy("bucket")
        cross = (
            sums.join(state.select("key", "rest"), "key")
            .withColumn("sum", F.sum("words").over(upto))
            .where("sum > rest")
            .groupBy("key")
            .agg(F.min(F.struct("bucket", F.col("words"), (F.col("sum") - F.col("words")).alias("below"))).alias("at"))
        )
        # without a crossing all that is left is taken: the threshold lies above every hash
        before, state = state, materialize(
            state.join(cross, "key", "left").select(
                "key", "source_size", "target", "copies",
                (F.col("rest") - F.coalesce("at.below", F.lit(0))).alias("rest"),
                F.coalesce("at.bucket", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
                F.col("at.words").alias("words"),
            ),
            f"mix-level{level}",
        )
        if level > 1:
            release(before)
    above = (F.col("words").isNotNull() & (2 * F.col("rest") >= F.col("words"))).cast("long")
    found = materialize(state.select("key", "source_size", "target", "copies", (F.col("prefix") + above).alias("threshold")), "mix-thresholds")
    release(state)
    return found


def mix_plan(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with _size, _source_size, _target and _copies.

    Rows that repeat an identifier and a text share a hash and are taken alike. A null text has no
    words, a null source is a source of its own. An empty table gives an empty result; other columns
    are carried along.
    """
    sized = materialize(documents.select(F.col("source").cast("string").alias("source"), *measures()), "mix-sizes")
    wanted = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    # one row a source: Spark broadcasts it if its measured size allows
    limits = thresholds(sized, wanted)
    release(sized, wanted)
    # the caller's columns stand in one struct, where their names meet no others
    own = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*own).alias("row"), *measures(), source_key(F.col("source").cast("string")).alias("key")).join(limits, "key")
    copies = F.least(F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(int(MOST)))
    made = zip(("size", "source_size", "target", "copies"), ("size", "source_size", "target", copies), strict=True)
    names = plan_columns(documents)
    return rows.select(*[F.col(f"row.`{c}`") for c in documents.columns], *[(F.col(x) if isinstance(x, str) else x).alias(names[n]) for n, x in made])


def measures() -> list[Column]:
    """size and hash of a document."""
    text = text_of()
    return [F.size(words_of(text)).cast("long").alias("size"), hash_of(F.col("doc_id"), text).alias("hash")]


def plan_columns(documents: DataFrame) -> dict[str, str]:
    """The names that mix_plan() gives its columns: with an underscore before, and more behind where ``documents`` has that name."""
    return {n: fresh_name(documents, f"_{n}") for n in ("size", "source_size", "target", "copies")}


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns, whatever their names."""
    copies = F.col(plan_columns(documents)["copies"])
    own = [F.col(f"`{c}`") for c in documents.columns]
    plan = mix_plan(documents).where(copies > 0)
    return plan.select(*own, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(fresh_name(documents, "_copy"))).select(*own)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2 * source_size / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN w * level >= 2 * source_size THEN 2 * source_size
         ELSE w * max(CASE WHEN w * level < 2 * source_size THEN level END) OVER () END AS target
  FROM l
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), v AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
)
SELECT d.doc_id, d.size::BIGINT AS size, c.source_size::BIGINT AS source_size, c.target AS target,
       (d.size * least(2, c.copies + CASE WHEN v.upto <= c.target - c.copies * c.source_size
         OR (v.upto - v.words <= c.target - c.copies * c.source_size AND 2 * (c.target - c.copies * c.source_size - (v.upto - v.words)) >= v.words)
         THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN v ON v.h = d.h AND v.source IS NOT DISTINCT FROM d.source
"""
