"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap; a candidate that breaks its kind's rules (a
check sum, an impossible area) is none. Format and context of each candidate make a row of features.
Boosted trees learn from the base kinds' checks and, for the other kinds, from evidence that no feature
holds: words before a span that speak for or against its kind. Their scores choose, by thresholds
calibrated for each kind, which candidates are added to the validated ones.
Everything runs as built-in functions: spans and features in array functions inside the row, the
trees as CASE expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import materialize, release, table, text_of

#: Kind, pattern, and a character without which the text can't match. The first four are the base kinds.
#: Possessive repeats and the look-behinds keep long runs linear: a match that fails from the start of
#: a run fails from every later place in it, and after a match the search goes on where that ended.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("email_words", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{2,64}(?:\x20?[(\[](?:dot|DOT)[)\]]\x20?[A-Za-z0-9-]{2,64}){1,4}", None),
    ("phone_local", r"(?<![0-9+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
]
N_BASE = 4
#: Characters on either side of a candidate that count as its context.
CONTEXT = 32
#: Words before a candidate that speak for a kind that is not a base kind, and those that speak against all.
CUES = {"email_words": "mail|contact|write", "phone_local": "phone|tel|call|mobil|fax", "national_id": "id|ssn|social|passport", "iban": "iban|account|konto|bank|pay"}
AGAINST = "part|order|invoice|ref|sku|model|version|serial|ticket|tracking|isbn|item|batch"
#: Groups that the other words of a context are hashed to.
WORD_GROUPS = 16
#: Candidates to train on (about so many at most, in equal parts by kind, chosen by hash, and at most half of a kind), trees, their depth.
TRAIN_ROWS, TREES, DEPTH = 20_000, 10, 3
#: A threshold is the least score that the evidence doesn't speak against: at which the share of valid candidates, of
#: those of a kind outside the training rows that have a label, may be this by a Wilson interval of Z deviations.
PRECISION, Z = 0.95, 1.96
#: A threshold that no score reaches, and the steps of the hash that chooses training rows.
NEVER, STEPS = 2.0, 1 << 30
SPAN = "array<struct<start: int, end: int, value: string, before: string, behind: string>>"


def matches(text: Column, pattern: str, needs: str | None) -> Column:
    """All leftmost non-overlapping matches with their places in code points, in order, and what stands on either side, in lower case.

    The gaps between matches and the matches themselves add up to the places. A context is CONTEXT
    characters long, or as long as the gap to the match beside it, so that no place is searched from the text's begin.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    gaps = F.split(text, pattern, -1)

    def step(at, x):
        start = at + F.length(x["0"])
        end = start + F.length(x["1"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["1"].alias("value"), F.lower(F.right(x["0"], F.lit(CONTEXT))).alias("before"), F.lower(F.left(x["2"], F.lit(CONTEXT))).alias("behind"))

    # a gap stands before each match and behind the last
    items = let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda v: F.transform(v["found"], lambda m, i: F.struct(F.get(v["gaps"], i).alias("0"), m.alias("1"), F.get(v["gaps"], i + 1).alias("2"))))
    return walked(items, step, SPAN)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda a column that isn't its variable is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walked(items: Column, step, kind: str) -> Column:
    """The array that ``step`` makes of ``items`` in order; it takes a number and an item to the next number and an element, or to null for none.

    Appending copies an array, so elements are gathered in blocks of about the root of their number.
    """
    state = f"struct<at: int, out: array<{kind[6:-1]}>>"
    blocks = f"struct<at: int, out: array<array<{kind[6:-1]}>>>"

    def inner(a, x):
        def grown(next_):
            at, element = next_["at"], next_["element"]
            return F.struct(at.cast("int").alias("at"), F.when(element.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(element))).alias("out")).cast(state)

        at, element = step(a["at"], x)
        return let(F.struct(at.alias("at"), element.alias("element")), grown)

    def whole(v):
        items, block = v["items"], v["block"]

        def outer(a, k):
            own = F.aggregate(F.slice(items, k * block + 1, block), F.struct(a["at"].alias("at"), F.array().alias("out")).cast(state), inner)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(a["out"], F.array(o["out"])).alias("out")).cast(blocks))

        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / block) - 1, F.lit(0)).cast("int"))
        return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(blocks), outer, lambda a: F.flatten(a["out"]))

    block = lambda v: F.struct(v.alias("items"), F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(v)))).cast("int").alias("block"))
    return F.when(F.size(items) > 0, let(let(items, block), whole)).otherwise(F.array().cast(kind))


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def iban_sum(value: Column) -> Column:
    """Whether an IBAN of 15 to 34 characters leaves 1 modulo 97, its first four put last and letters read as 10 to 35."""
    whole = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(whole, 5, 40), F.substring(whole, 1, 4))

    def add(rest, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.length(whole).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1)


def well_formed(kind: int, value: Column) -> Column:
    """Whether a candidate of a kind that is not a base kind keeps that kind's rules; base kinds have checks instead."""
    if KINDS[kind][0] == "email_words":
        return value.rlike(r"^[A-Za-z0-9].*[)\]]\x20?[A-Za-z]{2,}$")
    if KINDS[kind][0] == "phone_local":
        return value.rlike(r"^(?:\([2-9]|[2-9][0-9]{2}([\x20.-])[0-9]{3}\1)")
    if KINDS[kind][0] == "national_id":
        return value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    if KINDS[kind][0] == "iban":
        return iban_sum(value)
    return F.lit(True)


def label(kind: int, value: Column, before: Column) -> Column:
    """What is known of a candidate: the base kinds' checks; of others a word before it that speaks for its kind or against, null if none or both do."""
    name, digits = KINDS[kind][0], F.regexp_replace(value, "[^0-9]", "")
    if name == "email":
        return F.lit(True)
    if name == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if name == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if name == "phone":
        return F.length(digits).between(9, 15)
    speaks, denies = before.rlike(rf"\b(?:{CUES[name]})"), before.rlike(rf"\b(?:{AGAINST})")
    return F.when(speaks != denies, speaks)


def word_groups(before: Column) -> Column:
    """Groups of the words of a context, without those that label() looks for."""
    cues = "|".join([*CUES.values(), AGAINST])
    words = F.split(F.regexp_replace(before, rf"\b(?:{cues})\w*", " "), r"\W+")
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.crc32(w.cast("binary")) % WORD_GROUPS)


def features(kind: int, c: Column, n_email: Column, n_phone: Column) -> Column:
    """Kind, format and context of a candidate, as doubles; neither checks nor the words that label() looks for are among them."""
    value, before, behind = c["value"], c["before"], c["behind"]
    count = lambda x, p: F.length(F.regexp_replace(x, f"[^{p}]", ""))
    return F.array(*[x.cast("double") for x in [
        F.length(value), count(value, "0-9"), count(value, "A-Za-z"), count(value, " ().-"), count(value, "."), count(value, "@"), count(value, "+("),
        F.size(F.array_distinct(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))),
        F.substring(before, -1, 1).rlike("[a-z0-9@=/]"), F.substring(behind, 1, 1).rlike("[a-z0-9@=/]"),
        count(before, "0-9"), count(behind, "0-9"), count(before, "#:=/"), count(behind, "#:=/"), n_email, n_phone,
        *[F.lit(k == kind) for k in range(len(KINDS))], *[F.array_contains(c["groups"], F.lit(g).cast("long")) for g in range(WORD_GROUPS)],
    ]])


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and all generators' candidates: (start, kind_no, end, valid, x), x the features and valid their label()."""
    rows = documents.select("doc_id", text_of().alias("text"))
    kept = lambda k: (lambda found: found if k < N_BASE else F.filter(found, lambda c: well_formed(k, c["value"])))
    rows = rows.select("doc_id", *[kept(k)(matches(F.col("text"), p, needs)).alias(f"k{k}") for k, (_, p, needs) in enumerate(KINDS)])
    n_email, n_phone = F.size("k0"), F.size("k3")

    def full(k):
        grouped = F.transform(f"k{k}", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["before"].alias("before"), c["behind"].alias("behind"), word_groups(c["before"]).alias("groups")))
        return F.transform(grouped, lambda c: F.struct(c["start"].alias("start"), F.lit(k).alias("kind_no"), c["end"].alias("end"), label(k, c["value"], c["before"]).alias("valid"), features(k, c, n_email, n_phone).alias("x")))

    return rows.select("doc_id", F.concat(*[full(k) for k in range(len(KINDS))]).alias("found"))


def tree_expression(lines: list[str]):
    """A function from features to a tree's value, from the model's printed form."""
    lines = [x.strip() for x in lines]

    def read(at: int):
        if lines[at].startswith("Predict:"):
            value = float(lines[at].split(":")[1])
            return (lambda x: F.lit(value)), at + 1
        feature, cut = re.match(r"If \(feature (\d+) <= (.+)\)", lines[at]).groups()
        low, at = read(at + 1)
        high, at = read(at + 1)
        return (lambda x: F.when(F.get(x, F.lit(int(feature))) <= float(cut), low(x)).otherwise(high(x))), at

    return read(0)[0]


@dataclass(frozen=True)
class Model:
    """Boosted trees as expressions, and the least score of each kind."""

    trees: list
    thresholds: dict[int, float]

    def score(self, x: Column) -> Column:
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + weight * tree(x)
        return 1 / (1 + F.exp(-2 * margin))


def may_be(good: float, n: float) -> bool:
    """Whether a share of ``good`` of ``n`` leaves it open that the true share is PRECISION: the upper end of the Wilson interval reaches it."""
    share, spread = good / n, Z * Z / n
    upper = (share + spread / 2 + Z * (share * (1 - share) / n + spread / (4 * n)) ** 0.5) / (1 + spread)
    return good == n or upper >= PRECISION


def train(found: DataFrame) -> Model:
    """Fit trees and a threshold for each kind to the candidates with a label; no trees, and one score, if all are of one class.

    Only the trees' sample is bounded, where each kind weighs the same; a threshold is taken over all
    labelled candidates of its kind outside that sample, or over those in it if there are no others. A kind
    that no label speaks against keeps all its candidates.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    every = found.select("doc_id", F.explode("found").alias("c")).select(F.pmod(F.xxhash64("doc_id", "c.start", "c.kind_no"), F.lit(STEPS)).alias("h"), F.col("c.kind_no").alias("kind_no"), F.col("c.valid").cast("double").alias("label"), F.col("c.x").alias("x"))
    rows = every.where("label IS NOT NULL")
    numbers = every.groupBy("kind_no").agg(F.count("label").alias("known")).collect()  # a row a kind
    counts = {r.kind_no: r.known for r in numbers if r.known}
    limits = [int(STEPS * min(0.5, TRAIN_ROWS / len(counts) / counts[k])) if k in counts else 0 for k in range(len(KINDS))]
    weights = [1 / min(counts[k] / 2, TRAIN_ROWS / len(counts)) if k in counts else 0.0 for k in range(len(KINDS))]
    of_kind = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("kind_no"))
    inside = F.col("h") < of_kind(limits)
    sample = materialize(rows.where(inside).withColumn("weight", of_kind(weights)).repartition(2), "pii-train")
    trees = []
    if sample.select("label").distinct().count() == 2:
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, featuresCol="features", weightCol="weight").fit(sample.select(array_to_vector("x").alias("features"), "label", "weight"))
        parts = re.split(r"\n\s*Tree \d+ \(weight ([-0-9.E]+)\):\n", fitted.toDebugString)
        trees = [(float(w), tree_expression(x.rstrip("\n").split("\n"))) for w, x in zip(parts[1::2], parts[2::2], strict=True)]
    release(sample)
    model = Model(trees, {})
    bins = rows.groupBy("kind_no", inside.alias("inside"), F.floor(100 * model.score(F.col("x"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
    thresholds = dict.fromkeys(range(len(KINDS)), NEVER)
    for k in (r.kind_no for r in numbers):
        own = [r for r in bins if r.kind_no == k]
        own = sorted([r for r in own if not r.inside] or own, key=lambda r: -r.bin)
        n = good = 0
        open_ = True
        for r in own:
            n, good = n + r.n, good + r.good
            open_ = may_be(good, n)
            if open_:
                thresholds[k] = r.bin / 100
        if open_:  # no label speaks against lower scores
            thresholds[k] = 0.0
    return Model(trees, thresholds)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (start, kind_no, end, kind), in that order; and n_candidates.

    All valid matches of the base kinds; of the other kinds those that keep their kind's rules, whose score
    reaches their kind's threshold and that overlap no base span. Null and empty texts have none. Rows that repeat are treated each
    for itself; an empty table gives an empty result; other columns are ignored.
    """
    found = materialize(candidates(documents), "pii-candidates")
    model = train(found)
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    base = F.filter("found", lambda c: (c["kind_no"] < N_BASE) & c["valid"])
    rows = found.select("doc_id", "found", base.alias("base"))
    threshold = F.array(*[F.lit(model.thresholds[k]) for k in range(len(KINDS))])
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.filter("found", lambda c: (c["kind_no"] >= N_BASE) & (F.floor(100 * model.score(c["x"])) / 100 >= F.get(threshold, c["kind_no"])) & apart(c))
    name = lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"), F.get(kinds, c["kind_no"]).alias("kind"))
    return rows.select("doc_id", F.sort_array(F.transform(F.concat("base", more), name)).alias("spans"), F.size("found").alias("n_candidates"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands."""

    def step(at, s):
        inside = s["start"] < at
        piece = F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(inside, at).otherwise(s["end"]), F.when(~inside, F.struct(piece.alias("piece"), s["end"].alias("end")))

    def whole(pieces):
        rest = F.coalesce(F.get(pieces, F.size(pieces) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""), F.substring(text, rest + 1, F.length(text)))

    return let(walked(spans, step, "array<struct<piece: string, end: int>>"), whole)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")
    base = F.filter("spans", lambda s: s["kind_no"] < N_BASE)
    return found.select("doc_id", *[count(k) for k in range(N_BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_candidates")
