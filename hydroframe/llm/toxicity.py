"""Toxicity by weak supervision.

Voters of different kinds look at each text: lexicons and patterns of beginnings mined from labelled
texts, hand-written lexicons, words that keep company with those (found without labels), and patterns
of how a text is written (capitals, repeated marks, disguised spelling, insults that address someone).
A generative label model, fitted to how the voters agree over all documents, gives each voter's
accuracy for both classes and finds voters that agree more than their accuracies explain; such voters
share one vote. Its posterior labels of documents, labelled or not, train a linear classifier over the
terms, which scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import bounded_batches, materialize, portions, release, table, text_of

#: Terms that the classifier sees at most, by their weight of evidence.
TERMS = 4096
#: Mined voters of each kind (whole words, beginnings).
MINED = 8
#: Hand-written lexicons, fixed values: insults to persons, words of contempt, threats.
LEXICONS = [
    """idiot idiots moron morons loser losers fool fools jerk liar coward creep freak clown imbecile scum vermin
    trottel versager abschaum feigling dummkopf imbécile menteur crétin abruti idiota imbécil mentiroso cobarde escoria""".split(),
    """stupid dumb pathetic worthless disgusting trash garbage useless ugly filthy ridiculous
    dumm wertlos ekelhaft widerlich erbärmlich stupide minable dégoûtant ordure estúpido asqueroso inútil basura""".split(),
    """hate kill shut destroy hurt hasse stirb verschwinde déteste crève odio muere cállate""".split(),
]
LEXICON_WORDS = frozenset(w for own in LEXICONS for w in own)
#: Three words of capitals in a row; a mark three times; a word with a digit or sign among its letters.
CAPITALS, MARKS, DISGUISED = re.compile(r"(?:\b[A-Z]{3,}\b\W{1,3}){2}[A-Z]{3,}\b"), re.compile(r"!{3}|\?{3}"), re.compile(r"(?<![^\W_])[a-z]++[@$0-9][a-z@$0-9]*+")
#: What stands for a letter in disguised words.
LETTERS = str.maketrans("@430157$", "aaeoists")
#: A word of address, and a word of the lexicons among the next four.
ADDRESS = re.compile(r"\b(?:you|your|du|dein|deine|tu|toi|ton|vous|tú|usted|eres)\b(?:\W{1,3}\w++){0,3}?\W{1,3}(?:" + "|".join(sorted(LEXICON_WORDS)) + r")\b")
#: The voters in their order.
VOTERS = [f"words {k}" for k in range(MINED)] + [f"beginnings {k}" for k in range(MINED)] + ["insults", "contempt", "threats", "company", "capitals", "marks", "disguised", "address"]
#: Bytes of text whose terms are counted at a time.
COUNTED = 1_500_000
#: Beginnings of words that count as terms.
STEMS = (4, 5, 6)
#: Labelled texts that hold a term at least.
LEAST_TEXTS = 3
#: Labelled rows that are learnt from at most, those with the least hash of their identifier. With the
#: bound, some 16 bytes a row are broadcast, and no text is shuffled to meet its label.
LABELLED = 100_000
#: Documents with a posterior label that the classifier is fitted to, about so many at most, chosen by
#: a hash of their terms; rows with equal terms are one row with their number as its weight.
POSTERIORS = 100_000
#: Least share of toxic texts among those with a term, for it to stand in a voter's list. Its gain must
#: also be more than chance gives the best of so many terms.
VOTER_SHARE = 0.8
#: Covariance beyond the model's, as a share of the voters' deviations, from which voters count as correlated.
CORRELATED = 0.15

WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text: ``=word`` and ``stem*``, lower case."""
    words = words_in(text)
    found = {"=" + w for w in words}
    for n in STEMS:
        found.update([w[:n] + "*" for w in words if len(w) >= n])
    return found


def term_counts(labelled: DataFrame) -> DataFrame:
    """Of (text, toxic): term, toxic texts and other texts that hold it, and those of both with a word of the lexicons. Counts over all rows.

    The empty term stands in every text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(0), batch.column(1).to_pylist()
            for at, stop in portions(texts, COUNTED):
                counts = (Counter(), Counter(), Counter())
                for k in range(at, stop):
                    own = terms_of(texts[k].as_py()) | {""}
                    counts[toxic[k]].update(own)
                    if any("=" + w in own for w in LEXICON_WORDS):
                        counts[2].update(own)
                for kind, own in enumerate(counts):
                    n, none = pa.array(own.values(), pa.int64()), pa.array(np.zeros(len(own), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), *[n if kind == c else none for c in (1, 0, 2)]], ["term", "toxic", "other", "beside"])

    each = labelled.select("text", (F.col("toxic") == 1).cast("int").alias("toxic")).mapInArrow(run, "term string, toxic long, other long, beside long")
    return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("toxic", "other", "beside")])


@dataclass(frozen=True)
class Terms:
    """The classifier's terms by number, and the voters that each stands in, as bits."""

    number: dict[str, int]
    votes: list[int]


def information(with_a: Column, with_b: Column, n_a: int, n_b: int) -> Column:
    """What a term, held by so many texts of two classes, tells about the class, in nats."""
    a, b = (with_a + 0.5) / (n_a + 1.0), (with_b + 0.5) / (n_b + 1.0)
    p = n_a / max(1, n_a + n_b)
    q = p * a + (1 - p) * b
    return p * a * F.log(a / q) + (1 - p) * b * F.log(b / q) + p * (1 - a) * F.log((1 - a) / (1 - q)) + (1 - p) * (1 - b) * F.log((1 - b) / (1 - q))


def choose_terms(counts: DataFrame, n_toxic: int, n_other: int) -> Terms:
    """The TERMS terms with the largest information gain, and the mined voters that they stand in.

    In order of gain, so with like terms one after the other, terms that speak for toxicity are dealt
    to the voters of their kind in turn, so that each knows a part of every vocabulary. Words that are met with the lexicons' words rather than without, whatever the labels
    say, vote as their company. A bounded number of rows comes to the driver: the largest of an
    ordered list.
    """
    n = n_toxic + n_other
    gain = information(F.col("toxic"), F.col("other"), n_toxic, n_other)
    counts = materialize(counts.where(F.col("toxic") + F.col("other") >= LEAST_TEXTS), "toxicity-counts")
    beside = sum(r.beside for r in counts.where("term = ''").select("beside").collect())
    near = information(F.col("beside"), F.col("toxic") + F.col("other") - F.col("beside"), beside, n - beside)
    best = counts.where("term <> ''").withColumns({"gain": gain, "near": near}).orderBy(F.desc("gain"), "term").limit(TERMS).collect()
    chance = np.log(max(1, counts.count())) / n
    release(counts)
    votes, turn = [], [0, 0]
    for r in best:
        whole, held, vote = int(r.term[0] == "="), r.toxic + r.other, 0
        if r.gain >= chance and r.toxic >= VOTER_SHARE * held:
            vote |= 1 << (turn[whole] % MINED + (0 if whole else MINED))
            turn[whole] += 1
        if whole and r.term[1:] not in LEXICON_WORDS and r.near >= chance and r.beside >= VOTER_SHARE * held:
            vote |= 1 << VOTERS.index("company")
        votes.append(vote)
    return Terms({r.term: k for k, r in enumerate(best)}, votes)


def written_votes(text: str, words: set[str]) -> int:
    """The votes, as bits, of the hand-written lexicons and of the patterns of how a text is written."""
    vote, lexicons = 0, VOTERS.index("insults")
    listed = not LEXICON_WORDS.isdisjoint(words)
    if listed:
        for k, own in enumerate(LEXICONS):
            vote |= (not words.isdisjoint(own)) << (lexicons + k)
    for name, pattern in (("capitals", CAPITALS), ("marks", MARKS)):
        vote |= (pattern.search(text) is not None) << VOTERS.index(name)
    lower = text.lower()
    if any(w.translate(LETTERS) in LEXICON_WORDS for w in DISGUISED.findall(lower)):
        vote |= 1 << VOTERS.index("disguised")
    if listed and ADDRESS.search(lower):
        vote |= 1 << VOTERS.index("address")
    return vote


class Finder:
    """The numbers of the terms that a text holds."""

    def __init__(self, terms: Terms):
        self.whole = {t[1:]: k for t, k in terms.number.items() if t[0] == "="}
        self.stems = [(n, {t[:-1]: k for t, k in terms.number.items() if t[0] != "=" and len(t) == n + 1}) for n in STEMS]

    def __call__(self, text: str) -> list[int]:
        return self.of_words(words_in(text))

    def of_words(self, words: set[str]) -> list[int]:
        own = [self.whole[w] for w in words & self.whole.keys()]
        for n, numbers in self.stems:
            own += [numbers[s] for s in {w[:n] for w in words} & numbers.keys()]
        return sorted(own)


def found_terms(text: Column, terms: Terms) -> Column:
    """Of a text: the numbers of the terms that it holds, and its votes as bits."""
    find, votes_of = Finder(terms), terms.votes

    @F.arrow_udf("struct<terms: array<int>, votes: bigint>")
    def found(texts: pa.Array) -> pa.Array:
        flat, ends, votes = [], [0], []
        for x in texts:
            text = x.as_py()
            words = words_in(text)
            own, vote = find.of_words(words), written_votes(text, words)
            for k in own:
                vote |= votes_of[k]
            flat += own
            ends.append(len(flat))
            votes.append(vote)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(votes, pa.int64())], ["terms", "votes"])

    return found(text)


@dataclass(frozen=True)
class LabelModel:
    """Class share, each voter's rate of votes in toxic and other texts, and the weight of its vote."""

    prior: float
    toxic: np.ndarray
    other: np.ndarray
    weight: np.ndarray
    correlated: list[tuple[int, int]]

    def posterior(self, votes: Column) -> Column:
        """The share of class 1 among texts with these votes, given as bits."""
        yes, no = np.log(self.toxic / self.other), np.log((1 - self.toxic) / (1 - self.other))
        logit = F.lit(float(np.log(self.prior / (1 - self.prior)) + (self.weight * no).sum()))
        for k, w in enumerate(self.weight * (yes - no)):
            logit = logit + F.when(votes.bitwiseAND(F.lit(1 << k)) != 0, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def fit_label_model(n: int, together: np.ndarray, prior: float) -> LabelModel:
    """Fit to the counts of texts in which two voters vote together (alone on the diagonal).

    If voters are independent given the class, their covariances are products of one number a voter:
    the root of prior (1 - prior) times the difference of its rates. These numbers are fitted to the covariances;
    the pairs whose covariance stands out from the fit count as correlated, and the rest is fitted anew.
    """
    m = len(together)
    rate = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(rate, rate)
    dev = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    use = ~np.eye(m, dtype=bool) & (np.outer(rate, rate) > 0)
    d, correlated = np.sqrt(prior * (1 - prior)) * np.sqrt(np.maximum(rate, 0)), []
    for _ in range(4):
        for _ in range(200):
            d = 0.5 * d + 0.5 * ((cov * use) @ d) / np.maximum((use * d**2).sum(axis=1), 1e-12)
        over = use & ((cov - np.outer(d, d)) / np.outer(dev, dev) > CORRELATED)
        if not over.any():
            break
        correlated += [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(over)), strict=True)]
        if ((use & ~over).sum(axis=1)[rate > 0] < 2).any():
            break
        use &= ~over
    # the two rates lie between 0 and 1 and average to the voter's rate
    gap = np.clip(d / np.sqrt(prior * (1 - prior)), 0, np.minimum(rate / prior, (1 - rate) / (1 - prior)))
    toxic, other = np.clip(rate + (1 - prior) * gap, 1e-4, 1 - 1e-4), np.clip(rate - prior * gap, 1e-4, 1 - 1e-4)
    group = list(range(m))
    for i, j in correlated:
        old, new = group[j], group[i]
        group = [new if g == old else g for g in group]
    weight = np.asarray([1 / group.count(g) for g in group], float)
    return LabelModel(prior, toxic, other, weight, correlated)


def voting_counts(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and texts in which voters i and j vote, over all rows; a bounded matrix."""
    m = len(VOTERS)
    bit = lambda k: F.col("votes").bitwiseAND(F.lit(1 << k)) != 0
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(bit(i) & bit(j)).alias(f"c_{i}_{j}") for i in range(m) for j in range(i + 1)]).first()
    out = np.zeros((m, m))
    for i in range(m):
        for j in range(i + 1):
            out[i, j] = out[j, i] = sums[f"c_{i}_{j}"]
    return sums["n"], out


@dataclass(frozen=True)
class Classifier:
    terms: Terms
    intercept: float
    weights: np.ndarray
    labels: LabelModel | None = None

    def score(self, terms: Column) -> Column:
        """From 0 to 1, of a list of term numbers."""
        weights, intercept = self.weights, self.intercept

        @F.arrow_udf("double")
        def score(ids: pa.Array) -> pa.Array:
            lengths = np.asarray(ids.value_lengths(), np.int64)
            flat = np.asarray(ids.flatten(), np.int64)
            logit = intercept + np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights[flat] if len(flat) else None, len(lengths))
            return pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

        return score(terms)

    def is_toxic(self, text: Column) -> Column:
        """Whether a text's score is 0.5 at least, from the text in one step."""
        weights, intercept, find = self.weights, self.intercept, Finder(self.terms)

        @F.arrow_udf("boolean")
        def toxic(texts: pa.Array) -> pa.Array:
            return pa.array([bool(intercept + weights[find(x.as_py())].sum() >= 0) for x in texts], pa.bool_())

        return toxic(text)


def train(documents: DataFrame, labels: DataFrame) -> tuple[Classifier, DataFrame]:
    """A classifier, and doc_id, terms and votes of all documents, a table to be released.

    Rows of ``labels`` (doc_id, toxic) given choose the terms; how voters agree is counted over all
    documents, and posterior labels of documents, whether labelled or not, fit the classifier.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    bounded_batches(documents.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    toxic = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    labelled = materialize(documents.select(doc_id.alias("doc_id"), text_of().alias("text")).join(F.broadcast(toxic), "doc_id").select("text", "toxic"), "toxicity-labelled")
    n = {r.toxic: r.n for r in labelled.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    terms = choose_terms(term_counts(labelled), n_toxic, n_other) if n_toxic else Terms({}, [])
    release(labelled)
    rows = materialize(documents.select(doc_id.alias("doc_id"), found_terms(text_of(), terms).alias("found")).select("doc_id", "found.*"), "toxicity-terms")
    prior = (n_toxic + 0.5) / (n_toxic + n_other + 1)
    if not terms.number or not n_other:
        return Classifier(terms, float(np.log(prior / (1 - prior))), np.zeros(len(terms.number))), rows
    n_all, together = voting_counts(rows)
    model = fit_label_model(n_all, together, prior)
    steps = 1 << 30
    chosen = rows.where(F.pmod(F.xxhash64("terms", "votes"), F.lit(steps)) < int(steps * min(1.0, POSTERIORS / max(1, n_all))))
    chosen = chosen.groupBy("terms", "votes").agg(F.count(F.lit(1)).alias("n")).withColumn("share", model.posterior(F.col("votes")))
    # a soft label is two rows that share its weight
    both = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), (F.col("n") * w).alias("weight")) for y, w in ((1.0, F.col("share")), (0.0, 1 - F.col("share")))]))
    both = materialize(chosen.select(F.col("terms").cast("array<string>").alias("terms"), both.alias("x")).select("terms", "x.*").where("weight > 0"), "toxicity-posteriors")
    numbers = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(terms.number))], "terms", "features")
    fitted = LogisticRegression(regParam=1e-4, maxIter=30, standardization=False, weightCol="weight").fit(numbers.transform(both).select("features", "label", "weight"))
    release(both)
    return Classifier(terms, float(fitted.intercept), fitted.coefficients.toArray(), model), rows


def is_held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def given_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~is_held_out())


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, score and predicted; labels of held-out documents are not read.

    A null or empty text has the score of a text without any term. Rows that repeat are scored each
    for itself; null labels and identifiers teach nothing; without toxic labels every score is the
    share of toxic labels. An empty table gives an empty result; other columns are ignored.
    """
    classifier, rows = train(documents, given_labels(labels))
    scored = rows.select("doc_id", classifier.score(F.col("terms")).alias("score"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text is not predicted toxic, with all their columns, whatever their names.

    Null, empty and repeated rows and empty tables are treated as in toxicity_scores(). Terms are found
    anew, since the other way is to write or to shuffle every text once more.
    """
    classifier, rows = train(documents, given_labels(labels))
    release(rows)
    return documents.where(~classifier.is_toxic(text_of()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
