import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from hydroframe.llm import toxicity
from tests.llm.helpers import ODD_TEXTS


def corpus(n=600):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8)))
    rude = ["zorg", "blarg", "grimbl", "fnord", "quuxly", "wazzok"]
    docs, labels = [], []
    for k in range(n):
        words, bad = [word() for _ in range(40)], k % 5 < 2
        if bad:
            words[3:3] = rng.sample(rude, 3)
        docs.append((k, " ".join(words), "x"))
        labels.append((k, 1, int(bad)))
    return docs, labels


def test_label_model_finds_rates(spark):
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    rates = np.linspace(0.3, 0.8, 16)
    votes = np.where(y[:, None], rng.random((40_000, 16)) < rates, rng.random((40_000, 16)) < 0.02)
    votes[:, 1] = votes[:, 0]  # says the same as its neighbour
    model = toxicity.fit_label_model(len(y), (votes.T.astype(float) @ votes), y.mean())
    assert abs(model.toxic[2:] - rates[2:]).max() < 0.05 and (0, 1) in model.correlated and model.weight[0] == 0.5
    bits = (votes.astype(np.int64) << np.arange(16)).sum(axis=1)
    rows = spark.createDataFrame([(int(b), bool(v)) for b, v in zip(bits[:4000], y[:4000], strict=True)], "votes long, y boolean")
    assert rows.select(((model.posterior(F.col("votes")) > 0.5) == F.col("y")).cast("int").alias("x")).agg(F.avg("x")).first()[0] > 0.98
    yes, no = np.log(model.toxic / model.other), np.log((1 - model.toxic) / (1 - model.other))
    want = 1 / (1 + np.exp(-(np.log(model.prior / (1 - model.prior)) + (model.weight * np.where(votes[0], yes, no)).sum())))
    assert abs(rows.limit(1).select(model.posterior(F.lit(int(bits[0])))).first()[0] - want) < 1e-9


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    rows = docs + [(10_000 + k, t, "x") for k, t in enumerate(ODD_TEXTS)] + [(None, "null name", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(table, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (crc32(str(d).encode()) % 5 == 0) for d, r in got.items() if d is not None)
    held = [d for d, _, _ in labels if got[d].held_out]
    assert len(held) > 50 and np.mean([got[d].predicted == int(d % 5 < 2) for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[10_000].predicted == 0


def test_without_labels_or_rows(spark):
    docs, _ = corpus(20)
    table, none = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(table, none).count() == 20
    assert toxicity.toxicity_scores(table.where("false"), none).count() == 0


def test_most_documents_have_no_label(spark):
    docs, labels = corpus(900)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    few = spark.createDataFrame([x for x in labels if x[0] % 6 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(table, few).collect()}
    rest = [k for k in got if k % 6]
    assert np.mean([got[k] == int(k % 5 < 2) for k in rest]) > 0.95


def test_clean_documents_keep_their_columns(spark):
    docs, labels = corpus()
    rows = [(k, t, k, "a") for k, t, _ in docs] + [(1, docs[1][1], 1, "a"), (None, None, 7, "b"), (3, "", 8, "b"), (70_000, "word " * 200_000, 9, "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _terms int, `Votes.x` string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity.clean_documents(table, given).collect()
    scored = toxicity.toxicity_scores(table, given).where("predicted = 0")
    assert toxicity.clean_documents(table, given).columns == table.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept) == sorted(r.doc_id if r.doc_id is not None else -1 for r in scored.collect())
    assert {7, 8, 9} <= {r._terms for r in kept} and len(kept) < len(rows)
    assert toxicity.clean_documents(table.where("false"), given).count() == 0


def test_voters_of_how_a_text_is_written():
    bit = lambda name: 1 << toxicity.VOTERS.index(name)
    votes = lambda text: toxicity.written_votes(text, toxicity.words_in(text))
    assert votes("a calm note on tides") == 0 and votes("") == 0
    assert votes("You are such an idiot") == bit("insults") | bit("address")
    assert votes("an idiot, that one") == bit("insults")
    assert votes("du bist ein Trottel, wertlos") == bit("insults") | bit("contempt") | bit("address")
    assert votes("an 1d1ot") == 0 and votes("what an id10t or m0r0n!") == bit("disguised")
    assert votes("LOOK HERE NOW, all") == bit("capitals") and votes("well!!!") == bit("marks")
    assert votes("they hate it") == bit("threats")
    assert len(toxicity.VOTERS) < 63 and votes("ab1" * 300_000 + " moron") == bit("insults")


def test_copied_voters_share_a_vote_and_others_do_not():
    rng = np.random.default_rng(5)
    y = rng.random(60_000) < 0.15
    m = len(toxicity.VOTERS)
    votes = np.where(y[:, None], rng.random((60_000, m)) < 0.45, rng.random((60_000, m)) < 0.01)
    votes[:, 9], votes[:, 20] = votes[:, 2], votes[:, 16]
    model = toxicity.fit_label_model(len(y), votes.T.astype(float) @ votes, y.mean())
    assert model.correlated == [(2, 9), (16, 20)]
    assert [k for k, w in enumerate(model.weight) if w == 0.5] == [2, 9, 16, 20] and (np.delete(model.weight, [2, 9, 16, 20]) == 1).all()


def test_company_is_found_without_labels(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.sample(["sand", "tide", "reef", "gull", "kelp", "foam"], 3)) + (" idiot snorbl" if k % 4 == 0 else ""), k % 2) for k in range(400)]
    counts = toxicity.term_counts(spark.createDataFrame(rows, "text string, toxic int"))
    terms = toxicity.choose_terms(counts, 200, 200)
    company = 1 << toxicity.VOTERS.index("company")
    assert {t for t, k in terms.number.items() if terms.votes[k] & company} == {"=snorbl"}
