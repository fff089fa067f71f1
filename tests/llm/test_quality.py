import random

import numpy as np

from hydroframe.llm import quality
from hydroframe.llm.shared import table
from tests.llm.helpers import ODD_TEXTS, statistics

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def test_chi_square():
    assert abs(quality.chi2_cdf(3.841458820694124, 1) - 0.95) < 1e-9
    assert abs(quality.chi2_quantile(0.975, 5) - 12.832501994) < 1e-6


def test_counts_equal_brute_force(spark):
    rows = [(k, t, "en", None) for k, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(table(spark, SMALL, "documents").selectExpr("-1 - doc_id AS doc_id", "text", "lang", "source"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.text_statistics(docs).collect():
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(80, 300))), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(word() + "$$$" for _ in range(120)), "en", "s") for k in range(20)]
    rows += [(2000, None, None, None), (2001, "", "en", "s")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].kept for k in range(300))
    assert not any(got[1000 + k].kept for k in range(20))
    assert got[2000].base_failed and not got[2000].kept and got[2001].n_words == 0


def test_least_determinant_of_a_group_equals_numpy(spark):
    """Three in ten rows of a group lie together far off: the estimate is that of the rest, and of that group alone."""
    rng = np.random.default_rng(3)
    p = len(quality.FEATURES)
    mix = np.tril(rng.normal(size=(p, p)))
    good = {g: rng.normal(size=(700, p)) @ mix.T + shift for g, shift in (("a", 0.0), ("b", 30.0))}
    rows = [(g, *map(float, x)) for g, own in good.items() for x in own] + [("a", *map(float, x)) for x in rng.normal(size=(150, p)) * 0.1 + 60]
    got = {r.grp: r for r in quality.robust_estimates(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{n} double" for n in quality.FEATURES)).repartition(7)).collect()}
    for g, own in good.items():
        assert abs(np.array([got[g][f"m_{i}"] for i in range(p)]) - own.mean(0)).max() < 0.25
        c = np.array([[got[g][f"c_{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])
        assert abs(c - np.cov(own.T)).max() < 0.25 * abs(np.cov(own.T)).max()
        assert abs(got[g].logdet - np.linalg.slogdet(c + np.diag(np.array(list(quality.FEATURES.values())) ** 2))[1]) < 1e-6
        assert got[g].n <= 700


def test_groups_have_estimates_of_their_own(spark):
    """What is usual in one source is an outlier in another."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda mark: " ".join(word() + mark for _ in range(rng.randint(80, 200)))
    rows = [(k, text(""), "en", "plain") for k in range(400)] + [(1000 + k, text("$$$"), "en", "code") for k in range(400)] + [(5000, text("$$$"), "en", "plain"), (5001, text("") + " w" * 300_000, "en", "plain")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].kept for k in range(400)) and all(got[1000 + k].kept for k in range(400))
    assert not got[5000].kept and got[5001].base_failed


def test_empty_table_and_few_rows(spark):
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, "a b c " * 3 + " ".join(map(str, range(40))), "en", "s")] * 2, SCHEMA + "")
    assert [r.kept for r in quality.quality_rules(few).collect()] == [True, True]
