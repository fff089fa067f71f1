from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hydroframe.llm import mixing
from hydroframe.llm.shared import shared_root
from tests.llm.helpers import ODD_TEXTS, WORD

SCHEMA = "doc_id long, text string, source string, _size string, `Hash.x` int"


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    out, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        for s in over or open_:
            out[s] = 2.0 * sizes[s] if over else weight[s] * share
        left -= sum(out[s] for s in over)
        open_ = open_ - over if over else set()
    return out


def test_sources_come_near_their_targets(spark):
    rows = [(k, "w " * (k % 37), f"s{k % 5}" if k % 3 else "s0", "v", 1) for k in range(900)]
    rows += [(1000 + k, t, None, "v", 1) for k, t in enumerate(ODD_TEXTS)] + [(7, rows[7][1], rows[7][2], "v", 1), (None, "a b", "s1", "v", 1), (2000, "", "empty", "v", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    plan = mixing.mix_plan(docs)
    got = plan.collect()
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, again))
    for r in got:
        d = r.asDict()
        target = next(v for k, v in d.items() if k.startswith("_target"))
        copies = next(v for k, v in d.items() if k.startswith("_copies"))
        n = size(r.text)
        assert abs(target - want[r.source]) < 1e-6 and 0 <= copies <= 2
        taken[r.source] += n * copies
        longest[r.source] = max(longest[r.source], n)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(size(r.text) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_names_of_helpers_may_stand_in_the_documents(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 9), f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    want = sorted((r.doc_id, r._target, r._copies) for r in mixing.mix_plan(docs).collect())
    names = ["_hash", "_key", "_base", "_threshold", "_limit_key", "key", "hash", "size", "row", "copies", "target", "threshold", "source_size", "prefix", "rest", "words", "_copy", "_size", "_Target", "row.x", "bucket", "at"]
    odd = docs.select("*", *[F.lit("mine").alias(n) for n in names])
    got = mixing.mix_plan(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and len({c.lower() for c in got.columns}) == len(odd.columns) + 4
    rows = got.collect()
    target, copies = got.columns[-2:]
    assert sorted((r.doc_id, r[target], r[copies]) for r in rows) == want and all(r[n] == "mine" for r in rows for n in names)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(n for *_, n in want)


def test_only_what_the_result_reads_stays(spark):
    import os

    there = lambda: {x for x in os.listdir(shared_root(spark).removeprefix("file:")) if x.startswith("mix_")}
    docs = spark.createDataFrame([(k, "w " * (k % 9), "s") for k in range(60)], "doc_id long, text string, source string")
    mixing.mix_plan(docs.limit(1)).count()  # makes the folder
    before = there()
    plan = mixing.mix_plan(docs)
    assert [x.split("_")[1] for x in there() - before] == ["thresholds"] and plan.count() == 60
