import random

import numpy as np
import pyarrow as pa
import pytest

from hydroframe.llm import jaccard
from hydroframe.llm.shared import table
from tests.llm.helpers import ODD_TEXTS, WORD

SMALL = "/root/testdata/sf0.001"


def plain_set(text, words):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def plain(rows, words, percent):
    """Components by comparing every two rows; equal sets link, empty ones never do."""
    sets = [plain_set(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), names[find(i)]) for i, (doc, _) in enumerate(rows))


def check(spark, rows, words, percent):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, set string, size int").repartition(3)
    got = sorted(tuple(r) for r in jaccard.similarity_components(docs, words, percent).collect())
    assert got == plain(rows, words, percent)


def test_shingles_count_words_as_defined():
    for t in ODD_TEXTS:
        assert len(jaccard.shingles(t or "", 4)) == len(plain_set(t, 4))


def test_prefix_and_overlap_bounds():
    for n in range(1, 300):
        for percent in (80, 85):
            least = -(-percent * n // 100)
            assert jaccard.prefix_length(n, percent) == n - least + 1
            assert jaccard.needed(n, n, percent) <= n
    assert jaccard.needed(np.array([10]), np.array([12]), 85).tolist() == [11]


def test_shared_first_tokens_bound():
    rng = random.Random(1)
    for _ in range(3000):
        percent = rng.choice([80, 85])
        a = set(rng.sample(range(60), rng.randint(1, 50)))
        b = set(a)
        for _ in range(rng.randint(0, 6)):
            b ^= {rng.randrange(60)}
        if b and 100 * len(a & b) >= percent * len(a | b):
            first = [set(sorted(x)[: jaccard.prefix_length(len(x), percent)]) for x in (a, b)]
            assert len(first[0] & first[1]) >= jaccard.shared_least(len(a), len(b), percent)


def test_small_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    check(spark, rows + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS * 2)], 4, 85)


@pytest.mark.parametrize(("words", "percent", "cell"), [(4, 85, 1024), (5, 80, 1024), (4, 85, 4)])
def test_chains_groups_and_shared_passages(spark, words, percent, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_TOKENS", 200)
    monkeypatch.setattr(jaccard, "CELL", cell)  # at 4, most lists are worked on in tiles
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.randint(12, 200))
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if group % 3 == 0:
                text = passage + text
            rows.append(" ".join(text))
    walk = rng.choices(vocabulary, k=90)
    for _ in range(25):  # each a step from the last: the ends are far apart
        walk[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append(" ".join(walk))
    rng.shuffle(rows)
    check(spark, [(7 * k, t) for k, t in enumerate(rows)] + [(7, rows[5]), (7, "another text with the same name")], words, percent)


def test_empty_table(spark):
    assert jaccard.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_early_tokens_bound():
    rng = random.Random(2)
    for _ in range(3000):
        percent = rng.choice([80, 85])
        a = set(rng.sample(range(60), rng.randint(1, 50)))
        b = set(a)
        for _ in range(rng.randint(0, 6)):
            b ^= {rng.randrange(60)}
        if b and 100 * len(a & b) >= percent * len(a | b):
            least, first_a, first_b = jaccard.within_reach(len(a), len(b), percent)
            assert first_a <= jaccard.prefix_length(len(a), percent) and first_b <= jaccard.prefix_length(len(b), percent)
            assert len(set(sorted(a)[:first_a]) & set(sorted(b)[:first_b])) >= least


def test_bitmaps_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(5)
    for size in (1, 30, 147, 1100, 3000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.union1d(a[: -(size // 10) or None], rng.integers(0, 2**63, size // 20).astype(np.uint64))
        c = np.union1d(a, rng.integers(0, 2**63, size).astype(np.uint64))  # with a longer bitmap, if not the longest
        bits = [np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (a, b, c)]
        words = np.array([len(x) for x in bits])
        got = jaccard.differing_bits(np.concatenate(bits), np.cumsum(words) - words, words, 0, np.array([1, 2]) if words[1] >= words[0] else np.array([0, 2]))
        assert got[0] <= len(np.setxor1d(a, b)) and got[1] <= len(np.setxor1d(a, c)) and got[1] > got[0]
    assert len(jaccard.bitmap(np.empty(0, np.uint64))) * 8 == jaccard.BITMAPS[0] and len(jaccard.bitmap(a)) > 64


def test_candidate_pairs_are_added_up_whole():
    rng = random.Random(5)
    rows = [(rng.randrange(6), rng.randrange(6), rng.randrange(1, 4), rng.randrange(1, 9)) for _ in range(400)]
    wanted = {}
    for a, b, shared, least in rows:
        n, m = wanted.get((a, b), (0, least))
        wanted[a, b] = (n + shared, min(m, least))
    cols = lambda part: [np.array(c, np.int64) for c in zip(*part, strict=True)]
    found = jaccard.added_up([cols(rows[:150]), [np.empty(0, np.int64)] * 4, cols(rows[150:])])
    assert {(a, b): (n, m) for a, b, n, m in zip(*(c.tolist() for c in found), strict=True)} == wanted
    assert len(found[0]) == len(wanted)
    assert [len(c) for c in jaccard.added_up([[np.empty(0, np.int64)] * 4])] == [0] * 4


def test_batches_are_cut_at_whole_lists():
    rng = random.Random(6)
    values = sorted(rng.randrange(12) for _ in range(200))
    rows = list(enumerate(values))
    for width in (1, 3, 40, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array([v for _, v in rows[i : i + width]]), pa.array([k for k, _ in rows[i : i + width]])], ["v", "k"]) for i in range(0, 200, width)]
        parts = [list(zip(v.tolist(), k.tolist(), strict=True)) for v, k in jaccard.whole_lists(iter([batches[0].slice(0, 0), *batches]))]
        assert [(k, v) for part in parts for v, k in part] == rows
        seen = [{v for v, _ in part} for part in parts]
        assert all(parts) and sum(map(len, seen)) == len(set(values))
    assert list(jaccard.whole_lists(iter([]))) == []


def test_entries_are_dealt_out_with_every_two_in_one_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 5)
    entries = [(token, s, 10, 0, s, s % 3, s, 0.0) for token, sets in ((1, range(23)), (2, range(20, 22)), (3, [3, 6, 9])) for s in sets]
    lists = spark.createDataFrame(entries, "token long, set long, size long, place int, center long, comp long, pivot long, apart double")
    sets = spark.createDataFrame([(s, bytes([s])) for s in range(23)], "set long, bits binary")
    rows, _ = jaccard._dealt(lists, sets)
    together, bits = {}, set()
    for r in rows.collect():
        if r.entry:
            together.setdefault((r.portion, r.token, r.low, r.high), []).append((r.set, r.cell))
        else:
            assert bytes(r.bits) == bytes([r.set]) and (r.portion, r.set) not in bits
            bits.add((r.portion, r.set))
    met = [(token, *sorted((x, y))) for (_, token, low, high), own in together.items() for i, (x, c) in enumerate(own) for y, d in own[:i] if low == high or c != d]
    wanted = [(1, i, j) for j in range(23) for i in range(j)] + [(2, 20, 21)]  # the third list is one component's
    assert sorted(met) == sorted(wanted)
    assert {(p, s) for (p, *_), own in together.items() for s, _ in own} == bits
