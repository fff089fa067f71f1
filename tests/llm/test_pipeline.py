from collections import Counter, defaultdict

import corpus_pipeline
from hydroframe.llm import packing, toxicity
from hydroframe.llm.shared import materialize, table
from tests.llm.helpers import WORD

SMALL = "/root/testdata/sf0.001"


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_do_what_they_say_on_what_the_stage_before_kept(spark):
    docs = table(spark, SMALL, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == columns
        seen.append(docs.collect())
    every, clean, single, apart, mixed = seen
    # toxicity: the rows that the scores reject, and no others, go
    toxic = {r.doc_id for r in toxicity.toxicity_scores(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert sorted(r.doc_id for r in every if r.doc_id not in toxic) == sorted(r.doc_id for r in clean)
    # exact copies: the largest identifier stays
    top = {}
    for r in clean:
        top[r.text or ""] = max(r.doc_id, top.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in single) == sorted(top.values())
    # near copies: the smallest identifier of each component stays
    sets = {r.doc_id: shingle_set(r.text) for r in single}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in apart) == sorted(d for d in sets if root(d) == d)
    # mix: whole rows of what was left, none more than twice
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in apart} and max(copies.values()) <= 2
    # packing: each row's pieces follow one another, cover it and end with the end id
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    coder, pieces = packing.WordIds(packing.tokenizer_path()), defaultdict(list)
    for r in packed:
        assert r.offset == 0 and r.length == 1 << r.bucket
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    texts = {r.doc_id: r.text or "" for r in mixed}
    for doc, own in pieces.items():
        starts = sorted(own)
        once = b"".join(ids for _, ids in starts[:: copies[doc]])
        assert once == coder.ids([texts[doc]])[0] + (2).to_bytes(4, "little") and len(own) % copies[doc] == 0
    assert set(pieces) == set(copies)


def test_stages_take_odd_rows_and_clashing_names(spark):
    names = ["_hash", "_key", "_base", "_threshold", "_copy", "key", "hash", "size", "row", "copies"]
    texts = [None, "", " ", "one two three four five six", "one two three four five six", "\U0001f600 odd", "long words " * 5000] + [f"text number {k} of some words" for k in range(20)]
    rows = [(k, t, ["a", None, "b"][k % 3], *["mine"] * len(names)) for k, t in enumerate(texts)] + [(3, texts[3], "a", *["mine"] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"{n} string" for n in names]]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SMALL), "test-odd")
        assert out.columns == docs.columns and all(r[n] == "mine" for r in out.collect() for n in names)
        assert stage(spark, docs.where("false"), SMALL).count() == 0
        docs = out
    left = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == set(left)
