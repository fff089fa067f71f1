import json
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from hydroframe.llm import packing
from hydroframe.llm.shared import table
from tests.llm.helpers import ODD_TEXTS

SMALL = "/root/testdata/sf0.001"


def test_pieces():
    assert packing.pieces(0) == []
    assert packing.pieces(4096 * 2 + 7) == [4096, 4096, 4, 2, 1]
    assert all(sum(packing.pieces(n)) == n for n in range(1, 9000, 7))


def test_ids_equal_the_tokenizer(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD_TEXTS)] + [(3, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").unionByName(table(spark, SMALL, "documents").selectExpr("doc_id + 100 AS doc_id", "text", "lang AS ids"))
    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(plain.encode(r.text or "", add_special_tokens=False).ids + [2])
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    ids = defaultdict(list)
    for r in got:
        own = np.frombuffer(r.ids, "<u4")
        assert len(own) == r.length == 2**r.bucket and r.length <= 4096 and crc32(r.ids) == r.ids_crc32
        if r.start == 0:
            ids[r.doc_id].append([])
        ids[r.doc_id][-1].extend(own.tolist())
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}


def test_words_equal_the_tokenizer(tmp_path):
    rng = random.Random(1)
    parts = ["'s", "'S", "it's", "I'LL", "a", "É", "ß", "ÿ", "_", "a_b", "x.", "x,", "x.,", "...", ". ", ",", " ", "\n", ".\n", "!", "''s", "9", "1.5", "²", "½", "ª", "µ", "×", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\u0085", "\t", "\x1c", "\xad", "İ", "Σ", "中", "\U0001f600", "e\u0301", "Å", "K", "'re", "$$$", "bar,"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)]
    coder = packing.WordIds(packing.tokenizer_path())
    assert coder.by_word
    # a tokenizer that joins across blanks gets whole texts
    other = json.loads(coder.tokenizer.to_str())
    other["pre_tokenizer"] = other["pre_tokenizer"]["pretokenizers"][1]
    (tmp_path / "other.json").write_text(json.dumps(other))
    whole = packing.WordIds(str(tmp_path / "other.json"))
    assert not whole.by_word
    for own in (coder, whole):
        for t, ids in zip(texts, own.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    coder = packing.WordIds(packing.tokenizer_path())
    texts = [" ".join(f"w{i}x{k}" for i in range(40)) for k in range(10)]
    for t in texts * 2:
        assert np.frombuffer(coder.ids([t])[0], "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(coder.seen) <= 50 + 41


def test_empty_table_and_buckets(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, packing.tokenizer_path()), f"{tmp_path}/b")
    assert {r.bucket: r.n for r in spark.read.parquet(f"{tmp_path}/b").groupBy("bucket").agg({"*": "count"}).toDF("bucket", "n").collect()} == {0: 1, 1: 1, 2: 1}
