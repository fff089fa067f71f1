from collections import defaultdict

from pyspark.sql import functions as F

from hydroframe.llm import exact_dedup

TEXTS = [None, "", "a", "a ", "A", "b", "b", "b", "é", "é", "x" * 300_000, "x" * 300_000, "same", "same"]
SCHEMA = "doc_id long, text string, _kept_file string, digest int"


def rows_of():
    rows = [(k, t, "f", 1) for k, t in enumerate(TEXTS)]
    return rows + [(5, "b", "g", 2), (5, "b", "g", 2), (None, "null name", "h", 3), (None, "a", "h", 3)]


def check(got, rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    want = defaultdict(list)
    for text, docs in groups.items():
        top = max((d for d in docs if d is not None), default=None)
        for d in docs:
            want[d].append((top, len(docs)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.keep_id, r.group_size))
    order = lambda x: sorted(x, key=repr)
    assert {k: order(v) for k, v in have.items()} == {k: order(v) for k, v in want.items()}
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_small_triggers_and_colliding_digests(spark, tmp_path):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(6, "doc_id").write.parquet(f"{tmp_path}/docs")
    # a file a micro-batch, so that state is written and met again
    check(exact_dedup.exact_dedup(docs, f"{tmp_path}/docs", max_bytes_per_trigger=1).collect(), rows)
    # a digest that many texts share: bytes decide
    check(exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 0)).collect(), rows)
    check(exact_dedup.exact_dedup(docs.where("false")).collect(), [])


def test_kept_rows_have_all_their_columns(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len({t or "" for t in TEXTS} | {"null name"}) and (12, "same", "f", 1) not in got and (13, "same", "f", 1) in got
    assert exact_dedup.kept_documents(docs.where("false")).count() == 0
