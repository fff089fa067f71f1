import duckdb

from hydroframe.plans import bindings


def test_copies_far_apart_in_a_language_are_found(spark, tmp_path):
    rows = [(1, "x", "en"), (49, "y", "en"), (5_000, "x", "en"), (90_000_000, "x", "en"), (51, "x", "de"), (2, "z", "de"), (7, "x", None), (7_000, "x", None), (9, None, "fr"), (9_000, None, "fr"), (10, "", "fr"), (3, "u", "it"), (8_000, "u", "it"), (4, "v", "it"), (8_001, "v", "it")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in bindings.QUERIES["q5_duplicate_content"](spark, str(tmp_path)).collect()]
    assert {r[0]: r[3] for r in got} == {"en": ["D00000001", "D00005000", "D90000000"], None: ["D00000007", "D00007000"], "fr": ["D00000009", "D00009000"], "it": ["D00000003", "D00000004", "D00008000", "D00008001"]}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(bindings.ORACLES["q5_duplicate_content"]).fetchall(), key=str)
