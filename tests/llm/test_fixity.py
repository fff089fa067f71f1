from hydroframe.llm import fixity

PAGES = "page_id long, url string, html string, state string"


def audit(spark, ours, theirs):
    a, b = (fixity.leaves(spark.createDataFrame([(*r, "x") for r in rows], PAGES)) for rows in (ours, theirs))
    rows = fixity.fixity_audit(a, fixity.tree(a), b, fixity.tree(b)).collect()
    names = {r.record_id: r.page_id for r in a.union(b).collect()}
    return sorted((names[r.record_id] if names[r.record_id] is not None else -1, r.state) for r in rows)


def test_only_what_differs_is_named(spark):
    ours = [(k, f"http://h/{k}", f"page {k} " * (k % 7)) for k in [*range(40), 110, 111, 4096, 9000]]
    ours += [(None, "http://n", "no name"), (None, "http://m", None), (5, "http://h/5", "second capture"), (6, None, None)] + [(7, "http://h/7", ours[7][2])] * 3
    change = lambda k, f: [(*r[:2], f(r[2])) if r[0] == k else r for r in ours]
    assert audit(spark, ours, list(reversed(ours))) == []
    # bytes changed and of another length: those after it stay sound
    assert audit(spark, ours, change(13, lambda h: h + "é")) == [(13, "altered")]
    assert audit(spark, ours, change(0, lambda h: "")) == []
    assert audit(spark, ours, [(None, "http://m", "") if r[1] == "http://m" else r for r in ours]) == []
    assert audit(spark, ours, [(None, "http://m", "x") if r[1] == "http://m" else r for r in ours]) == [(-1, "altered")]
    # lost, added, repeated
    assert audit(spark, ours, [r for r in ours if r[0] != 2]) == [(2, "missing")]
    assert audit(spark, ours, [*ours, (2, "http://other", "y")]) == [(2, "extra")]
    assert audit(spark, ours, [*ours, (70_000, "http://far", "y")]) == [(70_000, "extra")]
    assert audit(spark, ours, [*ours, ours[7]]) == [(7, "altered")]
    # one of two captures
    assert audit(spark, ours, [r for r in ours if r[2] != "second capture"]) == [(5, "altered")]


def test_empty_and_long(spark):
    page = [(1, "u", "é" * 300_000)]
    assert audit(spark, [], []) == []
    assert audit(spark, page, []) == [(1, "missing")] and audit(spark, [], page) == [(1, "extra")]
    assert audit(spark, page, [(1, "u", "é" * 299_999 + "e")]) == [(1, "altered")]


def test_places_are_those_of_the_file(spark):
    rows = [(3, "u", "abc", "x"), (1, "v", "é", "x"), (1, "v", "é", "x"), (2, None, None, "x")]
    got = fixity.leaves(spark.createDataFrame(rows, PAGES)).orderBy("lo").collect()
    assert [r.page_id for r in got] == [1, 2, 3] and [r.copies for r in got] == [2, 1, 1]
    assert got[0].lo == 0 and got[0].hi == 2 * got[0].bytes and [r.lo for r in got[1:]] == [r.hi for r in got[:-1]]
