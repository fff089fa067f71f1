import hashlib

import pytest
from pyspark.sql import functions as F

from hydroframe.llm import fim
from tests.llm.helpers import ODD_TEXTS, WORD

SCHEMA = "doc_id long, text string, FIM string, fim_drawn int, `fim_.x` int"


def plain_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else (len(text), "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_outputs_equal_slices_and_go_back(spark):
    texts = [*ODD_TEXTS, "a<P>b", "<S>", "x<M", "<P", "P>S>M>", "$1\\2\\E(?s)[x]", "\r\n\r\n x", "\U0001f600" * 1500, "long text \U0001f600\n" * 60_000, "q" * 511, "q" * 512, "q" * 513]
    rows = [(k * len(texts) + j, t, "v", 1, 2) for k in range(12) for j, t in enumerate(texts)] + [(None, "no id", "v", 1, 2), (5, texts[5], "v", 1, 2), (5, texts[5], "v", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    out = fim.fill_in_middle(docs)
    assert out.columns[:-1] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    made = F.col(f"`{out.columns[-1]}`")
    got = out.select("doc_id", "text", made.alias("f"), fim.restored(made["output"], made["form"]).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.f.n, r.f.form, r.f.prefix_units, r.f.middle_units, r.f.output) == plain_cut(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.f.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize("unit", [fim.WORD, fim.LINE])
def test_other_units_are_never_cut(spark, unit):
    texts = [t for t in ODD_TEXTS if t] + ["one  two\n three\n\nfour " * 700]
    out = fim.fill_in_middle(spark.createDataFrame([(k, t) for k, t in enumerate(texts * 4)], "doc_id long, text string"), unit, ("[[pre]]", "[[suf]]", "[[$mid]]"), plain=0, suffix_first=50)
    got = out.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"), ("[[pre]]", "[[suf]]", "[[$mid]]"))).collect()
    for r in got:
        assert r.back == r.text and r.fim.form != "plain"
        parts = dict(x.split("]]", 1) for x in r.fim.output.split("[[")[1:])
        n = len(WORD.findall(r.text)) + (r.text[0] in " \t\n\x0b\x0c\r") if unit is fim.WORD else r.text.count("\n") + (r.text[-1] != "\n")
        assert r.fim.n == n
        units = (lambda t: len(WORD.findall(t)) + (t[:1] in tuple(" \t\n\x0b\x0c\r"))) if unit is fim.WORD else (lambda t: t.count("\n") + (t[-1:] not in ("", "\n")))
        assert units(parts["pre"]) == r.fim.prefix_units and units(parts["$mid"]) == r.fim.middle_units


def test_markers_that_run_into_each_other_are_refused():
    for bad in [("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("", "a", "b"), ("<P>", "<P>", "<M>"), ("aa", "b", "c")]:
        with pytest.raises(ValueError):
            fim.check_markers(bad)
    fim.check_markers(fim.MARKERS)
