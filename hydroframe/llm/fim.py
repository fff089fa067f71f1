"""Fill-in-middle examples by counted quantifiers.

regexp_count tells how many units a text has. Two cuts make a pattern of its own for each row, whose
possessive groups unit{a} and unit{b-a} take prefix and middle and whose rest is the suffix, so that
one match, in one regexp_replace, puts the three parts in the order asked for. A possessive count
over a group runs as a loop, without a stack, and never goes back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import fresh_name, table, text_of

#: Units that tile any text: code points, words with the blanks behind them, lines with their ends.
CODE_POINT = r"[\x{0}-\x{10FFFF}]"
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"
LINE = r"[^\n]*+\n|[^\n]++"
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Units are counted in runs of so many, so that a text's units never stand in one array.
RUN = 512


def units_in(text: Column, unit: str = CODE_POINT) -> Column:
    """How many units a text has, as a long: runs count for all of theirs, the rest singly."""
    run = f"(?:{unit}){{{RUN}}}+"
    return F.regexp_count(text, F.lit(f"{run}|{unit}")).cast("long") + (RUN - 1) * F.regexp_count(text, F.lit(run)).cast("long")


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of the seed, a colon and the identifier (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def check_markers(markers: tuple[str, str, str]) -> None:
    """Refuse markers that could be read where none was written: one inside another, or one's end as another's begin."""
    if len(set(markers)) < len(markers):
        raise ValueError(f"markers {markers} are not told apart in any text")
    for a in markers:
        if not a or any(a in b for b in markers if b != a) or any(a[-k:] == b[:k] for b in markers for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"markers {markers} are not told apart in any text")


def fill_in_middle(documents: DataFrame, unit: str = CODE_POINT, markers: tuple[str, str, str] = MARKERS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """The rows of ``documents`` with their columns and ``fim`` (with underscores behind where a column has that name): n, form, prefix_units, middle_units, output.

    ``unit`` is a pattern that tiles every text. Both cuts lie anywhere from 0 to n units, drawn by
    identifier; form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, which is
    the text itself: for empty and null texts, for texts that hold a marker, and for ``plain`` of 100
    others. Plain rows have no cuts (null). Rows of one identifier draw alike, a null one as the empty
    one; repeated rows stay. An empty table gives an empty result.
    """
    check_markers(markers)
    p, s, m = markers
    text, name = text_of(), fresh_name(documents, "fim")
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    n = units_in(text, unit)
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(text, F.lit(marker))
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    drawn, cut, done = (fresh_name(documents, f"{name}_{x}") for x in ("drawn", "cut", "done"))
    own = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.withColumn(drawn, F.struct(n.alias("n"), form.alias("form"), h1.alias("h1"), h2.alias("h2")))
    d = F.col(drawn)
    u1, u2 = d["h1"] % (d["n"] + 1), d["h2"] % (d["n"] + 1)
    rows = rows.withColumn(cut, F.when(d["form"] != "plain", F.struct(F.least(u1, u2).alias("a"), F.abs(u1 - u2).alias("b"))))
    c = F.col(cut)
    pattern = F.concat(F.lit(rf"\A((?:{unit}){{"), c["a"].cast("string"), F.lit(rf"}}+)((?:{unit}){{"), c["b"].cast("string"), F.lit(r"}+)([\x{0}-\x{10FFFF}]*+)\z"))
    quoted = [re.sub(r"([\\$])", r"\\\1", x) for x in (p, s, m)]
    order = F.when(d["form"] == "psm", f"{quoted[0]}$1{quoted[1]}$3{quoted[2]}$2").otherwise(f"{quoted[1]}$3{quoted[0]}$1{quoted[2]}$2")
    rows = rows.withColumn(done, F.when(d["form"] == "plain", text).otherwise(F.regexp_replace(text, pattern, order)))
    return rows.select(*own, F.struct(d["n"].alias("n"), d["form"].alias("form"), c["a"].alias("prefix_units"), c["b"].alias("middle_units"), F.col(done).alias("output")).alias(name))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of fill_in_middle() was made from."""
    quoted = "|".join(rf"\Q{x}\E" for x in markers)
    parts = F.split(output, quoted, -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = F.col("fim")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select(
        "doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_units"].alias("prefix_chars"), f["middle_units"].alias("middle_chars"),
        digest(f["output"]).alias("output_sha256"), digest(restored(f["output"], f["form"])).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), g AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS u1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS u2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, least(u1, u2) AS a, greatest(u1, u2) AS b FROM g
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
