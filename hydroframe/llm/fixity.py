"""Merkle fixity audit of WARC archives.

Records of an archive stand one after the other, in the order of their addresses, at known offsets.
Each record is hashed. A node of the tree covers a range of addresses and so of offsets; its hash is
taken over its children in order, each with its offset from the node's begin, its length and its hash,
up to one root an archive. Since offsets count from the parent's begin, a record of another length,
or one too many or too few, changes nothing but its own branch. Two replicas are compared from the
roots down, and only the children of nodes that differ are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.llm.shared import materialize, release, table

#: An archive spans FANOUT ** HEIGHT addresses, so that a tree of that height has one root.
FANOUT, HEIGHT = 16, 3
ARCHIVE = FANOUT**HEIGHT
#: The capture date of records whose page names none.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: Column, url: Column) -> Column:
    """A record's identifier, from the page's identifier and address alone."""
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), url).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def warc_record(name: Column, url: Column, body: Column) -> Column:
    """A WARC resource record as text."""
    fields = [F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: "), name, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url]
    return F.concat(*fields, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """One row a distinct record: archive, address, record_id, hash, bytes (of one), copies, lo, hi, page_id.

    ``pages`` has page_id, url and html; null url and html count as empty. A page stands at the address
    of its identifier, and without one at a negative number from the hash of its url. Records at one
    address stand by record_id and hash; records that repeat byte for byte are one row with their
    number, counted before they meet, and stand side by side. lo and hi are the offsets of all copies.
    An empty table gives an empty result; other columns are ignored. The window holds one archive.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text("url").alias("url"), text("html").alias("body"))
    unnamed = -1 - F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("address", F.coalesce("page_id", unnamed)).withColumn("record_id", record_id(F.col("page_id"), F.col("url")))
    rows = rows.withColumn("record", warc_record(F.col("record_id"), F.col("url"), F.col("body")))
    rows = rows.select("page_id", "address", "record_id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("bytes"))
    rows = rows.groupBy("page_id", "address", "record_id", "hash", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("archive", F.floor(F.col("address") / ARCHIVE).cast("long"))
    order = Window.partitionBy("archive").orderBy("address", "record_id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hi", F.sum(F.col("bytes") * F.col("copies")).over(order))
    return rows.withColumn("lo", F.col("hi") - F.col("bytes") * F.col("copies"))


def tree(records: DataFrame) -> DataFrame:
    """The nodes above records: archive, level (HEIGHT: the root), node, hash."""
    child = records.select("archive", "address", F.struct("address", "record_id", "hash").alias("at"), "lo", "hi", "hash")
    nodes = None
    for k in range(1, HEIGHT + 1):
        own = child.groupBy("archive", F.floor(F.col("address") / FANOUT).cast("long").alias("address")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("at", F.col("lo").alias("a"), F.col("hi").alias("b"), "hash"))).alias("children")
        )
        told = F.transform("children", lambda c: F.concat_ws(":", (c["a"] - F.col("lo")).cast("string"), (c["b"] - c["a"]).cast("string"), c["hash"]))
        own = own.select("archive", "address", "lo", "hi", F.sha2(F.array_join(told, "|"), 256).alias("hash"))
        level = own.select("archive", F.lit(k).alias("level"), F.col("address").alias("node"), "hash")
        nodes = level if nodes is None else nodes.unionByName(level)
        child = own.withColumn("at", F.struct("address"))
    return nodes


def fixity_audit(first: DataFrame, first_tree: DataFrame, second: DataFrame, second_tree: DataFrame) -> DataFrame:
    """What differs between two replicas, from their leaves() and tree(): archive, record_id, hash, state, other_lo.

    Records of the first replica that the second has with other bytes, or not as often, are ``altered``,
    those that it has not are ``missing``; ``extra`` records are in the second only, at ``other_lo``.
    Records of equal archives are not looked at. Empty replicas differ in nothing or in everything.
    """
    bad, written = None, []
    for k in range(HEIGHT, 0, -1):
        a, b = (t.where(F.col("level") == k) for t in (first_tree, second_tree))
        if bad is not None:
            up = bad.withColumnRenamed("node", "parent")
            a, b = (t.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(up, ["archive", "parent"], "left_semi") for t in (a, b))
        both = a.select("archive", "node", F.col("hash").alias("a")).join(b.select("archive", "node", F.col("hash").alias("b")), ["archive", "node"], "full")
        bad = materialize(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node"), f"fixity-{k}")
        written.append(bad)
    below = lambda t: t.withColumn("node", F.floor(F.col("address") / FANOUT).cast("long")).join(bad, ["archive", "node"], "left_semi")
    a = below(first).select("archive", "record_id", "hash", F.col("copies").alias("a"))
    b = below(second).select("archive", "record_id", "hash", F.col("copies").alias("b"), F.col("lo").alias("other_lo"))
    apart = a.join(b, ["archive", "record_id", "hash"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    known = lambda t, name: t.select("archive", "record_id", F.lit(True).alias(name)).distinct()
    apart = apart.join(known(b, "in_b"), ["archive", "record_id"], "left").join(known(a, "in_a"), ["archive", "record_id"], "left")
    state = F.when(F.col("a").isNotNull(), F.when(F.col("in_b"), "altered").otherwise("missing")).when(F.col("in_a").isNull(), "extra")
    out = materialize(apart.withColumn("state", state).where("state IS NOT NULL").select("archive", "record_id", "hash", "state", "other_lo"), "fixity-found")
    release(*written)
    return out


def decayed(pages: DataFrame) -> DataFrame:
    """A replica of pages after losses: one page in 97 ends in another character, one in 389 is gone, one in 401 is there a second time under another url."""
    mod = lambda n: F.coalesce(F.pmod("page_id", F.lit(n)), F.lit(-1))
    html = F.coalesce("html", F.lit(""))
    rows = pages.where(mod(389) != 7).withColumn("html", F.when(mod(97) == 13, F.concat(F.substring(html, F.lit(1), F.greatest(F.length(html) - 1, F.lit(0))), F.lit("\u0000"))).otherwise(html))
    more = pages.where(mod(401) == 3).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#2")))
    return rows.unionByName(more)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct record of ``pages`` with its place and state, and the extra ones of the second replica."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours, theirs = materialize(leaves(pages), "fixity-first"), materialize(leaves(decayed(pages)), "fixity-second")
    trees = [materialize(tree(x), "fixity-tree") for x in (ours, theirs)]
    found = fixity_audit(ours, trees[0], theirs, trees[1])
    release(*trees)
    key, out = ["archive", "record_id", "hash"], ["page_id", "archive", "record_id", F.col("lo").alias("offset"), "bytes", "copies", F.col("hash").alias("record_sha256"), "state"]
    extra = theirs.join(found.where("state = 'extra'").select(*key, "state"), key)
    own = ours.join(found.where("state <> 'extra'").select(*key, "state"), key, "left").withColumn("state", F.coalesce("state", F.lit("intact")))
    return own.select(*out).unionByName(extra.select(*out))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 'a' AS side FROM pages
  UNION ALL SELECT page_id, coalesce(url, ''), CASE WHEN page_id % 97 = 13 THEN left(coalesce(html, ''), greatest(length(coalesce(html, '')) - 1, 0)) || chr(0) ELSE coalesce(html, '') END, 'b'
  FROM pages WHERE coalesce(page_id % 389, -1) <> 7
  UNION ALL SELECT page_id, coalesce(url, '') || '#2', coalesce(html, ''), 'b' FROM pages WHERE page_id % 401 = 3
), n AS (
  SELECT *, coalesce(page_id, -1 - ('0x' || substr(md5(url), 1, 12))::BIGINT) AS address, md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || url) AS h FROM p
), i AS (
  SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' AS record_id FROM n
), r AS (
  SELECT *, replace('WARC/1.1' || chr(10) || 'WARC-Type: resource' || chr(10) || 'WARC-Record-ID: ', chr(10), chr(13) || chr(10)) || record_id || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z'
   || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR)
   || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM i
), g AS (
  SELECT side, page_id, address, record_id, sha256(record) AS hash, strlen(record) AS bytes, count(*) AS copies, CAST(floor(address / 4096) AS BIGINT) AS archive FROM r GROUP BY ALL
), o AS (
  SELECT *, (sum(bytes * copies) OVER (PARTITION BY side, archive ORDER BY address, record_id, hash ROWS UNBOUNDED PRECEDING) - bytes * copies)::BIGINT AS "offset" FROM g
)
SELECT page_id, archive, record_id, "offset", bytes, copies, hash AS record_sha256,
       CASE WHEN EXISTS (SELECT 1 FROM g b WHERE b.side = 'b' AND b.record_id = o.record_id AND b.hash = o.hash AND b.copies = o.copies) THEN 'intact'
            WHEN EXISTS (SELECT 1 FROM g b WHERE b.side = 'b' AND b.record_id = o.record_id) THEN 'altered' ELSE 'missing' END AS state
FROM o WHERE side = 'a'
UNION ALL
SELECT page_id, archive, record_id, "offset", bytes, copies, hash, 'extra' FROM o WHERE side = 'b' AND NOT EXISTS (SELECT 1 FROM g a WHERE a.side = 'a' AND a.record_id = o.record_id)
"""
