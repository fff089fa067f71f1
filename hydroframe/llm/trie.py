"""Prefix tries of conversations by adaptive radix trees.

A turn's id is the first 16 bytes of a SHA-256, a big-endian number of fixed width; a conversation's key
is its turns' ids in a row. Keys are dealt out in ranges, so that a task holds neighbours and a key that
a third of all conversations share is spread over tasks. Each task builds an adaptive radix tree of its
range and adds up what hangs below every turn-aligned depth. Nodes that the ranges beside it share are
given in part; parts add up because each distinct node counts in the first range that has it alone.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.llm.shared import bounded_batches, materialize, release, table, text_of, words_of

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations of a block share the first turns of its first conversation, fewer than HEADS each.
BLOCK, HEADS = 20, 4
#: Bytes of keys and identifiers that a range holds, about.
RANGE_BYTES = 8 << 20
#: Identifiers in one piece of a node's list.
PIECE = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: the bytes that lead to it, its children by their next byte, and what ends here.

    Up to 4 and up to 16 children stand in order of their bytes, up to 48 in slots that a table of 256
    bytes names, more in 256 places.
    """

    __slots__ = ("path", "room", "keys", "slots", "ends", "words")

    def __init__(self, path: bytes):
        self.path, self.room, self.keys, self.slots, self.ends, self.words = path, 4, bytearray(), [], None, None

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.keys.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.room == 48:
            return self.slots[self.keys[byte] - 1] if self.keys[byte] else None
        return self.slots[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set the child of a byte, growing to the next layout when this one is full."""
        if self.room == 256:
            self.slots[byte] = node
        elif self.room == 48 and self.keys[byte]:
            self.slots[self.keys[byte] - 1] = node
        elif self.room <= 16 and (at := self.keys.find(byte)) >= 0:
            self.slots[at] = node
        elif len(self.slots) == self.room:
            self.grow()
            self.put(byte, node)
        elif self.room == 48:
            self.slots.append(node)
            self.keys[byte] = len(self.slots)
        else:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.slots.insert(at, node)

    def grow(self) -> None:
        own = list(self.children())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 16:
            return
        self.keys, self.slots = bytearray(256) if self.room == 48 else bytearray(), [] if self.room == 48 else [None] * 256
        for byte, node in own:
            self.put(byte, node)

    def children(self) -> Iterator[tuple[int, Node]]:
        """Children in order of their bytes."""
        if self.room <= 16:
            yield from zip(self.keys, self.slots, strict=True)
        elif self.room == 48:
            yield from ((b, self.slots[k - 1]) for b, k in enumerate(self.keys) if k)
        else:
            yield from ((b, x) for b, x in enumerate(self.slots) if x is not None)


def common(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


class RadixTree:
    """Keys with what ends at them; the bytes that lead to a node are kept in one piece (path compression)."""

    def __init__(self):
        self.top = Node(b"")

    def node(self, key: bytes) -> Node:
        """The node where ``key`` ends, made if there is none."""
        at, node, above = 0, self.top, None
        while True:
            same = common(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                fork = Node(node.path[:same])
                above.put(fork.path[0] if same else node.path[0], fork)
                node.path = node.path[same:]
                fork.put(node.path[0], node)
                node = fork
            at += same
            if at == len(key):
                return node
            below = node.child(key[at])
            if below is None:
                below = Node(key[at:])
                node.put(key[at], below)
                return below
            above, node = node, below


def turn_ids(role: Column, text: Column) -> Column:
    """A turn's SHA-256 in hex; the role's length before it keeps role and text apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def rebuilt_conversations(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, ids (hex) and words, arrays over the turns of each rebuilt conversation.

    Turns stand by turn, null first, those of equal turn by their SHA-256; null roles and texts count as
    empty, repeated rows are turns of their own, rows without conv_id are left out. Conversation c starts
    with the first h turns of conversation c - c % block (h the CRC-32 of its number modulo ``heads``) and
    goes on with its own after the first h.
    """
    role, text = text_of("role"), text_of("text")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"), turn_ids(role, text).alias("id"), F.size(words_of(text)).cast("long").alias("words")).alias("t"),
    )
    own = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(F.substring(t["id"], 1, 2 * WIDTH).alias("id"), t["words"].alias("words"))).alias("own"))
    own = own.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % block)
    first = own.where("conv_id = head_id").select("head_id", F.slice("own", 1, heads - 1).alias("first"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    none = F.array().cast("array<struct<id: string, words: bigint>>")
    joined = own.join(first, "head_id", "left").withColumn("h", h.cast("int"))
    whole = F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.select("conv_id", whole.alias("turns")).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


PARTS = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shared boolean, parent_shared boolean, range int, piece int, ends string"
NODE, PARENT, PARENT_CONV, PARENT_SHARED = 0, 1, 4, 11


class Below:
    """What a finished subtree adds to the nodes above it; ``waiting`` are the rows of its topmost turns, whose parent isn't done."""

    __slots__ = ("convs", "least", "leaves", "saved", "tops", "words", "first", "last", "waiting")

    def __init__(self):
        self.convs = self.leaves = self.saved = self.tops = 0
        self.least, self.words, self.first, self.last, self.waiting = None, None, False, False, []

    def take(self, x: Below) -> None:
        self.convs, self.leaves, self.saved, self.tops = self.convs + x.convs, self.leaves + x.leaves, self.saved + x.saved, self.tops + x.tops
        self.least = x.least if self.least is None else min(self.least, x.least)
        self.words = self.words or x.words
        self.first, self.last = self.first or x.first, self.last or x.last
        if len(self.waiting) < len(x.waiting):
            self.waiting, x.waiting = x.waiting, self.waiting
        self.waiting += x.waiting


def nodes_of_range(number: int, keys: list[bytes], ids: list[int], words: list, before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Rows of PARTS for one range: keys in order with their conversations and words, and the keys next to the range.

    A node is shared if a key beside the range starts with it, and counts as the range's own unless the
    one before does. Its part of saved_tokens are its members' words less, for own nodes, the words once.
    A childless node counts as a leaf where the key after doesn't start with it. Shared nodes give the
    identifiers that end there in pieces.
    """
    tree = RadixTree()
    for key, conv, own in zip(keys, ids, words, strict=True):
        node = tree.node(key)
        if node.ends is None:
            node.ends, node.words = array("q"), own
        node.ends.append(conv)
    left = common(before, keys[0]) // WIDTH if before is not None else -1
    right = common(after, keys[-1]) // WIDTH if after is not None else -1
    first, last = tree.node(keys[0]), tree.node(keys[-1])
    done: list[Below] = []
    todo: list[tuple[Node, int, bool]] = [(tree.top, 0, False)]
    path, chain = bytearray(), [hashlib.blake2b(b"", digest_size=16).digest()]  # chain: the names of the nodes at the aligned depths of the path
    while todo:
        node, at, back = todo.pop()
        until = at + len(node.path)
        if not back:
            path[at:] = node.path
            del chain[at // WIDTH + 1 :]
            for d in range(at // WIDTH + 1, until // WIDTH + 1):
                chain.append(hashlib.blake2b(chain[-1] + path[(d - 1) * WIDTH : d * WIDTH], digest_size=16).digest())
            todo.append((node, at, True))
            todo += [(x, until, False) for _, x in node.children()]
            continue
        below, ends, leaf = Below(), (), False
        for _ in node.children():
            below.take(done.pop())
        if node.ends is not None:
            ends, leaf = node.ends, not len(node.slots)
            below.convs += len(ends)
            below.least = ends[0] if below.least is None else min(ends[0], below.least)
            below.words = node.words
            below.first, below.last = below.first or node is first, below.last or node is last
        for d in range(until // WIDTH, at // WIDTH if at or until else -1, -1):
            on_left, on_right = below.first and d <= left, below.last and d <= right
            shared, size = on_left or on_right, below.words[d - 1] if d else 0
            below.leaves += leaf and not on_right
            below.saved += (below.convs - (not on_left)) * size
            parent = chain[d - 1] if d else None
            listed = EMPTY_SHA256 if not len(ends) else None if shared else hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
            row = [chain[d], parent, d, below.least, None, below.convs, below.tops, below.leaves, below.saved, listed, shared, False, number, None, None]
            for own in below.waiting:
                own[PARENT_CONV], own[PARENT_SHARED] = below.least, shared
                yield own
            if shared:
                for k in range(0, len(ends), PIECE):
                    yield [chain[d], *[None] * 9, True, True, number, k // PIECE, ",".join(map(str, ends[k : k + PIECE]))]
            below.tops, below.waiting, ends, leaf = int(not on_left), [row], (), False
        done.append(below)
    yield from done.pop().waiting


def one_range_each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(range, keys, ids, words, before, after) of rows that come by range and kind: the key before it, its own, the key after."""
    number, held = None, None
    for batch in batches:
        for range_no, kind, key, conv, words in zip(*(batch[c].to_pylist() for c in ("range", "kind", "key", "conv_id", "words")), strict=True):
            if range_no != number:
                if held is not None:
                    yield (number, *held)
                number, held = range_no, [[], [], [], None, None]
            if kind == 1:
                held[0].append(key)
                held[1].append(conv)
                held[2].append(words)
            else:
                held[3 if kind == 0 else 4] = key
    if held is not None:
        yield (number, *held)


def partial_nodes(ranges: DataFrame) -> DataFrame:
    """PARTS of all ranges. ``ranges``: range, key, conv_id, words, written as a table."""
    edges = ranges.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("range")  # one row a range
    edges = edges.select("range", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    no_conv, no_words = F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<bigint>").alias("words")
    beside = edges.select("range", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("key")), F.struct(F.lit(2).alias("kind"), F.col("after").alias("key")))).alias("x"))
    rows = ranges.select("range", F.lit(1).alias("kind"), "key", "conv_id", "words").unionByName(beside.select("range", "x.kind", "x.key", no_conv, no_words))
    schema = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in PARTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in one_range_each(batches):
            held = []
            for row in nodes_of_range(*own):
                held.append(row)
                if len(held) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    bounded_batches(ranges.sparkSession)
    return rows.repartition("range").sortWithinPartitions("range", "kind", "key", "conv_id").mapInArrow(run, PARTS)


def hashed_ends(pieces: DataFrame) -> DataFrame:
    """node and ends_sha256 of shared nodes: pieces in order run through one SHA-256, which holds nothing but its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            for own, text in zip(batch["node"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if own != node:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})
                    node, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})

    rows = pieces.select("node", "range", "piece", "ends").repartition("node").sortWithinPartitions("node", "range", "piece")
    return rows.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node of the trie over conversations given as conv_id, ids (hex, one a turn) and words (one a turn).

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. Conversations without turns end at the root. No conversations give no rows.
    conv_id must be unique; a conversation's ids must fit a task, its copies need not.
    """
    keys = materialize(conversations.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), F.col("words").cast("array<bigint>").alias("words")), "trie-keys")
    size = keys.agg(F.sum(F.length("key") + 8 * F.size("words") + 16)).first()[0] or 0
    ranges = keys.repartitionByRange(1 + size // RANGE_BYTES, "key", "conv_id").withColumn("range", F.spark_partition_id())
    ranges = materialize(ranges, "trie-ranges")
    release(keys)
    parts = materialize(partial_nodes(ranges), "trie-parts")
    release(ranges)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("shared AND piece IS NULL").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    listed = hashed_ends(parts.where("piece IS NOT NULL"))
    merged = materialize(merged.join(listed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))), "trie-shared")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    own = parts.where("NOT shared AND NOT parent_shared")
    below = parts.where("NOT shared AND parent_shared").drop("parent_conv_id").join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    split = merged.join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    return own.select(*columns).unionByName(below.select(*columns)).unionByName(split.select(*columns))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS b, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
           lambda a, s: list_reduce(list_prepend(xor(a, s), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM n)
), r AS (
  SELECT c.conv_id, n.pos, n.id, n.words FROM c JOIN n ON n.conv_id = c.b AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, n.pos, n.id, n.words FROM c JOIN n ON n.conv_id = c.conv_id AND n.pos > c.h
), k AS (
  SELECT c.conv_id, coalesce(list(r.id ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS ids, coalesce(list(r.words ORDER BY r.pos) FILTER (r.id IS NOT NULL), []) AS ws
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, d, ids[1:d] AS node, ws[d] AS w, d = len(ids) AS here FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM k)
), v AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(max(w), 0) AS w, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here) AS ended
  FROM p GROUP BY node, d
), f AS (
  SELECT node[1:d - 1] AS node, count(*) AS children FROM v WHERE d > 0 GROUP BY 1
), u AS (
  SELECT v.*, coalesce(f.children, 0) AS children FROM v LEFT JOIN f ON f.node = v.node
), s AS (
  SELECT node[1:a] AS node, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM u) GROUP BY 1
)
SELECT u.conv_id::BIGINT AS conv_id, u.d::BIGINT AS depth, q.conv_id::BIGINT AS parent_conv_id, u.n::BIGINT AS n_convs, u.children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(u.ended, '')) AS ends_sha256
FROM u JOIN s ON s.node = u.node LEFT JOIN v q ON u.d > 0 AND q.node = u.node[1:u.d - 1]
"""
