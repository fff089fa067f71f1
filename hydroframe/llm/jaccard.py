"""Exact set similarity join over word shingles, with relations between sets used to skip work.

Texts become sets of hashed shingles; equal sets are one set. Sets that overlap enough share a token
among their first few in a common order of tokens, in which common tokens come last, so that an index
from each token to the sets that begin with it (a list) finds every candidate pair.

Skipping by position: a list is sorted by size, and cut into blocks of sets whose sizes allow a link
with the block's first; blocks whose sizes rule out a link are never paired, and pairs that share too few of
their first tokens for what is left behind those positions are dropped. So are pairs whose bitmaps
(the parity of a set's tokens by their last bits) differ in more bits than linked sets differ in tokens.

Skipping by answers: most sets of a list are near copies of one another. Each set is first verified
against one leader only. What two leaders have in common bounds what their followers can have in
common, by the triangle inequality of the Jaccard distance, so that the answer of one set settles
that of its followers; only followers that the bound leaves open are compared themselves, and sets
already connected never are. Nor are sets that a third one, with which both have been compared, shows
to be too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import bounded_batches, fresh_name, materialize, portions, release, table, text_of

#: Words in a shingle, least similarity in percent.
WORDS, PERCENT = 4, 85
#: Tokens that come last in the order; the most frequent ones, and the least count in a batch to be one.
COMMON_TOKENS, COMMON_COUNT = 500_000, 4
#: Of the tokens that sets of two sizes must share among their first ones, the share that is asked for:
#: the less, the fewer places of a set are looked at, and the more pairs that don't link are compared.
SHARED = 0.5
#: Bits of a set's bitmap, the least and the most; between them about as many as the set has tokens.
#: More bits rule out more pairs, and change nothing else.
BITMAPS = (512, 4096)
#: Candidate pairs that a task adds up before it passes them on; changes how often a pair is passed on, and nothing else.
HELD_PAIRS = 500_000
#: Entries of a list that are compared in one go; longer lists are cut into cells, of which every two meet. Changes how work is dealt out, and nothing else.
CELL = 1024
#: The most entries that are dealt out as one portion; changes how work is dealt out, and nothing else.
PORTION_ENTRIES = 200_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingles(text: str, words: int = WORDS, seen: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z in lower case, parted by the six blanks.

    Fewer words than a shingle has make one shingle of their own; no words make none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both know ASCII alone
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\xff" + b" ".join(parts))], np.uint64)
    seen = {} if seen is None else seen
    new = {p for p in parts if p not in seen}
    if len(seen) > 150_000:
        seen.clear()
        new = set(parts)
    for p in new:
        seen[p] = xxhash.xxh3_64_intdigest(p)
    own = np.fromiter(map(seen.__getitem__, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = (h ^ _finish(own[k : k + n] * _MIX[k])) * _MIX[(k + 3) % 8]
    return np.unique(_finish(h))


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits that name a whole set."""
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def bitmap(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens for each value of their last bits.

    Each token that only one of two sets has changes one bit, so bitmaps differ in no more bits than
    sets do in tokens. The number of bits is a power of two; the exclusive or of a bitmap's parts is
    the bitmap of as many bits as a part has.
    """
    n = min(max(BITMAPS[0], 1 << (len(tokens) // 2).bit_length()), BITMAPS[1])
    counts = np.bincount((tokens & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def differing_bits(flat: np.ndarray, start: np.ndarray, words: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps ``others`` differ from bitmap ``one``, which is none longer than they are.

    ``flat`` holds all bitmaps as words of 64 bits, ``start`` and ``words`` say where each one lies.
    """
    n = int(words[one])
    own, out = flat[start[one] : start[one] + n], np.empty(len(others), np.int64)
    lengths = words[others]
    for m in [n] if (lengths == n).all() else np.unique(lengths).tolist():
        at = np.nonzero(lengths == m)[0]
        rows = flat[start[others[at], None] + np.arange(m)]
        if m > n:
            rows = np.bitwise_xor.reduce(rows.reshape(len(at), m // n, n), axis=1)
        out[at] = np.bitwise_count(rows ^ own).sum(axis=1, dtype=np.int64)
    return out


def needed(size_a, size_b, percent: int = PERCENT):
    """The least overlap that links sets of these sizes."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for at, stop in portions(batch.column(1)):
            own = batch.slice(at, stop - at)
            yield own.column(0).to_pylist(), own.column(1).to_pylist()


def common_tokens(docs: DataFrame, words: int) -> np.ndarray:
    """The most frequent tokens, COMMON_TOKENS at most, sorted.

    Every portion of every document is counted; tokens met once or twice in a portion are left out.
    Any choice of tokens gives a valid order: the choice decides how short the lists are, not what is
    found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for _, texts in _portions(batches):
            sets = {s.tobytes(): s for s in (shingles(t, words, seen) for t in texts)}
            token, count = np.unique(np.concatenate(list(sets.values())), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, int))
            often = count >= COMMON_COUNT
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["token", "n"])

    counts = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).select("token").toPandas()
    return np.sort(rows.token.to_numpy(np.int64).view(np.uint64))


def set_rows(docs: DataFrame, words: int, percent: int, common) -> DataFrame:
    """doc_id, set_id (a 128-bit hash of the whole set), size, its first tokens in the common order, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = common.value, {}
        for ids, texts in _portions(batches):
            keys, sizes, firsts, bits = [], [], [], []
            for t in texts:
                s = shingles(t, words, seen)
                keys.append(set_id(s))
                sizes.append(len(s))
                bits.append(bitmap(s))
                if not len(s):
                    firsts.append(b"")
                    continue
                n = prefix_length(len(s), percent)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = often[at] == s
                    s = np.concatenate([s[~late], s[late]])
                firsts.append(s[:n].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "set_id", "size", "first", "bits"])

    return docs.mapInArrow(run, "doc_id long, set_id binary, size long, first binary, bits binary")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column, cut so that equal values stay together."""
    held: list[list[np.ndarray]] = []
    whole = lambda: [np.concatenate(c) for c in zip(*held, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        at = int(np.argmax(cols[0] == cols[0][-1]))
        if not held or held[0][0][0] != cols[0][-1]:
            held.append([c[:at] for c in cols])
            if len(held) > 1 or at:
                yield whole()
            held = []
        held.append([c[at:] for c in cols])
    if held:
        yield whole()


def token_lists(sets: DataFrame, percent: int) -> DataFrame:
    """The index: token, set (its number), size, place of the token in the set, leader. Lists of one set are left out.

    An entry's block is the run of entries by size whose sizes allow a link with the first of the
    block, and its leader the set of the block that has the fewest tokens before this one: of copies
    of a text, tokens before the common ones are what sets a copy apart from the others.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            first = batch.column(2).to_pylist()
            lengths = np.array([len(x) // 8 for x in first], np.int64)
            token = np.frombuffer(b"".join(first), np.int64)
            place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(numbers, lengths)), pa.array(np.repeat(sizes, lengths)), pa.array(place.astype(np.int32))], ["token", "set", "size", "place"])

    rows = sets.where("size > 0").select("set", "size", "first").mapInArrow(explode, "token long, set long, size long, place int")

    def blocks(token, size, number, place):
        """The leader of each entry of whole lists, sorted by token and size."""
        begin = np.concatenate([[True], token[1:] != token[:-1]])
        head = np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))
        # a list whose largest set can't link with its smallest is cut into blocks
        while True:
            far = size * percent > size[head] * 100
            if not far.any():
                break
            cut = far & ~np.concatenate([[False], (far[:-1]) & (head[1:] == head[:-1])])
            begin |= cut
            head = np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))
        block = np.cumsum(begin) - 1
        central = np.lexsort((number, place, block))[np.nonzero(begin)[0]]
        return number[central][block]

    def several(cols: list[np.ndarray]) -> pa.RecordBatch:
        token = cols[0]
        same = token[1:] == token[:-1]
        found = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        token, number, size, place = (c[found] for c in cols)
        leader = blocks(token, size, number, place) if len(token) else number
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, number, size, place, leader)], ["token", "set", "size", "place", "leader"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_lists(batches):
            yield several(cols)

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, "token").sortWithinPartitions("token", "size", "set")
    return sorted_.mapInArrow(run, "token long, set long, size long, place int, leader long")


def overlaps(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Of (a, b), a row a pair: a, b, size_a, size_b, common.

    ``sets`` names a document for each set, ``docs`` holds (doc, text); a text that has another set,
    as where documents share an identifier, is passed over. Only texts that a pair asks for move on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        known: dict = {}

        def get(key, text):
            """The set, or nothing if the text has another one; the last few are remembered."""
            if (found := known.get(key)) is None:
                own = shingles(text.as_py(), words, seen)
                if set_id(own) != key:
                    return None
                if len(known) >= 64:
                    known.clear()
                found = known[key] = own
            return found

        for batch in batches:
            a, b, id_a, id_b, text_a, text_b = batch.columns
            rows = []
            for x, y, i, j, s, t in zip(a.to_pylist(), b.to_pylist(), id_a.to_pylist(), id_b.to_pylist(), text_a, text_b, strict=True):
                p, q = get(i, s), get(j, t)
                if p is not None and q is not None:
                    rows.append((x, y, len(p), len(q), len(p) + len(q) - len(np.union1d(p, q))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "size_a", "size_b", "common"])

    side = lambda x: sets.select(F.col("set").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("set_id").alias(f"id_{x}"))
    text = lambda x: texts.select(F.col("doc").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}"))
    named = materialize(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"), "jaccard-pairs")
    asked = materialize(named.select(F.col("doc_a").alias("doc")).union(named.select("doc_b")).distinct(), "jaccard-asked")
    texts = materialize(docs.join(asked, "doc", "left_semi"), "jaccard-texts")
    both = named.join(text("a"), "doc_a").join(text("b"), "doc_b")
    out = both.select("a", "b", "id_a", "id_b", "text_a", "text_b").mapInArrow(run, "a long, b long, size_a long, size_b long, common long")
    out.scratch_tables = [named, asked, texts]
    return out


def components(edges: DataFrame, label: str) -> DataFrame:
    """Of (a, b): node and comp, the smallest node reachable. Alternates large and small stars until nothing changes."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-edges")
    while True:
        # large star: neighbours above a node go to the smallest node around it
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), f"{label}-large")
        # small star: a node and its neighbours below go to the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.where("u <> v").distinct(), f"{label}-small")
        same = now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty()
        release(before, least, large, low)
        if same:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            found.scratch_table = now.scratch_table
            return found


def shared_least(size_a, size_b, percent: int = PERCENT):
    """The least number of shared first tokens with which sets of these sizes can link.

    Of two sets' first tokens those up to the earlier end are compared in full; behind it the set
    that ends there has only the rest of its tokens left.
    """
    rest = np.maximum(-(-percent * size_a // 100), -(-percent * size_b // 100)) - 1
    return np.maximum(needed(size_a, size_b, percent) - rest, 1)


def within_reach(size_a, size_b, percent: int = PERCENT):
    """How many tokens sets of these sizes share at least, if they can link, and among how many first ones of each.

    Sets that link share a token that has no more before it, on either side, than the set can do
    without; and so many more tokens for each place beyond that. The places looked at are those of
    SHARED times the most tokens that can be asked for.
    """
    need = needed(size_a, size_b, percent)
    least = np.maximum((SHARED * shared_least(size_a, size_b, percent)).astype(np.int64), 1)
    return least, size_a - need + least, size_b - need + least


def added_up(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Of columns (a, b, shared, least), a row a pair: the sum of shared and the least of least."""
    a, b, shared, least = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(a):
        return [a, b, shared, least]
    order = np.lexsort((b, a))
    a, b, shared, least = a[order], b[order], shared[order], least[order]
    first = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[0]
    return [a[first], b[first], np.add.reduceat(shared, first), np.minimum.reduceat(least, first)]


def _dealt(lists: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of lists of several components, and the bitmaps they call for, as rows of portions; the table written for it.

    Lists that share their least component stand together, since mostly they hold the same sets: a pair is
    then added up in one portion and passed on once. A component with more than an even share of all entries
    has as many portions as it takes, its lists dealt out by hash; a list longer than CELL is cut into cells
    by hash of the set, and a tile for every two cells is dealt out as a list is. A bitmap goes out once a
    portion, not once an entry.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = lists.groupBy("token").agg(F.min("comp").alias("home"), F.max("comp").alias("other"), F.count(F.lit(1)).alias("entries")).where("home <> other")
    mixed = mixed.withColumn("cells", F.ceil(F.col("entries") / CELL)).withColumn("weight", F.col("entries") * F.col("cells")).drop("other", "entries")
    mixed = materialize(mixed, "jaccard-mixed")
    share = min(max((mixed.agg(F.sum("weight")).first()[0] or 0) // (4 * n), 1), PORTION_ENTRIES)
    shares = mixed.groupBy("home").agg(F.ceil(F.sum("weight") / share).alias("shares"))
    rows = lists.join(mixed.join(shares, "home").drop("weight"), "token")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("set"), "cells")).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    rows = rows.withColumn("low", F.least("cell", "met")).withColumn("high", F.greatest("cell", "met"))
    portion = F.xxhash64("home", F.pmod(F.xxhash64("token", "low", "high"), "shares"))
    rows = rows.select(portion.alias("portion"), "token", "low", "high", "cell", "size", "place", "center", "comp", "set", "pivot", "apart")
    written = materialize(rows, "jaccard-entries")
    bits = written.select("portion", "set").distinct().join(sets.select("set", "bits"), "set")
    none = [F.lit(0).cast(t).alias(c) for c, t in written.dtypes if c not in ("portion", "set")]
    order = ["portion", "entry", *written.columns[1:], "bits"]
    bits = bits.select("portion", "set", "bits", F.lit(0).alias("entry"), *none).select(*order)
    rows = written.withColumns({"entry": F.lit(1), "bits": F.lit("").cast("binary")}).select(*order).union(bits)
    release(mixed)
    return rows.repartition(n, "portion").sortWithinPartitions("portion", "entry", "token", "low", "high", "size", "set"), written


def _candidates(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaders of different components that share enough tokens for some of their sets to link, written.

    A list's entries come sorted by size; an entry meets those of its block and of later blocks until
    their sizes are out of reach, if the token stands early enough in both. Sets that have both been
    compared with one set (their pivot) are no nearer to one another than their distances from it
    differ; those of which one is the other's pivot have been compared. Each list (of a longer one, each
    tile) counts once for a pair of leaders, which is at least what any two of their sets that may link share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cols):
            entry = cols[1] == 1
            bits = cols[13][~entry]
            known, first = np.unique(cols[10][~entry], return_index=True)
            words = np.array([len(b) // 8 for b in bits[first]], np.int64)
            flat, start = np.frombuffer(b"".join(bits[first]), np.uint64), np.cumsum(words) - words
            part, token, low, high, cell, size, place, center, comp, name, pivot = (cols[c][entry].astype(np.int64) for c in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11))
            apart, own = cols[12][entry].astype(np.float64), np.searchsorted(known, name)
            if not len(token):
                return [np.empty(0, np.int64)] * 4
            found = []
            changes = np.any([c[1:] != c[:-1] for c in (part, token, low, high)], axis=0)
            begin = np.nonzero(np.concatenate([[True], changes]))[0]
            ends = np.append(begin[1:], len(token))
            mixed = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
            for n, (i, j) in enumerate(zip(begin[mixed], ends[mixed], strict=True)):
                reach = i + np.searchsorted(size[i:j] * percent, size[i:j] * 100, side="right")
                tile = low[i] != high[i]
                for k in range(i, j - 1):
                    t = slice(k + 1, reach[k - i])
                    least, first_k, first_t = within_reach(size[k], size[t], percent)
                    meets = (comp[t] != comp[k]) & (place[k] < first_k) & (place[t] < first_t) & (name[t] != pivot[k]) & (pivot[t] != name[k])
                    if tile:  # two of one cell meet in that cell's own tile
                        meets &= cell[t] != cell[k]
                    other = np.nonzero(meets)[0]
                    least, other = least[other], other + k + 1
                    open_ = (pivot[other] != pivot[k]) | (np.abs(apart[other] - apart[k]) <= 1 - percent / 100 + 1e-9)
                    least, other = least[open_], other[open_]
                    if not len(other):
                        continue
                    open_ = differing_bits(flat, start, words, own[k], own[other]) <= size[k] + size[other] - 2 * needed(size[k], size[other], percent)
                    least, x = least[open_], center[other[open_]]
                    if len(x):
                        found.append(np.column_stack([np.full(len(x), n), np.minimum(x, center[k]), np.maximum(x, center[k]), least]))
            if not found:
                return [np.empty(0, np.int64)] * 4
            rows = np.concatenate(found)
            rows = rows[np.lexsort(rows.T[::-1])]
            # once a list, with the least of its bounds, then all lists of this batch together
            rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])][:, 1:]
            return added_up([[rows[:, 0], rows[:, 1], np.ones(len(rows), np.int64), rows[:, 2]]])

        def passed_on(cols):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["a", "b", "shared", "least"])

        held, loose = [[np.empty(0, np.int64)] * 4], 0
        for cols in whole_lists(batches):
            held.append(pairs(cols))
            loose += len(held[-1][0])
            if loose >= HELD_PAIRS:
                held, loose = [added_up(held)], 0
                if len(held[0][0]) >= HELD_PAIRS:
                    yield passed_on(held[0])
                    held = [[np.empty(0, np.int64)] * 4]
        yield passed_on(added_up(held))

    rows, written = _dealt(lists, sets)
    found = rows.mapInArrow(run, "a long, b long, shared long, least long").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
    out = materialize(found.where("a <> b AND shared >= least").select("a", "b"), "jaccard-candidates")
    release(written)
    return out


def _distance() -> Column:
    return 1 - F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))


def _links(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))


def _linked(found: DataFrame, percent: int) -> DataFrame:
    return found.where(_links(percent))


def similarity_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id.

    Components are delivered and not links: sets that are connected already are not compared any more,
    so that the number of a document's links stays unknown. Null and empty texts and texts of blanks
    have no shingles and stand alone. Rows that repeat have the same set; rows that share a doc_id are
    told apart by their sets. A component is named by the smallest doc_id in it, nulls apart. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    common = spark.sparkContext.broadcast(common_tokens(docs.select("doc_id", "text"), words))
    rows = materialize(set_rows(docs, words, percent, common), "jaccard-sets")
    # each distinct set has a number, fixed once the table is written, and a document
    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("first").alias("first"), F.first("bits").alias("bits")).where("size > 0 AND doc IS NOT NULL")
    sets = materialize(sets.withColumn("set", F.monotonically_increasing_id()), "jaccard-distinct")
    lists = materialize(token_lists(sets, percent), "jaccard-lists")
    texts = docs.withColumnRenamed("doc_id", "doc")
    names = sets.select("set", "doc", "set_id")

    # each set against one leader, that of most of its lists, if they are about half of what a link needs
    n = F.col("size")
    half = (-(F.floor(-percent * 2 * n / (100 + percent))) + F.floor(-percent * n / 100) + 1) / 2
    star = lists.where("set <> leader").groupBy("set", "leader", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= half)
    star = star.groupBy("set").agg(F.max(F.struct("n", F.col("leader"))).alias("x")).select(F.col("x.leader").alias("a"), F.col("set").alias("b"))
    first = compared(star, names, texts, words, "jaccard-star")
    stars = _linked(first, percent)
    follows = stars.select(F.col("b").alias("set"), F.col("a").alias("center"), _distance().alias("apart"))
    comps = components(stars.select("a", "b"), "jaccard-first")
    radius = materialize(follows.groupBy("center").agg(F.max("apart").alias("radius")), "jaccard-radius")

    # what the leaders have in common settles most of the rest
    pivots = first.select(F.col("b").alias("set"), F.col("a").alias("pivot"), _distance().alias("apart"))
    labels = sets.select("set").join(comps.withColumnRenamed("node", "set"), "set", "left").join(follows.select("set", "center"), "set", "left").join(pivots, "set", "left")
    labels = labels.select("set", F.coalesce("center", "set").alias("center"), F.coalesce("comp", "set").alias("comp"), F.coalesce("pivot", "set").alias("pivot"), F.coalesce("apart", F.lit(0.0)).alias("apart"))
    labels = materialize(labels, "jaccard-labels")
    labelled = materialize(lists.select("token", "set", "size", "place").join(labels, "set"), "jaccard-labelled")
    release(lists, labels, comps)
    asked = _candidates(labelled, sets, percent)
    between = compared(asked, names, texts, words, "jaccard-between")
    reach = lambda side: radius.select(F.col("center").alias(side), F.col("radius").alias(f"r_{side}"))
    bound = between.where(~_links(percent)).join(reach("a"), "a", "left").join(reach("b"), "b", "left")
    slack = F.coalesce("r_a", F.lit(0.0)) + F.coalesce("r_b", F.lit(0.0))
    open_ = materialize(bound.where((slack > 0) & (_distance() <= 1 - percent / 100 + slack + 1e-9)).select("a", "b"), "jaccard-open")
    edges = stars.select("a", "b").union(_linked(between, percent).select("a", "b"))
    if not open_.isEmpty():
        edges = edges.union(_followers(open_, labelled, edges, sets, texts, words, percent))
    whole = components(edges, "jaccard-whole")
    named = materialize(sets.select("set_id", "set", "doc").join(whole.withColumnRenamed("node", "set"), "set", "left").select("set_id", "doc", F.coalesce("comp", "set").alias("comp")), "jaccard-named")
    least = materialize(named.groupBy("comp").agg(F.min("doc").alias("component_id")), "jaccard-least")
    found = materialize(named.join(least, "comp").select("set_id", "component_id"), "jaccard-components")
    narrow = materialize(rows.select("doc_id", "set_id", "size"), "jaccard-documents")
    release(rows, sets, first, radius, labelled, asked, between, open_, whole, named, least)
    return narrow.join(found, "set_id", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def compared(pairs: DataFrame, names: DataFrame, texts: DataFrame, words: int, label: str) -> DataFrame:
    """overlaps() of each pair once, written."""
    asked = materialize(pairs, f"{label}-pairs")
    found = overlaps(asked, names, texts, words)
    out = materialize(found.dropDuplicates(["a", "b"]), label)
    release(asked, *found.scratch_tables)
    return out


def _followers(open_: DataFrame, labelled: DataFrame, edges: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between followers of leaders whose bound leaves them open, and that nothing links yet."""
    comps = components(edges, "jaccard-second")
    ends = materialize(open_.select(F.col("a").alias("center")).union(open_.select(F.col("b").alias("center"))).distinct(), "jaccard-ends")
    rows = labelled.drop("comp").join(ends, "center", "left_semi").join(comps.select(F.col("node").alias("set"), F.col("comp").alias("whole")), "set", "left")
    # here every set is its own center, and the components are those known by now
    rows = materialize(rows.select("token", "size", "place", F.col("set").alias("center"), F.coalesce("whole", "set").alias("comp"), "set", "pivot", "apart"), "jaccard-followers")
    asked = _candidates(rows, sets, percent)
    found = compared(asked, sets.select("set", "doc", "set_id"), texts, words, "jaccard-open-overlaps")
    release(comps, ends, rows, asked)
    return _linked(found, percent).select("a", "b")


def one_of_each(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns, whatever their names.

    Of each component the row with the smallest doc_id stays (of rows that repeat it, all), and all
    rows without a doc_id. Null and empty texts stand alone and stay.
    """
    stays = fresh_name(documents, "_stays")
    found = similarity_components(documents, words, percent).where("doc_id = component_id OR doc_id IS NULL")
    stay = found.select(F.col("doc_id").alias(stays)).distinct()
    return documents.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(stays)), "left_semi")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))
