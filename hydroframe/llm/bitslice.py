"""Exact top-k search with a bit-sliced index.

The index holds, for blocks of vectors, every component's leading bits as bitmaps over the block's
rows. A query's coarse score is the sum of its components' bits times these slices, added by carry-save
bitmap arithmetic for many rows and queries at once. The least coarse score of the top rows is found
from the most significant slice of the sum downward, rows whose true score may still reach it stand at
the boundary, and these alone are scored exactly. Query blocks meet index blocks by stripes; the
index is dealt out once, and each task keeps what it has found so far as the floor of what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.llm.shared import bounded_batches, materialize, release, table

#: Components are turned into whole numbers by floor(SCALE * x).
SCALE = 1024
#: Bitmaps an attribute, and leading bits of a query's components that multiply them.
SLICES, QUERY_BITS = 7, 7
#: Bytes of a block's vectors, and queries of a query block.
BLOCK_BYTES, QUERY_ROWS = 4 << 20, 128
#: Words of 64 rows that one bitmap operation works on, over all queries of a portion.
PORTION_WORDS = 4096
#: Query blocks whose best rows a task holds before it passes them on.
HELD_BLOCKS = 1024

INDEX = "n int, dims int, bits int, shift int, spread double, reach double, ids binary, low binary, high binary, vectors binary, slices binary"
QUERIES = "block long, q_n int, q_dims int, numbers binary, q_ids binary, queries binary"
FOUND = "number long, query_id long, vec_id long, score long, same boolean"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v, the components as whole numbers, of the rows that take part.

    A null identifier, a null vector, and a null, infinite or undefined component keep a row out; so does
    a component so large that a score might not fit a long (beyond 2**31, or the root of 9e18 by the
    number of components).
    """
    v = F.col(f"`{vector_col}`")
    most = F.least(F.lit(float(2**31 - 1)), F.sqrt(F.lit(9.0e18) / F.greatest(F.size(v), F.lit(1)))) - 1
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) <= most, F.lit(False)) & ~F.isnan(x.cast("double")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("raw"), fits.alias("fits")).where("id IS NOT NULL AND fits")
    return rows.select("id", F.transform("raw", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, short ones with zeros behind."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    dims = max(1, int(sizes.max(initial=0)))
    flat = np.asarray(lists.flatten(), np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def collected(batches: Iterator[pa.RecordBatch], limit) -> Iterator[pa.Table]:
    """Tables of so many rows as ``limit`` allows for the first of them."""
    held, rows, most = [], 0, None
    for batch in batches:
        while batch.num_rows:
            most = limit(batch) if most is None else most
            head = batch.slice(0, most - rows)
            held.append(head)
            rows += head.num_rows
            batch = batch.slice(head.num_rows)
            if rows == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, most = [], 0, None
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def columns_of(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return own["id"].to_numpy(), matrix(own["v"].chunk(0))


def block_row(ids: np.ndarray, x: np.ndarray) -> dict:
    """The index row of a block: exact vectors, and for each attribute the leading bits of its height above the least as bitmaps.

    spread and reach bound how far a vector lies, at most, from what its slices say and from the middle of the block.
    """
    low, high = x.min(axis=0), x.max(axis=0)
    bits = max(1, int((high - low).max()).bit_length())
    shift = max(0, bits - SLICES)
    rest = x - low
    top = rest >> shift
    inner = (rest - (top << shift)) - ((1 << shift) - 1) / 2
    slices = np.zeros((x.shape[1], bits - shift, 8 * -(-len(ids) // 64)), np.uint8)
    for s in range(bits - shift):
        packed = np.packbits(((top >> s) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        slices[:, s, : packed.shape[1]] = packed
    return {
        "n": len(ids), "dims": x.shape[1], "bits": bits - shift, "shift": shift,
        "spread": float(np.sqrt((inner**2).sum(axis=1).max())), "reach": float(np.sqrt(((x - (low + high) / 2) ** 2).sum(axis=1).max())),
        "ids": ids.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "vectors": x.astype(np.int32).tobytes(), "slices": slices.tobytes(),
    }


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index of all rows of ``vectors`` that take part (see whole_vectors), a row a block of one partition's vectors.

    Nothing is shuffled. Repeated rows are indexed each for itself. An empty table gives an empty index.
    """
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[x.split()[1]]) for x in INDEX.split(", ")])

    def rows_a_block(batch: pa.RecordBatch) -> int:
        return max(64, BLOCK_BYTES // (4 * max(1, len(batch["v"][0]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in collected(batches, rows_a_block):
            yield pa.RecordBatch.from_pylist([block_row(*columns_of(own))], schema=schema)

    bounded_batches(vectors.sparkSession)
    return whole_vectors(vectors, id_col, vector_col).mapInArrow(run, INDEX)


def query_blocks(queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Blocks of queries; every query row that takes part has a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in collected(batches, lambda _: QUERY_ROWS):
            ids, q = columns_of(own)
            numbers = own["number"].to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"block": [int(numbers[0])], "q_n": pa.array([len(ids)], pa.int32()), "q_dims": pa.array([q.shape[1]], pa.int32()), "numbers": [numbers.tobytes()], "q_ids": [ids.tobytes()], "queries": [q.tobytes()]}
            )

    rows = whole_vectors(queries, id_col, vector_col)
    return rows.withColumn("number", F.monotonically_increasing_id()).mapInArrow(run, QUERIES)


def add_up(terms: Iterator[tuple[int, np.ndarray]]) -> list[np.ndarray | None]:
    """The slices, least significant first, of the sum of bitmaps that each weigh a power of two, by full adders of three bitmaps; none where no bitmap weighs so much."""
    columns: list[list[np.ndarray]] = []

    def put(at: int, x: np.ndarray) -> None:
        while True:
            while len(columns) <= at:
                columns.append([])
            own = columns[at]
            own.append(x)
            if len(own) < 3:
                return
            a, b, c = own
            half = a ^ b
            columns[at] = [half ^ c]
            a &= b
            half &= c
            a |= half
            at, x = at + 1, a

    for at, x in terms:
        put(at, x)
    at = 0
    while at < len(columns):
        if len(columns[at]) == 2:
            a, b = columns[at]
            columns[at] = [a ^ b]
            put(at + 1, a & b)
        at += 1
    return [c[0] if c else None for c in columns]


def masks(flags: np.ndarray) -> np.ndarray:
    """All ones where a flag is set, as a column of words."""
    return np.where(flags, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]


@dataclass(frozen=True)
class Block:
    """A row of the index."""

    ids: np.ndarray
    x: np.ndarray
    slices: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shift: int
    spread: float
    reach: float

    @classmethod
    def of(cls, r: dict) -> Block:
        n, dims, bits = r["n"], r["dims"], r["bits"]
        whole = lambda k: np.frombuffer(r[k], np.int64)
        return cls(whole("ids"), np.frombuffer(r["vectors"], np.int32).reshape(n, dims), np.frombuffer(r["slices"], np.uint64).reshape(dims, bits, -1), whole("low"), whole("high"), r["shift"], r["spread"], r["reach"])

    def boundary(self, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows whose score may be among a query's k best of this block and reach its floor (-inf: none).

        q: queries by as many components as the block has. True scores lie within ``off`` of base + unit * coarse.
        """
        n, (dims, bits, words) = len(self.ids), self.slices.shape
        size = np.abs(q)
        drop = max(0, int(size.max(initial=0)).bit_length() - QUERY_BITS)
        g = (size + ((1 << drop) >> 1)) >> drop
        down = q < 0
        coarse = np.where(down, -g, g) << drop
        rest = (q - coarse).astype(float)
        middle, inner, unit = (self.low + self.high) / 2, ((1 << self.shift) - 1) / 2, float(1 << (self.shift + drop))
        base = coarse @ self.low - unit * ((1 << bits) - 1) * (g * down).sum(axis=1) + inner * coarse.sum(axis=1) + rest @ middle
        off = np.minimum(np.linalg.norm(coarse.astype(float), axis=1) * self.spread, inner * np.abs(coarse).sum(axis=1))
        off += np.minimum(np.linalg.norm(rest, axis=1) * self.reach, np.abs(rest) @ ((self.high - self.low) / 2))
        greatest = np.maximum(np.abs(self.low), np.abs(self.high)).astype(float)
        off = off * (1 + 1e-9) + 1 + 1e-12 * (size @ greatest + unit * (1 << bits) * g.sum(axis=1))  # what rounding in doubles may do

        turned = masks(down.ravel()).reshape(*q.shape, 1)

        def terms() -> Iterator[tuple[int, np.ndarray]]:
            for d in range(dims):
                used = [(j, masks((g[:, d] >> j) & 1 == 1)) for j in range(int(g[:, d].max(initial=0)).bit_length())]
                for s in range(bits if used else 0):
                    plane = self.slices[d, s] ^ turned[:, d]
                    for j, mask in used:
                        yield s + j, plane & mask

        there = np.zeros(8 * words, np.uint8)
        packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
        there[: len(packed)] = packed
        rows = np.broadcast_to(there.view(np.uint64), (len(q), words))
        total = add_up(terms())
        cut = np.zeros(len(q))
        if n > k:
            # the k-th greatest coarse score, from the most significant slice downward
            sure, equal, kth = np.zeros_like(rows), rows.copy(), np.zeros(len(q))
            for p in range(len(total) - 1, -1, -1):
                if total[p] is None:
                    continue
                ones = equal & total[p]
                enough = np.bitwise_count(sure | ones).sum(axis=1) >= k
                many = masks(enough)
                sure |= ones & ~many
                equal = np.where(many != 0, ones, equal & ~ones)
                kth += np.where(enough, float(1 << p), 0.0)
            cut = kth - 2 * off / unit
        cut = np.floor(np.maximum(cut, (floor - base - off) / unit) - 1e-6)
        # rows whose coarse score is the cut or more, from the most significant slice downward
        top = float(1 << len(total))
        limit = np.clip(cut, 0, top - 1).astype(np.int64)
        more, equal = np.zeros_like(rows), rows & ~masks(cut >= top)
        for p in range(len(total) - 1, -1, -1):
            bit = masks((limit >> p) & 1 == 1)
            plane = total[p] if total[p] is not None else np.zeros_like(rows)
            more |= equal & plane & ~bit
            equal = equal & ~(plane ^ bit)
        return np.nonzero(np.unpackbits(np.ascontiguousarray(more | equal).view(np.uint8), axis=1, bitorder="little")[:, :n])


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k greatest scores, ties to the smaller identifier, by query and rank."""
    order = np.lexsort((ids, -score, query))
    by = query[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, int)
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[place < k]


def search_block(block: Block, q: np.ndarray, q_ids: np.ndarray, found: tuple, k: int) -> tuple:
    """The k best rows of each query, as (query, score, id, same), of those found before and the block's."""
    both = min(block.x.shape[1], q.shape[1])
    own = np.zeros((len(q), block.x.shape[1]), np.int64)
    own[:, :both] = q[:, :both]
    floor = np.full(len(q), -np.inf)
    if len(found[0]):
        counts = np.bincount(found[0], minlength=len(q))
        last = np.cumsum(counts) - 1
        full = counts >= k
        floor[full] = found[1][last[full]]
    parts, step = [found], max(1, PORTION_WORDS // block.slices.shape[2])
    for at in range(0, len(q), step):
        qi, ri = block.boundary(own[at : at + step], k, floor[at : at + step])
        qi = qi + at
        score = np.einsum("ij,ij->i", own[qi], block.x[ri].astype(np.int64))
        twin = block.ids[ri] == q_ids[qi]
        for p in np.flatnonzero(twin):  # the query's own row, or a copy of it
            width = max(block.x.shape[1], q.shape[1])
            twin[p] = np.array_equal(np.pad(block.x[ri[p]], (0, width - block.x.shape[1])), np.pad(q[qi[p]], (0, width - q.shape[1])))
        keep = best(qi, score, block.ids[ri], twin, k)
        parts.append((qi[keep], score[keep], block.ids[ri][keep], twin[keep]))
    joined = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    keep = best(*joined, k)
    return tuple(x[keep] for x in joined)


def top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: each query row's k greatest scores (all, if fewer) of the index's rows but its own, ties to the smaller identifier.

    ``index``: from build_index(); ``queries``: from query_blocks(), both written as tables. Vectors of
    unlike length are compared as if zeros stood behind the shorter. A repeated row is a candidate of
    its copies, and as a query gives its rows each time. No query or no candidate gives no rows.
    """
    spark = index.sparkSession
    stripes = max(1, min(index.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    wide = k + 1  # the query's own row may be among them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held: dict[int, tuple] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for numbers, q_ids, (qi, score, ids, same) in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(numbers[qi]), pa.array(q_ids[qi]), pa.array(ids), pa.array(score), pa.array(same)], names=["number", "query_id", "vec_id", "score", "same"])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                block = Block.of(r)
                numbers, q_ids = np.frombuffer(r["numbers"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                q = np.frombuffer(r["queries"], np.int64).reshape(r["q_n"], r["q_dims"])
                if r["block"] not in held and len(held) >= HELD_BLOCKS:
                    yield from passed_on()
                found = held[r["block"]][2] if r["block"] in held else nothing
                held[r["block"]] = numbers, q_ids, search_block(block, q, q_ids, found, wide)
        yield from passed_on()

    bounded_batches(spark)
    dealt = index.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int"))
    asked = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    found = dealt.join(asked, "stripe").drop("stripe").mapInArrow(run, FOUND)
    by = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    ranked = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= wide)
    ranked = ranked.withColumn("own", F.min(F.when(F.col("same"), F.col("place"))).over(Window.partitionBy("number")))
    rank = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    return ranked.where(F.col("own").isNull() | (F.col("place") != F.col("own"))).select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


#: Every so many identifiers are queries, and so many rows are returned for each.
EVERY, K = 100, 10


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    wanted = vectors.where(F.col("vec_id") % EVERY == 0)
    parts = -(-wanted.count() // (8 * QUERY_ROWS)) or 1
    index = materialize(build_index(vectors), "bits-index")
    queries = materialize(query_blocks(wanted.repartition(parts)), "bits-queries")
    out = materialize(top_k(index, queries, K), "bits-found")
    release(index, queries)
    return out


OP13_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.r <> q.r
  WHERE q.vec_id % 100 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM k WHERE rank <= 10
"""
