"""Exact top-k by inner product over a bit-sliced index.

Vectors of integers are dealt to blocks; a block stores, per dimension, the bits of (value - smallest value) as bitmaps over its rows: one
slice per bit. A query adds the slices of every dimension, shifted by the bits of its own component, with bitmap arithmetic
(full adders over equal weights); a negative component adds the slices of (largest value - value) instead. The sum's slices
hold every row's score but for a constant. The top rows are then selected from the most significant slice downward: rows above the
k-th score are settled slice by slice, rows that tie with it stay open to the last slice, and of these the smallest ids are taken.

Queries are dealt to the blocks in chunks; each block returns k rows per query, and the best k of all blocks are kept.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without id. Rows that
repeat an id, or a whole row, are rows of their own: each is a candidate of the others and, where its id is a query, a query of
its own (its results then repeat the query_id). Vectors only meet vectors of their own length; with fewer than k candidates all are returned; no
queries, no rows. Vectors so large that a score might not fit 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votepanel.session import cut_lineage

BLOCK_ROWS, CHUNK_QUERIES = 32_768, 512


class BitSlices:
    """Index of one block: ``ids`` ascending (with the number of each row), slices of every dimension as rows of uint64 words."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> None:
        turn = np.lexsort((numbers, ids))
        self.ids, values = ids[turn], values[turn]
        self.place = {n: at for at, n in enumerate(numbers[turn].tolist())}
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.bits = [int(h - lo).bit_length() for lo, h in zip(self.low.tolist(), self.high.tolist(), strict=True)]
        self.words = -(-len(ids) // 64)
        self.up = [self.slices(values[:, d] - self.low[d], b) for d, b in enumerate(self.bits)]
        self.down = [self.slices(self.high[d] - values[:, d], b) for d, b in enumerate(self.bits)]
        self.rows = self.pack(np.ones(len(ids), bool))

    def pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[: len(flags)] = flags
        return np.packbits(out, bitorder="little").view(np.uint64)

    def slices(self, values: np.ndarray, bits: int) -> list[np.ndarray]:
        return [self.pack((values >> b) & 1) for b in range(bits)]

    def sums(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of every row's score less a constant, and the constant."""
        columns: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query):
            source, edge = (self.up, self.low) if q >= 0 else (self.down, self.high)
            constant += q * int(edge[d])
            q = abs(q)
            for shift in range(q.bit_length()):
                if q >> shift & 1:
                    for b, bitmap in enumerate(source[d]):
                        while len(columns) <= shift + b:
                            columns.append([])
                        columns[shift + b].append(bitmap)
        out = []
        at = 0
        while at < len(columns):
            stack = columns[at]
            while len(stack) > 1:
                if len(columns) == at + 1:
                    columns.append([])
                if len(stack) == 2:  # half adder
                    a, b = stack
                    columns[at + 1].append(a & b)
                    stack = [a ^ b]
                    break
                a, b, c = stack[0], stack[1], stack[2]
                x = a ^ b
                columns[at + 1].append((a & b) | (x & c))
                stack = [*stack[3:], x ^ c]
            out.append(stack[0] if stack else np.zeros(self.words, np.uint64))
            at += 1
        return out, constant

    def top(self, slices: list[np.ndarray], k: int, leave_out: int | None) -> np.ndarray:
        """Places of the k best rows (all, if fewer) but for the row of number ``leave_out``, ties to the smaller id."""
        open_rows = self.rows
        at = self.place.get(leave_out)
        if at is not None:
            open_rows = open_rows.copy()
            open_rows[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        settled = np.zeros(self.words, np.uint64)
        for s in reversed(slices):
            ones = open_rows & s
            trial = settled | ones
            n = int(np.bitwise_count(trial).sum())
            if n > k:
                open_rows = ones
            else:
                settled, open_rows = trial, open_rows & ~s
                if n == k:
                    open_rows = np.zeros_like(open_rows)
                    break
        best, ties = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (settled, open_rows))
        return np.concatenate([best, ties[: k - len(best)]])

    def scores(self, slices: list[np.ndarray], constant: int, places: np.ndarray) -> np.ndarray:
        total = np.full(len(places), constant, np.int64)
        word, bit = places // 64, (places % 64).astype(np.uint64)
        for b, s in enumerate(slices):
            total += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << b
        return total


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, numbers, values, q_ids, q_numbers, queries = (batch.column(c)[row].values for c in range(6))
                dim = batch.column(6)[row].as_py()
                block = BitSlices(ids.to_numpy(), numbers.to_numpy(), values.flatten().to_numpy().reshape(-1, dim))
                out: list[list] = [[], [], [], []]
                for q_id, number, q in zip(q_ids.to_pylist(), q_numbers.to_pylist(), queries.to_pylist(), strict=True):
                    slices, constant = block.sums(q)
                    places = block.top(slices, k, number)
                    out[0].append(np.full(len(places), q_id))
                    out[1].append(np.full(len(places), number))
                    out[2].append(block.ids[places])
                    out[3].append(block.scores(slices, constant, places))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0), pa.int64()) for x in out], names=["query_id", "number", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every query row, by integer inner product of floor(scale * x).

    ``vectors``: ``vec_id`` and ``embedding``; ``is_query``: a condition on ``vec_id``."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & sound)
    # four times the largest sum of products, also between the slices, stays under 2^63
    largest = F.array_max(F.transform("x", lambda v: F.abs(v * F.lit(scale)) + 1))
    fits = 4.0 * F.size("x") * largest * largest < 2.0**63
    number = F.when(fits, F.floor(F.col("x")[0])).otherwise(F.raise_error(F.lit("vectors are too large for 64-bit scores")).cast("long"))
    ints = rows.withColumn("x", F.when(number.isNotNull(), F.col("x"))).select("vec_id", F.monotonically_increasing_id().alias("number"), F.transform("x", lambda v: F.floor(v * F.lit(scale))).alias("v"))
    ints = cut_lineage(ints.withColumn("dim", F.size("v")), "vectors")
    sizes = ints.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.count_if(is_query) / CHUNK_QUERIES).cast("int").alias("chunks"))

    def dealt(df: DataFrame, count: str, name: str, sign: str) -> DataFrame:
        no = F.pmod(F.xxhash64("number"), F.greatest(F.col(count), F.lit(1))).cast("int")
        row = F.collect_list(F.struct("vec_id", "number", "v"))
        return df.join(sizes, "dim").groupBy("dim", "blocks", no.alias(name)).agg(row.alias("_r")).select("dim", "blocks", name, *[F.col(f"_r.{c}").alias(f"{sign}_{c}") for c in ("vec_id", "number", "v")])

    blocks = dealt(ints, "blocks", "block", "c")
    queries = dealt(ints.where(is_query), "chunks", "chunk", "q").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = queries.drop("blocks").join(blocks.drop("blocks"), ["dim", "block"]).repartition(F.col("dim"), F.col("block"), F.col("chunk"))
    local = pairs.select(*[f"{s}_{c}" for s in "cq" for c in ("vec_id", "number", "v")], "dim").mapInArrow(_search(k), "query_id long, number long, vec_id long, score long")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every embedding whose vec_id is divisible by 20."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
