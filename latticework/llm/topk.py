"""Exact top-k inner products by MaxScore.

A vector's integer components are the impacts of its terms (dimensions).  Candidates are
packed into blocks, each an index shard of its own: for every dimension it keeps two impact-
ordered postings, the rows above the block's median and those below.  Against a query weight
``w`` the rows on the favourable side have a positive excess ``w * (c - median)`` over a base
score; the others have none, so base plus the largest excesses bound every score.

For a query, the threshold starts at the k-th exact score among the best rows of its strongest
postings.  Terms are ordered by largest excess; the weakest, whose excesses together cannot
lift the base to the threshold, are non-essential.  The postings of essential terms are
traversed, whatever their number, until every row has been met; rows in none of them are never
scored.  The terms of the rows met are then probed in chunks, strongest first, while a row's
partial score plus the bound of what is left still reaches the threshold.  Shards' answers are
merged.  ``met`` counts the rows that the traversals met, of ``held`` rows that they could have.

Query blocks meet candidate blocks, never rows rows; a block holds a bounded number of bytes.
Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id; shorter vectors count as padded with zeros; candidates with the query's
id are its own; a repeated query id is asked once; ties go to the smaller id; queries without
candidates, and empty tables, give no rows; components and
scores beyond a long count as the nearest one (of components, that a double can hold); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, cut, picked, shuffle_partitions

BLOCK_VALUES = 1 << 17
CHUNK = 16
PAIR_ROWS = 8
MOST = (1 << 63) - 1
BLOCK_SCHEMA = "block long, n int, d int, ids binary, impacts binary"
TOP_SCHEMA = "query_id long, vec_id long, score long"


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of a partition in blocks; vectors of one block have one length."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    made = 0

    def block(d: int) -> pa.RecordBatch:
        nonlocal made
        rows = held.pop(d)
        made += 1
        ids = np.array([i for i, _ in rows], np.int64)
        impacts = np.stack([v for _, v in rows]) if d else np.zeros((len(rows), 0), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([made], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([impacts.tobytes()], pa.binary())],
            names=["block", "n", "d", "ids", "impacts"],
        )

    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("v")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = held.setdefault(b - a, [])
            own.append((i, flat[a:b]))
            if len(own) * max(1, b - a) >= BLOCK_VALUES:
                yield block(b - a)
    for d in list(held):
        yield block(d)


class Shard:
    """A block of candidates with its postings."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], impacts[order]
        self.largest = max(int(rows.max()), -int(rows.min())) if rows.size else 0
        self.rows = rows
        self.median = np.sort(rows, axis=0)[len(rows) // 2] if rows.size else np.zeros(rows.shape[1], np.int64)
        self.low, self.high = (rows.min(axis=0), rows.max(axis=0)) if rows.size else (self.median, self.median)
        self.ordered = np.argsort(rows, axis=0, kind="stable").T if rows.size else np.zeros((rows.shape[1], 0), np.int64)
        # Rows of dimension j in impact order: those before `below[j]` are under the median, those from `above[j]` on over it.
        spread = np.take_along_axis(rows.T, self.ordered, axis=1) if rows.size else self.ordered
        self.below = (spread < self.median[:, None]).sum(axis=1)
        self.above = (spread <= self.median[:, None]).sum(axis=1)
        self.as_type: dict[type, np.ndarray] = {}
        self.met = self.held = 0

    def values(self, kind: type) -> np.ndarray:
        if kind not in self.as_type:
            self.as_type[kind] = self.rows.astype(kind)
        return self.as_type[kind]

    def posting(self, j: int, w: int) -> np.ndarray:
        """Rows with an excess in dimension j, strongest first."""
        return self.ordered[j][self.above[j] :][::-1] if w > 0 else self.ordered[j][: self.below[j]]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but ``own``, ties to smaller ids."""
        n, d = self.rows.shape
        q = np.zeros(d, np.int64)
        q[: min(d, len(query))] = query[:d]
        # Sums of this size are exact in doubles; larger ones are formed with unbounded integers.
        strongest = max(int(q.max()), -int(q.min())) if d else 0
        kind = float if self.largest * strongest * max(d, 1) < 1 << 52 else object
        rows, weights = self.values(kind), q.astype(kind)
        others = self.ids != own
        if not others.any():
            return self.ids[:0], np.zeros(0, np.int64)
        median = self.median.astype(kind)
        excess = np.maximum(weights * (self.high.astype(kind) - median), weights * (self.low.astype(kind) - median))
        terms = np.argsort(-excess, kind="stable")
        terms = terms[: int((excess > 0).sum())]
        base = (weights * median).sum() if d else 0
        threshold = None
        seeds = [self.posting(j, int(q[j]))[: 4 * k] for j in terms[:4]]
        if seeds:
            seeds = np.unique(np.concatenate(seeds))
            seeds = seeds[others[seeds]]
            if len(seeds) >= k:
                threshold = min(np.sort(rows[seeds] @ weights)[-k], MOST)
        alive = others.copy()
        if threshold is not None:
            # bound[i]: what the terms from i on can add to the base at most
            bound = np.concatenate((np.cumsum(excess[terms][::-1])[::-1], [0 * base]))
            essential = min(int((base + bound >= threshold).sum()), len(terms))
            if base < threshold:  # else a row without any excess may be among the best
                reached = np.zeros(n, bool)
                for c, j in enumerate(terms[:essential]):
                    reached[self.posting(j, int(q[j]))] = True
                    if c % 8 == 7 and reached.all():
                        break
                alive &= reached
            self.met += int(alive.sum())
            self.held += int(others.sum())
        at = np.flatnonzero(alive)
        partial = np.zeros(len(at), kind) + base
        for c in range(0, len(terms), CHUNK):
            use = terms[c : c + CHUNK]
            partial = partial + (rows[np.ix_(at, use)] - median[use]) @ weights[use]
            if threshold is not None:
                still = partial + bound[min(c + CHUNK, len(terms))] >= threshold
                at, partial = at[still], partial[still]
        rest = np.setdiff1d(np.flatnonzero(q), terms)
        if len(rest):  # weights whose dimension never exceeds the base
            partial = partial + (rows[np.ix_(at, rest)] - median[rest]) @ weights[rest]
        scores = partial.astype(np.int64) if kind is float else np.array([max(-MOST, min(MOST, int(s))) for s in partial], np.int64)
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def _pair_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            out_q, out_v, out_s = [], [], []
            for r in batch.to_pylist():
                if last != (r["c_block"], r["c_ids"]):
                    last = (r["c_block"], r["c_ids"])
                    shard = Shard(np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["c_impacts"], np.int64).reshape(r["c_n"], r["c_d"]))
                asked = np.frombuffer(r["impacts"], np.int64).reshape(r["n"], r["d"])
                for own, query in zip(np.frombuffer(r["ids"], np.int64).tolist(), asked, strict=True):
                    ids, scores = shard.top(query, own, k)
                    out_q.append(np.full(len(ids), own))
                    out_v.append(ids)
                    out_s.append(scores)
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best rows of ``vectors(vec_id, v)`` for each of ``queries(vec_id, v)``, both with
    integer components: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    shards = shuffle_partitions(spark)
    blocks = arrow(vectors, _pack_batches, BLOCK_SCHEMA).select(*[F.col(c).alias(f"c_{c}") for c in ("block", "n", "d", "ids", "impacts")])
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("c_ids"), F.lit(shards)).cast("int"))
    asked = arrow(queries, _pack_batches, BLOCK_SCHEMA).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # One row per pair of blocks, each of bounded bytes; few of them at a time go to Python.
    pairs = blocks.join(asked.hint("merge"), "shard")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, PAIR_ROWS)
    try:
        found = cut(arrow(pairs, _pair_batches(k), TOP_SCHEMA), "top")
    finally:
        spark.conf.set(name, was)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with ``floor(256 * x)`` of every component, for rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    most = float((1 << 63) - (1 << 10))  # the largest double that a long holds
    value = lambda x: F.floor(F.greatest(F.lit(-float(1 << 63)), F.least(F.lit(most), x.cast("double") * 256))).cast("long")
    rows = picked(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", value).alias("v"))


def embedding_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; all rows are candidates."""
    rows = quantised(embeddings)
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return top_k(rows, queries, k)
