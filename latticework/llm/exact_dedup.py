"""Exact dedup by composable polynomial fingerprints and chunkwise verification.

A text is cut into chunks; the fingerprint of a chunk is a polynomial in its bytes modulo
two primes, and fingerprints of neighbouring chunks combine by
``h(AB) = h(A) * base**len(B) + h(B)``, so a huge text is hashed in parts by many tasks and
their shifted fingerprints are summed.  Rows whose length and fingerprints agree are candidates; each is then compared with
the candidate group's representative, chunk by chunk, and rows that differ anywhere (a
collision) are split off by their digest.

Defined results: a null text counts as empty; empty texts are equal to each other; of equal
texts the row with the largest ``doc_id`` stays (a null id is the smallest; of repeated rows
with the same id exactly one stays); other columns play no part; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, drop, numbered, row_key, rows_of, shuffle_partitions, skew_join

CHUNK = 1 << 16
COMPARE_CHUNK = 1 << 20
SALT_ROWS = 2_000
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IDS = ("doc_id", "xh", "key", "uid")
PART = 1 << 20
# Candidates of up to so many rows of a few numbers are broadcast, more are joined by exchange.
BROADCAST_ROWS = 200_000
FP_SCHEMA = "doc_id long, xh long, key long, uid long, n_bytes long, h1 long, h2 long, sha string"
PART_SCHEMA = "doc_id long, xh long, key long, uid long, n_bytes long, sha string, h1 long, h2 long"


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo ``prime``, by doubling."""
    out = np.ones(n, dtype=np.int64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * pow(base, done, prime) % prime
        done += step
    return out


def combine(left: int, right: int, right_len: int, k: int) -> int:
    """Fingerprint ``k`` of the concatenation of two byte strings."""
    return (left * pow(BASES[k], right_len, PRIMES[k]) + right) % PRIMES[k]


def chunk_hashes(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, powers: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the non-empty chunks ``data[starts[i]:ends[i]]``, which lie end to end."""
    lens = ends - starts
    exponent = np.repeat(ends - 1, lens) - np.arange(starts[0], ends[-1])
    return np.add.reduceat((data.astype(np.int64) + 1) * powers[exponent], starts - starts[0]) % PRIMES[k]


def fingerprints(texts: list[bytes], chunk: int = CHUNK, block: int = 1 << 21) -> list[tuple[int, int]]:
    """Both fingerprints of each text; at most about ``block`` bytes are expanded at a time."""
    tables = [power_table(BASES[k], PRIMES[k], chunk) for k in range(2)]
    out = [[0, 0] for _ in texts]
    todo: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal todo, held
        if not todo:
            return
        data = np.frombuffer(b"".join(p for _, p in todo), dtype=np.uint8)
        ends = np.cumsum([len(p) for _, p in todo])
        starts = ends - np.array([len(p) for _, p in todo])
        both = [chunk_hashes(data, ends, starts, tables[k], k).tolist() for k in range(2)]
        for (row, piece), a, b in zip(todo, *both, strict=True):
            h = out[row]
            if h[0] or h[1]:
                h[0], h[1] = combine(h[0], a, len(piece), 0), combine(h[1], b, len(piece), 1)
            else:
                h[0], h[1] = a, b
        todo, held = [], 0

    for row, text in enumerate(texts):
        for at in range(0, len(text), chunk):
            todo.append((row, text[at : at + chunk]))
            held += len(todo[-1][1])
            if held >= block:
                flush()
    flush()
    return [(a, b) for a, b in out]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of whole texts."""
    for batch in batches:
        texts = [t.encode().lower() for t in batch.column("text").to_pylist()]
        pairs = fingerprints(texts)
        columns = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([a for a, _ in pairs], pa.int64()),
            pa.array([b for _, b in pairs], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*map(batch.column, IDS), *columns], names=[*IDS, "n_bytes", "h1", "h2", "sha"])


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of parts, each shifted by the length of what follows it in its text."""
    for batch in batches:
        parts = [t.lower() for t in batch.column("part").to_pylist()]
        behind = [n - at - len(p) for n, at, p in zip(batch.column("n_bytes").to_pylist(), batch.column("at").to_pylist(), parts, strict=True)]
        pairs = fingerprints(parts)
        shifted = [pa.array([h[k] * pow(BASES[k], b, PRIMES[k]) % PRIMES[k] for h, b in zip(pairs, behind, strict=True)], pa.int64()) for k in (0, 1)]
        names = [*IDS, "n_bytes", "sha"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *shifted], names=[*names, "h1", "h2"])


def _fingerprinted(base: DataFrame, part: int) -> DataFrame:
    """Fingerprints of all texts.  Those longer than ``part`` bytes are dealt out in parts, whose
    shifted fingerprints add up to the text's, so one huge text keeps many tasks busy."""
    size = F.octet_length("text")
    uid = F.monotonically_increasing_id()
    short = arrow(base.withColumn("uid", uid * 2).where(size <= part), _fingerprint_batches, FP_SCHEMA)
    long = base.withColumn("uid", uid * 2 + 1).where(size > part)
    long = long.select(*IDS, size.cast("long").alias("n_bytes"), F.sha2(F.translate("text", UPPER, LOWER), 256).alias("sha"), F.encode("text", "UTF-8").alias("bytes"))
    parts = long.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(part).cast("long"))))
    parts = parts.withColumn("part", F.expr(f"substring(bytes, cast(at as int) + 1, {part})")).drop("bytes")
    parts = parts.repartition(shuffle_partitions(base.sparkSession), "uid", "at")
    hashed = arrow(parts, _part_batches, PART_SCHEMA).groupBy(*IDS, "n_bytes", "sha")
    sums = [(F.sum(h) % p).alias(h) for h, p in zip(("h1", "h2"), PRIMES, strict=True)]
    return short.unionByName(hashed.agg(*sums))


def _base(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text, xh, key): xh tells raw texts apart, key whole rows."""
    inner = numbered(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    text = F.coalesce(text, F.lit(""))
    return inner.select(doc_id.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("xh"), row_key(inner).alias("key"))


def _unequal(base: DataFrame, fps: DataFrame) -> DataFrame:
    """Rows ``(doc_id, xh, bad)`` whose text differs from their candidate group's representative."""
    groups = fps.groupBy("n_bytes", "h1", "h2").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "xh")).alias("rep"))
    groups = groups.where("n > 1 and n_bytes > 0").select(
        "n_bytes", "h1", "h2", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.xh").alias("rep_xh")
    )
    # Equal raw texts of one id need no comparison; each (id, raw hash) is compared once.
    cand = skew_join(fps.select("doc_id", "xh", "n_bytes", "h1", "h2"), groups, ["n_bytes", "h1", "h2"]).drop("h1", "h2").distinct()
    cand = cut(cand, "cand")
    if cand.count() <= BROADCAST_ROWS:
        cand = F.broadcast(cand)
    text = F.translate("text", UPPER, LOWER)
    same_row = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.xh") == F.col("c.xh"))
    texts = cut(
        base.alias("t").join(cand.alias("c"), same_row).select("c.*", F.encode(text, "UTF-8").alias("bytes")).dropDuplicates(["doc_id", "xh", "n_bytes"]), "texts"
    )
    n_chunks = F.ceil(F.col("n_bytes") / COMPARE_CHUNK).cast("int")
    chunks = texts.withColumn("at", F.explode(F.sequence(F.lit(0), n_chunks - 1))).withColumn(
        "chunk", F.expr(f"substring(bytes, at * {COMPARE_CHUNK} + 1, {COMPARE_CHUNK})")
    )
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("xh") == F.col("rep_xh"))
    members = chunks.where(~is_rep).select(
        "doc_id", "xh", "rep_id", "rep_xh", "at", "chunk", F.pmod(F.xxhash64("doc_id", "xh"), F.col("salts")).cast("int").alias("salt")
    )
    reps = chunks.where(is_rep).select(
        F.col("rep_id").alias("r_id"), F.col("rep_xh").alias("r_xh"), F.col("at").alias("r_at"), F.col("chunk").alias("r_chunk"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("r_salt")
    )
    pair = members.join(
        reps, F.col("rep_id").eqNullSafe(F.col("r_id")) & F.expr("rep_xh = r_xh and at = r_at and salt = r_salt"), "left"
    )
    return pair.where("r_chunk is null or chunk <> r_chunk").select("doc_id", "xh", F.lit(True).alias("bad")).distinct()


def exact_dedup(docs: DataFrame, part: int = PART) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, xh and key (hashes of the raw text and of the whole row).
    """
    base = _base(docs)
    fps = cut(_fingerprinted(base, part), "fps")
    bad = _unequal(base, fps)
    on = F.col("f.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("f.xh") == F.col("b.xh"))
    rows = fps.alias("f").join(bad.alias("b"), on, "left").select("f.*", F.when(F.col("b.bad"), F.col("f.sha")).otherwise("").alias("tag"))
    rows = cut(rows, "rows")
    keys = ["n_bytes", "h1", "h2", "tag"]
    classes = rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "key", "uid")).alias("keep"))
    return skew_join(rows, classes, keys).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "xh", "key"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, all columns, one row per distinct text.

    Of equal texts the row of the largest id stays, a null id being the smallest; among rows of
    one id the one whose hash of all columns is largest.  Null and empty texts are equal; no rows
    give no rows; columns may have any names."""
    kept = exact_dedup(docs).where("kept").select("doc_id", "key")
    return rows_of(docs, cut(kept, "kept"))
