"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id), so equal texts lie side by side.  The splitters
between shards are found by counting: each round sums the exact bytes of the rows below every
candidate key, keeps for each splitter the gap that its target falls into, and probes inside
these gaps only, until a candidate is within tolerance of the target.  A group of equal texts
stays whole unless cutting at its edges would miss the target by more than ``GROUP_TOLERANCE``
of a shard; then ids inside the group are probed.  Rows then move once.

Slots number a shard's rows without gaps: rows are ranked inside cells of bounded size and
offset by the rows of the cells before them, so no task ever holds a shard.

Defined results: a null text has 16 bytes, crc32 0, and is in the group of empty texts; a null
id sorts first; rows that agree in text and id stay together; other columns play no part; no
rows give no rows.  The law is ``bytes``; ``grown_shard`` belongs to another law and is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, picked

ROW_BYTES = 16
DIGIT = 12
TOLERANCE = 0.005
GROUP_TOLERANCE = 0.05
CELL_BITS = 12
HOT_CELLS = 1_000
LOWEST = -(1 << 63)


def _prefix(level: int, shift_ids: int) -> list[Column]:
    """Key prefix at a level: digits of the hash, then of the id's offset."""
    if DIGIT * level < 64:
        return [F.shiftright("k", 64 - DIGIT * level).alias("a"), F.lit(0).cast("long").alias("b")]
    deeper = max(0, shift_ids - DIGIT * (level - math.ceil(64 / DIGIT)))
    ids = F.lit(0).cast("long") if deeper >= shift_ids else F.shiftright("off", deeper)
    return [F.col("k").alias("a"), ids.alias("b")]


def splitters(rows: DataFrame, n_shards: int) -> list[tuple[int, int] | None]:
    """Keys ``(hash, id)`` of the first row of shards 1 .. n-1; None: beyond all rows.

    ``rows(k, doc_id, size)``.  What a round collects is bounded: at most ``n_shards`` gaps of
    ``2**DIGIT`` counts each."""
    sums = rows.agg(F.sum("size").alias("total"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if sums.total is None:
        return [None] * (n_shards - 1)
    total, low = int(sums.total), int(sums.low)
    id_bits = max(1, (int(sums.high) - low).bit_length())
    # An id range of the full 64 bits would overflow the offset; halving keeps the order.
    off = F.col("doc_id") - F.lit(low) if id_bits < 63 else F.shiftright("doc_id", 2) - F.lit(low >> 2)
    id_bits = id_bits if id_bits < 63 else 63
    rows = rows.withColumn("off", off)
    wanted = {j: total * j / n_shards for j in range(1, n_shards)}
    shard = total / n_shards
    out: dict[int, tuple[int, int] | None] = {}
    gaps: dict[tuple[int, int] | None, tuple[int, list[int]]] = {None: (0, list(wanted))}
    hash_levels = math.ceil(64 / DIGIT)
    last_level = hash_levels + math.ceil(id_bits / DIGIT)

    def key(level: int, a: int, b: int) -> tuple[int, int]:
        if DIGIT * level < 64:
            return a << (64 - DIGIT * level), LOWEST
        if level == hash_levels:
            return a, LOWEST
        base = (b << max(0, id_bits - DIGIT * (level - hash_levels)))
        return a, (base + low if id_bits < 63 else (base + (low >> 2)) << 2)

    for level in range(1, last_level + 1):
        if not gaps:
            break
        counted = rows.select(*_prefix(level, id_bits), "size", *[c.alias(f"_{c_name}") for c, c_name in zip(_prefix(level - 1, id_bits) if level > 1 else [], "ab", strict=False)])
        if level > 1:
            inside = None
            for g in gaps:
                hit = (F.col("_a") == g[0]) & (F.col("_b") == g[1])
                inside = hit if inside is None else inside | hit
            counted = counted.where(inside)
        held: dict[tuple[int, int] | None, list] = {}
        parent = ["_a", "_b"] if level > 1 else []
        for r in counted.groupBy("a", "b", *parent).agg(F.sum("size").alias("bytes")).collect():
            held.setdefault((r["_a"], r["_b"]) if level > 1 else None, []).append((r.a, r.b, int(r.bytes)))
        tolerance = shard * (GROUP_TOLERANCE if level == hash_levels else TOLERANCE)
        following: dict[tuple[int, int] | None, tuple[int, list[int]]] = {}
        for g, (below, js) in gaps.items():
            bins = sorted(held[g])
            for j in js:
                at = below
                for i, (a, b, size) in enumerate(bins):
                    if at + size >= wanted[j] or i == len(bins) - 1:
                        break
                    at += size
                down, up = abs(wanted[j] - at), abs(at + size - wanted[j])
                if min(down, up) <= tolerance or level == last_level:
                    if down <= up:
                        out[j] = key(level, a, b)
                    elif i + 1 < len(bins):
                        out[j] = key(level, *bins[i + 1][:2])
                    else:
                        out[j] = _after(level, a, b, key, hash_levels, g)
                else:
                    following.setdefault((a, b), (at, []))[1].append(j)
        gaps = following
    return [out[j] for j in sorted(out)]


def _after(level: int, a: int, b: int, key, hash_levels: int, gap) -> tuple[int, int] | None:
    """The first key behind the last bin of a gap."""
    if level > hash_levels:
        return (a + 1, LOWEST) if a + 1 < 1 << 63 else None
    step = 64 - DIGIT * level if DIGIT * level < 64 else 0
    return ((a + 1) << step, LOWEST) if (a + 1) << step < 1 << 63 else None


def shard(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        picked(docs, "doc_id", "text").select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"),
            F.col("doc_id").isNull().alias("no_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("k"),
        ),
        "keys",
    )
    found = splitters(rows, n_shards)
    bounds = [F.struct(F.lit(s[0]).cast("long").alias("k"), F.lit(s[1]).cast("long").alias("doc_id")) for s in found if s is not None]
    place = F.size(F.filter(F.array(*bounds), lambda s: s <= F.struct("k", "doc_id"))) if bounds else F.lit(0)
    cells = rows.withColumn("shard", place.cast("int")).withColumn("cell", F.shiftright("k", 64 - CELL_BITS).cast("int"))
    total = rows.count()
    # Fewer than HOT_CELLS cells can each hold more than a HOT_CELLS-th of all rows.
    hot = cells.groupBy("shard", "cell").count().where(F.col("count") > max(PART_LEAST, total // HOT_CELLS)).collect()
    salts = F.lit(1)
    if hot:
        named = [x for r in hot for x in (F.lit(f"{r.shard}/{r.cell}"), F.lit(math.ceil(r["count"] / max(PART_LEAST, total // HOT_CELLS))))]
        salts = F.coalesce(F.element_at(F.create_map(*named), F.concat_ws("/", "shard", "cell")), F.lit(1))
    cells = cells.withColumn("sub", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    counts = cells.groupBy("shard", "cell", "sub").count()
    offsets = counts.select("shard", "cell", "sub", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell", "sub")) - F.col("count")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell", "sub").orderBy("k", "doc_id"))
    placed = cells.withColumn("inside", inside).join(offsets, ["shard", "cell", "sub"])
    return placed.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


PART_LEAST = 100
