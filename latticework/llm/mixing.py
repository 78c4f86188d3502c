"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates between 0 and 3 copies, entropy balancing picks those closest to one
copy each (in relative entropy) under which every source's words meet its target.  The convex
dual has one multiplier per source; its solution tilts rates exponentially in the document's
size, ``rate = min(3, exp(lambda_source * size / mean_size))``.  Newton steps, kept inside a
bracket, run on a pre-aggregated table of (source, size, count), so a step costs one small
aggregate however the documents are spread; sums are decimals, so reruns agree bit by bit.

Rates become whole copies: inside a source, sizes descending, a running sum of fractional
copies is rounded, and a source's remaining error is settled with whole copies of a few sizes.
Which documents of a (source, size) class get the extra copy follows a hash of their id; large
classes are ranked in salted parts with offsets, never in one task.

Defined results: a null text has size 0 and is never taken; null is a source of its own, the
last; a source without words has target 0; repeated rows are separate documents; other columns
play no part; no rows give no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, numbered, picked, row_key, rows_of, skew_join

MAX_COPIES = 3
PART_ROWS = 2_000
WORDS = r"[^\x20\x09-\x0D]+"


def share_targets(sizes: list[int], weights: list[float], cap: float = MAX_COPIES) -> list[float]:
    """Targets by weight that share ``sum(sizes)``; what exceeds ``cap`` times a size is reshared."""
    targets = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
            free.remove(i)
    return targets


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few driver-side rows as an SQL expression."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _rate(lam: str = "lam", x: str = "x") -> Column:
    return F.exp(F.least(F.col(lam) * F.col(x), F.lit(math.log(MAX_COPIES))))


def solve(classes: DataFrame, sources: list[dict], rounds: int = 60, tolerance: float = 1e-7) -> dict[int, float]:
    """Multipliers by Newton's method on the dual, all sources at once; ``None`` means cap."""
    spark = classes.sparkSession
    lam = {s["sid"]: 0.0 for s in sources if 0 < s["target"] < MAX_COPIES * s["source_size"]}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    by = {s["sid"]: s for s in sources}
    todo = set(lam)
    for _ in range(rounds):
        if not todo:
            break
        at = _small(spark, [{"sid": k, "lam": lam[k], "mean": by[k]["mean"]} for k in sorted(todo)], "sid:int,lam:double,mean:double")
        x = classes.join(at, "sid").withColumn("x", F.col("size") / F.col("mean"))
        words = F.col("n") * F.col("size") * _rate()
        slope = F.when(F.col("lam") * F.col("x") < math.log(MAX_COPIES), words * F.col("x")).otherwise(0.0)
        sums = x.groupBy("sid").agg(F.sum(words.cast("decimal(38,9)")).alias("g"), F.sum(slope.cast("decimal(38,9)")).alias("d"))
        for r in sums.collect():
            k, target, now = r.sid, by[r.sid]["target"], lam[r.sid]
            miss = float(r.g) - target
            if abs(miss) <= tolerance * target:
                todo.discard(k)
                continue
            low[k], high[k] = (now, high[k]) if miss < 0 else (low[k], now)
            step = now - miss / float(r.d) if r.d else math.nan
            inside = low[k] < step < high[k]
            if not inside:
                if math.isinf(low[k]):
                    step = 2 * now - 1
                elif math.isinf(high[k]):
                    step = 2 * now + 1
                else:
                    step = (low[k] + high[k]) / 2
            if step == now:
                todo.discard(k)
            lam[k] = step
    return lam


def settle(error: float, choices: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Whole copies ``(size, change)`` that bring ``error`` words near zero, largest sizes first.

    ``choices``: (size, copies that can be added, copies that can be removed)."""
    out = []
    for size, up, down in sorted(choices, reverse=True):
        room = up if error > 0 else down
        q = min(room, int(abs(error) // size))
        if q:
            q = q if error > 0 else -q
            out.append((size, q))
            error -= q * size
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``.

    Columns: doc_id, size, source_size, target, taken, copies, xh (hash of the raw text)."""
    return _mixed(picked(docs, "doc_id", "text", "source").withColumn("xh", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), weights)


def _mixed(docs: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """:func:`mix` for ``docs(doc_id, text, source, xh)``; ``xh`` is any hash that tells rows apart."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), "xh"),
        "sizes",
    )
    counted = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    found = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"), F.sum("n").alias("docs")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    targets = share_targets([r.source_size for r in found], [weights[i % len(weights)] for i in range(len(found))])
    sources = [
        {"sid": i, "source": r.source, "source_size": r.source_size, "target": t, "mean": max(1.0, r.source_size / r.docs)} for i, (r, t) in enumerate(zip(found, targets, strict=True))
    ]
    # One row per source: a table of configuration size.
    known = _small(spark, sources, "sid:int,source:string,source_size:long,target:double,mean:double")
    classes = cut(counted.alias("c").join(known.alias("k"), F.expr("c.source <=> k.source")).select("sid", "k.source", "size", "n"), "sids")
    lam = solve(classes, sources)
    rates = [
        {"sid": s["sid"], "lam": lam.get(s["sid"], 1e9 if s["target"] > 0 else -1e9), "mean": s["mean"], "none": s["target"] <= 0} for s in sources
    ]
    at = _small(spark, rates, "sid:int,lam:double,mean:double,none:boolean")
    rated = classes.join(at, "sid").withColumn("x", F.col("size") / F.col("mean"))
    rate = F.when((F.col("size") == 0) | F.col("none"), 0.0).otherwise(_rate())
    # All capped sources sit at the cap itself, free of rounding in exp and log.
    rated = rated.withColumn("rate", F.when(F.abs(rate - MAX_COPIES) < 1e-9, float(MAX_COPIES)).otherwise(rate))
    part = (F.col("n") * (F.col("rate") - F.floor("rate"))).cast("decimal(28,9)")
    running = F.sum(part).over(Window.partitionBy("sid").orderBy(F.desc("size")))
    # One window row per (source, size) class, not per document.
    rounded = rated.withColumn("up_to", F.floor(running + F.lit("0.5").cast("decimal(28,9)")).cast("long"))
    before = F.coalesce(F.lag("up_to").over(Window.partitionBy("sid").orderBy(F.desc("size"))), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("up_to") - before))
    counted = cut(rounded.select("sid", "source", "size", "n", (F.col("n") * F.floor("rate") + extra).cast("long").alias("copies")), "copies")
    taken = {r.sid: int(r.w) for r in counted.groupBy("sid").agg(F.sum((F.col("copies") * F.col("size")).cast("decimal(38,0)")).alias("w")).collect()}
    # At most 64 size classes a source (one per power of two) settle what is left.
    picks = (
        counted.where("size > 0")
        .groupBy("sid", F.floor(F.log2("size")).alias("b"))
        .agg(F.max(F.struct("n", "size", "copies")).alias("c"))
        .select("sid", "c.*")
        .collect()
    )
    choices: dict[int, list[tuple[int, int, int]]] = {}
    for r in picks:
        choices.setdefault(r.sid, []).append((r.size, MAX_COPIES * r.n - r.copies, r.copies))
    changes = [{"sid": s["sid"], "size": size, "change": q} for s in sources for size, q in settle(s["target"] - taken.get(s["sid"], 0), choices.get(s["sid"], []))]
    if changes:
        counted = counted.join(_small(spark, changes, "sid:int,size:long,change:long"), ["sid", "size"], "left")
    else:
        counted = counted.withColumn("change", F.lit(0))
    final = counted.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).join(known.drop("source"), "sid")
    final = final.select(
        F.xxhash64("source", "size").alias("class"), "source", "size", "n", "source_size", "target", F.expr("copies div n").alias("base"), F.expr("copies % n").alias("extra"), F.ceil(F.col("n") / PART_ROWS).alias("parts")
    )
    rows = rows.withColumn("class", F.xxhash64("source", "size"))
    joined = skew_join(rows, final.drop("source", "size"), ["class"])
    order = F.xxhash64("doc_id", F.lit("mix"))
    joined = joined.withColumn("order", order).withColumn("part", F.pmod("order", "parts").cast("int"))
    parts = joined.where("extra > 0").groupBy("class", "part").agg(F.count("*").alias("rows"))
    offsets = parts.withColumn("offset", F.sum("rows").over(Window.partitionBy("class").orderBy("part")) - F.col("rows")).drop("rows")
    place = F.row_number().over(Window.partitionBy("class", "part").orderBy("order", "doc_id", "xh"))
    ranked = joined.withColumn("place", place).join(offsets, ["class", "part"], "left")
    copies = F.col("base") + F.when(F.coalesce("offset", F.lit(0)) + F.col("place") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), "xh")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, all columns.

    Rows are told apart by id and a hash of all columns; rows that agree in all of them are the
    same and their copies count together.  Null texts and texts without words are never taken; a
    null source is one of its own; no rows give no rows; columns may have any names."""
    inner = numbered(docs)
    columns = [F.col(f"c{docs.columns.index(n)}").alias(n) for n in ("doc_id", "text", "source")]
    copies = _mixed(inner.select(*columns, row_key(inner).alias("xh")), weights).groupBy("doc_id", F.col("xh").alias("key")).agg(F.sum("copies").alias("n"))
    return rows_of(docs, cut(copies.where("n > 0"), "taken"), copies=True)
