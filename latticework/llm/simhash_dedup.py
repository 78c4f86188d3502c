"""SimHash near-dedup with the general pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles.  The bits are grouped into ``m``
partitions, correlated bits together.  If two fingerprints differ in at most ``tau`` bits
and the thresholds ``t_1 .. t_m`` (each -1 or more) sum to ``tau - m + 1``, then in some
partition they differ in at most ``t_i`` bits; a dynamic programme picks the thresholds with
the fewest estimated candidates.  In partition ``i`` every fingerprint enters the buckets of
all values within ``ceil(t_i / 2)`` bits of its own (none for -1); two entries of a bucket are
candidates if their distances to its value sum to at most ``t_i``, and every candidate is
verified on all bits.

Only distinct fingerprints are compared.  A bucket is walked in one task while it holds at
most ``BUCKET_ROWS`` entries; larger buckets take another exact way.  For small ``tau`` it is
linear in their size: two fingerprints are within three bits if and only if some value is
within two bits of one and one bit of the other (in general ``tau - tau // 2`` and
``tau // 2``), so all that meet at a value are linked to one hub there.  For larger ``tau`` the
bucket is cut into blocks and every pair of blocks is a row of its own.  Links are reduced to
spanning trees in each task before components are found, so no group's pairs are ever emitted.

With ``wide``, links are confirmed by a second fingerprint of 64 bits: both together must
differ in at most ``wide`` bits.

The pipeline's near-dedup stage (``keep_one``) links texts whose sets of shingles have a Jaccard
similarity of 0.8 or more.  The fingerprints of the sets are grouped as above, by the same code
and ``tau``.  Such pairs may differ in more than ``tau`` bits, so sets of different groups also
meet by prefix filtering, which loses none; sizes and 128 SimHash bits sort out most other pairs
(sets of up to ``SKETCH_FROM`` shingles are never judged by bits).  Pairs of one group are not
looked at again there.  Bits alone link other texts too, so every link is confirmed on the shingles.

Defined results: a null text counts as empty; texts without words have fingerprint zero and
are linked like any other (in the stage with each other only); rows with a null id take part and carry null; other columns play
no part; no rows give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, components, cut, drop, numbered, picked, row_key, rows_of, shuffle_partitions, skew_join

BITS, TAU = 64, 3
BUCKET_ROWS = 1 << 14
MAX_RADIUS = 2
# An entry is exploded, exchanged and sorted; a candidate is one step of a vector.
ENTRY_COST = 300
SEED = 42
FP_SCHEMA = "doc_id long, xh long, uid long, fp long, fp2 long"
HUB_TAU = 3
SET_SCHEMA = "doc_id long, xh long, id long, n int, fp long, fp2 long, prefix array<long>"
# The pipeline's stage links at a Jaccard similarity of 4 / 5.
NEAR = (4, 5)
# The sketches of a pair at 0.8 differ in about 19.4 bits of 128, with a deviation near 4.
SKETCH_FROM, SKETCH_BITS = 32, 46
SAMPLE_ROWS, COMMON, COMMON_MOST = 8_000, 4, 100_000
RUN_SHINGLES = 1 << 22
# Links of up to so many rows are broadcast to find their texts, more are joined by exchange.
BROADCAST_ROWS = 200_000


def simhash(text: bytes, width: int, seeds: tuple[int, ...] = (SEED,), block: int = 1 << 17) -> list[int]:
    """64-bit SimHashes, one a seed, over ``width``-word shingles of lower-cased UTF-8, repeats included."""
    words = text.lower().split()
    if not words:
        return [0] * len(seeds)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    out = []
    for seed in seeds:
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(first), block):
            raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + block], last[at : at + block], strict=True)])
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big"))
    return out


def _simhash_batches(width: int, seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t.as_py().encode(), width, seeds) for t in batch.column("text")], dtype=np.uint64).reshape(-1, len(seeds)).view(np.int64)
            both = [pa.array(values[:, 0]), pa.array(values[:, -1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("xh"), batch.column("uid"), *both], names=["doc_id", "xh", "uid", "fp", "fp2"])

    return run


def bit_groups(co: np.ndarray, ones: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Group the bits into ``m`` equal partitions, each grown from a seed by highest correlation."""
    p = ones / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((co / max(n, 1) - np.outer(p, p)) / np.outer(var, var))
    left, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        sub = corr[np.ix_(left, left)] - np.eye(len(left)) * 9
        group = [left[int(sub.max(axis=1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def ball_counts(hist: np.ndarray, radius: int) -> list[float]:
    """For a histogram over all values of a partition: ordered pairs within 0 .. radius bits."""
    bits = len(hist).bit_length() - 1
    index = np.arange(len(hist))
    shells = [hist.astype(float)] + [np.zeros(len(hist)) for _ in range(radius)]
    for b in range(bits):
        flipped = index ^ (1 << b)
        for r in range(radius, 0, -1):
            shells[r] = shells[r] + shells[r - 1][flipped]
    return np.cumsum([float((hist * s).sum()) for s in shells]).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The least summed cost and its thresholds; ``costs[i][t + 1]`` is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if have + t not in step or cost + c < step[have + t][0]:
                    step[have + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def _co_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    co, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        raw = batch.column("fp").to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float32)
        for at in range(0, len(bits), 1 << 16):
            piece = bits[at : at + (1 << 16)]
            co += (piece.T @ piece).astype(np.int64)
        n += len(bits)
    rows = np.repeat(np.arange(BITS), BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows.astype(np.int32)), pa.array(np.tile(np.arange(BITS), BITS).astype(np.int32)), pa.array(co.ravel()), pa.array(np.full(BITS * BITS, n))], names=["i", "j", "n", "rows"]
    )


def _gather(fp: Column, bits: list[int]) -> Column:
    """The value of a fingerprint's ``bits`` as a number, first bit lowest; runs of bits share a shift."""
    out, at = F.lit(0).cast("long"), 0
    while at < len(bits):
        n = 1
        while at + n < len(bits) and bits[at + n] == bits[at] + n:
            n += 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bits[at]).bitwiseAND(F.lit((1 << n) - 1)), at))
        at += n
    return out


def plan(nodes: DataFrame, n: int, tau: int = TAU) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and thresholds.  Estimates are gathered from all fingerprints; their
    tables are bounded (64 x 64 counts; at most 2**16 values a partition), and they steer
    cost only, never results."""
    co = np.zeros((BITS, BITS), np.int64)
    for r in arrow(nodes, _co_batches, "i int, j int, n long, rows long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        co[r.i, r.j] = r.n
    best = None
    for m in (4, 5) if n <= 1 << 24 else (3, 4) if n <= 1 << 34 else (2, 3):
        if tau - m + 1 < -m:
            continue
        groups = bit_groups(co, co.diagonal().astype(float), n, m)
        seen = [g[:16] for g in groups]
        values = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), _gather(F.col("fp"), g).alias("v")) for k, g in enumerate(seen)])).alias("e")
        hist = [np.zeros(1 << len(g)) for g in seen]
        for r in nodes.select(values).groupBy("e.p", "e.v").count().collect():
            hist[r.p][r.v] = r["count"]
        costs = []
        for g, h in zip(groups, hist, strict=True):
            narrowed = 2.0 ** (len(g) - min(len(g), 16))
            entries = np.cumsum([math.comb(len(g), r) for r in range(MAX_RADIUS + 1)])
            # A pair below the threshold meets at several values; that is the price of few entries.
            balls = ball_counts(h, min(tau, 2 * MAX_RADIUS))
            costs.append([0.0] + [(c / narrowed) * (1 if t < 2 else len(g) / 2) + ENTRY_COST * n * float(entries[-(-t // 2)]) for t, c in enumerate(balls)])
        cost, chosen = allocate(costs, tau - m + 1)
        if best is None or cost < best[0]:
            best = (cost, groups, chosen)
    return best[1], best[2]


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merge the classes of ``a[i]`` and ``b[i]`` in ``label`` (each entry ends at its class minimum)."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _link_runs(key: np.ndarray, far: np.ndarray, most: np.ndarray, fp: np.ndarray, fp2: np.ndarray, tau: int, wide: int | None, half: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among entries with equal (sorted) keys.

    ``far``: an entry's distance to its bucket's value; ``most``: its partition's threshold;
    ``half``: where given and not negative, only pairs of unequal halves are looked at."""
    n = len(key)
    label = np.arange(n)
    at = np.arange(n)
    d = 0
    while len(at):
        d += 1
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        b = at + d
        hit = (far[at] + far[b] <= most[at]) & (label[at] != label[b])
        if half is not None:
            hit &= (half[at] != half[b]) | (half[at] < 0)
        a, b = at[hit], b[hit]
        bits = np.bitwise_count(fp[a] ^ fp[b])
        near = bits <= tau
        if wide is not None and near.any():
            near &= bits + np.bitwise_count(fp2[a] ^ fp2[b]) <= wide
        if near.any():
            _forest(a[near], b[near], label)
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def _link_batches(tau: int, wide: int | None, thresholds: list[int]):
    limits = np.array(thresholds)

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, part, far, half = (rows.column(c).to_numpy() for c in ("key", "p", "far", "half"))
        fp, fp2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        run_id = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        a, b = _link_runs(run_id, far, limits[part], fp, fp2, tau, wide, None if (half < 0).all() else half)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 1 << 16:
                continue
            rows = pa.Table.from_batches(held)
            key, part = rows.column("key").to_numpy(), rows.column("p").to_numpy()
            whole = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            if len(whole):  # the last run may go on in the next batch
                yield links(rows.slice(0, int(whole[-1]) + 1))
                held = rows.slice(int(whole[-1]) + 1).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _masks(bits: list[int], radius: int) -> list[tuple[int, int]]:
    """All sets of at most ``radius`` of the bits as signed 64-bit masks, with their sizes."""
    masks = [(sum(1 << b for b in some), r) for r in range(radius + 1) for some in itertools.combinations(bits, r)]
    return [(x - (1 << 64) if x >> 63 else x, r) for x, r in masks]


def _flips(fp: Column, bits: list[int], radius: int) -> Column:
    """All values within ``radius`` flips of ``bits`` as an array."""
    return F.transform(F.array(*[F.lit(x).cast("long") for x, _ in _masks(bits, radius)]), lambda x: x.bitwiseXOR(fp))


def _hub_links(entries: DataFrame, tau: int, bits: list[list[int]]) -> DataFrame:
    """Links inside oversized buckets.  Members meet at values that are ``tau // 2`` bits from
    one and the rest of ``tau`` from the other; all that meet at a value link to one of its
    near members, so every link is real and the work is linear in the members."""
    out = None
    for p, free in enumerate(bits):
        mine = entries.where(F.col("p") == p).select("key", "fp").distinct()
        near = mine.select("key", "fp", F.explode(_flips(F.col("fp"), free, tau // 2)).alias("z")).groupBy("key", "z").agg(F.min("fp").alias("hub"))
        far = mine.select("key", "fp", F.explode(_flips(F.col("fp"), free, tau - tau // 2)).alias("z"))
        met = skew_join(far, near, ["key", "z"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
        out = met if out is None else out.union(met)
    return out.distinct()


def _entries(p: int, group: list[int], threshold: int) -> Column:
    """A fingerprint's entries in partition ``p``: the bucket's value and its distance."""
    masks = _masks(group, -(-threshold // 2))
    pairs = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(r).alias("r")) for x, r in masks])
    return F.transform(pairs, lambda m: F.struct(F.lit(p).alias("p"), _gather(m["x"].bitwiseXOR(F.col("fp")), group).alias("key"), m["r"].alias("far")))


def _block_pairs(entries: DataFrame, sizes: DataFrame, bucket_rows: int) -> DataFrame:
    """Oversized buckets as runs of two blocks each: every entry goes to each pair that its
    block is part of, and a pair of different blocks looks at pairs across only."""
    n = F.ceil(2 * F.col("count") / bucket_rows)
    mine = skew_join(entries, sizes.select("p", "key", n.cast("int").alias("blocks")), ["p", "key"])
    mine = mine.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    half = F.when(low == high, -1).otherwise((F.col("block") == high).cast("int"))
    return mine.select("p", F.xxhash64("key", low, high).alias("key"), "far", "fp", "fp2", half.alias("half"))


def near_links(nodes: DataFrame, tau: int = TAU, wide: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` spanning every set of distinct ``nodes(fp, fp2)`` joined by steps of ``tau`` bits."""
    spark = nodes.sparkSession
    n = nodes.count()
    if n < 2:
        return spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    groups, thresholds = plan(nodes, n, tau)
    all_entries = F.concat(*[_entries(p, g, t) for p, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0])
    entries = nodes.select("fp", "fp2", F.explode(all_entries).alias("e")).select("e.p", "e.key", "e.far", "fp", "fp2")
    hot = cut(entries.groupBy("p", "key").count().where(F.col("count") > bucket_rows), "hot")
    some_hot = not hot.isEmpty()
    usual = skew_join(entries, hot, ["p", "key"], "left").where("count is null").drop("count") if some_hot else entries
    usual = usual.withColumn("half", F.lit(-1))
    hubs = tau <= HUB_TAU and wide is None
    if some_hot and not hubs:
        usual = usual.select("p", "key", "far", "fp", "fp2", "half").union(_block_pairs(entries, hot, bucket_rows))
    # The exchange brings a bucket's entries to one task, the sort inside it side by side.
    runs = usual.repartition(shuffle_partitions(spark), "p", "key").sortWithinPartitions("p", "key", "fp").select("p", "key", "far", "half", "fp", "fp2")
    links = arrow(runs, _link_batches(tau, wide, thresholds), "a long, b long")
    if some_hot and hubs:
        # Without flips all members agree on the partition's own bits.
        free = [[b for b in range(BITS) if t > 0 or b not in g] for g, t in zip(groups, thresholds, strict=True)]
        links = links.union(_hub_links(skew_join(entries, hot, ["p", "key"]), tau, free))
    return links


def fingerprint_groups(nodes: DataFrame, tau: int = TAU) -> DataFrame:
    """Components ``(node, root)`` of the distinct ``nodes(fp, fp2)`` under steps of ``tau`` bits; :func:`drop` takes them."""
    return components(near_links(nodes.select("fp", "fp2"), tau))


def simhash_dedup(docs: DataFrame, width: int = 3, tau: int = TAU) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, uid, fingerprint, component_id, kept.

    ``kept`` marks one row per component, that of the smallest id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = picked(docs, "doc_id", "text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("xh"), F.monotonically_increasing_id().alias("uid"))
    fps = cut(arrow(base, _simhash_batches(width, (SEED,)), FP_SCHEMA), "fps")
    nodes = cut(fps.groupBy("fp").agg(F.min("fp2").alias("fp2"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")), "nodes")
    links = fingerprint_groups(nodes, tau)
    rooted = nodes.join(links, nodes.fp == links.node, "left").select("fp", "low", "first", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    classes = skew_join(rooted.select("fp", "root"), roots, ["root"])
    return skew_join(fps, classes, ["fp"]).select(
        "doc_id", "uid", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("uid") == F.col("first.uid")).alias("kept"), "xh"
    )


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles of lower-cased UTF-8."""
    words = text.lower().split()
    width = min(width, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two shingle sets of at least 0.8; empty ones are similar to each other only."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def _majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.int64)[0])


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit SimHashes of a shingle set; the second is over the hashes mixed anew."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(hashes), _majority(x ^ (x >> np.uint64(31)))


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which every set with Jaccard 0.8 or more shares one with this one's.

    Sets are taken in one order, the ``common`` (sorted) shingles last.  Such a pair shares
    ``ceil(0.8 n)`` of either's shingles, so its first common one lies before the rest."""
    if not len(hashes):
        return hashes
    last = np.isin(hashes, common, assume_unique=True)
    n = len(hashes)
    return np.concatenate((hashes[~last], hashes[last]))[: n + 1 + -NEAR[0] * n // NEAR[1]]


def _count_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py().encode(), width) for t in batch.column("text")]
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


def _common(base: DataFrame, width: int) -> np.ndarray:
    """Shingles that many texts have, from a sample of the rows.  They steer cost only, never results."""
    step = max(1, base.count() // SAMPLE_ROWS)
    counts = arrow(base.where(F.pmod("xh", F.lit(step)) == 0).select("text"), _count_batches(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(COMMON_MOST).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def _set_batches(width: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for t in batch.column("text"):
                own = shingles(t.as_py().encode(), width)
                told.append((xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), *sketch(own), prefix(own, common).view(np.int64)))
            ids, n, fp, fp2, pre = zip(*told, strict=True) if told else ((),) * 5
            columns = [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(fp2, pa.int64()), pa.array(pre, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("xh"), *columns], names=["doc_id", "xh", "id", "n", "fp", "fp2", "prefix"])

    return run


def _possible(n: np.ndarray, fp: np.ndarray, fp2: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that sizes and sketches leave possible at a Jaccard similarity of 0.8."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    bits = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) + np.bitwise_count(fp2[a] ^ fp2[b])
    return (NEAR[1] * low >= NEAR[0] * high) & ((high <= SKETCH_FROM) | (bits <= SKETCH_BITS))


def _set_runs(run: np.ndarray, half: np.ndarray, n: np.ndarray, fp: np.ndarray, fp2: np.ndarray, sets: list[np.ndarray] | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """Classes of the entries with equal (sorted) ``run``, each named by its first entry.  With
    ``sets`` every step is confirmed by them; else a step is a pair that is possible.  Entries of
    one ``group`` are one class from the start."""
    label, at, d = np.arange(len(run)), np.arange(len(run)), 0
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(run))))
    if group is not None and len(run):
        order = np.lexsort((group, number))
        heads = np.flatnonzero(np.concatenate(([True], (number[order][1:] != number[order][:-1]) | (group[order][1:] != group[order][:-1]))))
        label[order] = np.repeat(order[heads], np.diff(np.append(heads, len(run))))
        at = at[np.minimum.reduceat(label, starts)[number] != np.maximum.reduceat(label, starts)[number]]
    while len(at):
        d += 1
        at = at[at + d < len(run)]
        at = at[number[at] == number[at + d]]
        hit = (label[at] != label[at + d]) & ((half[at] != half[at + d]) | (half[at] < 0))
        a, b = at[hit], at[hit] + d
        near = _possible(n, fp, fp2, a, b)
        a, b = a[near], b[near]
        if sets is None:
            if len(a):
                _forest(a, b, label)
        else:
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = sorted((int(label[i]), int(label[j])))
                if x != y and similar(sets[i], sets[j]):
                    label[label == y] = x
        if d & (d - 1) == 0 and len(at):  # runs of one class are done
            done = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            at = at[~done[number[at]]]
    return label


def _set_links(width: int | None):
    """Links inside runs of equal keys; with ``width`` by the texts' shingles, which are formed here,
    else between the groups of fingerprints that ``id`` then names."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, half, n, ids = (rows.column(c).to_numpy() for c in ("key", "half", "n", "id"))
        fp, fp2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        if width is None:
            label = _set_runs(key, half, n, fp, fp2, group=ids)
        else:
            label = np.zeros(0, np.int64)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist()
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                sets = [shingles(t.as_py().encode(), width) for t in rows.column("text").slice(a, b - a)]
                label = np.append(label, a + _set_runs(key[a:b], half[a:b], n[a:b], fp[a:b], fp2[a:b], sets))
        child = np.flatnonzero(ids[label] != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[label[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if width is None and sum(x.num_rows for x in held) < 1 << 16:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            whole = np.flatnonzero(key != key[-1])
            if len(whole):  # the last run may go on in the next batch
                yield links(rows.slice(0, int(whole[-1]) + 1))
                held = rows.slice(int(whole[-1]) + 1).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _set_blocks(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """``entries`` with ``half``; keys of ``sizes(key, blocks)`` become runs of two blocks each, as
    in :func:`_block_pairs`."""
    mine = skew_join(entries, sizes, ["key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    half = F.when(low == high, -1).otherwise((F.col("block") == high).cast("int"))
    key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    return mine.select(key.alias("key"), half.alias("half"), *[c for c in entries.columns if c != "key"])


def _grouped(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sets`` with ``grp``, the smallest id of the sets whose fingerprints are joined to theirs by
    steps of ``TAU`` bits, and ``many``: whether the group has several sets.  Also the table that it reads."""
    prints = cut(sets.groupBy("fp").agg(F.min("fp2").alias("fp2"), F.min("id").alias("id"), F.count("*").alias("sets")), "prints")
    links = fingerprint_groups(prints)
    rooted = prints.join(links, prints.fp == links.node, "left").select("fp", "id", "sets", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("id").alias("grp"), F.sum("sets").alias("sets")).where("sets > 1").select("root", "grp")
    groups = cut(skew_join(rooted.select("fp", "root"), firsts, ["root"]).select("fp", "grp"), "groups")
    drop(links, prints)
    told = skew_join(sets, groups, ["fp"], "left").withColumn("many", F.col("grp").isNotNull())
    return told.withColumn("grp", F.coalesce("grp", "id")), groups


def jaccard_links(base: DataFrame, sets: DataFrame, width: int, bucket_rows: int = BUCKET_ROWS, run_shingles: int = RUN_SHINGLES, made: list[DataFrame] | None = None) -> DataFrame:
    """Links ``(a, b)`` spanning ``sets``, one row per ``id``, joined by steps of Jaccard 0.8 or more.

    Sets within ``TAU`` bits are grouped by their fingerprints; sets of different groups meet in
    the buckets of their prefixes' shingles.  What sizes and sketches leave of these pairs joins
    groups, and inside a joined one every step is confirmed by the texts.
    Tables that the result reads are added to ``made``."""
    spark = base.sparkSession
    parts = shuffle_partitions(spark)
    grouped, groups = _grouped(sets)
    entries = grouped.select(F.explode("prefix").alias("key"), "id", "grp", "n", "fp", "fp2")
    hot = sets.select(F.explode("prefix").alias("key")).groupBy("key").count().where(F.col("count") > bucket_rows)
    hot = cut(hot.select("key", F.ceil(2 * F.col("count") / bucket_rows).cast("int").alias("blocks")), "hot")
    entries = entries.withColumn("half", F.lit(-1)) if hot.isEmpty() else _set_blocks(entries, hot)
    entries = entries.select("key", "half", F.col("grp").alias("id"), "n", "fp", "fp2")
    joined = components(arrow(entries.repartition(parts, "key").sortWithinPartitions("key", "fp"), _set_links(None), "a long, b long"))
    roots = joined.select(F.col("node").alias("grp"), "root").union(joined.select("root", "root").distinct()).distinct()
    members = skew_join(grouped.drop("prefix"), roots, ["grp"], "left").where("many or root is not null")
    members = cut(members.select("id", "n", "fp", "fp2", F.col("doc_id").alias("_d"), F.col("xh").alias("_h"), F.coalesce("root", "grp").alias("key")), "members")
    drop(joined, groups, hot)
    if made is not None:
        made += [members]
    sizes = members.groupBy("key").agg(F.sum("n").alias("s")).where(F.col("s") > run_shingles).select("key", F.ceil(2 * F.col("s") / run_shingles).cast("int").alias("blocks"))
    told = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = base.join(told, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("xh") == F.col("_h"))).select("key", "id", "n", "fp", "fp2", "text")
    runs = _set_blocks(texts, sizes).repartition(parts, "key").sortWithinPartitions("key", "fp").select("key", "half", "id", "n", "fp", "fp2", "text")
    return arrow(runs, _set_links(width), "a long, b long")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one per component of steps of shingle Jaccard 0.8 or more,
    that of the smallest id (a null id is the largest), all columns.

    Among rows of one id that of the smallest hashes stays.  Texts without words, null ones
    included, are near copies of each other only; no rows give no rows; columns may have any
    names."""
    inner = numbered(docs)
    doc_id, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    text = F.coalesce(text, F.lit(""))
    base = inner.select(doc_id.cast("long").alias("doc_id"), row_key(inner).alias("xh"), text.alias("text"))
    fps = cut(arrow(base, _set_batches(width, _common(base, width)), SET_SCHEMA), "fps")
    ids, sets = cut(fps.select("doc_id", "xh", "id"), "ids"), cut(fps.dropDuplicates(["id"]), "sets")
    drop(fps)
    made: list[DataFrame] = [ids, sets]
    links = components(jaccard_links(base, sets, width, made=made))
    firsts = ids.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "xh")).alias("first"))
    rooted = firsts.join(links, firsts.id == links.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    kept = cut(rooted.select(F.col("first.doc_id").alias("doc_id"), F.col("first.xh").alias("key")), "kept")
    drop(links, *made)
    return rows_of(docs, kept)
