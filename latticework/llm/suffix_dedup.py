"""Suffix-array dedup: removal of every long enough byte string that occurs more than once.

Every byte covered by a ``WINDOW``-byte string that also starts elsewhere goes, in all its
places.  The suffix array is built by linear grouping construction: suffixes are grouped by
their Lyndon prefixes, groups are processed in descending order, previous-smaller pointers tell
how often a group's prefix follows a lower suffix, and those suffixes move to new groups right
behind their own; a final pass emits each group's order along the same pointers, without
recursive renaming.  Equal windows are neighbours in the array.

The array is built only where it is needed, in four distributed steps:

1. The windows of a text fall into runs ("pieces") that share a minimiser, the ``GRAM``-byte
   string of smallest hash in the window.  Equal windows have equal minimisers at equal
   offsets, so pieces whose minimiser occurs once hold no repeated window.
2. Equal pieces of a minimiser are collapsed: a piece that occurs twice repeats as a whole.
3. The different pieces of a minimiser meet in one task, which concatenates many groups, the
   shared minimiser as one symbol, builds their suffix array, and marks the windows that have
   an equal neighbour.  Pieces are first trimmed to the windows whose hash occurs twice.  A
   minimiser with more than ``GROUP_PIECES`` different pieces would be a hot group: its windows
   are dealt out and counted by their bytes instead.
4. Marked windows become byte ranges of their documents, which are merged and cut out.

Equal pieces are found by two 64-bit hashes (of the minimiser and of all bytes) and their shape;
everything else is compared by bytes.  Counts and comparisons are aggregates with map-side combination, so a text copied into a third
of all rows costs one row a task; nothing gathers a group of copies.

Defined results: a null text counts as empty; texts shorter than a window keep all bytes;
repeated rows repeat each other's windows; ids that are null or not unique are told apart by
their texts; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, picked, shuffle_partitions, skew_join

WINDOW, GRAM = 200, 128
BASE = 0x9E3779B97F4A7C15
SEED = 20240229
# Texts are hashed in blocks whose arrays fit a core's cache; what blocks give is sent together.
BLOCK, SEND = 1 << 17, 1 << 21
SEGMENT = 1 << 23
GROUP_PIECES = 2_000
BATCH_SYMBOLS = 8_000
PIECE_SCHEMA = "uid long, at long, n int, off int, h long, ph long"
SLICE_SCHEMA = "uid long, h long, at long, n int, off int, pieces long, raw binary"
RANGE_SCHEMA = "uid long, a long, b long"


def letter_codes() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


CODES = letter_codes()


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Mixed hashes of all ``GRAM``-byte strings, put together from strings of doubled length."""
    h, length, out, have = codes, 1, None, 0
    while length <= GRAM:
        if GRAM & length:
            if out is None:
                out = h
            else:
                tail = h[have:]
                out = out[: len(tail)] * np.uint64(pow(BASE, length, 1 << 64)) + tail
            have += length
        h = h[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + h[length:]
        length *= 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out[: len(codes) - GRAM + 1]


def _minimiser_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Windows of texts laid end to end, in runs that share a minimiser.

    Returns arrays: text index, first window start, number of windows, start of the minimiser,
    its hash.  Starts are in ``codes``."""
    if len(codes) < WINDOW:
        return None
    grams = gram_hashes(codes)
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    slide, step = WINDOW - GRAM + 1, 1
    while step * 2 <= slide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if slide > step:
        low = np.minimum(low[: len(low) - (slide - step)], low[slide - step :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    lens = ends - starts
    windows = np.maximum(0, lens - WINDOW + 1)
    has = np.flatnonzero(windows)
    if not len(has):
        return None
    text = np.repeat(has, windows[has])
    first = np.cumsum(windows[has]) - windows[has]
    at = np.arange(len(text)) - np.repeat(first, windows[has]) + np.repeat(starts[has], windows[has])
    anchor = anchor[at]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    head = np.concatenate(([0], change))
    count = np.diff(np.concatenate((head, [len(text)])))
    return text[head], at[head], count, anchor[head], grams[anchor[head]].view(np.int64)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Windows of texts laid end to end, in runs that share a minimiser.

    Returns arrays: text index, first window start inside the text, number of windows, offset
    of the minimiser from that start, its hash, and the hash of the run's bytes."""
    n, codes = len(data), CODES[data]
    found = _minimiser_runs(codes, starts, ends)
    if found is None:
        return None
    text, begin, count, anchor, h = found
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)))
    inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    end = begin + count - 1 + WINDOW
    whole = (sums[end] - sums[begin]) * inverse[begin]
    return text, begin - starts[text], count, anchor - begin, h, whole.view(np.int64)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a sequence of integers by linear grouping construction."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # stable: equal symbols by position
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    lower = [-1] * n
    end = n
    while end:
        head = group[order[end - 1]]
        followed: dict[int, int] = {}
        for i in sorted(order[head:end]):
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = lower[j]
            lower[i] = j
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, times in followed.items():
            levels.setdefault(times, []).append(j)
        for times in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for j in levels[times]:
                own = group[j]
                k = moved.get(own, 0)
                target = own + size[own] - 1 - k
                other, at = order[target], place[j]
                order[at], place[other] = other, at
                order[target], place[j] = j, target
                moved[own] = k + 1
            for j in levels[times]:
                own = group[j]
                group[j] = own + size[own] - moved[own]
            for own, k in moved.items():
                if k < size[own]:
                    size[own + size[own] - k] = k
                    size[own] -= k
        end = head
    out = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    j = n - 1
    for i in range(-1, n):
        j = n - 1 if i < 0 else out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = lower[j]
    return out


def hopeful(rows: list[tuple[int, bytes, int, int]]) -> list[tuple[int, int, int]]:
    """The pieces ``(minimiser, bytes, windows, offset)`` that may hold a repeated window: their
    numbers, with the first and last such window.  Equal windows have equal hashes, and their
    minimiser at the same place, so none is lost."""
    n = np.array([r[2] for r in rows], np.int64)
    lens = np.array([len(r[1]) for r in rows], np.int64)
    codes = CODES[np.frombuffer(b"".join(r[1] for r in rows), np.uint8)]
    powers = np.full(len(codes), BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)))
    inverse = np.full(len(codes), pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    piece = np.repeat(np.arange(len(rows)), n)
    w = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = w + np.repeat(np.cumsum(lens) - lens, n)
    key = (sums[at + WINDOW] - sums[at]) * inverse[at]
    key ^= np.repeat(np.array([r[0] for r in rows], np.int64).view(np.uint64), n) * np.uint64(BASE)
    key += (np.repeat(np.array([r[3] for r in rows], np.int64), n) - w).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    found = np.flatnonzero(again)
    if not len(found):
        return []
    heads = np.flatnonzero(np.concatenate(([True], piece[found][1:] != piece[found][:-1])))
    lasts = np.append(heads[1:], len(found)) - 1
    return list(zip(piece[found[heads]].tolist(), w[found[heads]].tolist(), w[found[lasts]].tolist(), strict=True))


def repeated_windows(rows: list[tuple[int, bytes, int, int]]) -> list[list[int]]:
    """For pieces ``(minimiser, bytes, windows, offset)``: the windows that occur in them twice."""
    out: list[list[int]] = [[] for _ in rows]
    some = hopeful(rows)
    trimmed = [(rows[k][0], rows[k][1][a : b + WINDOW], b - a + 1, rows[k][3] - a) for k, a, b in some]
    for (k, a, _), windows in zip(some, _array_repeats(trimmed), strict=True):
        out[k] = [a + w for w in windows]
    return out


def _array_repeats(rows: list[tuple[int, bytes, int, int]]) -> list[list[int]]:
    """:func:`repeated_windows` by one suffix array over all the pieces."""
    symbols: list[int] = []
    owner: list[int] = []
    heads: list[int] = []
    names: dict[int, int] = {}
    for h, raw, n, off in rows:
        anchor = names.setdefault(h, 256 + len(names))
        heads.append(len(symbols))
        symbols += raw[:off]
        symbols.append(anchor)
        symbols += raw[off + GRAM :]
        symbols.append(-1)  # a separator, named below
        owner += [len(heads) - 1] * (len(symbols) - len(owner))
    last = 256 + len(names)
    for i, x in enumerate(symbols):
        if x < 0:
            symbols[i] = last
            last += 1
    short = WINDOW - GRAM + 1
    spelled = "".join(map(chr, symbols))
    counts = [r[2] for r in rows]
    out: list[list[int]] = [[] for _ in rows]
    before, marked = -1, False
    for i in suffix_array(symbols):
        k = owner[i]
        w = i - heads[k]
        if w >= counts[k]:
            continue
        if before >= 0 and spelled[i : i + short] == spelled[before : before + short]:
            if not marked:
                b = owner[before]
                out[b].append(before - heads[b])
            out[k].append(w)
            marked = True
        else:
            marked = False
        before = i
    return out


def runs(values: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive integers, as first and last."""
    out: list[tuple[int, int]] = []
    for v in sorted(values):
        if out and v == out[-1][1] + 1:
            out[-1] = (out[-1][0], v)
        else:
            out.append((v, v))
    return out


def _text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a window or more in blocks: ids, shifts, and the bytes with the texts' starts and ends."""

    def block(uids: list[int], shifts: list[int], texts: list[bytes]):
        lens = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lens)
        return np.array(uids, np.int64), np.array(shifts, np.int64), np.frombuffer(b"".join(texts), np.uint8), ends - lens, ends

    uids, shifts, texts, held = [], [], [], 0
    for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
        raw = text.as_py().encode()
        # A segment's windows may not reach into the next one's, so it keeps a window's tail.
        for at in range(0, max(1, len(raw)), SEGMENT):
            part = raw[at : at + SEGMENT + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            uids.append(uid)
            shifts.append(at)
            texts.append(part)
            held += len(part)
            if held >= BLOCK:
                yield block(uids, shifts, texts)
                uids, shifts, texts, held = [], [], [], 0
    if texts:
        yield block(uids, shifts, texts)


def _block_batches(names: list[str], columns_of):
    """Arrow batches of ``columns_of(uids, shifts, data, starts, ends)``, those of many blocks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for block in _text_blocks(batch):
                columns = columns_of(*block)
                if columns is not None:
                    held.append(columns)
                size += len(block[2])
                if held and size >= SEND:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    return run


def _piece_columns(uids: np.ndarray, shifts: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    got = pieces(data, starts, ends)
    if got is None:
        return None
    text, at, n, off, h, ph = got
    return uids[text], at + shifts[text], n.astype(np.int32), off.astype(np.int32), h, ph


def _minimiser_columns(uids: np.ndarray, shifts: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    got = _minimiser_runs(CODES[data], starts, ends)
    return None if got is None else (got[4],)


_piece_batches = _block_batches(["uid", "at", "n", "off", "h", "ph"], _piece_columns)
_minimiser_batches = _block_batches(["h"], _minimiser_columns)


def _mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser; whole groups are gathered up to a batch of symbols."""
    held: list[tuple[int, int, int, int, int, bytes]] = []

    def marked(rows) -> pa.RecordBatch:
        got = repeated_windows([(h, raw, n, off) for h, _, _, n, off, raw in rows])
        ranges = [(uid, at + a, at + b + WINDOW) for (_, uid, at, _, _, _), windows in zip(rows, got, strict=True) for a, b in runs(windows)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ranges], pa.int64()) for k in range(3)], names=["uid", "a", "b"])

    symbols = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "at", "n", "off", "raw")), strict=True):
            if symbols >= BATCH_SYMBOLS and held[-1][0] != row[0]:
                yield marked(held)
                held, symbols = [], 0
            held.append(row)
            symbols += row[3] + WINDOW - GRAM + 1
    if held:
        yield marked(held)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        unions = [merged([(r["a"], r["b"]) for r in ranges]) for ranges in batch.column("ranges").to_pylist()]
        columns = [
            batch.column("uid"),
            pa.array([sum(b - a for a, b in u) for u in unions], pa.int64()),
            pa.array([len(u) for u in unions], pa.int64()),
            pa.array([[{"a": a, "b": b} for a, b in u] for u in unions], kind),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["uid", "n_removed", "n_spans", "spans"])


def _rest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of what is left of each text without its spans."""
    for batch in batches:
        digests = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw, at, digest = text.as_py().encode(), 0, hashlib.sha256()
            for r in spans:
                digest.update(raw[at : r["a"]])
                at = r["b"]
            digest.update(raw[at:])
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(digests, pa.string())], names=["uid", "kept_sha256"])


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a text's border pieces; a text is encoded once for all of them."""
    names = ["h", "at", "n", "off", "pieces"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        for k in range(batch.num_rows):
            raw, uid = batch.column("text")[k].as_py().encode(), batch.column("uid")[k].as_py()
            own = batch.column("border")[k].as_py()
            for at in range(0, len(own), 10_000):
                part = own[at : at + 10_000]
                columns = [pa.array([r[name] for r in part], kind) for name, kind in zip(names, kinds, strict=True)]
                cuts = pa.array([raw[r["at"] : r["at"] + r["n"] - 1 + WINDOW] for r in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(part), pa.int64()), *columns, cuts], names=["uid", *names, "raw"])


def _crowded(slices: DataFrame) -> DataFrame:
    """Repeated windows of minimisers with very many pieces: windows counted by their bytes."""
    windows = slices.select("uid", "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"), "raw")
    windows = windows.select("uid", (F.col("at") + F.col("w")).alias("a"), F.expr(f"substring(raw, w + 1, {WINDOW})").alias("window"))
    twice = windows.groupBy("window").count().where("count > 1").drop("count")
    return skew_join(windows, twice, ["window"]).select("uid", "a", (F.col("a") + WINDOW).alias("b"))


def repeated_ranges(docs: DataFrame, group_pieces: int = GROUP_PIECES) -> tuple[DataFrame, DataFrame]:
    """Ranges ``(uid, a, b)`` of repeated windows of ``docs(uid, text, n_bytes)``, and the texts
    ``(uid, text)`` of the documents that have some, but for those made of copied pieces only."""
    long = docs.where(F.col("n_bytes") >= WINDOW).select("uid", "text")
    found = arrow(long, _piece_batches, PIECE_SCHEMA)
    # A piece's two small numbers share a column: rows are many, so their width counts.
    found = found.select("uid", "at", (F.col("n") * 1024 + F.col("off")).alias("shape"), "h", "ph")
    # To count the pieces of a minimiser takes its hash alone, neither places nor piece hashes.
    twice = arrow(long, _minimiser_batches, "h long").groupBy("h").count().where("count > 1").select("h")
    cand = cut(skew_join(found, twice, ["h"]), "cand")
    distinct = cand.groupBy("h", "ph", "shape").agg(F.count("*").alias("m"), F.min(F.struct("uid", "at")).alias("rep"))
    distinct = cut(distinct, "distinct")
    windows = F.expr("shape div 1024")
    copied = skew_join(cand, distinct.where("m > 1").select("h", "ph", "shape"), ["h", "ph", "shape"])
    copied = cut(copied.select("uid", F.col("at").alias("a"), (F.col("at") + windows - 1 + WINDOW).alias("b")), "copied")
    several = distinct.groupBy("h").agg(F.count("*").alias("pieces"), F.min("m").alias("fewest")).where("pieces > 1 and fewest = 1")
    border = skew_join(distinct, several.drop("fewest"), ["h"])
    border = border.select("h", F.col("rep.uid").alias("uid"), F.col("rep.at").alias("at"), windows.cast("int").alias("n"), (F.col("shape") % 1024).cast("int").alias("off"), "pieces")
    border = cut(border, "border")
    # Pieces partition a text's windows, so their windows tell whether all of it is copied.
    whole = copied.groupBy("uid").agg(F.sum(F.col("b") - F.col("a") - WINDOW + 1).alias("windows"))
    partly = docs.select("uid", "n_bytes").join(whole, "uid").where(F.col("windows") < F.col("n_bytes") - WINDOW + 1).select("uid")
    needed = border.select("uid").union(partly).distinct()
    texts = cut(docs.select("uid", "text").join(needed, "uid").dropDuplicates(["uid"]), "texts")
    # A text's pieces are fewer than its bytes, so its list is bounded by the text beside it.
    listed = border.groupBy("uid").agg(F.collect_list(F.struct("h", "at", "n", "off", "pieces")).alias("border"))
    slices = cut(arrow(listed.join(texts, "uid").select("uid", "border", "text"), _slice_batches, SLICE_SCHEMA), "slices")
    usual = slices.where(F.col("pieces") <= group_pieces)
    parts = usual.repartition(shuffle_partitions(docs.sparkSession), "h").select("h", "uid", "at", "n", "off", "raw").sortWithinPartitions("h", "uid", "at")
    marked = arrow(parts, _mark_batches, RANGE_SCHEMA)
    crowded = _crowded(slices.where(F.col("pieces") > group_pieces))
    return copied.union(marked).union(crowded), texts


def suffix_dedup(docs: DataFrame, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    docs = docs.withColumn("uid", F.col("doc_id") if ids.rows == ids.ids else F.xxhash64("doc_id", "text"))
    ranges, texts = repeated_ranges(docs, group_pieces)
    # A document's ranges are no more than its windows; equal ones are one.
    by_doc = ranges.groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    unions = cut(arrow(by_doc, _merge_batches, "uid long, n_removed long, n_spans long, spans array<struct<a:long,b:long>>"), "unions")
    rest = arrow(texts.join(unions.select("uid", "spans"), "uid").select("uid", "text", "spans"), _rest_batches, "uid long, kept_sha256 string")
    rows = docs.select("doc_id", "uid", "n_bytes", F.sha2("text", 256).alias("whole"))
    told = rows.join(unions, "uid", "left").join(rest, "uid", "left")
    none = F.lit(0).cast("long")
    gone = F.when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256))
    kept = F.when(F.col("n_removed").isNull(), F.col("whole")).otherwise(F.coalesce("kept_sha256", gone))
    return told.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), kept.alias("kept_sha256"), "spans")
