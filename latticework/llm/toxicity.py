"""Toxic spans and document scores from a linear-chain conditional random field.

A two-state chain (clean, toxic) runs over the words of a text.  A word's emission weight is
the sum of the weights of its features: the word itself and its prefixes of four to seven
letters.  Word labels for training come from document labels: in a toxic document a word is
labelled toxic if one of its features is much and significantly more frequent there than in
clean training documents; in a clean document no word is.  Forward-backward marginals give each word a
probability; a small logistic model turns a document's largest marginal and its expected
number of toxic words into the document's score; words above one half are the offending spans.

The model is fitted on at most ``SAMPLE`` labelled rows of each class (a documented bound, in
hash order of the id, so reruns agree), whole texts whatever their length; of several rows of one
labelled id one takes part.  The fit's words lie in a temporary file of the driver.  Scoring covers every row and whole texts.  Inputs of a
score are the text's words only.

Defined results: a null or empty text, or one without letters, gets the score of a document
without toxic words; labels that are null are ignored, of repeated labels of one id the
largest counts; without both classes among the labelled rows the score is 0; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, numbered, picked, text_blocks

SAMPLE = 1_500
FIT_TOKENS = 150_000
THRESHOLD = 0.3
MIN_SUPPORT = 2
MIN_LOG_ODDS = 2.5
MIN_DOCS, MIN_Z = 3, 3.5
PREFIXES = (4, 5, 6, 7)
SCAN_BYTES = 1 << 20
CACHE_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")
SCORE_SCHEMA = "doc_id long, uid long, xh long, score double, spans array<struct<start:int,end:int>>"


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    transitions: np.ndarray  # [from, to], as factors
    document: tuple[float, float, float]
    trained: bool = True

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def _products(e: np.ndarray, s: np.ndarray, t: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """State shares at every step of columns ``e`` (length x columns) that follow each other.

    A chain's first step has ``s`` = 1: it forgets what came before.  One pass forms the 2 x 2
    product of each column, a short scan carries the state across columns, and a second pass
    runs inside all columns at once."""
    length, cols = e.shape
    order = range(length) if forward else range(length - 1, -1, -1)

    def factors(i: int) -> tuple[np.ndarray, ...]:
        keep = 1 - s[i]
        return tuple(s[i] + keep * t[a, b] for a in (0, 1) for b in (0, 1))

    def step(i: int, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t00, t01, t10, t11 = factors(i)
        if forward:
            return t00 * x0 + t10 * x1, e[i] * (t01 * x0 + t11 * x1)
        y1 = e[i] * x1
        return t00 * x0 + t01 * y1, t10 * x0 + t11 * y1

    p = [np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)]  # columns (x0, x1) from either start
    for i in order:
        p[0], p[1] = step(i, p[0], p[1])
        p[2], p[3] = step(i, p[2], p[3])
        norm = 1 / (p[0] + p[1] + p[2] + p[3])
        p = [x * norm for x in p]
    begin = np.empty((2, cols))
    x0 = x1 = 0.5
    for c in range(cols) if forward else range(cols - 1, -1, -1):
        begin[:, c] = x0, x1
        x0, x1 = p[0][c] * x0 + p[2][c] * x1, p[1][c] * x0 + p[3][c] * x1
        total = x0 + x1
        x0, x1 = x0 / total, x1 / total
    out0, out1 = np.empty_like(e), np.empty_like(e)
    x0, x1 = begin
    for i in order:
        if not forward:
            out0[i], out1[i] = x0, x1  # what follows the step
        x0, x1 = step(i, x0, x1)
        norm = 1 / (x0 + x1)
        x0, x1 = x0 * norm, x1 * norm
        if forward:
            out0[i], out1[i] = x0, x1
    return out0, out1


def marginals(emission: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic probability of every word of chains laid end to end, and expected transitions
    inside chains (2 x 2)."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    length = max(1, int(np.sqrt(n)))
    cols = -(-n // length)
    e = np.ones(length * cols)
    e[:n] = np.exp(np.clip(emission, -30, 30))
    s = np.zeros(length * cols)
    s[n:] = 1
    s[np.concatenate(([0], np.cumsum(lengths[lengths > 0])[:-1]))] = 1
    e, s = (np.ascontiguousarray(x.reshape(cols, length).T) for x in (e, s))
    f0, f1 = _products(e, s, t, True)
    b0, b1 = _products(e, s, t, False)
    p0, p1 = f0 * b0, f1 * b1
    prob = (p1 / (p0 + p1)).T.ravel()[:n]
    flat = [x.T.ravel()[:n] for x in (f0, f1, b0, b1, e, s)]
    inside = flat[5][1:] == 0
    pair = np.empty((2, 2, n - 1))
    for a in (0, 1):
        pair[a, 0] = flat[a][:-1] * t[a, 0] * flat[2][1:]
        pair[a, 1] = flat[a][:-1] * t[a, 1] * flat[4][1:] * flat[3][1:]
    pair /= pair.sum(axis=(0, 1))
    return prob, pair[:, :, inside].sum(axis=2)


def document_features(prob: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: logit of the largest marginal, and log1p of the expected toxic words."""
    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    has = lengths > 0
    if has.any():
        starts = np.concatenate(([0], np.cumsum(lengths[has])[:-1]))
        top[has] = np.maximum.reduceat(prob, starts)
        total[has] = np.add.reduceat(np.where(prob > 0.25, prob, 0), starts)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.log(top / (1 - top)), np.log1p(total)], axis=1)


def fit(rows: Iterable[tuple[str, int]], rounds: int = 40) -> Model:
    """Train on whole documents with 0/1 labels; see the module's text for the word labels.

    The texts are read once, one at a time; their words go to a file as numbers."""
    with tempfile.TemporaryFile() as file:
        spelled: dict[str, int] = {}
        toxic, sizes = [], []
        for text, label in rows:
            words = np.fromiter((spelled.setdefault(w.group().lower(), len(spelled)) for w in WORD.finditer(text)), np.int32)
            file.write(words.tobytes())
            toxic.append(label)
            sizes.append(len(words))
        file.flush()
        words = np.memmap(file, np.int32, "r") if sum(sizes) else np.zeros(0, np.int32)
        return _fit(words, list(spelled), np.array(sizes, np.int64), toxic, rounds)


def _fit(words: np.ndarray, spelled: list[str], sizes: np.ndarray, toxic: list[int], rounds: int) -> Model:
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0, np.ones((2, 2)), (0.0, 0.0, 0.0), trained=False)
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    support = [Counter(), Counter()]
    for label in (1, 0):  # features that no toxic document has carry no weight
        for end, size, own in zip(np.cumsum(sizes).tolist(), sizes.tolist(), toxic, strict=True):
            if own == label:
                seen = {f for w in np.unique(words[end - size : end]).tolist() for f in features(spelled[w])}
                support[label].update(seen if label else [f for f in seen if f in support[1]])
        if label:
            support[1] = Counter({f: c for f, c in support[1].items() if c >= MIN_SUPPORT})
    odds = {f: np.log((c + 0.5) / (n[1] + 1)) - np.log((support[0][f] + 0.5) / (n[0] + 1)) for f, c in support[1].items()}
    share = n[1] / (n[0] + n[1])

    def above(f: str) -> float:
        """Deviations of a feature's toxic documents above what their share explains."""
        c = support[0][f] + support[1][f]
        return (support[1][f] - share * c) / (share * (1 - share) * c) ** 0.5

    strong = {f for f, o in odds.items() if o >= MIN_LOG_ODDS and support[1][f] >= MIN_DOCS and above(f) >= MIN_Z}
    known = sorted(odds)
    column = {f: i for i, f in enumerate(known)}
    # Words without a known feature share entry 0.
    row, col, hot = [], [], [False]
    entry = np.zeros(len(spelled), np.int32)
    for w, word in enumerate(spelled):
        own = [column[f] for f in features(word) if f in column]
        if own:
            entry[w] = len(hot)
            row.extend([len(hot)] * len(own))
            col.extend(own)
            hot.append(any(f in strong for f in features(word)))

    # Blocks of whole documents bound what a pass holds.
    ends = np.cumsum(sizes)
    cuts, held = [0], 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= FIT_TOKENS or k == len(sizes) - 1:
            cuts.append(k + 1)
            held = 0

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield entry[words[ends[a] - sizes[a] : ends[b - 1]]], sizes[a:b]

    row, col, hot = np.array(row, np.int64), np.array(col, np.int64), np.array(hot)
    labels, moves, done = [], np.zeros((2, 2)), 0
    for ids, lengths in blocks():
        own = (hot[ids] & (np.repeat(y[done : done + len(lengths)], lengths) > 0)).astype(np.int8)
        done += len(lengths)
        inside = np.ones(max(0, len(ids) - 1), bool)
        inside[np.cumsum(lengths)[:-1][(np.cumsum(lengths)[:-1] > 0) & (np.cumsum(lengths)[:-1] < len(ids))] - 1] = False
        np.add.at(moves, (own[:-1][inside], own[1:][inside]), 1)
        labels.append(own)
    params = np.zeros(len(known) + 5)  # feature weights, bias, log transitions
    mean, var = np.zeros_like(params), np.zeros_like(params)
    scale = max(1.0, float(sum(int(x.sum()) for x in labels)))
    for k in range(1, rounds + 1):
        per_word = np.bincount(row, params[col], len(hot)) + params[-5]
        t = np.exp(params[-4:].reshape(2, 2))
        by_word, moved = np.zeros(len(hot)), np.zeros((2, 2))
        for (ids, lengths), own in zip(blocks(), labels, strict=True):
            prob, expected = marginals(per_word[ids], lengths, t)
            by_word += np.bincount(ids, prob - own, len(hot))
            moved += expected
        grad = np.concatenate((np.bincount(col, by_word[row], len(known)), [by_word.sum()], (moved - moves).ravel())) / scale
        grad[: len(known)] += 0.002 * params[: len(known)]
        mean, var = 0.8 * mean + 0.2 * grad, 0.95 * var + 0.05 * grad**2
        params = params - 0.35 * (mean / (1 - 0.8**k)) / (np.sqrt(var / (1 - 0.95**k)) + 1e-8)
    keep = np.abs(params[: len(known)]) > 1e-3
    weights = {f: float(params[i]) for i, f in enumerate(known) if keep[i]}
    t = np.exp(params[-4:].reshape(2, 2))
    per_word = np.bincount(row, params[col], len(hot)) + params[-5]
    told = [document_features(marginals(per_word[ids], lengths, t)[0], lengths) for ids, lengths in blocks()]
    x = np.column_stack([np.ones(len(y)), np.concatenate(told)])
    beta = np.zeros(3)
    for _ in range(25):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-6, 0.05, 0.05])
        beta = beta + np.linalg.solve(hess, x.T @ (y - p) - np.array([0, 0.05, 0.05]) * beta)
    return Model(weights, float(params[-5]), t, tuple(beta.tolist()))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows of ``docs`` that are not held out, at most ``SAMPLE`` of each class."""
    usable = picked(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * SAMPLE rows of two numbers: small enough to broadcast at any input size.
    rows = picked(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    return fit((r.text, int(r.toxic)) for r in rows.toLocalIterator())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _score_texts(model: Model, texts: list[str], cache: dict[str, float]) -> tuple[list[float], list[list[tuple[int, int]]]]:
    if len(cache) > CACHE_WORDS:
        cache.clear()
    words, lengths = [], []
    for text in texts:
        found = list(map(str.lower, WORD.findall(text)))
        words += found
        lengths.append(len(found))
    for w in set(words).difference(cache):
        cache[w] = model.emission(w)
    emission = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
    size = np.array(lengths, dtype=np.int64)
    prob, _ = marginals(emission, size, model.transitions)
    x = document_features(prob, size)
    z = np.clip(model.document[0] + x @ np.array(model.document[1:]), -30, 30)
    score = 1 / (1 + np.exp(-z)) if model.trained else np.zeros(len(texts))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    ends = np.cumsum(size)
    flagged = np.flatnonzero(prob > 0.5) if model.trained else np.zeros(0, np.int64)
    by_doc: dict[int, set[int]] = {}
    for word, doc in zip(flagged.tolist(), np.searchsorted(ends, flagged, side="right").tolist(), strict=True):
        by_doc.setdefault(doc, set()).add(word - int(ends[doc] - size[doc]))
    for doc, wanted in by_doc.items():
        spans[doc] = [m.span() for k, m in enumerate(WORD.finditer(texts[doc])) if k in wanted]
    return score.tolist(), spans


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in text_blocks(batch, SCAN_BYTES):
                score, spans = _score_texts(model, part.column("text").to_pylist(), cache)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("uid"), part.column("xh"), pa.array(score, pa.float64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)],
                    names=["doc_id", "uid", "xh", "score", "spans"],
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, spans, uid, xh."""
    model = model or train(docs, labels)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(text).alias("xh"), text.alias("text"))
    scored = arrow(base, _score_batches(model), SCORE_SCHEMA)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans", "uid", "xh")


def _keep_batches(model: Model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for part in text_blocks(batch, SCAN_BYTES, column):
                score, _ = _score_texts(model, [t or "" for t in part.column(column).to_pylist()], cache)
                yield part.filter(pa.array([x < THRESHOLD for x in score], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns; one pass, no exchange.

    Every row is judged by its own text, so repeated rows stay or go together; a null text
    counts as empty; no rows give no rows; columns may have any names."""
    model, inner = train(docs, labels), numbered(docs)
    return arrow(inner, _keep_batches(model, f"c{docs.columns.index('text')}"), inner.schema).toDF(*docs.columns)
