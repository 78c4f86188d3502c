"""Operators that SQL does not express, held against plain versions."""

from collections import Counter, defaultdict
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_removed

from latticework.llm import bpe, exact_dedup, mixing, sharding, suffix_dedup, toxicity


def test_multipliers_solve_the_dual(spark):
    """Each source's multiplier against bisection on its own words; sources by code point, null last."""
    rng = np.random.default_rng(3)
    names = ["b", "Z", "é", None, "a"]
    rows = [(i, " ".join(["w"] * int(n)), names[i % 5]) for i, n in enumerate(rng.integers(0, 90, 400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = defaultdict(list)
    for _, text, source in rows:
        sizes[source].append(len(text.split()))
    order = ["Z", "a", "b", "é", None]
    targets = mixing.share_targets([sum(sizes[s]) for s in order], [1, 2, 3, 1, 2])
    told = mixing.mix(frame).join(frame.select("doc_id", "source"), "doc_id").collect()
    for k, source in enumerate(order):
        assert {round(r.target, 6) for r in told if r.source == source} == {round(targets[k], 6)}
    sources = [{"sid": k, "source": s, "source_size": sum(sizes[s]), "target": targets[k], "mean": max(1.0, sum(sizes[s]) / len(sizes[s]))} for k, s in enumerate(order)]
    classes = [(k, s, n, c) for k, s in enumerate(order) for n, c in Counter(sizes[s]).items()]
    got = mixing.solve(spark.createDataFrame(classes, "sid int, source string, size long, n long"), sources)

    def words(k, lam):
        return sum(n * min(3.0, exp(min(50.0, lam * n / sources[k]["mean"]))) for n in sizes[order[k]])

    for k, lam in got.items():
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(k, mid) < targets[k] else (low, mid)
        assert words(k, lam) == pytest.approx(targets[k], rel=1e-6) and lam == pytest.approx(low, abs=1e-4)
    # Whole copies follow the tilted rates: no document is far from its own.
    rate = {(order[k], n): min(3.0, exp(lam * n / sources[k]["mean"])) for k, lam in got.items() for n in set(sizes[order[k]])}
    close = [abs(r.copies - rate[r.source, r.size]) < 1 + 1e-6 for r in told if r.size]
    assert np.mean(close) > 0.97


def test_forty_shards(spark):
    """Even bytes, equal texts side by side, and the order of the histogram sort."""
    rng = np.random.default_rng(4)
    rows = [(i, f"text {rng.integers(1 << 40)} " + "word " * int(rng.integers(1, 60))) for i in range(6_000)]
    rows += [(10_000 + 10 * k + c, f"copy {k} " * 9) for k in range(60) for c in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard(frame, 40).collect()}
    size = Counter()
    for r in got.values():
        size[r.shard] += r.size
    mean = sum(size.values()) / 40
    assert sorted(size) == list(range(40)) and all(abs(b - mean) < 0.06 * mean for b in size.values())
    apart = [k for k in range(60) if len({got[10_000 + 10 * k + c].shard for c in range(4)}) > 1]
    assert not apart


def test_scores_by_a_plain_chain():
    rows = [(f"calm words {k} here and there" + " scoundrel vile villain" * (k % 3 == 0), int(k % 3 == 0)) for k in range(120)]
    model = toxicity.fit(rows)
    texts = ["", "42 !", "calm words", "you scoundrel", "a vile b villain c calm scoundrel " * 3, "Villain"]
    scores, spans = toxicity._score_texts(model, texts, {})
    t = model.transitions
    for text, score, span in zip(texts, scores, spans, strict=True):
        words = [w.lower() for w in toxicity.WORD.findall(text)]
        e = [exp(max(-30, min(30, model.emission(w)))) for w in words]
        prob = []
        if words:
            f = [np.array([1.0, e[0]])]
            for x in e[1:]:
                f.append((f[-1] @ t) * [1.0, x])
            b = [np.ones(2)]
            for x in e[:0:-1]:
                b.insert(0, t @ (np.array([1.0, x]) * b[0]))
            prob = [float(p[1] / p.sum()) for p in (x * y for x, y in zip(f, b, strict=True))]
        top = min(1 - 1e-4, max(1e-4, max(prob, default=0.0)))
        z = model.document[0] + model.document[1] * log(top / (1 - top)) + model.document[2] * log1p(sum(p for p in prob if p > 0.25))
        assert score == pytest.approx(1 / (1 + exp(-z)))
        assert len(span) == sum(p > 0.5 for p in prob)


def test_odd_words_are_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = ["a" * 30_000, "ab" * 20_000, "banana" * 500, "<|ENDOFTEXT|> <|endoftext|>x<|endoftext|>", "aaa aaaa aaaaa", "ﬁ ǅ ß İ", "😀" * 400, "don't can't 'll''s", "1234567 ²³ ٣", "x" * 5 + "​" + "y", "\x00\x1c\x1d"]
    texts += ["".join(chr(int(c)) for c in np.random.default_rng(k).choice([97, 98, 101, 110, 116, 32, 39, 233, 8217], 3_000)) for k in range(5)]
    got = bpe.Encoder(bpe.default_path()).encode_batch(texts)
    want = lib.encode_batch(texts, add_special_tokens=False)
    for g, w in zip(got, want, strict=True):
        assert g == (len(w.ids), " ".join(map(str, w.ids)), lib.decode(w.ids, skip_special_tokens=False))


def test_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    enc = bpe.Encoder(bpe.default_path())
    texts = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(6)]
    once = [enc.encode_batch([t])[0] for t in texts]
    assert once == bpe.Encoder(bpe.default_path()).encode_batch(texts) and len(enc.index) < 200


def test_parts_of_long_texts(spark):
    rows = [(1, "Some LONGER text that is cut in parts"), (2, "some longer TEXT that is cut in parts"), (3, "some longer text that is cut in partz"), (4, None), (5, "ü" * 20), (6, "Ü" * 20), (7, "ü" * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole, parts = (sorted(tuple(r)[:5] for r in exact_dedup.exact_dedup(frame, n).collect()) for n in (1 << 20, 7))
    assert whole == parts and {r[0]: r[1] for r in whole} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 7, 6: 6, 7: 7}


@pytest.mark.parametrize("pieces", [2_000, 2])
def test_passages_of_all_lengths(spark, pieces):
    rng = np.random.default_rng(11)
    junk = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passages = [junk(n) for n in (199, 200, 201, 260, 420, 900)]
    texts = [junk(int(rng.integers(0, 80))) + passages[int(rng.integers(6))][int(rng.integers(0, 30)) :] + junk(int(rng.integers(0, 200))) for _ in range(40)]
    texts += ["ab" * 300, "abc" * 90, passages[4] + passages[4]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame, pieces).collect()}
    assert [got[k] for k in range(len(texts))] == brute_removed(texts)


def test_minimisers_are_counted_without_pieces(monkeypatch):
    """The counting pass forms no piece hashes; blocks stay small and do not change what is found."""
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("abcd "), int(n))) for n in rng.integers(0, 1200, 900)] + ["long " * 40_000]
    batch = pa.RecordBatch.from_pydict({"uid": list(range(len(texts))), "text": texts})
    blocks = list(suffix_dedup._text_blocks(batch))
    assert max(len(b[2]) - (b[4] - b[3]).max() for b in blocks) < 1 << 17 and len(blocks) > 3
    rows = lambda run: sorted(tuple(r.values()) for b in run(iter([batch])) for r in b.to_pylist())
    found = rows(suffix_dedup._piece_batches)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 21)
    assert rows(suffix_dedup._piece_batches) == found
    monkeypatch.setattr(suffix_dedup, "pieces", None)
    assert rows(suffix_dedup._minimiser_batches) == sorted((r[4],) for r in found)
