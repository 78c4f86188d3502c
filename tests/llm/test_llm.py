"""Training-data operators against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.llm import bpe, common, exact_dedup, html_text, mixing, sharding, simhash_dedup, suffix_dedup, topk, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, key string, uid long"
LONG = " ".join(f"word{i % 701} tail{i * 7 % 1009}" for i in range(9_000))
PASSAGE = "the quick passage that many rows share is long enough to be found again and again, " * 4
TEXTS = [None, "", "", " \t\n", "a", "A", "Same text", "same TEXT", "Ünïcode ß ÄÖ", "aaaa" * 100, "x" + PASSAGE + "1", "y " + PASSAGE + " 2", PASSAGE, LONG, LONG, LONG + " end", "<|endoftext|> I'll 's ΑΣ\x1c"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, None, (None, "b", "a")[i % 3], None, "h", "k", 7) for i, t in enumerate(TEXTS)]
    return [*out, (None, "no id", "en", "a", 5, None, None, None), out[6], out[6]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return [r[1] or "" for r in rows]


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    lower = [t.encode().lower() for t in texts_of(rows)]
    sizes = Counter(lower)
    keep = {}
    for r, t in zip(rows, lower, strict=True):
        keep[t] = max(keep.get(t, -1), -1 if r[0] is None else r[0])
    want = Counter((r[0], None if keep[t] < 0 else keep[t], sizes[t], hashlib.sha256(t).hexdigest()) for r, t in zip(rows, lower, strict=True))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(sizes)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(sizes)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_fingerprints_compose(texts, chunk):
    def whole(t, k):
        h = 0
        for b in t:
            h = (h * exact_dedup.BASES[k] + b + 1) % exact_dedup.PRIMES[k]
        return h

    assert exact_dedup.fingerprints(texts, chunk, 64) == [(whole(t, 0), whole(t, 1)) for t in texts]


def test_collisions_are_told_apart(spark):
    base = spark.createDataFrame([(1, "aaaa", 1), (2, "bbbb", 2), (3, "aaaa", 1)], "doc_id long, text string, xh long")
    fps = base.select("doc_id", "xh", F.col("doc_id").alias("uid"), F.lit(4).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2"), F.md5("text").alias("sha"))
    assert [r.doc_id for r in exact_dedup._unequal(base, fps).collect()] == [2]


def brute_components(fps, tau):
    label = np.arange(len(fps))
    while True:
        new = np.array([label[np.bitwise_count(fps ^ f) <= tau].min() for f in fps])
        if (new == label).all():
            return label
        label = new


def test_simhash(docs, rows, empty):
    got = simhash_dedup.simhash_dedup(docs).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for r in rows:
        assert prints[r[0]] == simhash_dedup.simhash((r[1] or "").encode(), 3)[0]
    fps, ids = np.array([int(r.fingerprint, 16) for r in got], np.uint64), np.array([-1 if r.doc_id is None else r.doc_id for r in got])
    label = brute_components(fps, 3)
    for r, c in zip(got, label, strict=True):
        members = ids[(label == c) & (ids >= 0)]
        assert r.component_id == (members.min() if len(members) else None)
    assert sum(r.kept for r in got) == len(set(label.tolist()))
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert simhash_dedup.simhash_dedup(empty).count() == 0


def test_simhash_is_the_definition(spark):
    words = "alpha Beta gamma delta epsilon".lower().split()
    frame = spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(3)], "s string").select(F.xxhash64("s").alias("h"))
    hashes = [r.h % (1 << 64) for r in frame.collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash_dedup.simhash(b"alpha Beta\tgamma  delta epsilon", 3) == [want]


@pytest.mark.parametrize(("tau", "wide", "bucket"), [(3, None, 1 << 14), (3, None, 4), (9, 40, 1 << 14), (9, 40, 5)])
def test_links_are_complete(spark, tau, wide, bucket):
    rng = np.random.default_rng(tau + bucket)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    noisy = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, tau + 2), replace=False))) for c in centres for _ in range(6)]
    fps = np.unique(np.array(noisy, np.uint64))
    nodes = spark.createDataFrame([(int(f), 0) for f in fps.view(np.int64)], "fp long, fp2 long")
    roots = {r.node: r.root for r in common.components(simhash_dedup.near_links(nodes, tau, wide, bucket)).collect()}
    signed = fps.view(np.int64).tolist()
    label = brute_components(fps, tau)
    groups: dict[int, set[int]] = {}
    for f, c in zip(signed, label.tolist(), strict=True):
        groups.setdefault(c, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({next(iter(g)) for g in groups.values()})


def test_thresholds_sum():
    costs = [[0, 5, 9, 30, 99], [0, 1, 2, 3, 4], [0, 50, 90, 99, 99], [0, 7, 8, 9, 10]]
    for total in (0, 1, 3):
        assert sum(simhash_dedup.allocate(costs, total)[1]) == total


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and got[101] == 100 and got[202] == got[201] == 200 and 7 in got


def brute_removed(texts):
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("pieces", [2_000, 1])
def test_suffix_dedup(docs, rows, empty, pieces):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, pieces).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, brute_removed(texts_of(rows)), strict=True))
    if pieces > 1:
        assert suffix_dedup.suffix_dedup(empty).count() == 0


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 4}") for i, n in enumerate(rng.integers(1, 60, 400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).join(frame.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.sum("size").alias("s")).orderBy("source").collect()
    whole = sum(r.s for r in got)
    for r, weight in zip(got, (1, 2, 3, 1), strict=True):
        assert r.w == pytest.approx(whole * weight / 7) and r.t == pytest.approx(r.w, rel=0.02)


def test_share_targets():
    assert mixing.share_targets([10, 10, 80], [1, 1, 1]) == [30, 30, 40]
    assert mixing.share_targets([0, 5], [1, 2]) == [0, 5]
    assert sum(mixing.share_targets([1, 2, 97], [5, 5, 1])) == pytest.approx(100)


@pytest.mark.parametrize("n", [40, 3])
def test_sharding(docs, rows, empty, n):
    got = sharding.shard(docs, n).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None for r in got)
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty, n).count() == 0


def test_shards_are_even(spark):
    copies = [(i, "copy " * 20) for i in range(700)]
    frame = spark.createDataFrame(copies + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(1_400)], "doc_id long, text string")
    sizes = sharding.shard(frame, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r.b for r in sizes) / 10
    assert len(sizes) == 10 and all(abs(r.b - mean) < 0.08 * mean for r in sizes)


def test_top_k(spark, empty):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 12)) * 0.2
    vectors[100:200] = vectors[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1050, [None] * 12), (1100, [float("nan")] * 12), (None, [1.0] * 12), (1150, []), (1200, [1e30] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got: dict[int, list] = {}
    for r in topk.embedding_top_k(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    low, high = -(1 << 63), (1 << 63) - (1 << 10)  # of doubles that a long holds
    ints = {i: [max(low, min(high, int(np.floor(256 * x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    limit = (1 << 63) - 1
    for q, v in ints.items():
        if q % 50 == 0:
            scores = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in ints.items() if i != q)[:5]
            assert got[q] == [(i, -s) for s, i in scores]
    assert topk.embedding_top_k(frame.limit(0)).count() == 0


def test_max_score_shards():
    rng = np.random.default_rng(8)
    for spread in (3, 300, 10**12):
        ids, impacts = rng.permutation(500)[:300], rng.integers(-spread, spread, (300, 20))
        shard = topk.Shard(ids, impacts)
        for own in ids[:20].tolist():
            query = impacts[ids == own][0]
            got_ids, got = shard.top(query, own, 5)
            limit = (1 << 63) - 1
            clip = lambda s: max(-limit, min(limit, s))
            scores = sorted((-clip(sum(int(a) * int(b) for a, b in zip(query, v, strict=True))), int(i)) for i, v in zip(ids, impacts, strict=True) if i != own)[:5]
            assert list(zip(got_ids.tolist(), got.tolist(), strict=True)) == [(i, -s) for s, i in scores]


PAGES = [
    (1, "http://A.example.org/en/12?x=/y", "<article><h1>T&amp;x</h1><p>one\n two<br>three<p>four</article><footer>no</footer>"),
    (2, "https://sub.example.com/fr/1", None),
    (3, None, ""),
    (4, "no scheme/path", "<html><body>"),
    (5, "ftp://example.org", "<nav><a>menu</a></nav><main><p>Main text of some length stands here.</p><p>Short.</p><div class='comments'><p>first!</p></div></main>"),
    (None, "http://x.net/a/b/c/d/e/f", "plain words"),
    (7, "http://x.net//a//", "<div class='sidebar'>side</div><p>Body text that is long enough to be told from the rest.</p><script>var t='</p>';</script>"),
]


def test_html(spark):
    frame = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(frame).collect()}
    assert got[1].text == "T&x\none two three\nfour" and got[2].text == got[3].text == got[4].text == ""
    assert got[5].text == "Main text of some length stands here.\nShort." and got[None].text == "plain words"
    assert got[7].text == "Body text that is long enough to be told from the rest." and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(frame.limit(0)).count() == 0


def test_url_filter(spark):
    extra = [(100 + i, f"http://site.example.com/{s}/item/{i}", None) for i, s in enumerate(("de", "fr") * 20)] + [(200 + i, f"http://site.example.com/en/item/{i}", None) for i in range(9)]
    frame = spark.createDataFrame(PAGES + extra, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(frame).collect()}
    assert len(got) == len(PAGES) + len(extra)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[2].rule == "com/fr/"
    assert got[3].host == got[3].path == got[4].host == "" and got[5].rule is None and got[100].verdict == "block"
    assert got[200].template == "/en/item/*" and got[200].verdict in ("allow", "block")
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_url_filter_matches_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001/pages.parquet"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}'")
    want = sorted(map(tuple, con.sql(url_filter.oracle()).df().fillna("").values.tolist()))
    frame = url_filter.judge(spark.read.parquet(data)).select("page_id", "host", "path", "rule", "verdict").toPandas().fillna("")
    assert sorted(map(tuple, frame.values.tolist())) == want


def toxic_corpus(n=240):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = [f"w{''.join(rng.choice(list('abcdef'), 4))}" for _ in range(rng.integers(5, 60))]
        bad = int(rng.random() < 0.3)
        for _ in range(bad * int(rng.integers(2, 5))):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["Scoundrel", "villain", "rogueish"])))
        rows.append((i, " ".join(words), bad))
    return rows


def test_marginals_are_exact():
    import itertools

    rng = np.random.default_rng(0)
    t, lens = np.exp(rng.normal(size=(2, 2))), [3, 0, 1, 5, 2]
    e = rng.normal(size=11) * 2
    prob, moves = toxicity.marginals(e, np.array(lens), t)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in filter(None, lens):
        total, mean, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[at + i] for i in range(n) if s[i])) * np.prod([t[a, b] for a, b in zip(s, s[1:], strict=False)])
            total, mean = total + w, mean + w * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                seen[a, b] += w
        want += list(mean / total)
        pairs, at = pairs + seen / total, at + n
    assert prob == pytest.approx(want) and moves == pytest.approx(pairs)


def test_toxicity(spark, docs, rows, empty):
    corpus = toxic_corpus()
    frame = spark.createDataFrame([r[:2] for r in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in corpus] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, labels).collect()}
    held = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {k for k, r in got.items() if r.held_out}
    assert np.mean([got[r[0]].predicted == r[2] for r in held]) > 0.9
    told = next(r for r in held if r[2])
    assert any(told[1][s.start : s.end].lower() in ("scoundrel", "villain", "rogueish") for s in got[told[0]].spans)
    model = toxicity.train(frame, labels)
    scored = toxicity.toxicity(docs, labels, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels, model).count() == 0
    clean = toxicity.keep_clean(frame, labels)
    assert clean.columns == frame.columns and clean.count() == sum(not r.predicted for r in got.values())


def test_bpe_is_the_library(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], tuple(ids), lib.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.encode(docs).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    digests = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, digest=True).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == Counter({(d, len(i), sha(" ".join(map(str, i))), sha(t)): n for (d, i, t), n in want.items()})
    assert bpe.encode(empty).count() == 0


@given(st.lists(st.text(alphabet=st.sampled_from("inthearΣσß'sİI 　\x1c1²é😀"), max_size=40), max_size=8))
@settings(max_examples=100, deadline=None)
def test_bpe_on_odd_texts(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    got = bpe.encoder(bpe.default_path()).encode_batch(texts)
    assert [g[1] for g in got] == [" ".join(map(str, e.ids)) for e in lib.encode_batch(texts, add_special_tokens=False)]
