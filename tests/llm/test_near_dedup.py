"""The near-dedup stage against brute-force shingle Jaccard."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm import common, simhash_dedup


def shingle_set(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """The ids that stay: the smallest of every component of steps of Jaccard 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return {min(d for (d, _), c in zip(rows, label, strict=True) if c == k) for k in set(label)}


@pytest.fixture(scope="module")
def planted():
    """60 pairs of Jaccard 0.80 to 0.89, most of them at the limit, and a family of near copies."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(1 << 40)}"
    out = []
    for n in (9, 36, 45, 225) * 15:
        a = [word() for _ in range(n + 4)]
        low = -(-4 * n // 5)
        b = a[: low + 4] if n % 2 == 0 or n == 225 else a[:-1]
        sets = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        if 5 * len(sets[0] & sets[1]) > 4.3 * len(sets[0] | sets[1]):
            b = a[: low + 4]
        out += [" ".join(a), " ".join(b)]
    base = [word() for _ in range(120)]
    out += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(0, 120, 3)]
    return [(i, t) for i, t in enumerate(out)]


def test_pairs_at_the_limit(spark, planted):
    pairs = planted[:120]
    assert all(similar(shingle_set(pairs[i][1]), shingle_set(pairs[i + 1][1])) for i in range(0, 120, 2))
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash_dedup.keep_one(docs).collect()} == brute(planted)


@pytest.mark.parametrize(("bucket", "shingles"), [(4, 1 << 22), (1 << 14, 400)])
def test_blocks_of_large_groups(spark, planted, bucket, shingles):
    docs = spark.createDataFrame(planted, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as xh", "text")
    fps = docs.mapInArrow(simhash_dedup._set_batches(5, np.zeros(0, np.uint64)), simhash_dedup.SET_SCHEMA).cache()
    links = common.components(simhash_dedup.jaccard_links(docs, fps, 5, bucket, shingles))
    roots = {r.node: r.root for r in links.collect()}
    assert len({roots.get(r.id, r.id) for r in fps.collect()}) == len(brute(planted))


def test_the_order_of_shingles_is_free():
    rng = np.random.default_rng(2)
    for _ in range(300):
        union = np.unique(rng.integers(0, 1 << 63, int(rng.integers(4, 60)), dtype=np.uint64))
        cut = len(union) // 5
        a, b = np.sort(rng.permutation(union)[cut // 2 :]), union
        b = np.setdiff1d(b, rng.permutation(a)[: cut - cut // 2])
        usual = np.sort(rng.choice(union, len(union) // 2, replace=False))
        assert simhash_dedup.similar(a, b) == (5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
        if simhash_dedup.similar(a, b):
            assert len(np.intersect1d(simhash_dedup.prefix(a, usual), simhash_dedup.prefix(b, usual)))


def test_texts_of_few_words_stay(spark):
    """Few shingles make fingerprints poor in ones: by bits alone these texts are near an empty one."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(1 << 40, size=6))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "ONE "), (105, "a b c"), (106, "a b c d e f g h"), (107, "a b c d e f g h i"), (108, "b c d e f g h i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash_dedup.keep_one(docs).collect()}
    assert kept == brute(rows) == {*range(40), 100, 103, 105, 106}


def test_fingerprints_lead_to_links(spark, planted):
    """Sets within three bits are linked by their fingerprints, in the operator's way, without a common
    shingle in their prefixes; what the fingerprints lose is found by the prefixes."""
    docs = spark.createDataFrame(planted, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as xh", "text")
    fps = docs.mapInArrow(simhash_dedup._set_batches(5, np.zeros(0, np.uint64)), simhash_dedup.SET_SCHEMA).cache()
    rows = fps.collect()
    sets = {r.id: shingle_set(dict(planted)[r.doc_id]) for r in rows}
    near = {(a.id, b.id) for a in rows for b in rows if a.id < b.id and ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count() <= 3 and similar(sets[a.id], sets[b.id])}
    bare = fps.withColumn("prefix", F.array().cast("array<long>"))
    got = common.components(simhash_dedup.jaccard_links(docs, bare, 5))
    roots = {r.node: r.root for r in got.collect()}
    assert near and all(roots.get(a, a) == roots.get(b, b) for a, b in near)
    whole = {r.node: r.root for r in common.components(simhash_dedup.jaccard_links(docs, fps, 5)).collect()}
    assert len(whole) > len(roots) and len({whole.get(r.id, r.id) for r in rows}) == len(brute(planted))


def test_prefixes_join_groups_only():
    """A pair of one group is not looked at again; others join groups, by any of their sets."""
    key, group = [1, 1, 1, 1, 2, 2, 3, 3], [7, 9, 7, 8, 7, 7, 5, 6]
    n = [100, 100, 100, 40, 90, 90, 50, 90]
    fp = [0, -1, 1, 2, 0, 1, 0, 0]
    columns = {"key": key, "half": [-1] * 8, "id": group, "n": pa.array(n, pa.int32()), "fp": fp, "fp2": fp}
    links = [tuple(r.values()) for b in simhash_dedup._set_links(None)(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    assert links == []
    columns["fp"] = columns["fp2"] = [0, 3, 1, 2, 0, 1, 0, 0]
    links = [tuple(r.values()) for b in simhash_dedup._set_links(None)(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    assert links == [(9, 7)]
