"""The pipeline's filtering and mixing stages on odd rows: nulls, repeats, ties, clashing names."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from latticework.llm import exact_dedup, mixing, simhash_dedup, toxicity

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _d long, _h string, _n int, n int, _kd long, key string, uid long, c0 string, TEXT string"
LONG = " ".join(f"calm{i % 997} river{i % 83}" for i in range(60_000))


def row(doc_id, text, source="a", other=1):
    return (doc_id, text, None, source, other, 1, "h", 2, 3, 4, None, 6, "c", "other text")


@pytest.fixture(scope="module")
def rows():
    out = [row(1, "same words here"), row(1, "same words here", "y"), row(1, "same words here", None), row(2, "Same WORDS here"), row(2, "Same WORDS here")]
    out += [row(3, None), row(4, ""), row(None, "no id at all"), row(None, None), row(5, LONG), row(6, LONG + " end"), row(7, "scoundrel villain wretch you scoundrel")]
    return [*out, *(row(100 + k, f"plain text number {k} of some more", f"s{k % 3}") for k in range(20))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "true")  # only so that the fixture can be made
    frame = spark.createDataFrame(rows, CLASHING).repartition(3).cache()
    frame.count()
    spark.conf.unset("spark.sql.caseSensitive")
    return frame


def as_rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_exact_dedup_keeps_whole_rows(docs, rows):
    got = as_rows(exact_dedup.keep_one(docs))
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").encode().lower(), []).append(r)
    assert sum(got.values()) == len(groups) and set(got) <= set(rows)
    for text, members in groups.items():
        best = max(-1 if r[0] is None else r[0] for r in members)
        mine = [r for r in got if (r[1] or "").encode().lower() == text]
        assert [-1 if r[0] is None else r[0] for r in mine] == [best]


def test_near_dedup_keeps_whole_rows(docs, rows):
    got = as_rows(simhash_dedup.keep_one(docs))
    assert set(got.values()) == {1} and set(got) <= set(rows)
    # Equal words, no words, and the two long texts are one group each.
    assert {r[0] for r in got} == {1, 3, None, 5, 7, *range(100, 120)}


def test_mixing_keeps_each_source_apart(docs, rows):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.xh] += r.copies
    got = as_rows(mixing.mixed_documents(docs))
    assert set(got) <= set(rows) and sum(got.values()) == sum(taken.values())
    assert all(n <= 3 * rows.count(r) and r[1] for r, n in got.items())
    mixed = Counter()
    for r, n in got.items():
        mixed[r[3]] += n * len(r[1].split())
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    whole = sum(size.values())
    names = sorted(filter(None, size)) + [None]
    targets = dict(zip(names, mixing.share_targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    assert whole == pytest.approx(sum(targets.values()))
    for s in names[1:]:  # all but the one that is nearly all of one long text
        assert abs(mixed[s] - targets[s]) <= max(8, 0.1 * targets[s])


def test_toxicity_keeps_whole_rows(spark, docs, rows):
    labelled = [(i, f"calm words {i} " + "scoundrel villain wretch" * (i % 2), i % 2) for i in range(200, 320)]
    frame = docs.union(spark.createDataFrame([row(i, t) for i, t, _ in labelled], docs.schema))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled], "doc_id long, quality int, toxic int")
    got = as_rows(toxicity.keep_clean(frame, labels))
    assert {r: n for r, n in got.items() if r in rows} == {r: n for r, n in Counter(rows).items() if r[0] != 7}


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    data = "/root/testdata/sf0.001"
    for name, stage in cp.STAGES:
        out = stage(spark, empty, data)
        assert out.count() == 0
        assert name == "bpe" or out.columns == empty.columns


def test_spans_are_offsets_of_the_text():
    rows = [(f"calm words {k} here" + " scoundrel villain" * (k % 3 == 0), int(k % 3 == 0)) for k in range(120)]
    model = toxicity.fit(rows)
    text = "İİİİ scoundrel here"
    _, spans = toxicity._score_texts(model, [text], {})
    assert [text[a:b] for a, b in spans[0]] == ["scoundrel"]


def test_neighbours_change_a_tag():
    """The chain's transitions, not the word alone, decide a word of no weight."""
    rows = [(f"calm words {k} here and there" + " scoundrel vile villain vile wretch" * (k % 3 == 0), int(k % 3 == 0)) for k in range(120)]
    model = toxicity.fit(rows)
    tag = lambda words, at: float(toxicity.marginals(np.array([model.emission(w) for w in words]), np.array([len(words)]), model.transitions)[0][at])
    assert tag(["scoundrel", "unseen", "villain"], 1) > 2 * tag(["calm", "unseen", "words"], 1)
