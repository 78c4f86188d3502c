"""What Python workers hold: freed memory goes back between batches, the encoder's share is small."""

import tracemalloc

import pyarrow as pa

from latticework.llm import bpe, common


def test_memory_is_given_back_between_batches(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1 << 16), "text": ["x" * 40] * (1 << 16)})
    told = list(common.trimmed(lambda batches: (b.slice(0, 2) for b in batches), iter([batch] * 8)))
    assert [b.num_rows for b in told] == [2] * 8 and len(calls) >= 3


def test_encoder_holds_few_times_its_texts():
    enc = bpe.Encoder(bpe.default_path())
    texts = ["one two three four five six seven " * 30] * 1_000
    expected = enc.token_ids(texts[:1])[0].tolist()
    size = sum(map(len, texts))
    tracemalloc.start()
    found = enc.token_ids(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(ids.tolist() == expected for ids in found)
    assert peak < 5 * size, peak / size


def test_no_piece_outlives_its_task():
    path = bpe.default_path()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, and others", "words again"]})
    for digest in (True, False):
        assert sum(b.num_rows for b in bpe._encode_batches(path, digest)(iter([batch]))) == 2
        enc = bpe.encoder(path)
        assert set(enc.index) == {f" {t}" for t in enc.special}


def test_cache_that_starts_anew_changes_nothing(monkeypatch):
    texts = [" ".join(f"Word{k * j % 97}, piece{k}!" for j in range(9)) for k in range(40)] + ["", "piece3! <|endoftext|> Word0,"]
    expected = [ids.tolist() for ids in bpe.Encoder(bpe.default_path()).token_ids(texts)]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    enc = bpe.Encoder(bpe.default_path())
    for at in range(0, len(texts), 3):
        assert [ids.tolist() for ids in enc.token_ids(texts[at : at + 3])] == expected[at : at + 3]
