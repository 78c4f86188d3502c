"""BPE encoding and decoding with a pair occurrence index.

Reads a ``tokenizers`` JSON file of the word-end kind: NFC, white space folded, lower case, a
pattern that finds the words, bytes spelled as printable characters, merges by rank.  The
words of a partition that were not met before are laid out as one linked list of symbols; an
index maps each adjacent pair to all its positions, and a heap holds the ranks of the pairs
that occur.  The lowest active rank is applied to all its positions, which updates the lists
of the pairs beside them, until no pair has a rank.  Each distinct word is merged once while
it stays in the cache of its task; texts are assembled from their words.

The index works on arrays: a rank is applied to all its positions at once.  Words in which a
rank has several positions at a time, where the order inside the word matters, go through the
same index position by position.

Special tokens' strings in a text become their ids, as the library does by default.  Decoding
joins token strings by a space, which is what the library does for a file without a decoder.

Defined results: a null text counts as empty; an empty text has no ids; rows with null ids or
clashing extra columns pass through unharmed; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, picked, text_blocks

CACHE_PIECES = 400_000
BLOCK = 1 << 21  # bytes of text that are encoded together
# Unicode White_Space, which the library's patterns call white space.
SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """Printable stand-ins for the 256 bytes: visible Latin-1 as itself, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Encoder:
    """Merges words by rank; pieces between white space are kept as arrays of tokens, up to
    ``CACHE_PIECES`` of them, until a task ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        strings = dict(map(reversed, vocab.items()))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings |= {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # A line break ends a piece where many are split at once.
        self.words = regex.compile(f"(?:{pattern})|\n".replace("\\s", SPACE))
        self.fold = regex.compile(f"[{SPACE}]+")
        self.separators = regex.compile("[\\x1c-\\x1f]")
        letters = byte_letters()
        # Symbols of the 256 bytes, inside a word and at its end; -1: no such symbol.
        self.inside = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.at_end = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        codes = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.pair_codes = codes[order]
        self.pair_ranks = np.array([r for r, _ in self.rank.values()], np.int32)[order]
        self.by_rank = {r: (a, b, new) for (a, b), (r, new) in self.rank.items()}
        lowest: dict[int, int] = {}  # of the ranks that a symbol takes part in
        for (a, b), (r, _) in self.rank.items():
            lowest[a], lowest[b] = min(r, lowest.get(a, r)), min(r, lowest.get(b, r))
        # A rank whose new symbol takes part in a lower one: its positions in a word are not independent.
        self.tangled = {r for r, new in self.rank.values() if lowest.get(new, r + 1) < r}
        most = max(strings) + 1
        self.as_digits = np.array([str(i) for i in range(most)], object)
        self.as_string = np.array([strings.get(i, "") for i in range(most)], object)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}  # piece -> its entry in ``bound``
        self.known: dict[str, int] = {}  # word -> the same
        self.flat = np.zeros(0, np.int32)
        self.bound = np.zeros(1, np.int64)
        # No piece holds a space, so no piece is taken for a special token.
        self.index.update(zip([f" {t}" for t in self.special], self.extend(np.array([*self.special.values()], np.int32), np.ones(len(self.special), np.int64)), strict=True))

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Append entries of ``sizes`` tokens each; returns their numbers."""
        first = len(self.bound) - 1
        self.bound = np.concatenate((self.bound, len(self.flat) + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, ids))
        return range(first, first + len(sizes))

    def split(self, text: str) -> list[str]:
        """The pieces between white space of a text that holds no special token."""
        # Lower case letter by letter: no rule looks at the neighbours.
        folded = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.separators.search(folded):  # Python splits there, the library does not
            return [p for p in self.fold.sub(" ", folded).split(" ") if p]
        return folded.split()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where a pair has none."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words laid end to end, and how many each word has."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = self.inside[data]
        ends = np.cumsum(lens)[lens > 0] - 1
        out[ends] = self.at_end[data[ends]]
        if (out < 0).any():
            owner = np.repeat(np.arange(len(words)), lens)
            lens = np.bincount(owner[out >= 0], minlength=len(words))
            out = out[out >= 0]
        return out, lens

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, end to end, and the number of each: all words are merged
        together through the pair index."""
        symbol, lens = self.symbols(words)
        n = len(symbol)
        bound = np.concatenate(([0], np.cumsum(lens)))
        # One entry of padding at the end stands for "none".
        symbol = np.append(symbol, np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        some = lens > 0
        after[bound[1:][some] - 1], before[bound[:-1][some]] = n, n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(where: np.ndarray) -> None:
            """Enter the pairs that start at ``where``."""
            behind = after[where]
            rank = self.ranks(symbol[where], symbol[behind])  # padding has none
            has = rank >= 0
            where, rank = where[has], rank[has]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            where, rank = where[order], rank[order]
            heads = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()]
            for a, b, r in zip(heads, [*heads[1:], len(rank)], rank[heads].tolist(), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(where[a:b])

        note(np.arange(n, dtype=np.int32))
        single: set[int] = set()  # words to merge position by position
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            left, right, new = self.by_rank[rank]
            behind = after[at]
            live = (symbol[at] == left) & (symbol[behind] == right)
            at = at[live]
            if left == right and len(at) > 1:
                # Overlapping pairs: of a run of equal symbols every other position is taken.
                at = np.unique(at)
                head = np.concatenate(([True], after[at[:-1]] != at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            if rank in self.tangled and len(at) > 1:
                owner = np.searchsorted(bound, np.unique(at), side="right") - 1
                twice = np.unique(owner[1:][owner[1:] == owner[:-1]])
                if len(twice):
                    single.update(twice.tolist())
                    at = at[~np.isin(np.searchsorted(bound, at, side="right") - 1, twice)]
                    for k in twice.tolist():
                        symbol[bound[k] : bound[k + 1]] = -1
            if not len(at):
                continue
            behind = after[at]
            symbol[at], symbol[behind] = new, -1
            rest = after[behind]
            after[at] = rest
            before[rest] = at
            before[n] = n
            note(np.concatenate((at, before[at])))
        if single:
            for k, ids in zip(sorted(single), self.merge_in_order([words[k] for k in sorted(single)]), strict=True):
                symbol[bound[k] : bound[k + 1]] = -1
                symbol[bound[k] : bound[k] + len(ids)] = ids
        kept = symbol[:n] >= 0
        return symbol[:n][kept], np.diff(np.concatenate(([0], np.cumsum(kept)))[bound])

    def merge_in_order(self, words: list[str]) -> list[list[int]]:
        """The same by single positions: of one rank, left to right inside a word."""
        symbols, lens = self.symbols(words)
        symbol: list[int] = symbols.tolist()
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        owner: list[int] = np.repeat(np.arange(len(words)), lens).tolist()
        heads: list[int] = []
        for size, end in zip(lens.tolist(), np.cumsum(lens).tolist(), strict=True):
            heads.append(end - size if size else -1)
            if size:
                after[end - 1], before[end - size] = -1, -1
        rank = self.rank
        index: dict[tuple[int, int], list[int]] = {}
        for i, n in enumerate(after):
            if n >= 0:
                pair = (symbol[i], symbol[n])
                if pair in rank:
                    index.setdefault(pair, []).append(i)
        active = [(rank[p][0], p) for p in index]
        heapq.heapify(active)
        while active:
            at_rank, pair = heapq.heappop(active)
            positions = index.pop(pair, None)
            if positions is None:
                continue
            left, right = pair
            new = rank[pair][1]
            positions.sort()
            waiting = -1  # a word in which a lower rank arose: its other positions come later
            again: list[int] = []
            for i in positions:
                n = after[i]
                if symbol[i] != left or n < 0 or symbol[n] != right:
                    continue  # an overlapping merge took it
                if owner[i] == waiting:
                    again.append(i)
                    continue
                symbol[i], symbol[n] = new, -1
                n = after[n]
                after[i] = n
                if n >= 0:
                    before[n] = i
                    pair_after = (new, symbol[n])
                    if pair_after in rank:
                        if pair_after not in index:
                            index[pair_after] = []
                            heapq.heappush(active, (rank[pair_after][0], pair_after))
                        index[pair_after].append(i)
                        if rank[pair_after][0] < at_rank:
                            waiting = owner[i]
                b = before[i]
                if b >= 0:
                    pair_before = (symbol[b], new)
                    if pair_before in rank:
                        if pair_before not in index:
                            index[pair_before] = []
                            heapq.heappush(active, (rank[pair_before][0], pair_before))
                        index[pair_before].append(b)
                        if rank[pair_before][0] < at_rank:
                            waiting = owner[i]
            if again:
                index.setdefault(pair, []).extend(again)
                heapq.heappush(active, (at_rank, pair))
        out = []
        for head in heads:
            ids = []
            while head >= 0:
                ids.append(symbol[head])
                head = after[head]
            out.append(ids)
        return out

    def learn(self, pieces: set[str]) -> None:
        """Make entries for pieces that have none.  Words have entries, too: the pattern looks at
        nothing beside a word, so a word is a piece that is one word."""
        plain = [p for p in pieces if p.isascii() and p.isalpha()]
        others = list(pieces.difference(plain))
        found = self.words.findall("\n".join(others) + "\n")
        words = list(set(plain).union(found).difference(self.index, "\n"))
        self.index.update(zip(words, self.extend(*self.merge(words)), strict=True))
        entries = np.fromiter(map(self.index.get, found, repeat(-1)), np.int64, len(found))
        counts = np.diff(np.flatnonzero(entries < 0), prepend=-1) - 1  # words of each piece
        new = np.array([p not in self.index for p in others], bool)
        ids, ends = self.gathered(entries[entries >= 0][np.repeat(new, counts)])
        ends = np.concatenate(([0], ends))[np.cumsum(counts[new])]
        self.index.update(zip([p for p in others if p not in self.index], self.extend(ids, np.diff(ends, prepend=0)), strict=True))

    def gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of entries end to end, and where each entry's end."""
        begin = self.bound[entries]
        size = self.bound[entries + 1] - begin
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at], ends

    def pieces(self, text: str) -> list[str]:
        if self.split_special is None or not any(token in text for token in self.special):
            return self.split(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(f" {part}")
            else:
                out += self.split(part)
        return out

    def entries_of(self, texts: list[str]) -> tuple[list[np.ndarray], dict[str, int]]:
        """The entries of each text's pieces, and the pieces that have none, numbered: ``-1 - k``
        stands for number k.  Of a text that is done only its entries are held."""
        out, fresh = [], {}
        for text in texts:
            own = self.pieces(text)
            entries = np.fromiter(map(self.index.get, own, repeat(-1)), np.int32, len(own))
            for k in np.flatnonzero(entries < 0).tolist():
                entries[k] = -1 - fresh.setdefault(own[k], len(fresh))
            out.append(entries)
        return out, fresh

    def token_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        found, fresh = self.entries_of(texts)
        if len(self.index) + len(fresh) > CACHE_PIECES:  # the cache starts anew before it outgrows its bound
            self.clear()
            found, fresh = self.entries_of(texts)
        if fresh:
            self.learn(set(fresh))
            learnt = np.fromiter(map(self.index.__getitem__, fresh), np.int32, len(fresh))
            for entries in found:
                missing = entries < 0
                entries[missing] = learnt[-1 - entries[missing]]
        # Text by text: what gathering takes is many times what it gives.
        return [self.gathered(entries)[0] for entries in found]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.as_string[ids].tolist())

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: token count, ids as decimals, decoded text."""
        return [(len(ids), " ".join(self.as_digits[ids].tolist()), self.decode(ids)) for ids in self.token_ids(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode_batches(path: str, digest: bool, block: int = BLOCK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for batch in batches:
                for part in text_blocks(batch, block):
                    yield told(enc, part)
        finally:
            enc.clear()  # workers live on; what a task learnt would stay beside what other stages need

    def told(enc: Encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        if digest:
            rows = [(n, *(hashlib.sha256(x.encode()).hexdigest() for x in both)) for n, *both in enc.encode_batch(texts)]
            columns = [pa.array([t[k] for t in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        found = enc.token_ids(texts)
        columns = [pa.array([len(ids) for ids in found], pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(map(enc.decode, found), pa.string())]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_tokens, and ids with the decoded
    text, or with ``digest`` the SHA-256 of each, taken where the tokens are made."""
    base = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return arrow(base, _encode_batches(path or default_path(), digest), DIGEST_SCHEMA if digest else FULL_SCHEMA)
