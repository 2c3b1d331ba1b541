"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A pre-token is a row of symbols. The leaves of a tree hold rank and place of each adjacent
pair; every node holds the least of its two children, so the root is the leftmost pair of
the lowest rank. Merging it changes three leaves (its own, the one before, the one that
vanishes), each a logarithmic update; encoding ends when the root is empty. A pre-token of
any length takes O(n log n).

Words repeat, so a worker keeps what it has encoded in a memory of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NONE = 1 << 62
PLACE = 32  # low bits of a leaf hold the place


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge_pairs(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Token ids after all merges; ``pairs`` has (rank, merged id) by pair of ids."""
    count = len(symbols) - 1
    if count < 1:
        return symbols
    leaves = 1 << (count - 1).bit_length() if count > 1 else 1
    tree = [NONE] * (2 * leaves)
    for i in range(count):
        hit = pairs.get((symbols[i], symbols[i + 1]))
        if hit:
            tree[leaves + i] = hit[0] << PLACE | i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, count + 2)), list(range(-1, count))
    last = count + 1

    def put(place: int) -> None:
        node = leaves + place
        following = after[place]
        hit = pairs.get((symbols[place], symbols[following])) if following < last else None
        tree[node] = hit[0] << PLACE | place if hit else NONE
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    mask = (1 << PLACE) - 1
    while tree[1] != NONE:
        left = tree[1] & mask
        right = after[left]
        symbols[left] = pairs[symbols[left], symbols[right]][1]
        after[left] = after[right]
        if after[right] < last:
            before[after[right]] = left
        after[right] = last
        if right < count:
            put(right)
        put(left) if left < count else None
        if before[left] >= 0:
            put(before[left])
        symbols[right] = -1
    return [s for s in symbols if s >= 0]


class PairTable:
    """Rank and merged id of pairs, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 20 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int64)[order]
        self.merged = np.zeros(int(self.ranks.max(initial=0)) + 1, dtype=np.int64)
        for rank, result in pairs.values():
            self.merged[rank] = result

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at] << PLACE | place, NONE)


def merge_rows(symbols: np.ndarray, counts: np.ndarray, table: PairTable) -> np.ndarray:
    """``merge_pairs`` for many short rows at once: one tree per row, one merge a round.

    ``symbols`` is padded to a power of two; vanished and padded places come back as -1.
    """
    rows, leaves = symbols.shape
    places = np.arange(leaves)
    tree = np.full((rows, 2 * leaves), NONE, dtype=np.int64)
    first = table.leaf(symbols[:, :-1], symbols[:, 1:], places[:-1])
    tree[:, leaves : 2 * leaves - 1] = np.where(places[1:] < counts[:, None], first, NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    after = np.tile(places + 1, (rows, 1))
    before = np.tile(places - 1, (rows, 1))
    levels = leaves.bit_length() - 1
    mask = (1 << PLACE) - 1

    def climb(row: np.ndarray, place: np.ndarray) -> None:
        node = leaves + place
        for _ in range(levels):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def put(row: np.ndarray, place: np.ndarray) -> None:
        following = after[row, place]
        has = following < counts[row]
        following = np.where(has, following, place)
        leaf = table.leaf(symbols[row, place], symbols[row, following], place)
        tree[row, leaves + place] = np.where(has, leaf, NONE)
        climb(row, place)

    alive = np.flatnonzero(tree[:, 1] != NONE)
    while len(alive):
        root = tree[alive, 1]
        left = root & mask
        right = after[alive, left]
        symbols[alive, left] = table.merged[root >> PLACE]
        symbols[alive, right] = -1
        following = after[alive, right]
        after[alive, left] = following
        linked = following < counts[alive]
        before[alive[linked], following[linked]] = left[linked]
        tree[alive, leaves + right] = NONE
        climb(alive, right)
        put(alive, left)
        prior = before[alive, left]
        inner = prior >= 0
        put(alive[inner], prior[inner])
        alive = alive[tree[alive, 1] != NONE]
    return symbols


def runs(labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of one label."""
    if len(labels):
        begin = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
        yield from zip(begin.tolist(), np.append(begin[1:], len(labels)).tolist())


class WordBpe:
    """Encoder and decoder of a BPE file with an end-of-word suffix and lower-casing.

    No pre-token spans a blank, so a text is cut at blanks and line ends first and whole
    pieces are remembered, at most ``MEMORY`` of them.
    """

    MEMORY = 400_000
    LONGEST = 64

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)])
        self.final = np.array([self.vocab[letters[b] + suffix] for b in range(256)])
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.table = PairTable(self.pairs)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.added).items()}
        split = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.words = regex.compile(split)
        library = Tokenizer.from_str(source)
        self.library = library.normalizer, library.pre_tokenizer
        marks = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is a sigma)."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def words_of(self, piece: str) -> list[str]:
        """Pre-tokens. Beyond U+0300 the order of marks and the classes of letters depend on
        the Unicode version, so there the library's own tables decide."""
        if max(piece, default="") < "\u0300":
            return self.words.findall(self.normalise(piece))
        normalizer, pre_tokenizer = self.library
        text = normalizer.normalize_str(piece)
        return [text[begin:end] for _, (begin, end) in pre_tokenizer.pre_tokenize_str(text)]

    def cut(self, text: str | None) -> list[str]:
        """Pieces between blanks and line ends, special tokens apart."""
        text = text or ""
        if self.marks and "<|" in text:
            out = []
            for part in self.marks.split(text):
                out += [part] if part in self.added else part.replace("\n", " ").split(" ")
            return out
        return text.replace("\n", " ").split(" ")

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Token ids of pre-tokens: short ones together by size, long ones alone."""
        out: list[list[int]] = [[]] * len(words)
        sizes: dict[int, list[int]] = {}
        data = [w.encode("utf-8", "replace") for w in words]
        for i, d in enumerate(data):
            if len(d) == 1:
                out[i] = [int(self.final[d[0]])]
            elif len(d) <= self.LONGEST:
                sizes.setdefault(1 << (len(d) - 1).bit_length(), []).append(i)
            else:
                symbols = self.inner[np.frombuffer(d, np.uint8)]
                symbols[-1] = self.final[d[-1]]
                out[i] = merge_pairs(symbols.tolist(), self.pairs)
        for width, group in sizes.items():
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                counts = np.array([len(data[i]) for i in some])
                block = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in some), np.uint8)
                block = block.reshape(len(some), width)
                symbols = self.inner[block]
                line = np.arange(len(some))
                symbols[line, counts - 1] = self.final[block[line, counts - 1]]
                symbols[np.arange(width) >= counts[:, None]] = -1
                done = merge_rows(symbols, counts, self.table)
                flat = done[done >= 0].tolist()
                ends = np.cumsum((done >= 0).sum(axis=1)).tolist()
                begin = 0
                for i, end in zip(some, ends):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not remembered yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.MEMORY:
            self.known.clear()
            new = list(pieces)
        words = [[] if p in self.added else self.words_of(p) for p in new]
        distinct = list({w for found in words for w in found})
        ids = dict(zip(distinct, self.ids_of(distinct)))
        for piece, found in zip(new, words):
            tokens = [self.added[piece]] if piece in self.added else [i for w in found for i in ids[w]]
            self.known[piece] = (
                len(tokens), " ".join(map(str, tokens)), " ".join([self.names[i] for i in tokens])
            )

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(tokens, SHA-256 of the ids joined by spaces, SHA-256 of the decoded text)."""
        for found in self.found(texts):
            counts, ids, decoded = zip(*found) if found else ((), (), ())
            yield (
                sum(counts),
                hashlib.sha256(" ".join(ids).encode()).hexdigest(),
                hashlib.sha256(" ".join(decoded).encode()).hexdigest(),
            )

    def found(self, texts: list[str | None], most: int = 1 << 20) -> Iterator[list[tuple[int, str, str]]]:
        """What is remembered of each text's pieces, without the empty ones.

        Texts of about ``most`` characters are cut at once, or a longer one alone.
        """
        ends = np.cumsum([len(t or "") for t in texts]) // most
        for at, end in runs(ends):
            cuts = [self.cut(t) for t in texts[at:end]]
            self.learn(set().union(*cuts))
            known = self.known
            for pieces in cuts:
                yield [e for e in map(known.__getitem__, pieces) if e[0]]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for e in found for i in e[1].split(" ")] for found in self.found(texts)]

    def decode(self, ids: list[int]) -> str:
        """Token names joined by spaces: these files name no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_LOADED: dict[int, WordBpe] = {}


def loaded(source: str) -> WordBpe:
    """One encoder for each file and Python worker."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(source)
    return _LOADED[key]


def encode_texts(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each document.

    ``tokenizer`` is the path of a vocabulary file; it is read on the driver and sent to
    the executors as it is (a few MB, fixed). A null text counts as empty: no tokens, and
    both digests those of the empty string. Texts of any length are encoded whole, special
    tokens in a text become their ids, repeated rows stay repeated. No shuffle.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(source.value)
        for part in parts:
            n, ids, decoded = zip(*bpe.digests(list(part["text"]))) if len(part) else ((), (), ())
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}
            )

    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_ids(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded): the tokens themselves; cases as in ``encode_texts``."""
    with open(tokenizer, encoding="utf-8") as file:
        source = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(source.value)
        for part in parts:
            ids = bpe.encode(list(part["text"]))
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"doc_id {kind}, ids array<int>, decoded string")
