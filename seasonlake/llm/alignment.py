"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text, so that copies fall together before anything
is encoded. Each distinct text is encoded by both tokenizers and cut into groups where
tokens of both end at one byte. What it links goes into the pair counts with the text's
multiplicity as weight, and its measures are joined back to the ids of its documents.

Pair counts are gathered by block (a few MB of texts): a pair stands once a block however
often it occurs, so frequent pairs neither swell the shuffle nor heap up in a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasonlake.llm.common import batches
from seasonlake.llm.copies import spread_join
from seasonlake.session import pinned

BLOCK_BYTES = 4 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: code points shown as they are,
    the others numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both token sequences of texts, group by group, remembered by unit.

    A unit begins at a blank that follows another character than a blank and precedes a
    character that is no white space. Neither tokenizer has a token across such a place:
    the byte-level pre-tokenizer gives the last blank to the word behind it, and no piece
    of the other has a blank behind another character (checked when it is loaded). So a
    group ends there and a unit's groups are the same wherever it stands. Units are kept
    without their first blank.
    """

    MEMORY = 300_000
    LONGEST = 64
    WIDE = 4096
    TWO_31 = 1 << 31
    ODD = re.compile(r" (?:\s|\Z)")
    CUT = re.compile(r"(?<=[^ ])(?= \S)")

    def __init__(self, vocabulary: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_str(vocabulary)
        self.first.encode_special_tokens = True
        letters = byte_letters()
        first = {i: bytes(letters[c] for c in token) for token, i in self.first.get_vocab(with_added_tokens=False).items()}
        self.first_bytes = [first.get(i, b"") for i in range(max(first) + 1)]
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank behind another character")
        self.width = len(pieces)
        self.second_bytes = [
            bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.first_sizes, self.second_sizes = (
            np.array([len(b) for b in table], np.int64) for table in (self.first_bytes, self.second_bytes)
        )
        many = max(len(self.first_bytes), self.width)
        self.shown = {end: np.array([f"{i}{end}" for i in range(many)], object) for end in ",|;"}
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []  # of each unit, a semicolon behind every group
        self.odd: set[int] = set()  # units that their tokens do not spell
        self.counts = array("q")  # MEASURES of each unit in turn
        self.pairs, self.links, self.ends = array("q"), array("q"), array("q", [0])

    def units(self, text: str) -> list[str]:
        spaced = " " + text
        if self.ODD.search(spaced):
            return [u[1:] for u in self.CUT.split(spaced)]
        return text.split(" ")

    def spelled(self, data: list[bytes], flat: np.ndarray, sizes: np.ndarray, table: list[bytes], widths: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit, ``sizes`` of them at a time, join to its bytes."""
        ends = np.concatenate([[0], np.cumsum(widths[flat])])[np.cumsum(sizes)]
        right = np.diff(ends, prepend=0) == np.fromiter(map(len, data), np.int64, len(data))
        tokens = list(map(table.__getitem__, flat.tolist()))
        if right.all() and b"".join(tokens) == b"".join(data):
            return right
        stops = np.cumsum(sizes).tolist()
        return np.array([b"".join(tokens[x:y]) == d for x, y, d in zip([0, *stops], stops, data)])

    def learn(self, new: list[str]) -> None:
        """Groups, counts and linked pairs of new units, all at once."""
        spaced = [" " + u for u in new]
        data = list(map(str.encode, spaced))
        first = [e.ids for e in self.first.encode_batch_fast(spaced, add_special_tokens=False)]
        second = self.second.encode(new, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (first, second))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((first, n_a), (second, n_b)))
        right = self.spelled(data, a, n_a, self.first_bytes, self.first_sizes)
        right &= self.spelled(data, b, n_b, self.second_bytes, self.second_sizes)
        start = len(self.groups)
        self.at.update(zip(new, range(start, start + len(new))))
        if not right.all():
            self.odd.update((start + np.flatnonzero(~right)).tolist())
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            n_a, n_b = n_a * right, n_b * right
        # all units in a row: both token sequences spell the same bytes
        ends_a, ends_b = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        cut_a, cut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        many = int(cut_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        unit = np.repeat(np.arange(len(new)), n_a)[cut_a]

        before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + before_b[group_a]] = np.where(cut_a, self.shown["|"][a], self.shown[","][a])
        out[np.arange(len(b)) + (before_a + size_a)[group_b]] = np.where(cut_b, self.shown[";"][b], self.shown[","][b])
        out, ends = out.tolist(), np.cumsum(n_a + n_b).tolist()
        self.groups.extend("".join(out[x:y]) for x, y in zip([0, *ends], ends))

        def per_unit(values: np.ndarray) -> np.ndarray:
            return np.bincount(unit, values, len(new)).astype(np.int64)

        counts = np.stack([n_a, n_b, np.bincount(unit, minlength=len(new)), per_unit(size_a * size_b)], axis=1)
        self.counts.frombytes(counts.tobytes())
        owner, pairs, links = self.linked(a, b, size_a, size_b, unit)
        self.pairs.frombytes(pairs.tobytes())
        self.links.frombytes(links.tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))).tobytes())

    def linked(self, a, b, size_a, size_b, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, links) of the groups; a pair is ``a * width + b``.

        A group of many tokens is counted by distinct ids first.
        """
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        owners, pairs, links = [], [], []
        wide = size_a * size_b > self.WIDE
        for g in np.flatnonzero(wide):
            left, times = np.unique(a[ends_a[g] - size_a[g] : ends_a[g]], return_counts=True)
            right, more = np.unique(b[ends_b[g] - size_b[g] : ends_b[g]], return_counts=True)
            pairs.append((left[:, None] * self.width + right).ravel())
            links.append(np.outer(times, more).ravel())
            owners.append(np.full(len(pairs[-1]), unit[g]))
        group_a = np.repeat(np.arange(len(size_a)), size_a)
        sizes = np.where(wide, 0, size_b)[group_a]
        row = np.repeat(np.arange(len(a)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group = group_a[row]
        pairs.append(a[row] * self.width + b[(ends_b - size_b)[group] + place])
        links.append(np.ones(len(row), np.int64))
        owners.append(unit[group])
        owner, pair, count = map(np.concatenate, (owners, pairs, links))
        key = owner * self.TWO_31 + pair
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(count, heads) if len(heads) else count
        return key[heads] // self.TWO_31, key[heads] % self.TWO_31, total

    def block(self, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
        """Measures of each text, and its distinct pairs as places in the block's pairs.

        A text whose tokens do not spell it, and an empty one, has no tokens at all.
        """
        if len(self.at) > self.MEMORY:
            self.forget()
        cuts = [self.units(t) if t else [] for t in texts]
        new = sorted(set().union(*cuts).difference(self.at), key=len)
        if new:
            self.learn(new)
        found = [list(map(self.at.__getitem__, cut)) for cut in cuts]
        if self.odd:
            found = [ids if self.odd.isdisjoint(ids) else [] for ids in found]
        shown = ("".join(map(self.groups.__getitem__, ids))[:-1] for ids in found)
        sums = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown]
        sizes = np.fromiter(map(len, found), np.int64, len(texts))
        unit = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(texts)), sizes)
        counts = np.array(self.counts, np.int64).reshape(-1, len(MEASURES))
        running = np.zeros((len(unit) + 1, len(MEASURES)), np.int64)
        np.cumsum(counts[unit], axis=0, out=running[1:])
        ends = np.cumsum(sizes)
        measures = running[ends] - running[ends - sizes]

        key, times = np.unique(owner * max(1, len(self.groups)) + unit, return_counts=True)
        owner, unit = np.divmod(key, max(1, len(self.groups)))
        ends = np.array(self.ends, np.int64)
        sizes = ends[unit + 1] - ends[unit]
        row = np.repeat(np.arange(len(unit)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + ends[unit][row]
        pairs, place = np.unique(np.array(self.pairs, np.int64)[at], return_inverse=True)
        key = owner[row] * max(1, len(pairs)) + place
        order = np.argsort(key, kind="stable")
        key, links = key[order], (np.array(self.links, np.int64)[at] * times[row])[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        links = np.add.reduceat(links, heads) if len(heads) else links
        owner, spots = np.divmod(key[heads], max(1, len(pairs)))
        self.drop(new[len(new) - sum(len(u) > self.LONGEST for u in new) :])
        return {
            "measures": measures, "sums": sums, "a": pairs // self.width, "b": pairs % self.width,
            "owner": owner, "spots": spots, "links": links,
        }

    def drop(self, last: list[str]) -> None:
        """Forget the units that were learnt last."""
        if not last:
            return
        for u in last:
            del self.at[u]
        keep = len(self.groups) - len(last)
        self.odd = {i for i in self.odd if i < keep}
        del self.groups[keep:], self.counts[keep * len(MEASURES) :], self.ends[keep + 1 :]
        del self.pairs[self.ends[-1] :], self.links[self.ends[-1] :]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest type, its size in front."""
    size = next(s for s in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << (8 * s - (s == 8)))
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


ALIGNED = pa.schema(
    [("block", pa.binary()), ("spot", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("holding", pa.int64()),
     ("digest", pa.binary()), ("copies", pa.int64()), *[(m, pa.int64()) for m in MEASURES],
     ("groups_sha256", pa.string()), ("spots", pa.binary()), ("links", pa.binary())]
)
ALIGNED_SQL = (
    "block binary, spot long, a int, b int, holding long, digest binary, copies long, n_a long, n_b long, "
    "n_groups long, n_links long, groups_sha256 string, spots binary, links binary"
)


def rows_of(columns: dict, size: int) -> pa.RecordBatch:
    """A batch of ``ALIGNED`` in which the columns that are not given are null."""
    made = [
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in ALIGNED
    ]
    return pa.RecordBatch.from_arrays(made, schema=ALIGNED)


def aligned_rows(aligner: Aligner, texts: list[str], copies: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block as rows: one for each text, then one for each pair that it holds."""
    found = aligner.block(texts)
    digests = [hashlib.sha256(t.encode()).digest() for t in texts]
    cut = np.searchsorted(found["owner"], np.arange(len(texts) + 1))
    spots, links = [], []
    for start, end in zip(cut[:-1].tolist(), cut[1:].tolist()):
        spots.append(packed(np.diff(found["spots"][start:end], prepend=0)))
        links.append(packed(found["links"][start:end]))
    measures = {m: found["measures"][:, i] for i, m in enumerate(MEASURES)}
    yield rows_of(
        {"block": [digests[0]] * len(texts), "digest": digests, "copies": copies, **measures,
         "groups_sha256": found["sums"], "spots": spots, "links": links},
        len(texts),
    )
    size = len(found["a"])
    order = np.argsort(found["spots"], kind="stable")
    heads = np.searchsorted(found["spots"][order], np.arange(size))
    holding = np.add.reduceat(copies[found["owner"]][order], heads) if size else copies[:0]
    yield rows_of(
        {"block": [digests[0]] * size, "spot": np.arange(size), "a": found["a"], "b": found["b"], "holding": holding}, size
    )


def weigh(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Each text of a block with its best links and the sum of their counts."""
    order = np.argsort(pairs["spot"].to_numpy())
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    n_best, sums = [], []
    for spots, links in zip(texts["spots"].to_pylist(), texts["links"].to_pylist()):
        at, times = np.cumsum(unpacked(spots)), unpacked(links)
        n_best.append(int((times * best[at]).sum()))
        sums.append(int((times * count[at]).sum()))
    out = texts.select(["digest", "copies", *MEASURES, "groups_sha256"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


WEIGHED = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_best long, count_sum long"
)


def align_texts(documents: DataFrame, vocabulary: str, model: str, text: str = "text") -> DataFrame:
    """Blocks of distinct texts as rows of ``ALIGNED``, stored.

    A row with ``digest`` is a text: copies, measures, and its pairs as places in the
    block. A row with ``spot`` is a pair of the block: ids and documents that hold it.
    """
    with open(vocabulary, encoding="utf-8") as file, open(model, "rb") as other:
        files = documents.sparkSession.sparkContext.broadcast((file.read(), other.read()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        for part in parts:
            for some in batches(part, BLOCK_BYTES, "text"):
                copies = some.column("copies").to_numpy(zero_copy_only=False)
                yield from aligned_rows(aligner, some.column("text").to_pylist(), copies)

    body = documents.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    distinct = body.groupBy("text").agg(F.count("*").alias("copies"))
    return pinned(distinct.mapInArrow(run, ALIGNED_SQL))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold a linked pair, and whether no other b has
    more for this a. The list of highest counts has a row an id at most, as many as the
    vocabulary has, and is broadcast."""
    pairs = aligned.where("spot IS NOT NULL").groupBy("a", "b").agg(F.sum("holding").alias("count"))
    pairs = pinned(pairs)
    highest = pairs.groupBy("a").agg(F.max("count").alias("highest"))
    return pairs.join(F.broadcast(highest), "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")
    )


def align(documents: DataFrame, vocabulary: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) a document.

    ``vocabulary`` is a byte-level file of the tokenizers library (A, given a blank and
    the text), ``model`` a sentencepiece model that adds the blank itself (B); both are
    read on the driver and sent out as they are. Special tokens in a text are plain text.
    A null or empty text, and one that either tokenizer does not spell byte by byte, has
    zeros and an empty digest. Repeated rows and ids and null ids stay as they are; an
    empty table gives no rows; other columns are ignored. A text is one row at a time
    whatever its length.
    """
    aligned = align_texts(documents, vocabulary, model, text)
    counts = pair_counts(aligned)
    pairs = aligned.where("spot IS NOT NULL").select(F.col("block").alias("home"), "spot", "a", "b").join(counts, ["a", "b"])
    texts = aligned.where("digest IS NOT NULL").select(
        "block", "digest", "copies", *MEASURES, "groups_sha256", "spots", "links"
    )
    weighed = texts.groupBy("block").cogroup(pairs.select("home", "spot", "count", "best").groupBy("home"))
    measures = pinned(weighed.applyInArrow(weigh, WEIGHED))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    rows = documents.select(F.col(key).alias("doc_id"), digest.alias("digest"))
    return spread_join(rows, measures, "digest", "copies").select(
        "doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256"
    )
