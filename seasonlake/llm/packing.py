"""Pack token pieces into sequences by a configuration linear program over their lengths.

Only the histogram of piece lengths, at most ``capacity`` numbers, comes to the driver. A
configuration is a multiset of lengths that fits one sequence. Multiplicative weights
price the lengths: each round a knapsack over the capacity finds the configuration of the
largest weight, it is taken as often as its scarcest length allows, and the weights of
what it covers fall exponentially with the share covered. The fractional counts are
rounded down and the rest goes best-fit, longest first, into the space that is left.

The result is a plan of groups of equal sequences, again bounded by the histogram. Pieces
of one length are numbered over the whole table and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasonlake.llm.alignment import byte_letters
from seasonlake.llm.common import spread
from seasonlake.session import pinned

PIECES = "piece int, start long, length long, ids_crc32 long"


class UnitTokenizer:
    """Token ids of whole texts by the tokenizers library, remembered by unit.

    A byte-level pre-tokenizer never joins visible characters with white space after
    them, so white space and the word behind it are encoded alike wherever they stand.
    Where blanks stand alone a text is cut at blanks, and the words behind them are
    remembered in ``spaced``; other texts are cut into runs, remembered in ``plain``.

    A file whose merges are in the order of their ids is a table of ranks, which tiktoken
    merges to the same ids, faster. It takes the texts of code points below U+0250, whose
    character classes are the same in every Unicode version; any other text, and one that
    holds an added token, goes by units.
    """

    LATER = re.compile("[^\x00-\u024f]")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    MEMORY = 800_000
    LONGEST = 64
    BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    UNIT = regex.compile(r"\s*\S+|\s+")

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(source)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes | None] = {}
        self.ranked = self.by_ranks(json.loads(source))

    def by_ranks(self, file: dict) -> tiktoken.Encoding | None:
        """The same merges as a table of ranks, if the file is a plain byte-level one."""
        letters = byte_letters()
        vocab = file["model"].get("vocab", {})
        merges = [m if isinstance(m, str) else " ".join(m) for m in file["model"].get("merges", [])]
        made = [vocab.get(m.replace(" ", ""), -1) for m in merges]
        added = {t["content"] for t in file.get("added_tokens", [])}
        plain = file.get("normalizer") is None and (file.get("pre_tokenizer") or {}) == self.BYTE_LEVEL
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added and set(t) <= letters.keys()}
        singles = all(bytes([b]) in ranks for b in range(256)) and max([ranks[bytes([b])] for b in range(256)]) < min(made, default=0)
        if not plain or not singles or made != sorted(set(made)) or len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_of(self, units: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def learn_spaced(self, words: set[str]) -> dict[str, bytes]:
        """Encode what stands behind a blank; long words are returned and not kept.

        A word that is empty or ends in white space is not cut off rightly by its blank:
        it is remembered as None.
        """
        known = self.spaced
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.MEMORY:
            known.clear()
            new = list(words)
        # a stop behind a letter is always a token of its own
        stem = [w[:-1] if len(w) > 1 and w[-1] in ".," and w[-2].isalpha() else w for w in new]
        wanted = list(dict.fromkeys(s for s in stem if s not in known and s and not s[-1].isspace()))
        fresh = dict(zip(wanted, self.ids_of([" " + s for s in wanted])))
        stops = dict(zip(".,", self.ids_of([".", ","])))
        long: dict[str, bytes] = {}
        for word, base in zip(new, stem):
            ids = fresh[base] if base in fresh else known.get(base)
            if ids is not None and base is not word:
                ids += stops[word[-1]]
            (known if len(word) <= self.LONGEST else long)[word] = ids
        return long

    def by_runs(self, text: str) -> bytes:
        if any(mark in text for mark in self.added):
            return self.ids_of([text])[0]
        units = self.UNIT.findall(text)
        new = list({u for u in units if u not in self.plain})
        fresh = dict(zip(new, self.ids_of(new)))
        out = b"".join([fresh[u] if u in fresh else self.plain[u] for u in units])
        if len(self.plain) + len(new) > self.MEMORY // 4:
            self.plain.clear()
        self.plain.update((u, i) for u, i in fresh.items() if len(u) <= self.LONGEST)
        return out

    def encode(self, texts: list[str | None], group: int = 500) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        ranked = self.ranked
        for at in range(0, len(texts), group):
            some = [t or "" for t in texts[at : at + group]]
            if ranked is None:
                yield from self.by_units(some)
                continue
            rest = [t for t in some if self.LATER.search(t) or any(mark in t for mark in self.added)]
            others = self.by_units(rest)
            waiting = set(rest)
            for text in some:
                yield next(others) if text in waiting else array("I", ranked.encode_ordinary(text)).tobytes()

    def by_units(self, texts: list[str], group: int = 500) -> Iterator[bytes]:
        for at in range(0, len(texts), group):
            cuts = [t.split(" ") for t in texts[at : at + group]]
            heads = [c.pop(0) for c in cuts]
            long = self.learn_spaced(set().union(*cuts))
            known = self.spaced | long if long else self.spaced
            for text, head, words in zip(texts[at : at + group], heads, cuts):
                ids = list(map(known.__getitem__, words))
                odd = None in ids or (head[-1:].isspace() and words) or any(mark in text for mark in self.added if text)
                yield self.by_runs(text) if odd else self.by_runs(head) + b"".join(ids)


def token_pieces(
    documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut where they are too long.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Beyond
    ``capacity`` it is cut into full pieces, of which only the first may be shorter.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = documents.sparkSession.sparkContext.broadcast(file.read())

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = UnitTokenizer(source.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        for part in parts:
            rows = []
            for doc, ids in zip(part["doc_id"], encoder.encode(list(part["text"]))):
                ids += end
                total, at, n = len(ids) // 4, 0, 0
                while at < total:
                    size = (total - 1) % capacity + 1 if n == 0 else capacity
                    rows.append((doc, n, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at, n = at + size, n + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": part["doc_id"].dtype}) if len(part) else out

    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(cut, f"doc_id {kind}, {PIECES}")


def best_configuration(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths within ``capacity`` of the largest total weight.

    Unbounded knapsack by dynamic programming over the space used.
    """
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for space in range(1, capacity + 1):
        n = upto[space]
        value[space] = value[space - 1]
        if n:
            sums = value[space - lengths[:n]] + weights[:n]
            best = int(sums.argmax())
            if sums[best] > value[space]:
                value[space], taken[space] = sums[best], best
    chosen: Counter = Counter()
    space = capacity
    while space > 0:
        if taken[space] < 0:
            space -= 1
        else:
            chosen[int(lengths[taken[space]])] += 1
            space -= int(lengths[taken[space]])
    return chosen


def solve_configurations(
    histogram: dict[int, int], capacity: int, rounds: int = 300, rate: float = 0.5
) -> list[tuple[Counter, float]]:
    """Fractional configurations by multiplicative weights, in the order they were priced.

    Lengths that no second piece can join are left to the rounding. The first prices are
    the lengths themselves, which are the exact prices where no space is wasted.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    if not len(lengths):
        return []
    place = {n: i for i, n in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    out: list[tuple[Counter, float]] = []
    for _ in range(rounds):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        prices = lengths / capacity * np.exp(-rate * covered)
        chosen = best_configuration(lengths[open_], prices[open_], capacity)
        at = np.array([place[n] for n in chosen])
        many = np.array(list(chosen.values()), dtype=float)
        times = float((counts[at] * (1 - covered[at]) / many).min())
        covered[at] += times * many / counts[at]
        out.append((chosen, times))
    return out


@dataclass
class Group:
    """``bins`` equal sequences; ``content`` lists (length, how many) in order of place."""

    bins: int
    content: tuple[tuple[int, int], ...]


def plan_groups(histogram: dict[int, int], capacity: int, rounds: int = 300) -> list[Group]:
    """The plan of fewest sequences among those that keep all, half, ... or none of the
    priced configurations, in their order, and place the rest best-fit.

    The first configurations waste least; late ones are priced on what is left over and
    may leave lengths that best-fit cannot join. Without any the plan is best-fit alone,
    so the configurations never cost a sequence.
    """
    solved = solve_configurations({int(n): int(c) for n, c in histogram.items() if c}, capacity, rounds)
    cuts = [len(solved) >> k for k in range(len(solved).bit_length() + 1)]
    plans = [rounded(histogram, capacity, solved[:cut]) for cut in cuts]
    return min(plans, key=lambda plan: sum(g.bins for g in plan), default=[])


def rounded(histogram: dict[int, int], capacity: int, solved: list[tuple[Counter, float]]) -> list[Group]:
    """Whole sequences: configurations rounded down, the rest best-fit, longest first."""
    left = Counter({int(n): int(c) for n, c in histogram.items() if c})
    by_free: dict[int, list[Group]] = {}
    frees: list[int] = []

    def put(free: int, group: Group) -> None:
        if free not in by_free:
            by_free[free] = []
            bisect.insort(frees, free)
        by_free[free].append(group)

    for chosen, times in solved:
        whole = min(int(times + 1e-6), *(left[n] // k for n, k in chosen.items()))
        if whole:
            left.subtract({n: k * whole for n, k in chosen.items()})
            put(
                capacity - sum(n * k for n, k in chosen.items()),
                Group(whole, tuple(sorted(chosen.items(), reverse=True))),
            )
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                put(capacity, Group(-(-todo // each), ()))
                continue
            free = frees[at]
            group = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], frees[at]
            each = free // length
            full, odd = min(group.bins, todo // each), 0
            if full:
                put(free - each * length, Group(full, group.content + ((length, each),)))
            elif todo < each:
                odd = todo
                put(free - odd * length, Group(1, group.content + ((length, odd),)))
            todo -= full * each + odd
            rest = group.bins - full - (1 if odd else 0)
            if rest:
                put(free, Group(rest, group.content))
    return [g for groups in by_free.values() for g in groups if g.content]


def slots(groups: list[Group]) -> pd.DataFrame:
    """Where the pieces of each length go, in order of their number: one row per run."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for g in groups:
        place = 0
        for length, each in g.content:
            rows.append((length, used[length], sequence, each, place))
            used[length] += g.bins * each
            place += length * each
        sequence += g.bins
    out = pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "place"], dtype="int64")
    return out.sort_values(["length", "first"], ignore_index=True)


def numbered(pieces: DataFrame, salts: int) -> DataFrame:
    """Add ``number``: 0, 1, ... among the pieces of one length, over all partitions.

    A length may hold most of the pieces, so it is ordered in ``salts`` parts by a hash
    and the counts of the earlier parts are added.
    """
    salted = pieces.withColumn("salt", spread(F.struct("doc_id", "piece", "start"), salts))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        salted.groupBy("length", "salt").count()
        .select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("number", F.row_number().over(inside) - 1)
        .join(counts, ["length", "salt"])
        .withColumn("number", F.col("number") + F.col("before")).drop("before", "salt")
    )


def pack(
    documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
    key: str = "doc_id", text: str = "text", rounds: int = 300,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Sequences are filled from place 0 without gaps and never over ``capacity``; every
    piece of every document is placed once. Null and empty texts are one token long;
    repeated rows are packed as often as they occur; equal pieces are interchangeable, so
    ties do not matter; an empty table gives no rows; other columns are not read.
    """
    pieces = pinned(token_pieces(documents, tokenizer, capacity, end_id, key, text))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = slots(plan_groups(histogram, capacity, rounds))
    keys = (plan["length"].to_numpy() << 40) + plan["first"].to_numpy()
    table = {c: plan[c].to_numpy() for c in plan.columns}

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            number = part.pop("number").to_numpy()
            length = part["length"].to_numpy()
            row = np.searchsorted(keys, (length << 40) + number, side="right") - 1
            behind = number - table["first"][row]
            each = table["each"][row]
            yield part.assign(
                sequence_id=table["sequence"][row] + behind // each,
                offset=table["place"][row] + behind % each * length,
            )

    salts = max(16, sum(histogram.values()) // 50_000)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered(pieces, salts).select("doc_id", *[p.split()[0] for p in PIECES.split(", ")], "number").mapInPandas(
        place, f"doc_id {kind}, {PIECES}, sequence_id long, offset long"
    )
