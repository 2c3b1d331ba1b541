"""Personal data in texts: fixed patterns, and a character model that adds spans.

The model is a bidirectional LSTM over character classes with a CRF on top, written and
trained in numpy. Its labelled spans are the pattern matches of a bounded sample, together
with the same matches written another way (a phone without its plus, an address with its
at sign spelled out), so that it learns the surroundings and shapes the patterns miss.

A text is read in overlapping windows around what every span must hold by its kind's shape:
a digit, an at sign or a spelled at; elsewhere no span can be. Windows are decoded together, and their spans are
reconciled over the whole text: a span cut by its window's edge gives way, then of two that
overlap the one deeper inside its window stays. Pattern spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlake.llm.common import batches

#: Bytes of documents that a worker reads at a time.
RUN_BYTES = 1 << 20
#: The kinds and patterns are fixed by the contract of the query.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match never starts inside a run of digits: the run's own start is tried first
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGITS = re.compile(r"[0-9]")
#: Runs in which a match may start and end, tried before the patterns. No pattern crosses
#: a run, so a match inside a run is the match the whole text gives.
EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fits(kind: str, text: str) -> bool:
    digits = "".join(DIGITS.findall(text)) if kind in ("card", "phone") else ""
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """Pattern matches that fit, leftmost and not overlapping within a kind, by start."""
    found: list[Span] = []
    has_digit = DIGITS.search(text) is not None
    if "@" in text:
        # an address lies inside one run of its characters, which keeps the search linear
        for run in EMAIL_RUN.finditer(text):
            if "@" in run[0]:
                found += [
                    (run.start() + m.start(), run.start() + m.end(), "email")
                    for m in PATTERNS["email"].finditer(run[0])
                ]
    if has_digit:
        for kind in ("ip", "card", "phone"):
            if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
                continue
            found += [(m.start(), m.end(), kind) for m in PATTERNS[kind].finditer(text) if fits(kind, m[0])]
    return sorted(found, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the model -------------------------------------------------------------------------

#: Character classes: a-z without case, digits and a few signs stand for themselves.
SIGNS = "@.+-() \n:,;/_#%"
DIGIT = 3 + len(SIGNS)
LETTER = DIGIT + 10
CLASSES = LETTER + 26
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE, MARGIN = 96, 48, 32


def class_table() -> np.ndarray:
    """Class of each code point below 128; all others are letters of class 1."""
    table = np.full(128, 2, dtype=np.uint8)
    for c in range(128):
        if chr(c).isalpha():
            table[c] = LETTER + ord(chr(c).lower()) - ord("a")
        elif chr(c).isdigit():
            table[c] = DIGIT + int(chr(c))
        elif chr(c) in SIGNS:
            table[c] = 3 + SIGNS.index(chr(c))
    return table


TABLE = class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, TABLE[np.minimum(points, 127)], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over windows: (windows, steps) classes to (windows, steps, hidden)."""

    def __init__(self, rng: np.random.Generator | None, hidden: int):
        self.hidden = hidden
        if rng is not None:
            self.x = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.h = rng.normal(0, 0.2, (hidden, 4 * hidden))
            self.x[:, hidden : 2 * hidden] += 1.0  # remember at first

    def run(self, codes: np.ndarray, keep: bool = False):
        n, steps = codes.shape
        k = self.hidden
        h, c = np.zeros((n, k), self.x.dtype), np.zeros((n, k), self.x.dtype)
        out = np.empty((steps, n, k), self.x.dtype)
        trace = []
        for t in range(steps):
            z = self.x[codes[:, t]] + h @ self.h
            gates = sigmoid(z[:, : 3 * k])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                trace.append((before, i, f, o, g, tc))
        return (out, trace) if keep else out

    def back(self, codes: np.ndarray, trace: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gx, gh = np.zeros_like(self.x), np.zeros_like(self.h)
        dh = dc = 0.0
        for t in range(codes.shape[1] - 1, -1, -1):
            (h, c), i, f, o, g, tc = trace[t]
            dh = dh + grads[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
            )
            np.add.at(gx, codes[:, t], dz)
            gh += h.T @ dz
            dh, dc = dz @ self.h.T, dc * f
        return gx, gh


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: inside follows its kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


@dataclass
class Tagger:
    """Both directions, a layer of tag scores and the CRF's transitions."""

    left: Lstm
    right: Lstm
    top: np.ndarray
    moves: np.ndarray

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        return cls(Lstm(rng, hidden), Lstm(rng, hidden), rng.normal(0, 0.2, (2 * hidden + 1, TAGS)), np.zeros((TAGS, TAGS)))

    def parameters(self) -> list[np.ndarray]:
        return [self.left.x, self.left.h, self.right.x, self.right.h, self.top, self.moves]

    def single(self) -> Tagger:
        """A copy in 32-bit numbers for decoding."""
        sides = []
        for side in (self.left, self.right):
            new = Lstm(None, side.hidden)
            new.x, new.h = side.x.astype(np.float32), side.h.astype(np.float32)
            sides.append(new)
        return Tagger(*sides, self.top.astype(np.float32), (self.moves + allowed()).astype(np.float32))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of each window by Viterbi; ``single()`` has the bans in ``moves``."""
        n, steps = codes.shape
        scores = self.left.run(codes) @ self.top[: self.left.hidden]
        scores += self.right.run(codes[:, ::-1])[::-1] @ self.top[self.left.hidden : -1]
        scores += self.top[-1]
        best = scores[0].copy()
        best[:, 2::2] -= 1e4
        back = np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + self.moves
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-likelihood of ``tags``."""
        n, steps = codes.shape
        k = self.left.hidden
        lo, lt = self.left.run(codes, keep=True)
        ro, rt = self.right.run(codes[:, ::-1], keep=True)
        both = np.concatenate([lo, ro[::-1], np.ones((steps, n, 1))], axis=2)
        scores = both @ self.top
        moves = self.moves + allowed()
        first = np.zeros(TAGS)
        first[2::2] = -1e4

        def logsum(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead = np.empty((steps, n, TAGS))
        ahead[0] = scores[0] + first
        for t in range(1, steps):
            ahead[t] = logsum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
        total = logsum(ahead[-1], 1)
        behind = np.zeros((n, TAGS))
        dscores, dmoves = np.empty_like(scores), np.zeros_like(moves)
        row = np.arange(n)
        for t in range(steps - 1, -1, -1):
            dscores[t] = np.exp(np.minimum(ahead[t] + behind - total[:, None], 0))
            dscores[t][row, tags[:, t]] -= 1
            if t:
                inner = scores[t] + behind
                joint = ahead[t - 1][:, :, None] + moves + inner[:, None, :] - total[:, None, None]
                dmoves += np.exp(np.minimum(joint, 0)).sum(axis=0)
                np.add.at(dmoves, (tags[:, t - 1], tags[:, t]), -1)
                behind = logsum(moves[None] + inner[:, None, :], 2)
        dscores /= n
        dtop = np.einsum("tnh,tnk->hk", both, dscores)
        dboth = dscores @ self.top.T
        lx, lh = self.left.back(codes, lt, dboth[:, :, :k])
        rx, rh = self.right.back(codes[:, ::-1], rt, dboth[::-1, :, k : 2 * k])
        return [lx, lh, rx, rh, dtop, dmoves / n]


def train(codes: np.ndarray, tags: np.ndarray, hidden: int = 12, steps: int = 800, batch: int = 32, seed: int = 3) -> Tagger:
    """Adam over labelled windows, as many steps for any number of them; without any
    window the model finds nothing."""
    tagger = Tagger.fresh(hidden, seed)
    if not len(codes):
        tagger.top[:] = 0
        tagger.top[-1, 0] = 10
        return tagger
    rng = np.random.default_rng(seed)
    parameters = tagger.parameters()
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    order = np.concatenate([rng.permutation(len(codes)) for _ in range(-(-steps * batch // len(codes)))])
    for step in range(1, steps + 1):
        some = order[(step - 1) * batch : step * batch]
        for p, g, m, v in zip(parameters, tagger.gradients(codes[some], tags[some]), first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


#: What stands for the signs of an address that is spelled out.
SPELLED = (" at ", " dot ")


def window_starts(codes: np.ndarray) -> list[int]:
    """Starts of the windows that cover every digit and at sign, and at and dot where they
    are spelled out, with a margin.

    Starts are multiples of the stride, so windows overlap by half and neighbours agree.
    """
    hot = (codes == 3 + SIGNS.index("@")) | ((codes >= DIGIT) & (codes < LETTER))
    for word in SPELLED:
        n = len(codes) - len(word) + 1
        if n > 0:
            hot[:n] |= np.logical_and.reduce([codes[i : i + n] == c for i, c in enumerate(classes(word))])
    marks = np.flatnonzero(hot)
    if not len(marks):
        return []
    low = np.maximum(0, (marks - MARGIN) // STRIDE - 1)
    high = (marks + MARGIN) // STRIDE
    last = max(0, (len(codes) - 1) // STRIDE)
    steps = np.unique(np.concatenate([np.minimum(low + i, high) for i in range(int((high - low).max()) + 1)]))
    return (steps[steps <= last] * STRIDE).tolist()


def windows(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), dtype=np.int64)
    for i, s in enumerate(starts):
        part = codes[s : s + WINDOW]
        out[i, : len(part)] = part
    return out


def tag_array(size: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(size, dtype=np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def other_spellings(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with phones bare of their plus and addresses with at and dot spelled."""
    out, moved, at = [], [], 0
    size = 0
    for a, b, kind in spans:
        if a < at:
            continue
        piece = text[a:b]
        if kind == "phone":
            piece = re.sub(r"^\+\d{1,2}[\x20.-]?", "", piece)
        elif kind == "email":
            piece = piece.replace("@", " at ").replace(".", " dot ")
        out.append(text[at:a])
        size += a - at
        moved.append((size, size + len(piece), kind))
        out.append(piece)
        size += len(piece)
        at = b
    return "".join(out) + text[at:], moved


def labelled_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of sample texts, as they are and in other spellings."""
    codes, tags = [np.zeros((0, WINDOW), np.int64)], [np.zeros((0, WINDOW), np.int64)]
    for text in texts:
        spans: list[Span] = []
        for s in sorted(base_spans(text), key=lambda s: (s[0], s[0] - s[1])):
            if not spans or s[0] >= spans[-1][1]:
                spans.append(s)
        for t, found in ((text, spans), other_spellings(text, spans)):
            c = classes(t)
            starts = window_starts(c)
            if starts:
                codes.append(windows(c, starts))
                tags.append(windows(tag_array(len(c), found), starts))
    codes, tags = np.concatenate(codes), np.concatenate(tags)
    # a span that began before the window is not a whole one
    for k in range(len(KINDS)):
        cut = tags[:, 0] == 2 + 2 * k
        tags[cut, 0] = 1 + 2 * k
    return codes, tags


SHAPES = {
    "email": re.compile(r"[^\s@]+(@| at )[^\s@]+((\.| dot )[^\s@.]+)+"),
    "ip": re.compile(r"[0-9]{1,3}([.,][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9][0-9\x20.-]*[0-9]"),
    "phone": re.compile(r"[+(]?[0-9][\x20().0-9/-]+[0-9]"),
}


def plausible(kind: str, text: str, before: str, behind: str) -> bool:
    """What a span of the model must be: a whole token of the kind's shape and size."""
    if before.isalnum() or behind.isalnum() or not SHAPES[kind].fullmatch(text):
        return False
    digits = len(DIGITS.findall(text))
    least, most = {"email": (0, len(text)), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}[kind]
    return least <= digits <= most


def model_spans(texts: list[str], tagger: Tagger, most_windows: int = 2048) -> list[list[Span]]:
    """Spans of every text after reconciling its overlapping windows."""
    codes = [classes(t) for t in texts]
    places = [(i, s) for i, c in enumerate(codes) for s in window_starts(c)]
    found: list[list[tuple[int, int, Span]]] = [[] for _ in texts]
    for at in range(0, len(places), most_windows):
        some = places[at : at + most_windows]
        block = np.concatenate([windows(codes[i], [s]) for i, s in some])
        tags = tagger.decode(block)
        for row in np.flatnonzero((tags > 0).any(axis=1)).tolist():
            i, start = some[row]
            line = tags[row]
            begins = np.flatnonzero(line % 2 == 1)
            for a in begins.tolist():
                b = a + 1
                while b < WINDOW and line[b] == line[a] + 1:
                    b += 1
                end = min(start + b, len(texts[i]))
                cut = (a == 0 and start > 0) or (b == WINDOW and end < len(texts[i]))
                depth = min(a if start else WINDOW, WINDOW - b if start + WINDOW < len(texts[i]) else WINDOW)
                found[i].append((cut, -depth, (start + a, end, KINDS[(int(line[a]) - 1) // 2])))
    out = []
    for text, spans in zip(texts, found):
        chosen: list[Span] = []
        for cut, _, (a, b, kind) in sorted(spans):
            piece = text[a:b].strip()
            a += len(text[a:b]) - len(text[a:b].lstrip())
            b = a + len(piece)
            whole = not cut and plausible(kind, piece, text[a - 1 : a] if a else "", text[b : b + 1])
            if whole and all(b <= x or a >= y for x, y, _ in chosen):
                chosen.append((a, b, kind))
        out.append(chosen)
    return out


def all_spans(text: str, base: list[Span], added: list[Span]) -> list[Span]:
    """Pattern spans, and the model's where they touch none of them."""
    free = [s for s in added if all(s[1] <= a or s[0] >= b for a, b, _ in base)]
    return sorted([*base, *free], key=order)


def fitted(documents: DataFrame, train_rows: int = 200) -> Tagger:
    """Train on the ``train_rows`` texts with a digit or at sign that come first by hash.

    The sample is chosen by hashes alone; only its own texts come to the driver.
    """
    hot = documents.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("hash"))
    first = [r["hash"] for r in hot.select("hash").distinct().orderBy("hash").limit(train_rows).collect()]
    texts = sorted({r["text"] for r in hot.where(F.col("hash").isin(first)).select("text").distinct().collect()})
    return train(*labelled_windows(texts))


def find_pii(
    documents: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = 200
) -> DataFrame:
    """(row, base, spans, masked) for each document, its columns in ``row``.

    ``base`` and ``spans`` list (start, end, kind) by start, in code points with the end
    exclusive; ``masked`` is the text with every span replaced by its kind in brackets,
    overlapping spans by the first. Null and empty texts have no spans and stay as they
    are. Texts are read whole; repeated rows get equal results; with no text to learn
    from the model adds nothing; the sample's size is bounded by ``train_rows``.
    """
    tagger = fitted(documents.select(F.col(text).alias("text")), train_rows).single()
    sent = documents.sparkSession.sparkContext.broadcast(tagger)
    narrow = documents.select(F.struct(*documents.columns).alias("row"))
    kind, place = narrow.schema["row"].dataType.simpleString(), documents.columns.index(text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        # a part is read in runs of bounded text, so that no worker holds more than a run
        for part in (run for whole in parts for run in batches(whole, RUN_BYTES, "row")):
            given = part.column("row").field(place).to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) for t in texts]
            every = [all_spans(*found) for found in zip(texts, base, model_spans(texts, model))]
            lists = [
                pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in found] for found in column], span)
                for column in (base, every)
            ]
            masked = [mask(t, found) if found else t for t, found in zip(given, every)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *lists, pa.array(masked, pa.string())], ["row", "base", "spans", "masked"]
            )

    items = "array<struct<start: int, end: int, kind: string>>"
    return narrow.mapInArrow(run, f"row {kind}, base {items}, spans {items}, masked string")


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = 200) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts of the pattern
    spans, the digest of their list, and the list of all spans as text."""
    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = find_pii(narrow, "doc_id", "text", train_rows)

    def listed(column: str) -> Column:
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(column, one), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), *map(count, KINDS),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )
