"""Near-duplicate texts: Jaccard join on word shingles by parity sketches.

A set of s shingles and one of b can only reach the similarity if they differ in at most
D = (s + b) * (1 - t) / (1 + t) shingles. Sizes fall into bands that double; in a band
every shingle has a place in a long bit sketch and flips its bit, so the Hamming distance
of two sketches never exceeds the symmetric difference of the sets. The sketch is cut into
more parts than D: two sets within reach agree on a whole part. Parts are long (a shingle's
place has 64 bits), so they are kept as the XOR of the places set in them.

Of the parts that are not empty a set needs to offer only its D + 1 first ones in a common
random order: at most D of them can be wrong before the first one both sets share. With
``slack`` more, two sets within reach share that many more. A set close to the top of its
band also offers parts of the next band, where its larger partners are. Parts meet by hash; sets that share one become candidates and are verified on their
whole shingle sets, so every returned link is exact and, unless 64-bit hashes collide, no
link is lost.

Equal sets are one node. A part shared by few sets gives its pairs; one shared by many, a
crowd, gives a star to its first set. A set with no more keys in crowds than the slack has
met every partner outside them, so a passage that many documents share costs nothing more.
Of the other sets only those that are still in different components after the links are
compared by sketch, in tiles; a tile gives a forest of the pairs within reach, never the
pairs. Sets that such forests join are verified among themselves, again in tiles that give
a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlake.llm.common import batches, bitmap, may_hold
from seasonlake.llm.components import components
from seasonlake.llm.copies import HOT_SHARES, spread_join
from seasonlake.llm.words import mix, shingle_sets
from seasonlake.session import pinned

BATCH_BYTES = 2 << 20
KEY_BYTES = 6
U64 = np.uint64


class Threshold:
    """``top / base``: the least Jaccard similarity, as a fraction."""

    def __init__(self, top: int, base: int):
        self.top, self.base = top, base

    def largest_partner(self, size: int) -> int:
        return size * self.base // self.top

    def differences(self, size: int, other: int) -> int:
        return (size + other) * (self.base - self.top) // (self.base + self.top)

    def reached(self, shared: int, size: int, other: int) -> bool:
        return self.base * shared >= self.top * (size + other - shared)


def fingerprint(found: np.ndarray) -> int:
    """A set's 64-bit name: a mixed sum over its shingles."""
    total = (mix(found ^ U64(0x5BF03635)).sum(dtype=U64, keepdims=True)) ^ U64(len(found))
    return int(mix(total)[0].astype(np.int64))


def part_keys(found: np.ndarray, band: int, offered: int) -> np.ndarray:
    """The ``offered`` first keys of a set's non-empty sketch parts in ``band``."""
    top = 1 << (band + 1)
    salt = mix(np.array([band + 1], dtype=U64))[0]
    if top <= 64:
        keys = mix(found ^ salt)
    else:
        # enough parts that more than D of a set's parts are filled, with a wide margin
        parts = int(top * (0.5 + 1.6 / top**0.5))
        part = ((found >> U64(32)) * U64(parts)) >> U64(32)  # hashes are sorted, so parts are runs
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        keys = mix(np.bitwise_xor.reduceat(mix(found), begin) ^ mix(part[begin] + salt))
    return np.partition(keys, offered)[:offered] if offered < len(keys) else keys


def slack(size: int) -> int:
    return size // 8


def offered_keys(found: np.ndarray, t: Threshold) -> np.ndarray:
    size = len(found)
    more = 1 + slack(size)
    band = size.bit_length() - 1
    top, partner = 1 << (band + 1), t.largest_partner(size)
    keys = part_keys(found, band, t.differences(size, min(partner, top - 1)) + more)
    if partner >= top:
        keys = np.append(keys, part_keys(found, band + 1, t.differences(size, partner) + more))
    return keys


def sketch(found: np.ndarray) -> bytes:
    """Parity bits of a whole set: 2 to 4 bits for each shingle, a power of two."""
    bits = max(256, 1 << (len(found).bit_length() + 1))
    places = np.bincount((found & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(places.astype(bool), bitorder="little").tobytes()


def fold(data: bytes, bits: int) -> np.ndarray:
    """A sketch over fewer bits: halves are added without carry."""
    out = np.frombuffer(data, dtype="<u8")
    while len(out) * 64 > bits:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def described(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, n, set, bits): shingle count, name and sketch of each document's set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, BATCH_BYTES, "text"):
                sets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "row", "n", "set", "bits"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, row long, n long, set long, bits binary")


def offers(documents: DataFrame, size: int, t: Threshold, parts: int, hot: dict[int, int]) -> DataFrame:
    """(part, sets, counts, keys): offered keys by hash part, packed by input batch.

    Copies in one batch offer once. Of a set in ``hot`` only the document of the given row
    offers, so no key comes from more than a thousandth of all documents by copies alone.
    """

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches_in:
            for batch in batches(whole, BATCH_BYTES, "text"):
                different = {}
                for row, found in zip(batch.column("row").to_pylist(), shingle_sets(batch.column("text"), size)):
                    if len(found):
                        name = fingerprint(found)
                        if hot.get(name, row) == row:
                            different[name] = found
                if not different:
                    continue
                sets = list(different.values())
                offered = [offered_keys(s, t) for s in sets]
                names = np.array(list(different), dtype=np.int64)
                owner = np.repeat(np.arange(len(sets)), [len(k) for k in offered])
                keys = np.concatenate(offered)
                home = (keys % U64(parts)).astype(np.int64)
                order = np.lexsort((owner, home))
                keys, owner, home = keys[order] // U64(parts), owner[order], home[order]
                cuts = np.searchsorted(home, np.arange(parts + 1))
                raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                rows = []
                for p in range(parts):
                    a, b = cuts[p], cuts[p + 1]
                    if a < b:
                        begin = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
                        rows.append((
                            p, names[owner[a:b][begin]].tobytes(),
                            np.diff(np.append(begin, b - a)).astype("<u4").tobytes(), raw[a:b].tobytes(),
                        ))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    ["part", "sets", "counts", "keys"],
                )

    return documents.select("row", "text").mapInArrow(run, "part int, sets binary, counts binary, keys binary")


FEW = 6


def shared_parts(offered: DataFrame) -> DataFrame:
    """(crowd, a, b, keys): sets that share a key.

    Up to ``FEW`` sets give their pairs (crowd 0). More are a crowd: pairs with their first
    set, a row (crowd, set, set) for each, where equal crowds have one name, and for each
    set the number of its keys in crowds (crowd -1).
    """

    def run(part: pa.Table) -> pa.Table:
        names, keys = [], []
        for row in part.to_pylist():
            raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, KEY_BYTES)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :KEY_BYTES] = raw
            keys.append(wide.reshape(-1).view("<u8"))
            names.append(np.repeat(np.frombuffer(row["sets"], "<i8"), np.frombuffer(row["counts"], "<u4")))
        keys, names = np.concatenate(keys), np.concatenate(names)
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))
        keys, names = keys[new], names[new]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(begin, len(keys)))
        out = [np.zeros((0, 3), np.int64)]
        for many in range(2, FEW + 1):
            at = begin[sizes == many]
            for i in range(many):
                for j in range(i + 1, many):
                    out.append(np.stack([np.zeros(len(at), np.int64), names[at + i], names[at + j]], axis=1))
        seen = set()
        for a, n in zip(begin[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            crowd = names[a : a + n]
            name = int(mix(mix(crowd.view(U64)).sum(dtype=U64, keepdims=True))[0] >> U64(1)) | 1
            if name not in seen:
                seen.add(name)
                out.append(np.stack([np.zeros(n - 1, np.int64), np.full(n - 1, crowd[0]), crowd[1:]], axis=1))
                out.append(np.stack([np.full(n, name), crowd, crowd], axis=1))
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.append(True, (found[1:] != found[:-1]).any(axis=1))] if len(found) else found
        busy, times = np.unique(names[np.repeat(sizes > FEW, sizes)], return_counts=True)
        rows = np.concatenate([found, np.stack([np.full(len(busy), -1), busy, busy], axis=1)])
        counts = np.append(np.zeros(len(found), np.int64), times)
        return pa.table({"crowd": rows[:, 0], "a": rows[:, 1], "b": rows[:, 2], "keys": counts})

    met = offered.groupBy("part").applyInArrow(run, "crowd long, a long, b long, keys long")
    return met.groupBy("crowd", "a", "b").agg(F.sum("keys").alias("keys"))


def stored_sets(documents: DataFrame, one: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(set, n, members): the 6-byte shingle hashes of each needed set.

    ``one`` has the row of a document for each set. A bitmap of the needed rows spares
    most other texts; what slips through leaves at the join.
    """
    rows = one.join(needed, "set", "left_semi").select("row")
    sent = documents.sparkSession.sparkContext.broadcast(bitmap(rows))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            hit = may_hold(sent.value, whole.column("row").to_numpy())
            whole = whole.filter(pa.array(hit))
            for part in batches(whole, BATCH_BYTES, "text"):
                sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
                packed = [
                    np.sort(s & U64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fingerprint(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(packed, pa.binary()),
                    ],
                    ["set", "n", "members"],
                )

    found = documents.select("row", "text").mapInArrow(run, "set long, n long, members binary")
    return pinned(found.join(needed, "set", "left_semi").dropDuplicates(["set"]))


def within_sketch(pairs: DataFrame, one: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y, most in zip(*(part.column(c).to_pylist() for c in ("left", "right", "most"))):
                bits = 8 * min(len(x), len(y))
                keep.append(int(np.bitwise_count(fold(x, bits) ^ fold(y, bits)).sum()) <= most)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(one.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("bits").alias("left")), "a")
    sized = sized.join(one.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("right")), "b")
    sized = sized.where((F.col("na") * t.base >= F.col("nb") * t.top) & (F.col("nb") * t.base >= F.col("na") * t.top))
    most = F.floor((F.col("na") + F.col("nb")) * F.lit(t.base - t.top) / F.lit(t.base + t.top) + F.lit(1e-9))
    return sized.select("a", "b", "left", "right", most.cast("long").alias("most")).mapInArrow(run, "a long, b long")


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def same_enough(left: bytes, right: bytes, t: Threshold) -> bool:
    """Whether two stored sets reach the similarity."""
    x, y = unpacked(left), unpacked(right)
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return t.reached(int((both[1:] == both[:-1]).sum()), len(x), len(y))


def verified(pairs: DataFrame, documents: DataFrame, one: DataFrame, size: int, t: Threshold) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    sets = stored_sets(documents, one, needed, size)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for left, right in zip(part.column("left").to_pylist(), part.column("right").to_pylist()):
                keep.append(same_enough(left, right, t))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("members").alias("left")), "a").join(
        sets.select(F.col("set").alias("b"), F.col("members").alias("right")), "b"
    )
    return pinned(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"))


class Links:
    """Which of the rows of a tile are linked so far, by a label of each."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def join(self, x: int, y: int) -> None:
        self.label[self.label == self.label[y]] = self.label[x]


def levels(n: np.ndarray, bits: list[bytes], t: Threshold) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(x, begin, sketches, upto) for every row x of a tile in the order of sizes.

    Partners of x are the rows after it up to ``upto[x]``; their sketches lie from
    ``begin`` on, folded to the bits of x's own.
    """
    upto = np.searchsorted(n * t.top, n * t.base, side="right")  # largest partner in reach
    length = np.array([len(b) for b in bits])
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        begin = int(rows[0])
        words = np.stack([fold(b, 8 * int(size)) for b in bits[begin : int(upto[rows[-1]])]])
        for x in rows.tolist():
            yield x, begin, words, upto


def near_rows(
    n: np.ndarray, bits: list[bytes], root: np.ndarray, links: Links, across: np.ndarray | None, t: Threshold
) -> Iterator[tuple[int, int]]:
    """Pairs (x, y) of rows of different roots, within reach by sketch and not linked when
    their turn comes.

    ``across`` marks the side of each row where two tiles meet; rows of one side have met
    elsewhere. The caller may link rows between two pairs.
    """
    for x, begin, words, upto in levels(n, bits, t):
        rest = slice(x + 1, upto[x])
        far = (links.label[rest] != links.label[x]) & (root[rest] != root[x])
        if across is not None:
            far &= across[rest] != across[x]
        pick = np.flatnonzero(far) + x + 1
        if not len(pick):
            continue
        apart = np.bitwise_count(words[pick - begin] ^ words[x - begin]).sum(axis=1)
        for y in pick[apart <= (n[pick] + n[x]) * (t.base - t.top) // (t.base + t.top)].tolist():
            if links.label[x] != links.label[y]:
                yield x, y


def tiled(rows: DataFrame, tiles: Column) -> DataFrame:
    """``rows`` once for each pair of tiles (i, j) of its group that its own tile is in."""
    own = F.pmod(F.xxhash64("set"), F.col("tiles")).cast("int")
    met = rows.withColumn("tiles", tiles.cast("int")).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    return met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("tiles", "other")


def rivals(crowds: DataFrame, named: DataFrame, t: Threshold, tile: int = 4096) -> DataFrame:
    """(a, b): links that join all sets of one crowd that are in different components and
    close enough by sketch, directly or through one another.

    ``named`` has set, root, n and bits. A crowd of one component has nothing left to
    find. The others are cut into tiles, and two tiles meet in one task, from which a
    forest comes out: fewer links than the task has rows.
    """
    rows = crowds.select("crowd", F.col("a").alias("set")).join(named.select("set", "root", "n", "bits"), "set")
    open_ = rows.groupBy("crowd").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")
    ).where("least < most")
    members = tiled(rows.join(open_.select("crowd", "size"), "crowd"), F.ceil(F.col("size") / tile))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "set"], ignore_index=True)
        name, n = part["set"].to_numpy(), part["n"].to_numpy()
        across = part["own"].to_numpy() if part["i"].iloc[0] != part["j"].iloc[0] else None
        # rows of one root are not linked here: what either is near to may be near to one only
        root, links, out = part["root"].to_numpy(), Links(np.arange(len(part))), []
        for x, y in near_rows(n, part["bits"].tolist(), root, links, across, t):
            links.join(x, y)
            out.append((min(name[x], name[y]), max(name[x], name[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    columns = ["crowd", "i", "j", "own", "set", "root", "n", "bits"]
    return members.select(columns).groupBy("crowd", "i", "j").applyInPandas(run, "a long, b long").distinct()


def settled(likely: DataFrame, named: DataFrame, documents: DataFrame, one: DataFrame, size: int, t: Threshold) -> DataFrame:
    """(a, b): verified links that join what the similarity joins among the sets of
    ``likely`` (node, root), the components of the forests of ``rivals``.

    Every pair of rivals lies in one such component, so a set travels with its shingles
    once for each tile of one component only. A tile holds some 4 million shingles or
    2048 sets; pairs not linked yet are verified on whole sets, and a forest comes out.
    """
    sets = stored_sets(documents, one, likely.select(F.col("node").alias("set")), size)
    groups = likely.select(F.col("node").alias("set"), F.col("root").alias("likely"))
    rows = sets.join(groups, "set").join(named.select("set", "root", "bits"), "set")
    weights = sets.select("set", "n").join(groups, "set").groupBy("likely").agg(
        F.ceil(F.greatest(F.count("*") / 2048, F.sum("n") / 4_000_000)).alias("weight")
    )
    members = tiled(rows.join(weights, "likely"), F.col("weight"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "set"], ignore_index=True)
        name, n = part["set"].to_numpy(), part["n"].to_numpy()
        across = part["own"].to_numpy() if part["i"].iloc[0] != part["j"].iloc[0] else None
        root, out = part["root"].to_numpy(), []
        links = Links(root)
        for x, y in near_rows(n, part["bits"].tolist(), root, links, across, t):
            if same_enough(part["members"].iloc[x], part["members"].iloc[y], t):
                links.join(x, y)
                out.append((min(name[x], name[y]), max(name[x], name[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    columns = ["likely", "i", "j", "own", "set", "root", "n", "bits", "members"]
    return members.select(columns).groupBy("likely", "i", "j").applyInPandas(run, "a long, b long")


def labelled_sets(narrow: DataFrame, size: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, set) of each document, and (set, root, copies, first) of each set.

    ``narrow`` has doc_id, text and row, a hash of both. Equal sets are one; sets without
    a link are their own root. ``first`` is a set's smallest (unnamed, doc_id, row).
    """
    docs = pinned(described(narrow, size))
    shingles = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(24, shingles // 4_000_000)
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    one = pinned(docs.where("n > 0").groupBy("set").agg(
        F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"),
        F.count("*").alias("copies"), F.min(rank).alias("first"),
    ))
    met = pinned(shared_parts(offers(narrow, size, t, parts, frequent(one))))
    pairs = pinned(within_sketch(met.where("crowd = 0").select("a", "b"), one, t))
    links = verified(pairs, narrow, one, size, t)
    roots = components(links)
    # a partner has at least top / base of a set's size, so at least that slack
    least = F.floor(F.floor(F.col("n") * t.top / t.base) / 8)
    busy = met.where("crowd = -1").join(one.select(F.col("set").alias("a"), "n"), "a").where(F.col("keys") > least)
    crowds = met.where("crowd > 0").select("crowd", "a").join(busy.select("a"), "a", "left_semi")
    if crowds.limit(1).count():
        named = with_roots(one, roots).select("set", "root", "n", "bits")
        likely = components(pinned(rivals(crowds, named, t)))
        if likely.limit(1).count():
            more = pinned(settled(likely, named, narrow, one, size, t))
            known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = components(known.union(more))
    return docs, pinned(with_roots(one, roots).select("set", "root", "copies", "first"))


def with_roots(one: DataFrame, roots: DataFrame) -> DataFrame:
    return one.join(roots.withColumnsRenamed({"node": "set"}), "set", "left").withColumn(
        "root", F.coalesce("root", "set")
    )


def frequent(one: DataFrame) -> dict[int, int]:
    """The row that stands for each set with more than a thousandth of all documents:
    fewer than a thousand sets."""
    total = one.agg(F.sum("copies")).first()[0] or 0
    hot = one.where(F.col("copies") * HOT_SHARES > max(total, HOT_SHARES)).select("set", "row")
    return {r["set"]: r["row"] for r in hot.collect()}


def narrowed(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text")
    )


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, top: int = 75, base: int = 100
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each document.

    ``component_id`` is the smallest id reachable by links of Jaccard similarity at least
    ``top / base``. Null and empty texts, or texts of white space, have no shingles and
    link with nothing: their component is their own id. Equal sets link always; repeated
    rows stay repeated. A null id takes part but names no component, unless nothing in
    the component has an id. Texts are read whole; other columns are not read.
    """
    docs, sets = labelled_sets(narrowed(documents, key, text), size, Threshold(top, base))
    least = pinned(sets.groupBy("root").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("members")))
    named = pinned(spread_join(sets.select("set", "root", "copies"), least, "root", "members").select("set", "copies", "component_id"))
    linked = spread_join(docs.where("n > 0"), named, "set", "copies").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    return linked.union(docs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def one_of_each(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, top: int = 75, base: int = 100
) -> DataFrame:
    """``documents`` with one row of each component: the smallest id (nulls last), then by hash.

    Rows without a shingle link with nothing and all stay, but for rows equal in id and
    text, of which one stays. All columns are kept; no name clashes.
    """
    docs, sets = labelled_sets(narrowed(documents, key, text), size, Threshold(top, base))
    kept = sets.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    kept = kept.union(docs.where("n = 0").select("row")).distinct()
    whole = documents.select(
        F.xxhash64(F.col(key), F.col(text)).alias("row"), F.struct(*documents.columns).alias("d")
    )
    return whole.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("d.*")
