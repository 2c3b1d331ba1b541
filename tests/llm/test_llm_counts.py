"""Filter audit, tokenizer alignment and cached token counts against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seasonlake.llm import alignment, filter_audit, token_counts
from seasonlake.llm.alignment import Aligner

LABELS = "doc_id long, quality int, toxic int, source string"


def filter_rows(seed: int):
    """Texts of every kind: short, repetitive, shouting, marked up, copied, null and empty."""
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(200)] + ["LOUD", "Aa", "naïve", "日本", "#tag", "a|b", "x y"]
    docs = []
    for i in range(160):
        size = rng.choice([0, 1, 3, 49, 50, 51, 80, 120])
        pool = words if rng.random() < 0.6 else words[:7] + words[-7:]
        text = rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", "  ", "\x0b"]).join(rng.choice(pool) for _ in range(size))
        docs.append((i, text, rng.choice(["web", "web", "books", None, ""]), 7))
    copies = [(1000 + i, docs[i % 5][1], "web", 7) for i in range(60)]
    odd = [(2000, None, "web", 7), (2001, None, None, 7), (2001, "", "books", 7), (None, docs[3][1], "web", 7)]
    docs += copies + odd + [docs[9], docs[9]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1]), "x") for i in range(0, 300, 2)]
    labels += [(4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x")]
    return docs, labels


def plain_audit(docs, labels):
    good = {i for i, q, t, _ in labels if q == 1 and i is not None}
    toxic = {i for i, q, t, _ in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    by_part = defaultdict(list)
    for i, text, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if i is not None and first[text] < i:
            fails.add("E")
        by_part[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in by_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                c = Counter()
                for fails, is_good, is_toxic in rows:
                    gone = bool(fails & set(order[:step]))
                    c["kept"] += not gone and f not in fails
                    c["removed"] += not gone and f in fails
                    c["redundant"] += gone and f in fails
                    c["unique_fails"] += fails == {f}
                    c["good_lost"] += not gone and f in fails and is_good
                    c["toxic_lost"] += not gone and f in fails and is_toxic
                shapley[f] += c["removed"]
                out[part, "".join(order), step + 1] = [c[k] for k in filter_audit.COUNTS]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def test_audit_matches_plain_walk(spark):
    docs, labels = filter_rows(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, quality int").repartition(5)
    found = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in found}
    assert len(got) == len(found) == 3 * 600
    assert got == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "few words", "web")], "doc_id long, text string, source string")
    rows = filter_audit.audit(one, labels).where("step = 1").collect()
    assert {r["removed"] for r in rows if r["filter_order"][0] == "A"} == {1}
    assert {r["removed"] for r in rows if r["filter_order"][0] != "A"} == {0}


def test_cells_walk_fewer_filters(spark):
    cells = spark.createDataFrame([("p", 3, 1, 0, 5), ("p", 1, 0, 1, 2), ("p", 0, 0, 0, 4)], "part string, mask int, good int, toxic int, n long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit_cells(cells, "XY").collect()}
    assert len(got) == 4
    assert (got["XY", 1]["removed"], got["XY", 2]["removed"], got["XY", 2]["redundant"]) == (7, 0, 5)
    assert (got["YX", 1]["removed"], got["YX", 2]["removed"], got["YX", 2]["kept"]) == (5, 2, 4)
    assert got["XY", 1]["shapley"] == 9 and got["YX", 1]["shapley"] == 5


def model_paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(seed: int, many: int) -> list:
    """Words, blanks of every kind, marks, scripts, controls and special strings in random order."""
    rng = random.Random(seed)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\x0b", "\x1c", " ", " ", "　", "\x00", "'s", "don't", "I'll",
             "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "é", "é", "日本語", "один", "اللغة", "👩‍👩‍👧", "🙂", "�",
             "Hello", "world", "123456", "a" * 70, "x=1;", "...", "—", "²", "﻿", "​", "naïve", "ſ", "\x7f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(many)]
    texts += [" ".join(rng.choice(parts[28:36] + ["plain", "words", "and"]) for _ in range(rng.randrange(1, 60))) for _ in range(many)]
    return texts + ["", None, " ", "  ", "\n", "▁", "a ▁b", "x▁", "a" * 5000, " " * 3000, "日本語" * 800, "word " * 2000]


def plain_alignment(texts: list):
    """Whole texts by the libraries, groups by byte offsets, counts by document."""
    json_path, model_path = model_paths()
    a_tok = Tokenizer.from_file(json_path)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=model_path)
    letters = {c: b for c, b in zip(
        [chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174],
        [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174])}
    letters |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False)
        ids_a, ids_b = a.ids, b_tok.encode(text or "")
        sizes_a = [bytes(letters[c] for c in t) for t in a.tokens]
        sizes_b = [b_bytes(i) for i in ids_b]
        if not text or not b"".join(sizes_a) == b"".join(sizes_b) == (" " + text).encode():
            found.append(None)
            continue
        ends = []
        for pieces in (sizes_a, sizes_b):
            at, out = 0, []
            for p in pieces:
                at += len(p)
                out.append(at)
            ends.append(out)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for end in both:
            ii, jj = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((ids_a[i:ii], ids_b[j:jj]))
            i, j = ii, jj
        found.append((ids_a, ids_b, groups))
    holding = Counter()
    for one in found:
        if one:
            holding.update({(x, y) for left, right in one[2] for x in left for y in right})
    highest = {}
    for (x, _), n in holding.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for one in found:
        if not one:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = Counter()
        for left, right in one[2]:
            for x, n in Counter(left).items():
                for y, m in Counter(right).items():
                    links[x, y] += n * m
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in one[2])
        out.append((len(one[0]), len(one[1]), len(one[2]), sum(links.values()),
                    sum(n for (x, y), n in links.items() if holding[x, y] == highest[x]),
                    sum(n * holding[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


ALIGN_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_whole_texts(spark):
    texts = odd_texts(11, 250)
    texts += texts[:40] + [texts[3]] * 200
    want = plain_alignment(texts)
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, copies int").repartition(6)
    found = {r["doc_id"]: tuple(r[c] for c in ALIGN_COLUMNS) for r in alignment.align(frame, *model_paths()).collect()}
    assert len(found) == len(texts)
    wrong = [(texts[i], found[i], want[i]) for i in range(len(texts)) if found[i] != want[i]]
    assert wrong == []


def test_alignment_keeps_rows(spark):
    rows = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None), (2, "")]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *model_paths())
    got = sorted(((r["doc_id"] or 0, r["n_groups"], r["groups_sha256"] != "") for r in found.collect()))
    assert got == [(0, 2, True), (1, 2, True), (1, 2, True), (2, 0, False), (2, 0, False)]
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *model_paths()).collect() == []


def test_units_forgotten_and_learnt_again():
    json_path, model_path = model_paths()
    aligner = Aligner(open(json_path, encoding="utf-8").read(), open(model_path, "rb").read())
    texts = [t or "" for t in odd_texts(5, 30)]
    once = aligner.block(texts)
    aligner.MEMORY = 10
    for start in range(0, len(texts), 7):
        some = aligner.block(texts[start : start + 7])
        assert (some["measures"] == once["measures"][start : start + 7]).all()
        assert some["sums"] == once["sums"][start : start + 7]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_match_library(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        plain = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = odd_texts(2, 60)
    texts += [texts[0]] * 150
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in
             token_counts.count_tokens(frame, path, str(tmp_path / "cache"), limit=50).collect()}
    want = {i: (len((t or "").encode()), plain(t or ""), plain(t or "") > 50) for i, t in enumerate(texts)}
    assert found == want


def test_cache_is_appended_and_used(spark, tmp_path, monkeypatch):
    path, other = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    cache = str(tmp_path / "cache")

    def stored():
        return spark.read.schema(token_counts.CACHE).parquet(cache)

    def run(texts, tokenizer=path):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(frame, tokenizer, cache).collect())

    first = run(["a b", "a b", "c", None, "a▁b"])
    assert stored().count() == 3  # the blank and its stand-in are one content
    assert run(["c", "a b"]) == [(0, first[2][1]), (1, first[0][1])] and stored().count() == 3
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", 0)
    assert run(["c", "d e f", "d e f"])[0] == (0, first[2][1]) and stored().count() == 4
    run(["c"], other)
    assert stored().count() == 5 and stored().select("version").distinct().count() == 2
    # what is stored is believed: nothing known is encoded again
    monkeypatch.setattr(token_counts, "encoded", lambda *_: pytest.fail("encoded a hit"))
    assert run(["c", "d e f"])[0] == (0, first[2][1])


def test_token_counts_keep_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in found.collect()) == [(0, 7), (1, 7), (1, 7), (2, 0)]
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
