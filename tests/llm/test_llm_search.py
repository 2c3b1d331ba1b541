"""URL filter, vector searches, near duplicates, lines and quality against plain versions."""

import os
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, duck
from seasonlake import session
from seasonlake.llm import line_dedup, max_score, parity_join, quality, rotated_codes, url_filter
from seasonlake.llm.components import components
from seasonlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_queries_with_sql(spark):
    con = duck(FOLDER)
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, FOLDER)
        status, _ = compare(df, con, sql)
        assert status in ("exact", "near"), (name, status)


def test_url_filter(spark):
    rules = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "a.b", "/x")]
    urls = [
        None, "", "no scheme", "http://a.NET/", "http://net/", "http://a.net", "http://example.net/en/1?q", "http://wexample.net/en/",
        "http://x.example.net/en", "http://x.a.b/xyz#f", "http://b/x", "ftp://net.org/", "http://.net/", "http://a..net/?://", "http://a.net/",
    ] + ["http://a.net/"] * 20
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [r for r in rules if ("." + host).endswith("." + r.host) and host and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.key), r.key), default=None)
        return host, path, best and best.key, best.action if best else "allow"

    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32("key") % 50 == 0)
    levels = url_filter.build_cascade(listed, keys)
    assert len(levels) > 1
    wrong = keys.where(url_filter.is_listed(levels, F.col("key")) != (F.crc32("key") % 50 == 0))
    assert wrong.count() == 0
    plan = keys.where(url_filter.is_listed(levels, F.col("key")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def vectors(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], 1) for i in range(n)]
    out += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] + [1.0] * (dim - 1), 1)]
    out += [(n + 4, [float("inf")] * dim, 1), (None, [1.0] * dim, 1), (7, out[7][1], 2), (7, out[7][1], 3), (n + 6, out[3][1], 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, score int"


def test_nearest_and_products(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    usable = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    nonzero = {i: v for i, v in usable.items() if v.any()}
    near = {}
    for r in rotated_codes.search_embeddings(df).collect():
        near.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in [i for i in nonzero if i % 50 == 0]:
        cosine = {i: v @ nonzero[q] / np.sqrt((v @ v) * (nonzero[q] @ nonzero[q])) for i, v in nonzero.items() if i != q}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        assert [near[q][k][0] for k in range(1, 6)] == best
        assert all(abs(near[q][k + 1][1] - cosine[i]) < 1e-12 for k, i in enumerate(best))
    score = {}
    for r in max_score.search_products(df).collect():
        score.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in usable.items()}
    for q in [i for i in whole if i % 50 == 0]:
        product = {i: int(v @ whole[q]) for i, v in whole.items() if i != q}
        best = sorted(product, key=lambda i: (-product[i], i))[:5]
        assert [score[q][k] for k in range(1, 6)] == [(i, product[i]) for i in best]
    for search in (rotated_codes.search_embeddings, max_score.search_products):
        assert search(df.limit(0)).count() == 0
        few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2.0], 1), (2, [-1.0, 0.5], 1)], SCHEMA)
        assert [r["rank"] for r in search(few).orderBy("rank").collect()] == [1, 2]


def test_max_score_skips_rows_and_stays_exact():
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((3000, 40)) < 0.1, rng.integers(-50, 300, (3000, 40)), 0)
    postings = max_score.Postings(weights)
    touched = 0
    for _ in range(30):
        query = np.where(rng.random(40) < 0.3, rng.integers(-20, 100, 40), 0)
        allowed = np.ones(3000, bool)
        pick = postings.top(query, allowed, 5)
        touched += len(pick)
        scores = weights @ query
        assert sorted(scores[pick])[-5:] == sorted(scores)[-5:]
    assert touched < 30 * 3000 / 2


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups(texts):
    """Component of each text by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def near_texts():
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d e", "A b c d E", "a b c d e f"]
    for n in (8, 20, 90, 300, 1500):
        base = fresh(n)
        texts += [" ".join(edited(rng, base, s)) for s in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(3)]
    crowd = fresh(130)
    texts += [" ".join(edited(rng, crowd, 0.03)) for _ in range(40)]
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(60)]
    texts += [" ".join(passage + fresh(k)) for k in range(0, 30, 2)]
    rng.shuffle(texts)
    return texts


def test_near_duplicates(spark):
    texts = near_texts()
    want, sets = groups(texts)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, set string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_duplicates(df.repartition(7)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}
    assert parity_join.near_duplicates(df.limit(0)).count() == 0
    kept = parity_join.one_of_each(df.union(df.where("doc_id < 20"))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in range(len(texts)) if want[i] == i)
    assert all(r["set"] == "x" and r.n == r.doc_id for r in kept)
    unnamed = spark.createDataFrame([(None, "p q r s t"), (None, "p q r s t"), (None, None), (4, "P q r s t")], "doc_id long, text string")
    rows = sorted(((r.n_shingles, r.component_id) for r in parity_join.near_duplicates(unnamed).collect()), key=str)
    assert rows == [(0, None), (1, 4), (1, 4), (1, 4)]


def test_offered_keys_meet():
    """Sets within reach always share an offered key."""
    rng = np.random.default_rng(2)
    t = parity_join.Threshold(75, 100)
    for size in (1, 2, 3, 5, 9, 31, 33, 64, 65, 100, 127, 128, 140, 200, 255, 400, 1000, 1023, 1024, 3000):
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            other = max(1, int(len(a) * rng.uniform(0.75, 1.33)))
            shared = -(-75 * (len(a) + other) // 175)
            if shared > min(len(a), other):
                continue
            b = np.unique(np.concatenate([rng.permutation(a)[:shared], rng.integers(0, 1 << 63, other - shared, dtype=np.uint64)]))
            assert t.reached(len(np.intersect1d(a, b)), len(a), len(b))
            assert len(np.intersect1d(parity_join.offered_keys(a, t), parity_join.offered_keys(b, t)))
            x, y = parity_join.sketch(a), parity_join.sketch(b)
            bits = 8 * min(len(x), len(y))
            apart = np.bitwise_count(parity_join.fold(x, bits) ^ parity_join.fold(y, bits)).sum()
            assert apart <= len(np.setxor1d(a, b))


def test_crowds_give_forests(spark):
    """Many sets around one passage, in chains: all links found, few rows out of a crowd."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(100), []
    for _ in range(12):
        chain = passage + fresh(60)
        for _ in range(14):
            at = 100 + rng.randrange(50)
            chain = chain[:at] + fresh(9) + chain[at + 9 :]
            texts.append(" ".join(chain))
    want, _ = groups(texts)
    assert 1 < len(set(want)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = parity_join.Threshold(75, 100)
    got = {r.doc_id: r.component_id for r in parity_join.near_duplicates(df.repartition(3)).collect()}
    assert got == dict(enumerate(want))
    docs = parity_join.described(parity_join.narrowed(df, "doc_id", "text"), 5)
    one = docs.select("set", F.col("set").alias("root"), "n", "bits")
    crowd = docs.select(F.lit(1).alias("crowd"), F.col("set").alias("a"))
    assert 0 < parity_join.rivals(crowd, one, t).count() < len(texts)
    likely = one.select(F.col("set").alias("node"), F.lit(1).alias("root"))
    found = parity_join.settled(likely, one, parity_join.narrowed(df, "doc_id", "text"), docs, 5, t)
    assert found.count() == len(texts) - len(set(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400, **{i: 1000 for i in range(1000, 1100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(texts, similarity=0.8):
    lines = {}
    for text in texts:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                lines.setdefault(line.strip(" \t\r\x0b\x0c"), fives(line.strip(" \t\r\x0b\x0c")))
    names = list(lines)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(lines[a] & lines[b])
            if shared >= similarity * (len(lines[a]) + len(lines[b]) - shared):
                root[find(a)] = find(b)
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append((None, 0))
            continue
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            if bare and find(bare) in seen:
                continue
            if bare:
                seen.add(find(bare))
            kept.append(line)
        out.append(("\n".join(kept), text.count("\n") + 1 - len(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(40)) for _ in range(12)]
    texts = [None, "", "\n\n", "x", "x", "y" * 40_000, "y" * 40_000]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = word()
            lines.append(rng.choice(["", "  ", "\t"]) + " ".join(line))
        texts.append("\n".join(lines + [f"only {word()} {word()} {i} {word()}", ""]))
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, gone int")
    cleaned = line_dedup.dedup_lines(df.repartition(5))
    assert cleaned.columns == ["doc_id", "text", "gone", "n_removed"]
    got = {r.doc_id: (r.text, r.n_removed) for r in cleaned.collect()}
    assert got == dict(enumerate(plain_lines(texts)))
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert Counter(r.text for r in line_dedup.dedup_lines(repeated).collect()) == {"a b\nc d": 2, "": 1, None: 1}


def fives(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def same(a, b):
    return len(fives(a) & fives(b)) / len(fives(a) | fives(b))


def test_line_dedup_of_short_lines(spark):
    """One changed or added letter in lines of 5 to 15 words, and in lines without a blank."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 9)))
    texts, near = [], {}
    while len(near) < 150:
        line = (" " if len(near) % 5 else "").join(word() for _ in range(rng.randint(5, 15)))
        at = rng.randrange(len(line))
        other = line[:at] + "é" + line[at + rng.randint(0, 1) :]
        if same(line, other) >= 0.8:
            near[len(texts) + 1] = other
        elif rng.random() < 0.5:
            continue
        texts += [line, other]
    texts += ["ab", "abc", "abcd", "abce", "\U0001f600\U0001f601", "\U0001f600\U0001f602"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.n_removed}
    assert gone <= set(near)
    assert len(gone) >= 0.96 * len(near)


def test_line_dedup_of_crowded_buckets(spark):
    """Near twins among lines of one template, which share buckets without being near."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 9)))
    shared = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(150):
        own = [word() for _ in range(12)]
        texts.append(f"{shared} {' '.join(own)}")
        own[rng.randrange(12)] = word()
        texts.append(f"{shared} {' '.join(own)}")
    sets = [fives(t) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert all(near(i, i + 1) for i in range(0, len(texts), 2))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = documents.withColumn("row", F.xxhash64("doc_id", "text"))
    distinct = line_dedup.pinned(line_dedup.distinct_lines(line_dedup.lines_of(documents), 8, 4))
    roots = {r.node: r.root for r in line_dedup.linked(distinct, documents, 8, 0.8).collect()}
    buckets, doc = {}, {}
    for r in distinct.collect():
        doc[r.id] = r.doc_id
        for b in range(8):
            buckets.setdefault(r[f"b{b}"], []).append(r.id)
    assert max(map(len, buckets.values())) > 20
    for ids in buckets.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                assert not near(doc[a], doc[b]) or roots.get(a, a) == roots.get(b, b)


def test_line_dedup_moves_no_text_of_chance_buckets(spark, monkeypatch):
    """Lines that share buckets and are not near meet by folded marks, without their texts."""
    rng = random.Random(29)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 9)))
    shared = " ".join(word() for _ in range(30))
    texts = [f"{shared} {' '.join(word() for _ in range(15))}" for _ in range(150)]
    # a twin of each of the first lines, with its last word changed
    texts += [f"{t.rsplit(' ', 1)[0]} é" for t in texts[:10]]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = documents.withColumn("row", F.xxhash64("doc_id", "text"))
    distinct = line_dedup.pinned(line_dedup.distinct_lines(line_dedup.lines_of(documents), 8, 4))
    lines = {r.id: r for r in distinct.collect()}
    sets = {i: fives(texts[r.doc_id]) for i, r in lines.items()}
    meet = lambda a, b: any(lines[a][f"b{k}"] == lines[b][f"b{k}"] for k in range(8))
    near = {
        (a, b) for a in lines for b in lines
        if a < b and meet(a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert len(near) >= 8
    inside = line_dedup.bucketed(distinct, 8).select("id", "key", "size", F.col("id").alias("root"), F.rand(3).alias("draw"))
    inside = line_dedup.pinned(inside.join(line_dedup.folds_of(distinct), "id"))
    found = {r.id for r in line_dedup.with_partner(inside, inside, 0.8).collect()}
    assert {i for pair in near for i in pair} <= found and len(found) < 40
    moved, pinned = [], line_dedup.pinned

    def watched(df):
        out = pinned(df)
        if {"line", "key"} <= set(out.columns):
            moved.append(out.select("id").distinct().count())
        return out

    monkeypatch.setattr(line_dedup, "pinned", watched)
    roots = {r.node: r.root for r in line_dedup.linked(distinct, documents, 8, 0.8).collect()}
    assert inside.where("size > 3").select("id").distinct().count() > 100 and sum(moved) < 40
    plan = line_dedup.chosen(distinct, inside)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(line_dedup, "SENT", 3)
    assert "ResolvedHint" not in line_dedup.chosen(distinct, inside)._jdf.queryExecution().analyzed().toString()
    assert all(roots[a] == roots[b] for a, b in near)
    assert set(roots) == {i for pair in near for i in pair}


def test_line_dedup_of_copies_of_a_frequent_line(spark, monkeypatch):
    """Copies that are near the line they were made from and not near each other: it is a
    pivot, and what a crowd compares comes out as links, each once, not as pairs."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 9)))
    base = [word() for _ in range(60)]
    texts = []
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(60), 4 if i % 3 else 9):
            own[at] = word()
        texts.append(" ".join(own))
    texts.insert(60, " ".join(base))
    documents = spark.createDataFrame(list(enumerate([*texts, texts[60], texts[60]])), "doc_id long, text string")
    documents = documents.withColumn("row", F.xxhash64("doc_id", "text"))
    distinct = line_dedup.pinned(line_dedup.distinct_lines(line_dedup.lines_of(documents), 8, 4))
    lines = {r.id: r for r in distinct.collect()}
    sets = {i: fives(texts[r.doc_id]) for i, r in lines.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    meet = lambda a, b: any(lines[a][f"b{k}"] == lines[b][f"b{k}"] for k in range(8))
    center = next(i for i, r in lines.items() if r.doc_id == 60)
    inside = line_dedup.pinned(line_dedup.bucketed(distinct, 8))
    first = {tuple(r) for r in line_dedup.first_pairs(inside, distinct, 0.8).collect()}
    around = {(min(i, center), max(i, center)) for i in lines if i != center and meet(i, center) and near(i, center)}
    assert len(around) > 70 and around <= first
    monkeypatch.setattr(line_dedup, "SHARE", 16)
    monkeypatch.setattr(line_dedup, "CROWD", 20)
    left = inside.select("id", "key", "size", F.col("id").alias("root"), F.rand(3).alias("draw")).join(distinct, "id")
    links = [tuple(r) for r in line_dedup.further_links(left, left, 8, 0.8).collect()]
    assert sorted(links) == sorted((a, b) for a in lines for b in lines if a < b and meet(a, b) and near(a, b))


def test_line_dedup_keeps_only_what_its_result_reads(spark):
    """No shuffle outlives the stage that made it, no stored stage the one that read it."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 9)))
    lines = [" ".join(word() for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(i, f"{lines[i % 40]} {word()}\n{word()}") for i in range(120)], "doc_id long, text string")
    session.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    folders, files = set(os.listdir(folder)), shuffles()
    cleaned = line_dedup.dedup_lines(df)
    left = set(os.listdir(folder)) - folders
    until = time.time() + 10
    while shuffles() - files and time.time() < until:
        time.sleep(0.2)
    assert len(left) == 1 and not shuffles() - files
    assert spark.conf.get(session.CLEANUP, None) in (None, "false")
    assert sum(r.n_removed for r in cleaned.collect()) >= 80


def test_marks_tell_long_lines_apart(spark):
    """Lines of some 1200 characters over few different shingles, which share buckets by chance."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghinorst", k=rng.randint(3, 9)))
    common = [word() for _ in range(400)]
    texts = [" ".join(rng.choices(common, k=170)) for _ in range(30)]
    texts += [t[:100] + "é" + t[101:] for t in texts[:5]]
    documents = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    distinct = line_dedup.pinned(line_dedup.distinct_lines(line_dedup.lines_of(documents), 8, 4))
    assert {r.doc_id: r.n for r in distinct.collect()} == {i: len(t) - 4 for i, t in enumerate(texts)}
    pairs = distinct.alias("x").join(distinct.alias("y"), F.col("x.doc_id") < F.col("y.doc_id"))
    left = pairs.where(line_dedup.in_reach("x", "y", line_dedup.words_of(distinct), 0.8)).select("x.doc_id", F.col("y.doc_id").alias("other"))
    assert {tuple(r) for r in left.collect()} == {(i, 30 + i) for i in range(5)}


def rated(rng, n):
    rows, labels = [], []
    common = [f"word{i}" for i in range(300)]
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = rng.choices(common, k=rng.randint(20, 120))
        if grade == 0:
            words = [w + rng.choice(["***", "$$$", "!!"]) for w in words]
        if grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["slurone", "slurtwo"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return rows, labels


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = rated(rng, 1500)
    df = spark.createDataFrame(rows + [(9001, None, "x"), (9002, "", "x"), (9003, "z" * 100_000, "x"), (None, "q", "x")], "doc_id long, text string, tail string")
    train = labels[:1000] + [(1, None, 0), (None, 1, 1), (77777, 1, 0), labels[0]]
    ratings = spark.createDataFrame(train, "doc_id long, quality int, toxic int")
    scored = quality.score_documents(df, ratings)
    got = {r.row.doc_id: r for r in scored.collect()}
    assert len(got) == 1504 and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    held = [(i, q == 1 and t == 0) for i, q, t in labels[1000:]]
    assert sum(got[i].keep == good for i, good in held) >= 0.95 * len(held)
    assert quality.score_documents(df.limit(0), ratings).count() == 0
    assert quality.score_documents(df.limit(5), ratings.limit(0)).count() == 5


def test_fit_reaches_the_likelihood_of_a_plain_fit():
    """Overlapping grades: as good as plain descent along numeric gradients."""
    rng = np.random.default_rng(7)
    names = np.array([5, 9, 70])
    has = rng.random((600, 3)) < 0.5
    latent = has @ np.array([1.5, -1.0, 0.5]) + rng.logistic(size=600)
    grades = (latent > -0.5).astype(int) + (latent > 1)

    def loss(p):
        edge = np.append(p[3:], np.inf)
        above = 1 / (1 + np.exp(-np.clip((has @ p[:3])[:, None] - edge, -50, 50)))  # P(grade > k)
        upper = np.where(grades > 0, above[np.arange(600), grades - 1], 1.0)
        return -np.log(np.maximum(upper - above[np.arange(600), grades], 1e-12)).mean()

    plain, step = np.array([0.0, 0, 0, -0.5, 0.5]), 1e-5 * np.eye(5)
    for _ in range(1500):
        plain -= np.array([(loss(plain + e) - loss(plain - e)) / 2e-5 for e in step])
    bins = [names[h].astype(np.int32) for h in has]
    bins = [np.append(b, 10).astype(np.int32) for b in bins]
    model = quality.fit(bins, grades, 3, shrink=0.0)
    fitted = np.append(model.weights[names], model.thresholds - model.weights[10])
    assert loss(fitted) <= loss(plain) + 0.003
    assert np.abs(fitted - plain).max() < 0.3


def test_quality_on_held_out_labels(spark):
    """Half of the given labels teach; the other half is judged by grade and rank."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic")
    scored = quality.score_documents(docs, labels.where("doc_id % 2 = 0")).select("row.doc_id", "tail", "keep")
    held = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.quality == 1 and r.toxic == 0 for r in held]
    assert sum(r.keep == g for r, g in zip(held, good)) >= 0.94 * len(held)
    assert sum(r.keep and g for r, g in zip(held, good)) >= 0.97 * sum(good)
    assert sum(r.keep for r in held if r.toxic == 1) <= 0.5 * sum(r.toxic == 1 for r in held)
    tails = np.array([r.tail for r in held])
    assert np.median(tails[np.array(good)]) > 0.9 and np.quantile(tails[~np.array(good)], 0.75) < 0.5


def test_cumulative_link_gradient():
    """The fitted model orders three separable grades."""
    bins = [np.array([g, 10], dtype=np.int32) for g in (0, 1, 2) for _ in range(60)]
    grades = np.repeat([0, 1, 2], 60)
    model = quality.fit(bins, grades, 3)
    scores = model.scores(np.array([0, 10, 1, 10, 2, 10]), np.array([0, 2, 4, 6]))
    assert scores[0] < scores[1] < scores[2] and model.thresholds[0] < model.thresholds[1]
    tails = model.tails(scores)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert tails[0, 0] < 0.5 < tails[1, 0] and tails[1, 1] < 0.5 < tails[2, 1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert 0 < out.count() <= before
        before = out.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, docs, FOLDER).collect()} == {r.doc_id for r in docs.collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", None), (1, None, "en", "s", None)], docs.schema)
    rows = Counter(tuple(r) for r in odd.collect())
    quality_stage, line_stage, near_stage, pii_stage, packing_stage = (stage for _, stage in corpus_pipeline.STAGES)
    assert Counter(tuple(r) for r in line_stage(spark, odd, FOLDER).collect()) == rows
    assert Counter(tuple(r) for r in near_stage(spark, odd, FOLDER).collect()) == Counter(set(rows))
    assert sorted((r.doc_id or 0, r.text or "") for r in pii_stage(spark, odd, FOLDER).collect()) == [(0, ""), (1, ""), (1, "")]
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in packing_stage(spark, odd, FOLDER).collect()) == [(0, 0, 1), (1, 0, 1), (1, 0, 1)]
    assert quality_stage(spark, odd, FOLDER).count() in (0, 3)  # equal texts share one fate
