"""HTML text, BPE, packing and personal data against plain versions, with odd inputs."""

import hashlib
import random
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasonlake.llm import bpe, html_text, packing, pii

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    None, "", " ", "\n\n", "a", "Σς İ ½Ⅷ", "x" * 30_000, "the cat " * 3_000, "a\n b  c\t d ", "<|endoftext|> it's",
    "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "the same", "the same", "1 2\x1c3\x85 4  5　",
    "don't DON'T é é 你好 世界", "<|startoftext|><|endoftext|>", "end. of,line.\nNext, line.",
]


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, piece int")


PAGES = {
    "<html><body><nav><a href=x>Menu</a></nav><article><h1>Ti<b>t</b>le</h1><p>One &amp; two<br>three"
    "<p>Four</article><div class='ad'>Buy</div><footer>&copy; us</footer>": "Title One & two three Four",
    "<body><div id='comments'><p>I agree</p></div><div><p>Body one is long enough here.</p><p>Body two &lt;3</p></div>":
        "Body one is long enough here. Body two <3",
    "<main><p>kept</p><aside>side</aside><form>f<input></form><script>var a='<p>no</p>'</script>"
    "<div role=alert>cookies</div><ul><li>a<li>b</ul></main>": "kept a b",
    "<article><p>a<!-- x --> b\n\n  c</p><table><tr><td>d<td>e</table></article>": "a b c d e",
    "no tags at all": "no tags at all", "": "", "<p>cut off <b>he": "cut off he", "<p>a</p><p": "a",
    "<article><p>x &am</article><style>p{}": "x &am",
}



def test_bpe_of_all_of_unicode():
    """Letters with marks of any age, and code points without a character."""
    rng = random.Random(1)
    chars = [chr(c) for c in range(32, 0x20000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in chars if unicodedata.category(c)[0] == "M"]
    letters = [c for c in chars if unicodedata.category(c)[0] == "L"]
    texts = ["i\u0611\u08cfu"]
    for _ in range(4000):
        texts.append(rng.choice(letters) + "".join(rng.choices(marks, k=3)) + rng.choice(letters))
        texts.append("".join(rng.choices(chars + [" ", "a", "\n"] * 9000, k=rng.randint(1, 9))))
    library = Tokenizer.from_file(WORD)
    ids = bpe.WordBpe(open(WORD, encoding="utf-8").read()).encode(texts)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


ARTICLE = "The article says a good deal about things that matter to people. " * 2
REMARK = "A reader remarks at length on what was said above and goes on. " * 8


def test_html_text_of_several_articles():
    """Titles, leads and second articles stay; comments go, however long they are."""
    text = ARTICLE.strip()
    assert html_text.main_text(
        f"<nav>menu</nav><main><h1>Title</h1><p>Lead</p><article><p>{ARTICLE}</p></article></main>"
    ) == f"Title Lead {text}"
    assert html_text.main_text(
        f"<main><article><p>One. {ARTICLE}</p></article><article><p>Two. {ARTICLE}</p></article></main>"
    ) == f"One. {text} Two. {text}"
    for page in (
        f"<article><p>{ARTICLE}</p></article><article class='comment'><p>{REMARK}</p></article>",
        f"<article><p>{ARTICLE}</p><div class=comments><p>{REMARK}</p></div></article>",
        f"<div class=ad>{REMARK}</div><article><p>{ARTICLE}</p></article>",
    ):
        assert html_text.main_text(page) == text
    for block in (ARTICLE, f"<p>{ARTICLE}</p><p>{ARTICLE}</p>"):
        page = f"<h1>Head</h1><div>{block}</div><p>Closing words of the page.</p>"
        assert html_text.main_text(page) == " ".join(["Head", *[text] * max(1, block.count("<p>")), "Closing words of the page."])


def test_html_text_of_deep_and_stray_tags():
    for page, want in (
        ("<div>" * 50_000 + "deep", "deep"), ("</div>" * 50_000 + "x", "x"), ("<b></div>" * 25_000 + "x", "x"),
        ("<p>" * 50_000 + "x", "x"),
    ):
        begun = time.process_time()
        assert html_text.main_text(page) == want
        assert time.process_time() - begun < 2


def test_main_text(spark):
    pages = [(i, "u", h, 5) for i, h in enumerate([*PAGES, None])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate([*PAGES.values(), ""])}
    assert html_text.extract_text(df.limit(0)).count() == 0
    deep = "<div>" * 5_000 + "<p>deep</p>"
    assert html_text.main_text(deep) == "deep"


def test_wrappers_with_noisy_names_stay():
    text = "<p>The article goes on and on here.</p><p>It has a second part.</p>"
    want = "The article goes on and on here. It has a second part."
    names = ["site has-sidebar", "content no-comments", "with-banner", "social-science", "entry related-topics", "site widget"]
    for name in names:
        for key in ("class", "id"):
            assert html_text.main_text(f"<body><div {key}='{name}'>{text}<div class=ad>Buy</div></div></body>") == want
    for name in ("comments", "cookie-banner", "cookie_notice", "x sidebar"):
        assert html_text.main_text(f"<body><div class='{name}'><p>Short noise</p></div><div>{text}</div></body>") == want


def test_raw_elements_end_where_the_page_says():
    page = "<main><p>" + "\u0130" * 9 + "</p><SCRIPT>var a = '<p>no</p>'</Script><p>after the script</p></main>"
    assert html_text.main_text(page) == "\u0130" * 9 + " after the script"


def test_densities_prefer_text_over_links():
    tree = html_text.Tree("<div><p>plain words that go on and on here</p></div><div><a href=x>linked words that go on</a></div>")
    density, _ = html_text.densities(tree)
    blocks = [i for i, t in enumerate(tree.tag) if t == "div"]
    assert density[blocks[0]] > density[blocks[1]] >= 0


def test_bpe_equals_the_library(spark):
    reference = Tokenizer.from_file(WORD)
    rng = random.Random(5)
    letters = ["a", "B", " ", "\n", "é", "é", "Σ", "1", "½", "'s", "<|", "<|endoftext|>", "你", "_", "-", "\x85", "\x1c", "ﬁ"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(300)]
    want = []
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((
            i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        ))
    got = bpe.encode_texts(frame(spark, texts), WORD)
    assert sorted(map(tuple, got.collect())) == want
    assert bpe.encode_texts(frame(spark, texts).limit(0), WORD).count() == 0
    few = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_ids(frame(spark, texts[:12]), WORD).collect()}
    for i, t in enumerate(texts[:12]):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert few[i] == (ids, reference.decode(ids, skip_special_tokens=False))


def test_tree_merges_like_a_scan():
    with open(WORD, encoding="utf-8") as file:
        encoder = bpe.WordBpe(file.read())

    def plain(symbols):
        while True:
            ranked = [(encoder.pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in encoder.pairs]
            if not ranked:
                return symbols
            _, i = min(ranked)
            symbols = symbols[:i] + [encoder.pairs[symbols[i], symbols[i + 1]][1]] + symbols[i + 2 :]

    rng = random.Random(2)
    words = ["".join(rng.choices("theinganor", k=rng.randint(1, 90))) for _ in range(400)]
    for word, ids in zip(words, encoder.ids_of(words)):
        data = word.encode()
        assert ids == plain([*encoder.inner[list(data[:-1])].tolist(), int(encoder.final[data[-1]])])


def packed(df):
    return packing.pack(df, BYTE).collect()


def test_packing(spark):
    reference = Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    texts = ODD + ["word " * rng.randint(1, 2500) for _ in range(60)] + ["same text"] * 40
    rows = packed(frame(spark, texts).repartition(5))
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, n] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packed(frame(spark, []).limit(0)) == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 300) for _ in range(rng.randint(0, 40))}
    groups = packing.plan_groups(histogram, 100)
    placed = {}
    for g in groups:
        assert sum(n * k for n, k in g.content) <= 100
        for n, k in g.content:
            placed[n] = placed.get(n, 0) + k * g.bins
    assert all(placed[n] >= c for n, c in histogram.items()) and set(placed) == set(histogram)
    assert placed == histogram


@pytest.mark.parametrize("kind", ["uniform", "halves", "long tail"])
def test_plan_never_loses_to_best_fit(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "uniform": rng.integers(300, 1501, 200_000), "halves": rng.choice([1024, 683, 341, 1365, 2048, 2], 50_000),
        "long tail": np.clip(rng.lognormal(6, 1, 200_000), 1, 2048).astype(int),
    }[kind]
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist()))
    best_fit = sum(g.bins for g in packing.rounded(histogram, 2048, []))
    plan = packing.plan_groups(histogram, 2048)
    assert -(-int(lengths.sum()) // 2048) <= sum(g.bins for g in plan) <= best_fit
    placed = {}
    for g in plan:
        assert sum(n * k for n, k in g.content) <= 2048
        for n, k in g.content:
            placed[n] = placed.get(n, 0) + k * g.bins
    assert placed == histogram


def test_rank_table_gives_the_library_ids():
    """Texts below U+0250 by ranks, others by units, in their order; long runs as well."""
    with open(BYTE, encoding="utf-8") as file:
        source = file.read()
    units, library = packing.UnitTokenizer(source), Tokenizer.from_str(source)
    assert units.ranked is not None and packing.UnitTokenizer(open(WORD, encoding="utf-8").read()).ranked is None
    rng = random.Random(9)
    low = [chr(c) for c in range(0x250)] + [" ", " ", "\n", "'s", "'LL", "don't", "<|endoftext|>", "Straße", "12"]
    high = low + ["日本", "е", "\u0301", "\u2003", "🙂"]
    texts = ["".join(rng.choices(rng.choice([low, low, high]), k=rng.randrange(0, 60))) for _ in range(3000)]
    texts += [None, "", "a" * 100_000, " " * 100_000 + "x", "ab1!" * 20_000, "\n" * 50_000]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in units.encode(texts)]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want


def test_pii_base_and_edges(spark):
    texts = [
        "mail a.b+c@x-y.example.com, or me@nowhere", "ip 10.0.0.255 not 10.0.0.256 or 1.2.3.4.5", "card 4111 1111 1111 1111 bad 4111 1111 1111 1112",
        "call +1 (616) 555-3963 or +12", None, "", "9" * 20_000, "x" * 200_000, "a@b.c" * 3, "é 7.7.7.7 é", "0" * 5_000 + ".1.1.1",
    ]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert len(got) == len(texts)
    assert [got[0].n_email, got[1].n_ip, got[2].n_card, got[3].n_phone] == [1, 2, 1, 1]
    import re

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for i, t in enumerate(texts):
        if len(t or "") > 50_000 or i in (6, 10):
            continue
        spans = sorted(
            ((m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, t or "") if pii.fits(k, m[0])),
            key=pii.order,
        )
        assert got[i].base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert set(pii.written(spans).split(",")) <= set(got[i].spans.split(","))
    assert pii.digest(df.limit(0)).count() == 0
    masked = {r.row.doc_id: r.masked for r in pii.find_pii(df).collect()}
    assert masked[9] == "é [ip] é" and masked[4] is None and masked[5] == ""


def test_pii_reads_bounded_runs(spark, monkeypatch):
    """A worker classifies and tags a run of bounded text at a time, however many rows a batch has."""
    whole, most = pii.model_spans, 2 << 20

    def bounded(texts, tagger):
        assert sum(map(len, texts)) <= most
        return whole(texts, tagger)

    monkeypatch.setattr(pii, "model_spans", bounded)
    untrained = pii.train(*pii.labelled_windows([]))
    monkeypatch.setattr(pii, "train", lambda codes, tags: untrained)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("and so on "), 200), F.lit("to a@b.org")).alias("text"))
    found = pii.find_pii(df.coalesce(1)).select("row.doc_id", "base", "masked").collect()
    assert len(found) == 3000
    assert all(r.masked.endswith("to [email]") and len(r.base) == 1 for r in found)


def test_crf_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.fresh(3, 1)
    codes = rng.integers(0, pii.CLASSES, (2, 7))
    tags = np.array([[0, 1, 2, 2, 0, 3, 4], [1, 2, 0, 0, 5, 6, 0]])

    def loss():
        k = tagger.left.hidden
        scores = tagger.left.run(codes) @ tagger.top[:k] + tagger.right.run(codes[:, ::-1])[::-1] @ tagger.top[k:-1] + tagger.top[-1]
        moves, total = tagger.moves + pii.allowed(), 0.0
        for w in range(2):
            ahead = scores[0, w] + np.where((np.arange(pii.TAGS) % 2 == 0) & (np.arange(pii.TAGS) > 0), -1e4, 0)
            score = scores[0, w, tags[w, 0]]
            for t in range(1, 7):
                ahead = np.logaddexp.reduce(ahead[:, None] + moves, axis=0) + scores[t, w]
                score += moves[tags[w, t - 1], tags[w, t]] + scores[t, w, tags[w, t]]
            total += np.logaddexp.reduce(ahead) - score
        return total / 2

    for p, g in zip(tagger.parameters(), tagger.gradients(codes, tags)):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_model_finds_other_spellings():
    rng = random.Random(4)
    words = "the heon of and or thing ented was is that with onst".split()

    def sentence():
        return " ".join(rng.choices(words, k=rng.randint(4, 14)))

    def text():
        number = "+1 ({}) 555-{}".format(rng.randint(200, 989), rng.randint(1000, 9999))
        mail = "{}{}@mail{}.example.com".format(rng.choice(words), rng.randint(1, 99), rng.randint(1, 9))
        return f"{sentence()} {number} {sentence()} {mail} {sentence()}"

    tagger = pii.train(*pii.labelled_windows([text() for _ in range(120)])).single()
    wanted = found = 0
    for _ in range(60):
        t = text()
        changed, spans = pii.other_spellings(t, pii.base_spans(t))
        got = pii.model_spans([changed], tagger)[0]
        wanted, found = wanted + len(spans), found + len(set(spans) & set(got))
    assert found >= 0.8 * wanted
    assert pii.model_spans(["no digits here at all"], tagger) == [[]]


def test_model_finds_spelled_addresses_without_a_digit():
    rng = random.Random(6)
    words = "the heon of and or thing ented was is at that with onst".split()

    def text():
        said = lambda: " ".join(rng.choices(words, k=rng.randint(4, 14)))
        name, host = ("".join(rng.choices("abcdeghinorst", k=rng.randint(4, 8))) for _ in range(2))
        return f"{said()} write to {name}@{host}.org {said()}"

    t = "write to jane@example.org now"
    assert pii.other_spellings(t, pii.base_spans(t)) == ("write to jane at example dot org now", [(9, 32, "email")])
    assert pii.plausible("email", "jane at example dot org", " ", " ")
    tagger = pii.train(*pii.labelled_windows([text() for _ in range(120)])).single()
    wanted = found = 0
    for _ in range(60):
        t = text()
        changed, spans = pii.other_spellings(t, pii.base_spans(t))
        got = pii.model_spans([changed], tagger)[0]
        wanted, found = wanted + len(spans), found + len(set(spans) & set(got))
    assert wanted == 60 and found >= 0.8 * wanted
