"""Collocations, source divergence and page texts against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from odd import CLASHES, LONG, ROWS, documents
from pyspark.sql import functions as F

from descry.llm import divergence, extraction, phrases

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


# --- collocations ------------------------------------------------------------------------


def collocations_by_hand(rows, least, longest, most_inside, most):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    found = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = Counter()
        for q, n in candidates.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    longer[q[i : i + size]] = max(longer[q[i : i + size]], n)
        kept = []
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= most_inside * a:
                continue
            cuts = [
                (1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))
            ]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:most], 1):
            found.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(found)


def speech(rng, n):
    words = "the of sea wind over old Stone é naïve 日本 x".split()
    weights = [9, 8, 5, 4, 3, 3, 2, 2, 2, 1, 1]
    text = " ".join(rng.choices(words, weights, k=n))
    return re.sub(r" (?=\S+ \S+ x)", lambda m: rng.choice([" ", ". ", ",\t", "\n", "  "]), text)


# with one cell for all, everything is active at once and counted in one cycle all the same
@pytest.mark.parametrize("shards, cells, longest", [(1, 1 << 15, 3), (3, 1 << 15, 4), (2, 1, 3)])
def test_collocations(spark, shards, cells, longest):
    rng = random.Random(shards)
    rows = [(speech(rng, rng.randrange(60)), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("red herring. red herring! red herring", "en")] * 5 + [(None, "en"), ("", None)]
    rows += [("one two three", "xx")] * 12
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = phrases.collocations(df, 6, longest, 50, 25, shards, cells)
    assert sorted(map(tuple, found.collect())) == collocations_by_hand(rows, 6, longest, 50, 25)


def test_collocations_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 1000)
    rows = [(text, lang) for _, text, lang, _ in ROWS]
    found = phrases.collocations(documents(spark), 2, 3, 50, 50, 2, 1 << 15)
    assert sorted(map(tuple, found.collect())) == collocations_by_hand(rows, 2, 3, 50, 50)
    empty = phrases.collocations(documents(spark).limit(0), 2, 3, 50, 50, 2, 1 << 15)
    assert empty.count() == 0 and empty.columns == found.columns


def test_only_frequent_phrases_are_spelled():
    """Running counts go by hashes; what may be frequent is spelled once, with exact counts."""
    words, piece = phrases._split(pa.array(["", "x B a  b.\ta b", "É,,a\tb \n", "b a"])[1:])
    assert words.to_pylist() == "x b a b a b É a b b a".split()
    runs = [list(words.take(np.flatnonzero(piece == k)).to_pylist()) for k in dict.fromkeys(piece)]
    assert runs == [["x", "b", "a", "b"], ["a", "b"], ["É"], ["a", "b"], ["b", "a"]]
    marks = phrases.Marks(3, 1 << 15)
    rows = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    counted = lambda step, first=99: rows(phrases._counted("en", words, piece, first, marks, step, 2, 3))
    assert sorted(n for *_, n in counted(0)) == [1, 1, 4, 5]
    _, _, hashes = phrases._numbered(pa.array(["a", "b"]), "en")
    marks.steps[1][(hashes & np.uint64(marks.cells - 1)).astype(int)] = 0
    key = lambda x, y: int((phrases._turned(x) ^ y).view(np.int64))
    ab, ba = key(*hashes), key(*hashes[::-1])
    assert [r for r in counted(1) if r[0] == 2] == [(2, 1, ba, 2), (2, 1, ab, 3)]
    assert [r for r in counted(2, 4)] == [(2, 1, ba, 1), (2, 1, ab, 1)]
    assert counted(3) == []
    frequent = phrases.Frequent(3, 1 << 15)
    spelled = lambda first=99: rows(phrases._spelled("en", words, piece, first, frequent, 3))
    assert spelled() == [("en", 0, "", 11)]
    for size, cells in ((1, hashes), (2, np.array([ab]).view(np.uint64))):
        for cell in (cells & np.uint64(frequent.cells - 1)).tolist():
            frequent.bits[size][cell >> 3] |= 1 << (cell & 7)
    expected = {("en", 0, "", 11), ("en", 1, "a", 4), ("en", 1, "b", 5), ("en", 2, "a b", 3)}
    assert set(spelled()) == expected and len(spelled()) == 4
    assert ("en", 2, "a b", 1) in spelled(4)


def test_scores_beyond_64_bits(spark):
    """Products of counts that no long holds."""
    a = 3_000_000_000_000_000
    counts = [("en", 0, "", 10 * a), ("en", 1, "u", 2 * a), ("en", 1, "v", a + 7), ("en", 2, "u v", a)]
    df = spark.createDataFrame(counts, "lang string, size int, phrase string, n long")
    row = phrases.scored_phrases(df).first()
    assert (row.a, row.l, row.r) == (a, 2 * a, a + 7)
    assert row.score == 1_000_000 * a * a // (2 * a * (a + 7))


# --- divergence ----------------------------------------------------------------------------


def divergence_by_hand(rows, least, most):
    docs = [(lang or "", source or "", re.findall(TERM, lower(text))) for text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held, total = Counter(), Counter()
        counts = {source: Counter() for _, source, _ in own}
        for _, source, terms in own:
            held.update(set(terms))
            total.update(terms)
            counts[source].update(terms)
        kept = [t for t in total if held[t] >= least]
        share = lambda c: lambda t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))
        p = {s: dict(zip(kept, map(share(c), kept))) for s, c in counts.items()}
        q = dict(zip(kept, map(share(total), kept)))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                found += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(ranked, 1)]
    return sorted(found)


@pytest.mark.parametrize("block, returned", [(1 << 18, 1 << 20), (5, 4)])
def test_divergence(spark, monkeypatch, block, returned):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(divergence, "LARGEST_BLOCK", block)
    monkeypatch.setattr(divergence, "ROWS_RETURNED", returned)
    monkeypatch.setattr(divergence, "CHARACTERS_AT_ONCE", 50 * returned)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzß"] + ["UP"]
    rows = []
    for k in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "s3", None, "é"])
        own = words[: 5 + hash_of(source) % 15]
        rows.append((" ".join(rng.choices(own, k=rng.randrange(12))) + "1a_b", lang, source))
    rows += [(None, "en", "silent"), ("", "lonely", "one"), ("aa bb", "rare", "a"), ("aa", "rare", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    found = divergence.source_divergence(df, 9, 7)
    assert sorted(map(tuple, found.collect())) == divergence_by_hand(rows, 9, 7)


def hash_of(source):
    return sum(map(ord, source or ""))


def test_divergence_of_odd_rows(spark):
    rows = [(text, lang, source) for _, text, lang, source in ROWS]
    found = divergence.source_divergence(documents(spark), 2, 5)
    assert sorted(map(tuple, found.collect())) == divergence_by_hand(rows, 2, 5)
    assert divergence.source_divergence(documents(spark).limit(0)).count() == 0


def test_exact_shares(spark):
    n, d = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000
    df = spark.createDataFrame([(n, d)], "n long, d long")
    assert df.select(divergence.share(F.col("n"), F.col("d"))).first()[0] == 1 + 10**9 * n // d


# --- page texts --------------------------------------------------------------------------------

MENU = "<nav><ul><li><a href=/a>Home<li>About</ul></nav>"


class Blocks(HTMLParser):
    """Texts between block tags of well-formed html, in order."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.blocks = [""]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in extraction.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    handle_endtag = lambda self, tag: self.handle_starttag(tag, ())

    def handle_data(self, data):
        self.blocks[-1] += data


def texts_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extraction.extracted_pages(df, **more)
    return {r["__page_id"]: r["text"] for r in found.collect()}


def test_pages_agree_with_a_plain_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["__page_id"]: r for r in extraction.extracted_pages(df).collect()}
    assert len(found) == df.count()
    for row in df.collect():
        inner = re.search("(?s)<article>(.*?)</article>", row.html).group(1)
        blocks = [" ".join(b.split()) for b in Blocks(inner).blocks]
        want = "\n\n".join(b for b in blocks if b)
        assert (found[row.page_id].text, found[row.page_id].n_chars) == (want, len(want))


def test_what_a_site_repeats_goes(spark):
    """No tag or class tells the boxes; a host's other pages do."""
    box = "<div><p>Sign our petition</p><div>Call 555</div></div>"
    page = lambda k: f"<body><div>{box}<section><p>Text {k}</p><p>Same words</p></section></div></body>"
    rows = [(k, "http://site.example/x", page(k)) for k in range(8)]
    rows += [(100 + k, "http://few.example/", page(k)) for k in range(3)]
    texts = texts_of(spark, rows)
    for k in range(8):
        assert texts[k] == f"Text {k}"  # the shared paragraph went with the site's template
    for k in range(3):
        assert texts[100 + k] == f"Sign our petition\n\nCall 555\n\nText {k}\n\nSame words"


def test_copies_of_an_article_stay(spark):
    article = "<article><h1>News</h1><p>All of it.</p><div class=teaser><p>Read {}</p></div></article>"
    rows = [(k, "http://a.example/", f"<p>{k}</p>" + article.format("more")) for k in range(9)]
    rows += [(50 + k, "http://b.example/", f"<div>{k}</div><div><p>Same</p></div>") for k in range(1)]
    rows += [(60 + k, "http://c.example/", "<div><p>Same page</p></div>") for k in range(9)]
    texts = texts_of(spark, rows)
    # a box inside articles that all share is template, their paragraphs are not
    assert {texts[k] for k in range(9)} == {"News\n\nAll of it."}
    assert {texts[60 + k] for k in range(9)} == {"Same page"}  # equal pages count once


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<b>b</b>c <i> d</i>\n\te<br>f", "abc d e f"),
        ("<article><p>x &lt;b&gt; &amp;amp; &eacute; &#233;&nbsp;y &am &unknown;</article>",
         "x <b> &amp; é é y &am &unknown;"),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", "1\n\n2\n\n3\n\n4"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t<!-- <p>no -->u", "tu"),
        ("<main>m<article>in<aside>no</aside></article></main>out", "in"),
        ("<div role=main>x</div><div hidden>y</div><div style='display: none'>z</div>", "x"),
        ("<div class='post has-sidebar'>x</div><div class=sidebar-left>y</div>", "x"),
        ("<div class='comments'><article>c</article></div><p>t", "t"),
        ("<form><input><article>kept</article></form><form>gone</form>", "kept"),
        ("<header>no</header><article><header><h1>yes</h1></header>t", "yes\n\nt"),
        ("<p title='a>b'>quoted <a href=\"x", "quoted"),
        ("a < b <3 c", "a < b <3 c"),
        ("</div></p>x</article>", "x"),
        ("<title>no</title>", ""),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", "1\n\n2\n\n3\n\n4"),
    ],
)
def test_markup(page, text):
    assert extraction.read_page(page)[1] == text


def test_odd_pages(spark):
    rows = [(k, u, h) for k, (u, h) in enumerate([
        (None, None), ("http://h.example", None), (None, "<p>x"), ("no host", "<p>y"), ("", ""),
        ("http://h.example/", f"<p>{LONG}"), ("http://h.example/", "<div>" * 5000 + "deep"),
    ])]
    rows += [rows[2], rows[2]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in ("page_id", "url")])
    found = extraction.extracted_pages(df)
    texts = sorted((r["__page_id"], r["text"], r["n_chars"], r["__text_crc32"]) for r in found.collect())
    want = [(0, ""), (1, ""), (2, "x"), (2, "x"), (2, "x"), (3, "y"), (4, ""), (5, LONG), (6, "deep")]
    assert texts == [(k, t, len(t), "own text_crc32") for k, t in want]
    assert extraction.extracted_pages(df.limit(0)).count() == 0
