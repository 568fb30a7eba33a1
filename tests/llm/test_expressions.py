"""Sharding, quality rules, URL rules and mixing against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import CLASHES, ROWS, documents
from pyspark.sql import functions as F

from descry.llm import mixing, quality, sharding, urlfilter
from descry.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@settings(max_examples=3, deadline=None)
@given(
    st.lists(st.integers(-(2**63), 2**63 - 1), min_size=40, max_size=40),
    st.sampled_from([1, 2, 16, 33, 1000]),
)
def test_jump_hash(spark, keys, shards):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
    assert all(r.s == jump(r.k, shards) for r in rows)


def test_growing_moves_only_into_the_new_shard(spark):
    df = spark.range(20_000).select(
        sharding.jump_shard(F.col("id"), 16).alias("a"), sharding.jump_shard(F.col("id"), 17).alias("b")
    )
    moved = df.filter("a <> b").groupBy("b").count().collect()
    assert [r.b for r in moved] == [16] and 1000 < moved[0]["count"] < 1350


def test_sharded_documents(spark):
    rows = sharding.sharded_documents(documents(spark), 4).collect()
    assert len(rows) == len(ROWS)
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 4), jump(r.doc_id or 0, 5))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded_documents(documents(spark, []), 4).count() == 0


def test_write_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    sharding.write_shards(documents(spark), "doc_id", 3, path)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS) and set(CLASHES) <= set(back.columns)
    assert all(r._shard == jump(r.doc_id or 0, 3) for r in back.collect())


# --- quality -------------------------------------------------------------------------


def measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark):
    docs = documents(spark)
    rows = quality.judged(docs, quality.language_references(docs)).collect()
    found = Counter(
        (r["__doc_id"], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in rows
    )
    assert found == Counter((i, *measures(t)) for i, t, *_ in ROWS)
    assert not [r for r in rows if r.base_failed and r.kept]
    assert quality.good_documents(docs).columns == docs.columns
    empty = documents(spark, [])
    assert quality.judged(empty, quality.language_references(empty)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=20, max_size=20))
def test_repeated_words(spark, texts):
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    found = {
        r["__doc_id"]: r.n_repeat_words
        for r in quality.judged(docs, quality.References({}, {})).collect()
    }
    assert found == {i: measures(t)[4] for i, t, *_ in rows}


def prose(i, word="{}"):
    rng = random.Random(i)
    parts = [
        rng.choice(quality.COMMON_WORDS["en"])
        if rng.random() < 0.4
        else "".join(rng.choices("abdeghilmnorstu", k=7))
        for _ in range(150)
    ]
    return " ".join(word.format(p) + ("." if k % 12 == 11 else "") for k, p in enumerate(parts))


def test_divergence_rejects_junk_and_keeps_prose(spark):
    good = [(i, prose(i), "en", "s") for i in range(60)]
    junk = [(100 + i, prose(i, w), "en", "s") for i, w in enumerate(("{}###", "{} |", "{}$$$ %"))]
    upper = [(200, prose(1).upper(), "en", "s")]
    kept = {r.doc_id for r in quality.good_documents(documents(spark, good + junk + upper)).collect()}
    assert kept == {i for i, *_ in good}


def other_prose(i, letters, words=120):
    rng = random.Random(i)
    return " ".join("".join(rng.choices(letters, k=6)) for _ in range(words)) + "."


def test_each_language_has_its_own_reference(spark):
    """Another script stays whole, and a language of few documents is not judged."""
    hindi = "कखगघचजटडतदनपबमयरलवशसह" + "ािीुूेैोौं्" * 2
    rows = [(i, prose(i), "en", "s") for i in range(60)]
    rows += [(100 + i, other_prose(i, hindi), "hi", "s") for i in range(30)]
    rows += [(200, other_prose(1, hindi).replace(" ", " ## $$ "), "hi", "s")]
    rows += [(300 + i, other_prose(i, "abdeghilmnorstu"), "de", "s") for i in range(30)]
    rows += [(400, other_prose(1, "abdeghilmnorstu").replace(" ", " ## $$ "), "de", "s")]
    rows += [(500 + i, other_prose(i, "0123456789", 120), "fr", "s") for i in range(2)]
    rows += [(600, other_prose(0, hindi), None, "s"), (601, other_prose(1, hindi), "rare", "s")]
    kept = {r.doc_id for r in quality.good_documents(documents(spark, rows)).collect()}
    assert kept == {i for i, *_ in rows} - {200, 400}


def test_short_documents_make_a_reference(spark):
    latin = "abdeghilmnorstu"
    rows = [(i, other_prose(i, latin, 80), "de", "s") for i in range(30)]
    rows += [(100, other_prose(1, latin, 80).replace(" ", " ## $$ "), "de", "s")]
    rows += [(200, other_prose(1, latin), "fr", "s"), (201, other_prose(2, "ABC##", 80), "fr", "s")]
    kept = {r.doc_id for r in quality.good_documents(documents(spark, rows)).collect()}
    assert kept == {i for i, *_ in rows} - {100}


def test_a_wide_language_has_a_wide_limit(spark):
    wide = [(i, prose(i, "{}" + "." * (i % 4)), "en", "s") for i in range(60)]
    found = quality.language_references(documents(spark, wide)).classes.collect()
    assert [r["_lang"] for r in found] == ["en"] and len(found[0].reference) == 6
    assert found[0].most > quality.MOST_CLASS_DISTANCE


def test_distance(spark):
    df = spark.createDataFrame([([3, 1], [0.75, 0.25]), ([5, 0], [0.0, 1.0]), ([0, 0], [0.5, 0.5])],
                               "c array<long>, q array<double>")
    found = [r.d for r in df.select(quality.distance(F.col("c"), F.col("q")).alias("d")).collect()]
    assert found == pytest.approx([0.0, 1.0, 0.0])


# --- URL rules -----------------------------------------------------------------------

URLS = {
    "http://net/x": ("net", "/x", "net/", "block"),
    "https://A.B.NET/": ("a.b.net", "/", "net/", "block"),
    "https://example.net/en/a?q#f": ("example.net", "/en/a", "example.net/en/", "allow"),
    "https://example.net/EN/a": ("example.net", "/EN/a", "net/", "block"),
    "https://myexample.net/en/": ("myexample.net", "/en/", "net/", "block"),
    "http://www.example.com/de/1": ("www.example.com", "/de/1", "example.com/de/", "block"),
    "http://www.example.com/de": ("www.example.com", "/de", None, "allow"),
    "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://x.org/fr/wp-admin/": ("x.org", "/fr/wp-admin/", "org/fr/", "allow"),
    "http://x.org/wp-admin/a": ("x.org", "/wp-admin/a", None, "block"),
    "http://x.org/login": ("x.org", "/login", None, "block"),
    "http://ads.x.org/": ("ads.x.org", "/", None, "block"),
    "http://x.net?a=/b/": ("x.net", "", None, "allow"),
    "no scheme/net/": ("", "", None, "allow"),
    "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    df = df.select("*", *[F.lit("own").alias(c) for c in CLASHES])
    for rows in (df, df.union(df)):
        found = urlfilter.judged_urls(rows).collect()
        assert len(found) == rows.count()
        assert {r["__url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == URLS
    assert urlfilter.judged_urls(df.limit(0)).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    pages = spark.createDataFrame(
        [(f"http://a{i}.example.net/en/{i}",) for i in range(5)] + [("http://q.org/fr/",)], "url string"
    )
    places = urlfilter.index_places(pages, urlfilter.PLACES)
    assert {r.name: t for r, t in places.items()} == {
        "net/": "host:net",
        "example.net/en/": "host:example",
        "example.com/de/": "host:com",
        "org/fr/": "host:org",
    }
    with pytest.raises(ValueError):
        urlfilter.judged_urls(pages, [urlfilter.PLACES[0]] * (urlfilter.MOST_RULES + 1))


# --- mixing --------------------------------------------------------------------------


def targets_by_rounds(sizes):
    """Shares above their cap are cut and the excess goes to the rest by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    cap, total = {s: 3 * sizes[s] for s in names}, sum(sizes.values())
    share = {s: 0.0 for s in names}
    rest, open_ = float(total), set(names)
    for _ in range(10_000):
        if rest < 1e-9 or not open_:
            break
        w = sum(weight[s] for s in open_)
        share = {s: share[s] + (rest * weight[s] / w if s in open_ else 0) for s in names}
        rest = sum(max(0.0, share[s] - cap[s]) for s in names)
        share = {s: min(share[s], float(cap[s])) for s in names}
        open_ = {s for s in names if share[s] < cap[s]}
    return share


@pytest.mark.parametrize("sources", [["a", "b", "c"], ["x", None, "B", "é", "y", "z"], ["only"]])
def test_mixing(spark, sources):
    rows = [
        (i, " ".join(["w"] * (1 + i * i % 23)), "en", sources[i * i % len(sources)]) for i in range(200)
    ]
    rows += [(900, "big " * 3000, "en", sources[0]), (901, None, None, None), (901, None, None, None)]
    docs = documents(spark, rows)
    found = mixing.mixed(mixing.sized_documents(docs)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    expected, taken = targets_by_rounds(sizes), Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert len(r["positions"]) == -(-r["taken"] // r["size"] if r["size"] else 0)
        assert r["positions"] == sorted(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    again = mixing.mixed(mixing.sized_documents(docs.repartition(7))).collect()
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_training_order(spark):
    docs = documents(spark)
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    assert {r.doc_id for r in ordered.collect()} <= {i for i, t, *_ in ROWS if (t or "").split()}
    assert mixing.training_order(documents(spark, [])).count() == 0


def test_the_mix_is_sorted_by_ranges(spark, tmp_path, monkeypatch):
    """op9 adds up the sorted mix; ties of position go by doc_id, left-out rows come last."""
    rows = [(i // 2, "w " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(120)]
    rows += [(500, "big " * 900, "en", "a"), (501, None, None, None), (None, "x y", "en", None)]
    rows += [(i, "tie", "en", f"s{i}") for i in range(600, 630)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    made, sort = [], mixing.in_training_order
    monkeypatch.setattr(
        mixing, "in_training_order", lambda *a: made.append(sort(*a)) or made[-1]
    )
    found = QUERIES["op9_curriculum_mixing"](spark, str(tmp_path)).collect()
    (mix,) = made
    last = float("inf")
    key = lambda r: (last if r.position is None else r.position, r.doc_id is None, r.doc_id or 0, r.size, r.row)
    listed = mix.collect()
    assert [key(r) for r in listed] == sorted(map(key, listed))
    assert listed[-1].position is None and listed[-1].words == 0
    assert all(0 < r.words <= r.size for r in listed if r.position is not None)
    docs = documents(spark, rows)
    plain = mixing.mixed(mixing.sized_documents(docs)).collect()
    first = lambda r: r.positions[0] if r.positions else None
    expected = Counter((r.doc_id, r.size, r.source_size, r.target, r.taken, first(r)) for r in plain)
    assert Counter(map(tuple, found)) == expected


def test_positions_invert_the_schedule(spark):
    for knots in mixing.SCHEDULES:
        grid = [i / 1000 for i in range(1001)]

        def weight(t):
            for (x, v), (y, w) in zip(knots, knots[1:]):
                if t <= y:
                    return v + (w - v) * (t - x) / (y - x)
            return knots[-1][1]

        area, shares = 0.0, [0.0]
        for a, b in zip(grid, grid[1:]):
            area += (b - a) * (weight(a) + weight(b)) / 2
            shares.append(area)
        df = spark.createDataFrame([(s / area,) for s in shares], "s double")
        found = [r.p for r in df.select(mixing.due_position(F.col("s"), knots).alias("p")).collect()]
        assert found == pytest.approx(grid, abs=1e-6)
