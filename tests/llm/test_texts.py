"""SimHash, line dedup, chats, personal data, BPE and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from odd import CLASHES, LONG, ROWS, documents
from pyspark.sql import functions as F

import corpus_pipeline
from descry.llm import bpe, chat, linededup, mixing, pii, quality, simhash, tagger
from descry.llm.components import connected_components, joined_labels
from descry.llm.queries import QUERIES, SQL, vocabulary

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\f\r"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- components ----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng, union = random.Random(seed), Union()
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    links += [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 90)]
    links += [(5, 5), (None, 3), (3, None), (7, None)] + links[:20]
    for a, b in links:
        if a is not None and b is not None and a != b:
            union.join(a, b)
    df = spark.createDataFrame(links, "a int, b int")
    found = {r.node: r.root for r in connected_components(df).collect()}
    assert found == {x: union.find(x) for x in union.up}
    assert connected_components(df.limit(0)).count() == 0


def test_joined_labels():
    label = joined_labels(np.arange(8), np.array([1, 6, 3, 7]), np.array([2, 5, 2, 6]))
    assert label.tolist() == [0, 1, 1, 1, 4, 5, 5, 5]


# --- SimHash -------------------------------------------------------------------------


def slow_print(text, n=3):
    words = (text or "").translate(UPPER).encode().split()
    if not words:
        return 0
    rows = [words[i : i + n] for i in range(len(words) - n + 1)] if len(words) >= n else [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    union, distinct = Union(), sorted({f for _, f in prints})
    for i, a in enumerate(distinct):
        union.find(a)
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                union.join(a, b)
    least = {}
    for doc_id, f in prints:
        root = union.find(f)
        ids = [x for x in (least.get(root), doc_id) if x is not None]
        least[root] = min(ids) if ids else None
    return Counter((d, f, least[union.find(f)]) for d, f in prints)


def test_near_duplicates(spark):
    docs = documents(spark)
    found = simhash.near_duplicates(docs).collect()
    expected = components_of([(i, slow_print(t)) for i, t, *_ in ROWS])
    assert Counter((r.doc_id, int.from_bytes(r.fp, "big"), r.component_id) for r in found) == expected
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.without_near_duplicates(docs, simhash.CLOSE)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in expected}
    assert kept.count() == len({c for _, _, c in expected})


@pytest.mark.parametrize("chunk", [4096, 5])
def test_close_fingerprints_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng, prints = random.Random(1), []
    for _ in range(40):
        now = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 60])):
            near = now
            for _ in range(rng.randrange(4)):
                near ^= 1 << rng.randrange(64)
            prints.append(near)
            now = near if rng.random() < 0.3 else now
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    roots = {r.node: r.root for r in connected_components(simhash.close_links(df)).collect()}
    expected = {f: c for (_, f, c) in components_of([(p, p) for p in prints])}
    for p in prints:
        raw = p.to_bytes(8, "big")
        assert int.from_bytes(roots.get(raw, raw), "big") == expected[p]


def test_similar_texts_are_linked(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(300)), "en", "s") for i in range(50)]
    for i in range(20):
        changed = list(words)
        for _ in range(4):
            changed[rng.randrange(400)] = f"other{rng.randrange(9)}"
        rows.append((100 + i, " ".join(changed), "en", "s"))
    kept = simhash.without_near_duplicates(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [*range(50), 100]


def edited(words, places):
    return " ".join("new" + w if k in places else w for k, w in enumerate(words))


def jaccard(a, b, n=5):
    rows = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split())]
    return len(rows[0] & rows[1]) / len(rows[0] | rows[1])


def test_similarity_is_verified_on_both_sides(spark):
    """Pairs just above 0.8 are linked, pairs just below are not, however fingerprints fall."""
    rng, rows, above, below = random.Random(5), [], 0, 0
    for pair in range(150):
        words = [f"p{pair}x{rng.randrange(9000)}" for _ in range(304)]
        # 300 shingles; so many that each change takes its own five with it
        changes, tail = (6, 3) if pair % 2 else (7, 0)
        text = edited(words, {20 + 30 * k for k in range(changes)} | set(range(304 - tail, 304)))
        j = jaccard(" ".join(words), text)
        assert (0.8 <= j < 0.82) if pair % 2 else (0.78 < j < 0.8)
        above, below = above + (j >= 0.8), below + (j < 0.8)
        rows += [(2 * pair, " ".join(words), "en", "s"), (2 * pair + 1, text, "en", "s")]
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(spark, rows)).collect()}
    assert above == below == 75
    assert kept == {i for i in range(300) if i % 2 == 0 or (i // 2) % 2 == 0}


def test_each_component_keeps_one_row_whatever_its_ids(spark):
    base = [[f"c{c}x{k}" for k in range(200)] for c in range(6)]
    plain, near = [" ".join(w) for w in base], [edited(w, {199}) for w in base]
    rows = [
        *[(None, text, "en", "s") for text in (plain[0], near[0], plain[0], plain[1], plain[2])],
        (7, plain[3], "en", "s"), (7, plain[4], "en", "s"), (7, near[4], "en", "s"),
        (8, near[3], "en", "s"), (None, near[2], "en", "s"), (9, near[2], "en", "s"),
        (10, plain[5], "en", "s"), (10, plain[5], "en", "s"),
    ]
    kept = simhash.without_near_duplicates(documents(spark, rows)).collect()
    found = sorted((r.text[:2], r.doc_id) for r in kept)
    assert found == [("c0", None), ("c1", None), ("c2", 9), ("c3", 7), ("c4", 7), ("c5", 10)]


def test_exceeding():
    rng = np.random.default_rng(0)
    raw = [rng.bytes(8) for _ in range(150)]
    raw[70:80] = [raw[69]] * 10
    planes = simhash.bit_planes(raw, 64)
    values = [int.from_bytes(r, "big") for r in raw]
    full = np.full(3, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for shift in (1, 7, 64, 65):
        for radius in (0, 2, 28):
            over = simhash.exceeding(planes, shift, 3, full, radius)
            bits = np.unpackbits(over.view(np.uint8), bitorder="little")
            for i in range(150 - shift):
                assert bool(bits[i]) == ((values[i] ^ values[i + shift]).bit_count() > radius)


# --- line dedup ----------------------------------------------------------------------


def deduped(rows):
    key = lambda x: x.strip(BLANKS).translate(UPPER)
    holders = defaultdict(set)
    order = lambda i: (i is None, i or 0)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    first = {k: min(v, key=order) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (key(x) in first and first[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def test_shared_lines(spark):
    docs = documents(spark)
    state = linededup.started(docs)
    found = linededup.kept_lines(docs, state).collect()
    expected = deduped([(i, t) for i, t, *_ in ROWS])
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == expected
    assert linededup.without_shared_lines(docs).columns == docs.columns
    assert linededup.without_shared_lines(documents(spark, [])).count() == 0


def test_documents_come_and_go(spark):
    rng = random.Random(5)
    texts = [
        "\n".join(f"a line of number {rng.randrange(40)}" for _ in range(rng.randrange(1, 9)))
        for _ in range(60)
    ]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    state = linededup.started(documents(spark, rows[:20]))
    state = linededup.inserted(state, documents(spark, rows[20:]))
    gone = set(range(0, 60, 3))
    state = linededup.deleted(state, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    for now in (state, linededup.rebuilt(state)):
        rest = [r for r in rows if r[0] not in gone]
        found = linededup.kept_lines(documents(spark, rest), now).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == deduped(
            [(i, t) for i, t, *_ in rest]
        )
    # what was deleted can come back
    state = linededup.inserted(state, documents(spark, [r for r in rows if r[0] in gone]))
    found = linededup.kept_lines(documents(spark, rows), state).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == deduped(
        [(i, t) for i, t, *_ in rows]
    )


def test_cuckoo_filter():
    keys = [hashlib.md5(b"%d" % i).digest() for i in range(6000)]
    hashes = linededup.CuckooFilter.hashes(keys)
    made = linededup.CuckooFilter(expected=3000)
    made.add(hashes[:3000])
    assert not made.full and made.has(hashes[:3000]).all()
    assert made.has(hashes[3000:]).mean() < 0.01
    made.remove(hashes[:1500])
    assert made.has(hashes[1500:3000]).all() and made.has(hashes[:1500]).mean() < 0.01
    small = linededup.CuckooFilter(expected=10)
    small.add(hashes)
    assert small.full and small.has(hashes).all()
    again = linededup.CuckooFilter(made.slots.tobytes())
    assert again.has(hashes[1500:3000]).all()


# --- chats ---------------------------------------------------------------------------


def test_events_are_folded(spark):
    log = [
        (1, 1, "message", 1, "user", "Hi"),
        (1, 2, "message", 2, "assistant", "Hel"),
        (1, 3, "delta", 2, None, "lo"),
        (1, 4, "message", 3, "user", "more?"),
        (1, 5, "message", 4, "assistant", "no"),
        (1, 6, "edit", 1, None, "Hi there"),
        (1, 7, "regenerate", 2, None, "Go"),
        (1, 8, "delta", 2, None, "od day"),
        (1, 9, "delta", 4, None, "lost, its message is gone"),
        (1, 10, "nonsense", 2, None, "x"),
        (2, 5, "delta", 1, "user", "nothing to add to"),
        (None, 1, "message", 1, None, None),
    ]
    rng = random.Random(0)
    rng.shuffle(log)
    events = spark.createDataFrame(log, chat.EVENTS).select("*", *[F.lit(1).alias(c) for c in ("size", "n_turns")])
    found = {r.conv_id: r for r in chat.format_conversations(events).collect()}
    assert chat.read_back(found[1].formatted) == [("user", "Hi there"), ("assistant", "Good day")]
    assert [found[1].formatted[a:b] for a, b in found[1].loss] == ["Good day"]
    assert found[2].formatted == "" and found[2].n_turns == 0
    assert chat.read_back(found[None].formatted) == [("", "")]
    assert chat.format_conversations(events.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_templates_read_back(seed):
    rng = random.Random(seed)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|", "<|", "<", "|", "\\", "\n", "%", "%0A", "a", "é", "assistant"]
    said = lambda: "".join(rng.choices(parts, k=rng.randrange(12)))
    turns = [(rng.choice(["user", "assistant", said()]), said()) for _ in range(5)]
    formatted, loss = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_ties_and_long_texts_stay_turns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, LONG)],
        "conv_id long, turn long, role string, text string",
    )
    (row,) = chat.format_conversations(chat.events_of(turns)).collect()
    assert chat.read_back(row.formatted) == [("", LONG), ("user", "a"), ("user", "a"), ("user", "b")]


# --- personal data -------------------------------------------------------------------


def test_base_spans():
    text = "a.b@c.de x@y 1.2.3.4 999.1.1.1 4111 1111 1111 1111 4111 1111 1111 1112 +1 (555) 123-4567 +12"
    kinds = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert kinds == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("phone", "+1 (555) 123-4567")]
    # the first card's match runs on into the second, fails, and isn't tried again
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans("card 4111-1111-1111-1111.")] == ["card"]
    assert pii.base_spans("") == []


def test_windows_cover_all_triggers():
    text = "x" * 1000 + "7" + "y" * 500 + "@"
    starts = pii.window_starts(text)
    for at in (1000, 1501):
        assert [s for s in starts if s <= at < s + pii.WINDOW]
    assert pii.window_starts("no trigger " * 100) == []


def test_slopes_agree_with_differences():
    rng = np.random.default_rng(0)
    model = tagger.Tagger(5, 1)
    chars, tags = rng.integers(0, tagger.SYMBOLS, (3, 7)), rng.integers(0, 5, (3, 7))
    _, slopes = model.loss_and_slopes(chars, tags)
    for name, weights in model.w.items():
        place = tuple(rng.integers(0, n) for n in weights.shape)
        weights[place] += 1e-5
        above = model.loss_and_slopes(chars, tags)[0]
        weights[place] -= 2e-5
        below = model.loss_and_slopes(chars, tags)[0]
        weights[place] += 1e-5
        assert slopes[name][place] == pytest.approx((above - below) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def trained(spark):
    """A tagger trained on three quarters of the sf0.1 documents, and the texts of the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    texts = [r.text for r in docs.where(held_out).select("text").distinct().collect() if r.text]
    return pii.trained_tagger(docs.where(~held_out)), texts


def test_tagger_finds_new_spellings_in_held_out_texts(trained):
    model, texts = trained
    hits, missed, wrong = Counter(), Counter(), 0
    for turn in range(4):
        for text in (t for t in texts if pii.base_spans(t)):
            said, labels = pii.respelled(text, pii.base_spans(text), turn)
            ((base, added),) = pii.all_spans([said], model)
            for span in set(labels) - set(base):
                (hits if span in added else missed)[span[1]] += 1
            wrong += len(set(added) - set(labels))
    for kind in range(len(pii.KINDS)):
        assert hits[kind] >= 0.8 * (hits[kind] + missed[kind]) > 0
    assert wrong <= 0.02 * hits.total()
    # texts as they are hold what the patterns find and nothing else
    assert not [s for _, added in pii.all_spans(texts, model) for s in added]


@pytest.mark.parametrize("size", [20, 60, 90])
def test_added_spans_of_any_length_at_any_offset(trained, size):
    name = ("long.name-of.someone" * 9)[: size - 14]
    span = f"{name} @ example.com"
    for offset in range(32):
        text = "word " * 10 + "x" * offset + f" {span} and words"
        at = text.index(span)
        assert pii.all_spans([text], trained[0])[0][1] == [(at, 0, at + size)]


def test_tagger_on_plain_prose_and_odd_rows(spark, trained):
    model, _ = trained
    for said in ("555-123-4567", "bob @ example.com", "4111.1111.1111.1111", "bob@[example.com]"):
        text = f"Please note {said} for later"
        ((_, added),) = pii.all_spans([text], model)
        assert [text[a:b] for a, _, b in added] == [said]
    spans = pii.personal_data(documents(spark), model).collect()
    assert len(spans) == len(ROWS) and not [r for r in spans if r.spans]
    digest = pii.span_digest(pii.personal_data(documents(spark), None)).collect()
    assert {r.base_sha256 for r in digest} == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(documents(spark, []), model).count() == 0
    assert pii.trained_tagger(documents(spark, [])) is None


def test_training_set_depends_on_the_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [pii.labelled_windows(docs.repartition(n)) for n in (1, 7)]
    assert found[0] == found[1]
    # rows that share an id are not taken for one, and no more than asked for are
    one_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert pii.sample_of(one_id, most=50).count() == 50


def test_stretches_are_decoded_once(monkeypatch, trained):
    texts = ["no trigger", "", "call 555-123-4567 or " * 40 + "bob @ example.com", "x" * 500 + "7"]
    found = pii.all_spans(texts, trained[0])
    monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", 3)
    assert pii.all_spans(texts, trained[0]) == found
    assert len(found[2][1]) == 41


def test_counts_and_digests_of_a_table(spark, trained):
    """Against a plain loop over the patterns, with the digests written out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = []
    for row in docs.collect():
        spans = []
        for kind in pii.KINDS:
            for m in pii.PATTERNS[kind].finditer(row.text or ""):
                digits = re.sub("[^0-9]", "", m.group())
                holds = {
                    "email": lambda: True,
                    "ip": lambda: max(map(int, m.group().split("."))) <= 255,
                    "card": lambda: 12 <= len(digits) <= 19
                    and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                    "phone": lambda: 9 <= len(digits) <= 15,
                }[kind]
                if holds():
                    spans.append((m.start(), pii.KINDS.index(kind), kind, m.end()))
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        counts = Counter(k for _, _, k, _ in spans)
        expected.append(
            (row.doc_id, *(counts[k] for k in pii.KINDS), hashlib.sha256(said.encode()).hexdigest())
        )
    found = pii.span_digest(pii.personal_data(docs, trained[0])).drop("spans")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_added_spans_spare_base_spans():
    text = "call 555-123-4567 or +1 (555) 123-4567"
    base = pii.base_spans(text)
    found = [(3.0, 5, 3, 17), (9.0, 21, 3, 38), (2.0, 5, 3, 16), (0.5, 0, 3, 4)]
    assert pii.reconciled(text, base, found) == [(5, 3, 17)]
    assert pii.masked(text, base + [(5, 3, 17)]) == "call [phone] or [phone]"


# --- BPE -----------------------------------------------------------------------------

TEXTS = [
    *(t for _, t, *_ in ROWS),
    " \n\n x", "   y  z", "𝔘𝔫𝔦 ½ ١٢٣ \u0085q", "a" * 300, "!!!???" * 20, "'s 'T 's'll",
    "\x00\x01\x7f", "é́", "<|endoftext|>", "tab\tand\u3000wide \u2028 end ",
]


@pytest.fixture(scope="module")
def pieces():
    return bpe.read_ranks(vocabulary())


@pytest.fixture(scope="module")
def encoding(pieces):
    import public_tokenizers

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={}
    )


def test_long_words_are_encoded_in_stretches(spark, monkeypatch, pieces, encoding):
    rng = random.Random(0)
    words = ["".join(rng.choices("etaoinshrdé", k=n)) for n in (32, 33, 64, 65, 200, 3000)]
    words += ["a" * 1001, "abc" * 400, "漢字仮名" * 100, "=" * 2000, "0123456789" * 90]
    words += [("".join(rng.choices("ab漢é", k=rng.randrange(1, 9))) * 200)[:400] for _ in range(30)]
    expected = [encoding._encode_single_piece(w) for w in words]
    docs = spark.createDataFrame(list(enumerate(words)), "i long, word string").repartition(4)
    # a single piece is often too few, so more are merged anew, and all at last
    for remerged in (bpe.REMERGED, (1, 2)):
        monkeypatch.setattr(bpe, "REMERGED", remerged)
        ids = docs.select("i", bpe.Ranks(pieces).encode(F.col("word")).alias("ids")).collect()
        assert [r.ids for r in sorted(ids)] == expected


@pytest.mark.parametrize("few, matrix", [(1, 1 << 18), (8, 100), (1000, 1 << 18)])
def test_words_of_a_block_are_merged_together(spark, monkeypatch, pieces, encoding, few, matrix):
    monkeypatch.setattr(bpe, "FEWEST_ROWS", few)
    monkeypatch.setattr(bpe, "MATRIX", matrix)
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshrdéA漢'", k=rng.randrange(1, 30))) for _ in range(300)]
    words += ["ab" * n for n in range(1, 90)] + ["", "a" * 2000, "é"]
    ids = bpe.Ranks(pieces).merges.encoded(pa.array(words)[5:])
    assert ids.to_pylist() == [encoding._encode_single_piece(w) if w else [] for w in words[5:]]
    # a byte without a rank is a piece of its own, without an id
    merges = bpe.Merges({b"a": 0, b"xy": 1, b"ab": 2})
    assert merges.encoded(pa.array(["xya", "cabx"])).to_pylist() == [[1, 0], [None, 2, None]]
    # blocks go to one worker, and no words come back to be merged
    docs = documents(spark, [(i, w, "en", "s") for i, w in enumerate(words)])
    encoded = bpe.encoded_documents(docs, bpe.Ranks(pieces))
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("block", [1 << 23, 50])
def test_ids_are_those_of_the_library(spark, monkeypatch, pieces, encoding, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    encoded = bpe.encoded_documents(docs, bpe.Ranks(pieces))
    rows = encoded.select("doc_id", "ids", bpe.decode(F.col("ids"), pieces).alias("raw")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == encoding.encode_ordinary(TEXTS[r.doc_id] or "")
        assert bytes(r.raw) == (TEXTS[r.doc_id] or "").encode()
    assert bpe.digested_documents(documents(spark, []), pieces).count() == 0


def digests_of(encoding, doc_id, text):
    ids = encoding.encode_ordinary(text or "")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


# --- pipeline ------------------------------------------------------------------------


def test_stages_on_odd_documents(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for rows in (docs, docs.limit(0)):
        now = rows
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, folder).write.parquet(f"{folder}/{rows.isEmpty()}/{number}")
            now = spark.read.parquet(f"{folder}/{rows.isEmpty()}/{number}")


def test_pipeline_agrees_with_its_steps_by_hand(spark, encoding):
    """The stages' rows from the operators' decisions and plain Python for the rest."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {
        r["__doc_id"]
        for r in quality.judged(docs, quality.language_references(docs)).filter("kept").collect()
    }
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    sources = {r.doc_id: r.source for r in docs.collect()}
    texts = {i: t for i, _, _, t in deduped(sorted(texts.items()))}
    union, scheme = Union(), simhash.SIMILAR
    prints = {i: int.from_bytes(simhash.fingerprint(t.encode(), scheme), "big") for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        union.find(a)
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= scheme.radius:
                union.join(a, b)
    texts = {i: t for i, t in texts.items() if union.find(i) == i}
    rows = spark.createDataFrame(
        [(i, t, "", sources[i]) for i, t in texts.items()], "doc_id long, text string, lang string, source string"
    )
    expected = Counter()
    for r in mixing.mixed(mixing.sized_documents(rows)).collect():
        for _ in range(int(r["taken"] / max(r["size"], 1) + 0.5)):
            expected[digests_of(encoding, r["doc_id"], texts[r["doc_id"]])] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == expected


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert CLASHES


def test_long_runs_of_digits_are_no_trouble():
    """More zeros than a number may have digits; the part is still 1."""
    text = "0" * 5000 + "1.2.3.4 and 1.2.3." + "9" * 6000 + " " + "0" * 5000
    ip = pii.KINDS.index("ip")
    assert [s for s in pii.base_spans(text) if s[1] == ip] == [(0, ip, 5007)]
