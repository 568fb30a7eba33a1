"""Personal data in texts: fixed patterns, and a character tagger that finds more.

The tagger is a bidirectional LSTM with CRF transitions, trained on spans that the
patterns label in a bounded sample of documents, also respelled as no pattern knows them.
It reads a text in windows that overlap by half.  The scores of windows that overlap are
added up, and each stretch of them is decoded once, so a span may have any length and lie
anywhere.  No kind of personal data is without a digit or an ``@``, so only windows near
one are read: a span elsewhere would not count.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.tagger import PAD, Tagger, numbers, train

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the kinds.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Documents whose spans train the tagger at most, and windows of them at most, half of
#: them with a span where there are as many.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 8192, 8192
STEPS = 600
WINDOW, STRIDE = 64, 32
#: Ends of the hosts that addresses in the training set are given.
ENDS = ("com", "org", "net", "de", "fr", "es", "info")
TRIGGER = re.compile(r"[0-9@]")
#: Least margin, averaged over a span, for the tagger's word to be taken.
MARGIN = 0.0
#: Windows decoded together, where one stretch has no more: a bound on memory only.
WINDOWS_AT_ONCE = 2048
#: Windows read on both sides of those that hold a trigger.
BESIDE = 2

#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _holds(kind: str, found: str) -> bool:
    """What a match must fulfil beyond its pattern."""
    if kind == "ip":
        # a part may have more zeros in front than int() takes
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    digits = _digits(found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end) of the patterns' matches, sorted; leftmost first in a
    kind, without overlaps, matches that fail dropped."""
    kinds = [k for k in KINDS if k != "email" or "@" in text]
    return sorted(
        (m.start(), KINDS.index(kind), m.end())
        for kind in kinds
        for m in PATTERNS[kind].finditer(text)
        if _holds(kind, m.group())
    )


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a trigger, and of BESIDE more on both sides."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    starts, known = [], 0
    for m in TRIGGER.finditer(text):
        low = (m.start() - WINDOW) // STRIDE + 1 - BESIDE
        high = min(m.start() // STRIDE + BESIDE, last)
        starts += range(max(low, known), high + 1)
        known = max(known, high + 1)
    return [s * STRIDE for s in starts]


def _tags(size: int, start: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for low, kind, high in spans:
        a, b = max(low - start, 0), min(high - start, size)
        if a < b:
            tags[a:b] = 2 + 2 * kind
            if low >= start:
                tags[a] = 1 + 2 * kind
    return tags


def _invented(words: list[str], rng: random.Random) -> tuple[str, str]:
    """Name and host of an address, of words of the text."""
    name = rng.choice("._-").join(rng.choices(words, k=rng.choice((1, 1, 2, 4, 10, 20))))
    return name, ".".join([*rng.choices(words, k=rng.choice((1, 1, 2, 4))), rng.choice(ENDS)])


def _respellings(kind: str, said: str, words: list[str], rng: random.Random) -> list[str]:
    """A span's text in spellings that the patterns don't know; half of the addresses get
    another name and host."""
    if kind == "email":
        name, _, host = said.partition("@")
        if words and rng.random() < 0.5:
            name, host = _invented(words, rng)
        return [f"{name} @ {host}", f"{name}@[{host}]", f"{name}@ {host}", f"{name} @{host}"]
    if kind == "ip":
        return [p.join(said.split(".")) for p in ("-", " . ", ". ", " ")]
    digits = _digits(said)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [p.join(fours) for p in (".", "/", " - ", "  ")]
    local = digits[-10:]
    parts = local[:-7], local[-7:-4], local[-4:]
    return ["({}) {}-{}".format(*parts), *(p.join(parts) for p in "-. /")]


def respelled(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """The text with its spans written otherwise; ``turn`` chooses among the spellings."""
    pieces, moved, at, size = [], [], 0, 0
    rng, words = random.Random(turn), re.findall("[A-Za-z]{2,12}", text)
    for number, (low, kind, high) in enumerate(spans):
        if low < at:
            continue
        ways = _respellings(KINDS[kind], text[low:high], words, rng)
        said = ways[(turn + number) % len(ways)]
        pieces += [text[at:low], said]
        size += low - at
        moved.append((size, kind, size + len(said)))
        size += len(said)
        at = high
    return "".join([*pieces, text[at:]]), moved


def sample_of(docs: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Texts of the different rows that come first by a hash of doc_id and text."""
    rows = docs.select(F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("_row"))
    first = rows.select("_row").distinct().orderBy("_row").limit(most)
    return rows.join(F.broadcast(first), "_row", "left_semi").dropDuplicates(["_row"]).select("text")


def labelled_windows(docs: DataFrame, most: int = SAMPLE_WINDOWS) -> list[tuple[bytes, bytes]]:
    """Characters' numbers and tags of the windows of a bounded sample of documents.

    A text with spans comes as it is and respelled twice, in ways chosen by its checksum.
    Of the windows, with and without a span, those first by a hash are taken, so that the
    training set depends on the rows alone.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, tags = [], []
            for item in batch.column(0):
                text = item.as_py() or ""
                spans = base_spans(text)
                versions = [(text, spans)]
                if spans:
                    turn = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                    versions += [respelled(text, spans, turn + k) for k in (0, 1)]
                for said, labels in versions:
                    for start in window_starts(said):
                        part = said[start : start + WINDOW]
                        padded = np.full(WINDOW, PAD)
                        padded[: len(part)] = numbers(part)
                        chars.append(padded.astype(np.uint8).tobytes())
                        tags.append(_tags(WINDOW, start, labels).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(chars, pa.binary()), pa.array(tags, pa.binary())], ["chars", "tags"]
            )

    found = sample_of(docs).mapInArrow(windows, "chars binary, tags binary")
    order = [F.xxhash64("chars"), "chars", "tags"]
    holds = F.col("tags") != F.lit(bytes(WINDOW))
    halves = [found.where(h).orderBy(*order).limit(most // 2) for h in (holds, ~holds)]
    return [(bytes(r["chars"]), bytes(r["tags"])) for half in halves for r in half.collect()]


def trained_tagger(docs: DataFrame, steps: int = STEPS) -> Tagger | None:
    """A tagger trained on documents; none where the sample has no spans."""
    rows = labelled_windows(docs)
    as_numbers = lambda part: np.frombuffer(b"".join(part), np.uint8).astype(np.int64)
    if not rows:
        return None
    chars = as_numbers([c for c, _ in rows]).reshape(-1, WINDOW)
    tags = as_numbers([t for _, t in rows]).reshape(-1, WINDOW)
    return train(chars, tags, TAGS, steps) if tags.any() else None


def plausible(kind: int, said: str) -> bool:
    """Whether a span that the tagger found can be of its kind.

    An address has one ``@`` with something on both sides; numbers have as many digits as
    the kind and, but for separators, nothing else.
    """
    digits = _digits(said)
    if KINDS[kind] == "email":
        left, at, right = said.strip("[]").partition("@")
        return bool(at and left.strip(" [") and re.search(r"[A-Za-z0-9]\.[A-Za-z]", right))
    if re.search(r"[^0-9 ().+/-]", said):
        return False
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "ip":
        return len(parts := re.split(r"[ .-]+", said)) == 4 and all(
            p and len(p) <= 3 and int(p) < 256 for p in parts
        )
    return 10 <= len(digits) <= 15 and bool(re.search("[ ().-]", said))


def _runs(tags: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind, end, mean margin) of the runs of a stretch."""
    at, inside = 0, np.flatnonzero(tags)
    for first in inside.tolist():
        if first < at:
            continue
        kind, at = (int(tags[first]) - 1) // 2, first + 1
        while at < len(tags) and tags[at] == 2 + 2 * kind:
            at += 1
        yield first, kind, at, float(margin[first:at].mean())


def whole_words(text: str, low: int, high: int) -> tuple[int, int]:
    """A span widened to whole words, without what can't stand at its ends."""
    while 0 < low < high and text[low - 1].isalnum() and text[low].isalnum():
        low -= 1
    while low < high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
        high += 1
    while low < high and not (text[low].isalnum() or text[low] in "([+"):
        low += 1
    while low < high and not (text[high - 1].isalnum() or text[high - 1] == "]"):
        high -= 1
    return low, high


#: How much a window's scores count at each of its characters: most in its middle.
WEIGHTS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)) / (WINDOW // 2)


def stretches(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of windows, each of which overlaps the next, as slices of their starts."""
    cuts = [0, *(i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > STRIDE), len(starts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def reconciled(text: str, base: list[Span], found: list[tuple[float, int, int, int]]) -> list[Span]:
    """Spans to add: of those that overlap, over all windows, the one with the best margin;
    none that touches a base span, stands inside a longer word, or can't be of its kind."""
    taken = np.zeros(len(text) + 1, bool)
    for low, _, high in base:
        taken[low:high] = True
    added = []
    for margin, low, kind, high in sorted(found, key=lambda s: (-s[0], s[1], s[2], s[3])):
        inside = (low > 0 and text[low - 1].isalnum() and text[low].isalnum()) or (
            high < len(text) and text[high].isalnum() and text[high - 1].isalnum()
        )
        if margin < MARGIN or inside or taken[low:high].any():
            continue
        if plausible(kind, text[low:high]):
            taken[low:high] = True
            added.append((low, kind, high))
    return sorted(added)


def _summed(model: Tagger, text: str, starts: list[int]) -> np.ndarray:
    """Scores of tags, (characters, tags), of a stretch: means over its windows."""
    size = min(starts[-1] + WINDOW, len(text)) - starts[0]
    total, weight = np.zeros((size, model.tags)), np.zeros((size, 1))
    for first in range(0, len(starts), WINDOWS_AT_ONCE):
        some = starts[first : first + WINDOWS_AT_ONCE]
        scores = model.emissions(_chars([(text, s) for s in some]))
        _add(total, weight, scores, [s - starts[0] for s in some])
    return total / weight


def _chars(windows: list[tuple[str, int]]) -> np.ndarray:
    chars = np.full((len(windows), WINDOW), PAD)
    for k, (text, start) in enumerate(windows):
        part = numbers(text[start : start + WINDOW])
        chars[k, : len(part)] = part
    return chars


def _add(total: np.ndarray, weight: np.ndarray, scores: np.ndarray, places: list[int]) -> None:
    for k, at in enumerate(places):
        size = min(WINDOW, len(total) - at)
        total[at : at + size] += scores[:size, k] * WEIGHTS[:size, None]
        weight[at : at + size, 0] += WEIGHTS[:size]


def _found(model: Tagger, texts: list[str]) -> Iterator[tuple[int, Span, float]]:
    """(text's number, span, margin) of what the tagger finds, stretch by stretch."""
    waiting: list[tuple[int, list[int]]] = []

    def decoded() -> Iterator[tuple[int, Span, float]]:
        scores = model.emissions(_chars([(texts[r], s) for r, starts in waiting for s in starts]))
        done, sums = 0, []
        for row, starts in waiting:
            size = min(starts[-1] + WINDOW, len(texts[row])) - starts[0]
            total, weight = np.zeros((size, model.tags)), np.zeros((size, 1))
            places = [s - starts[0] for s in starts]
            _add(total, weight, scores[:, done : done + len(starts)], places)
            done += len(starts)
            sums.append((row, starts[0], total / weight))
        yield from spans_of(sums)

    def spans_of(sums: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, Span, float]]:
        for low in range(0, len(sums := sorted(sums, key=lambda s: len(s[2]))), 256):
            some = sums[low : low + 256]
            tags, margins = model.best([s for _, _, s in some])
            for (row, start, s), t, m in zip(some, tags, margins, strict=True):
                for a, kind, b, margin in _runs(t[: len(s)], m[: len(s)]):
                    yield row, (start + a, kind, start + b), margin

    held = 0
    for row, text in enumerate(texts):
        starts = window_starts(text)
        for a, b in stretches(starts):
            if b - a > WINDOWS_AT_ONCE:
                yield from spans_of([(row, starts[a], _summed(model, text, starts[a:b]))])
                continue
            if held + b - a > WINDOWS_AT_ONCE:
                yield from decoded()
                waiting.clear()
                held = 0
            waiting.append((row, starts[a:b]))
            held += b - a
    if waiting:
        yield from decoded()


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    if model is not None:
        for row, (low, kind, high), margin in _found(model, texts):
            low, high = whole_words(texts[row], low, high)
            if low < high:
                found[row].append((margin, low, kind, high))
    return [(b, reconciled(t, b, f)) for t, b, f in zip(texts, base, found, strict=True)]


SPANS = "array<struct<kind: string, start: long, stop: long, base: boolean>>"


def personal_data(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """(doc_id, spans): kind, start, stop in code points and whether a pattern found it.

    Spans are sorted by start, then kind in the order of KINDS, then end.  A null or empty
    text has none.  Rows are read singly, so repeated rows give repeated rows; no column
    but doc_id and text is read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]
        )
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for base, added in all_spans(texts, model):
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                rows.append(
                    [
                        {"kind": KINDS[k], "start": a, "stop": b, "base": fixed}
                        for a, k, b, fixed in spans
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(kind_of))], ["doc_id", "spans"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(find, f"doc_id long, spans {SPANS}")


def span_digest(spans: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, the digest of the base spans, and all spans."""

    def joined(column):
        said = F.transform(
            column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
        )
        return F.array_join(said, ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    pieces, at = [], 0
    for low, kind, high in sorted(spans):
        if high <= at:
            continue
        pieces += [text[at : max(low, at)], f"[{KINDS[kind]}]"]
        at = high
    return "".join([*pieces, text[at:]])
