"""Quality rules by divergence from language references, all in expressions.

A document's histograms of character classes and of its language's common words are
compared with the language's own, taken over all documents, by the Jensen-Shannon
distance.  Short documents have ragged histograms, so each comparison has a least length.
Every language with documents enough has a reference of its classes, and the spread of its
documents around it sets the limit; a language without a reference is not judged by it.
The references are a few numbers a language; judging a document is work inside its row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.text import let, once
from descry.llm.common import BLANKS, hidden, shown, text_of, words_of
from descry.session import broadcast_if_small, checkpointed

#: Common function words of the languages that have a reference.
COMMON_WORDS = {
    "en": "the of and to in is it that for was on with".split(),
    "fr": "de la le et les des un une que dans pour sur".split(),
    "de": "der die und in den von zu das mit ist des auf".split(),
    "es": "de la que el en y a los se del las un".split(),
}
WORDS_LISTED = 12
#: Documents in no listed language, which have no common words.
ANY = ""
#: Character classes beside letters and digits, blanks, and the rest: pattern of one.
UPPER, DIGIT, STOP, SYMBOL = r"\p{Lu}", "[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]"
#: A text below LEAST_WORDS words fails, as does one of which half the words repeat.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words from which the common words are compared.
LEAST_FOR_WORDS = 100
#: Steps in which shares are counted for the references.
STEPS = 1000
#: Documents of a language from which it has a reference.
LEAST_DOCUMENTS = 20
#: Largest distances, between 0 and 1, at which a document is kept; that of the classes is
#: larger where SPREAD times the median distance of a language's documents is.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, SPREAD = 0.13, 0.35, 3


@dataclass(frozen=True)
class References:
    """Probabilities of character classes, as a table (_lang, reference, most) that holds
    the largest distance too, and of common words by language."""

    classes: DataFrame | dict
    words: dict[str, list[float]]


def kept_columns(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns if c.startswith("__")]


def _listed(column: Column) -> Column:
    """The language if it is listed, else ANY."""
    return F.when(column.isin(*COMMON_WORDS), column).otherwise(F.lit(ANY))


def measured(docs: DataFrame) -> DataFrame:
    """Rows, hidden, beside text, words, n_words, word_chars, n_symbols, language and the
    two histograms as arrays of counts."""
    rows = hidden(
        docs,
        text=text_of("text"),
        language=_listed(F.col("lang")),
        lang=F.col("lang").cast("string"),
    )
    rows = once(
        rows,
        words=words_of(F.col("text")),
        # what is left without letters is short, and holds all classes but two
        marks=F.regexp_replace("text", r"[\p{L}\p{M}]+", ""),
        upper=F.regexp_count("text", F.lit(UPPER)).cast("long"),
    )
    chars, marks = F.char_length("text").cast("long"), F.char_length("marks").cast("long")
    rows = once(
        rows,
        n_words=F.size("words").cast("long"),
        word_chars=F.char_length(F.array_join("words", "")).cast("long"),
        n_symbols=F.regexp_count("marks", F.lit(SYMBOL)).cast("long"),
        digits=F.regexp_count("marks", F.lit(DIGIT)).cast("long"),
        stops=F.regexp_count("marks", F.lit(STOP)).cast("long"),
        letters=chars - marks - F.col("upper"),
        chars=chars,
    )
    blanks = F.col("chars") - F.col("word_chars")
    rest = (
        F.col("chars") - F.col("letters") - F.col("upper") - blanks
        - F.col("n_symbols") - F.col("digits") - F.col("stops")
    )
    classes = F.array(
        F.col("letters") + F.col("digits"), "upper", blanks, "stops", "n_symbols", rest
    )
    return rows.select(
        *kept_columns(rows), "text", "lang", "language", "words", "n_words", "word_chars", "n_symbols",
        classes.alias("classes"), _common(F.col("words"), F.col("language")).alias("common"),
    )


def _common(words: Column, language: Column) -> Column:
    """Counts of the language's common words and of all others; of others only for ANY."""
    size = F.size(words)
    counts = []
    for k in range(WORDS_LISTED):
        word = F.lit(None).cast("string")
        for name, listed in COMMON_WORDS.items():
            word = F.when(language == name, F.lit(listed[k])).otherwise(word)
        counts.append((size - F.size(F.array_remove(words, word))).cast("long"))

    def with_others(found: Column) -> Column:
        known = F.aggregate(found, F.lit(0).cast("long"), lambda a, b: a + b)
        return F.concat(found, F.array(size.cast("long") - known))

    return F.when(language != ANY, let(F.array(*counts), with_others))


def _shares(name: str) -> Column:
    """(name, entry, step) of a histogram's entries: its share in steps of 1 / STEPS."""
    total = F.aggregate(name, F.lit(0).cast("long"), lambda a, b: a + b)
    shares = F.transform(
        name,
        lambda c, i: F.struct(
            F.lit(name).alias("name"),
            i.alias("entry"),
            F.floor(c * STEPS / total + 0.5).alias("step"),
        ),
    )
    return F.when(total > 0, shares).otherwise(F.array())


def language_references(docs: DataFrame) -> References:
    """References over all documents with words enough, of languages with documents enough.

    A share is the median of the documents' shares, in steps of 1 / STEPS, and the medians
    are brought to a sum of one: junk that is less than half of a language doesn't shift
    it.  Nor does it shift the median distance, which sets the limit.  Of common words the
    driver gets counts by listed language, entry and step, a fixed number at most; what
    classes there are stays a table, as languages may be any number.
    """
    rows = measured(docs).where(F.col("n_words") >= LEAST_WORDS)
    rows = checkpointed(rows.select("lang", "language", "n_words", "classes", "common"))
    long = rows.where((F.col("n_words") >= LEAST_FOR_WORDS) & F.col("common").isNotNull())
    counted = long.select("language", F.inline(_shares("common")))
    found = counted.groupBy("language", "entry", "step").count().collect()
    words: dict[str, list[float]] = {}
    for language in COMMON_WORDS:
        entries: dict[int, Counter[int]] = {}
        for x in found:
            if x["language"] == language:
                entries.setdefault(x["entry"], Counter())[x["step"]] += x["count"]
        medians = [_median(entries[k]) for k in sorted(entries)]
        if sum(medians) and sum(entries[0].values()) >= LEAST_DOCUMENTS:
            words[language] = [m / sum(medians) for m in medians]
    return References(_class_references(rows.where("lang IS NOT NULL")), words)


def _class_references(rows: DataFrame) -> DataFrame:
    """(_lang, reference, most) of languages with documents enough, from their histograms."""
    shares = rows.select("lang", F.inline(_shares("classes"))).drop("name")
    medians = _medians(shares, ["lang", "entry"]).where(F.col("n") >= LEAST_DOCUMENTS)
    listed = medians.groupBy("lang").agg(
        F.sum("step").alias("total"),
        F.sort_array(F.collect_list(F.struct("entry", "step"))).alias("entries"),
    )
    found = listed.where("total > 0").select(
        F.col("lang").alias("_lang"),
        F.transform("entries", lambda x: x["step"] / F.col("total")).alias("reference"),
    )
    found = broadcast_if_small(checkpointed(found))
    apart = rows.join(found, F.col("lang") == F.col("_lang")).select(
        "_lang", F.floor(distance(F.col("classes"), F.col("reference")) * STEPS + 0.5).alias("step")
    )
    most = F.greatest(F.lit(MOST_CLASS_DISTANCE), SPREAD * F.col("step") / STEPS)
    limits = _medians(apart, ["_lang"]).select("_lang", most.alias("most"))
    return broadcast_if_small(checkpointed(found.join(limits, "_lang")))


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """The median ``step`` of each group and its number of rows, from counts of steps."""
    counts = rows.groupBy(*by, "step").count()
    group = Window.partitionBy(*by)
    seen = counts.select(
        *by,
        "step",
        F.sum("count").over(group.orderBy("step")).alias("seen"),
        F.sum("count").over(group).alias("n"),
    )
    return seen.where("2 * seen >= n").groupBy(*by).agg(
        F.min("step").alias("step"), F.first("n").alias("n")
    )


def _median(counts: Counter[int]) -> int:
    seen, half = 0, sum(counts.values()) / 2
    for step in sorted(counts):
        seen += counts[step]
        if seen >= half:
            return step
    return 0


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits), 0 without counts."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x * 2 / (x + y))).otherwise(F.lit(0.0))

    def divergence(total: Column) -> Column:
        terms = F.zip_with(
            counts, reference, lambda c, q: let(c / total, lambda p: part(p, q) + part(q, p))
        )
        return F.sqrt(
            F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0))
        )

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
    return let(total, lambda t: F.when(t > 0, divergence(t)).otherwise(F.lit(0.0)))


def _reference(table: dict[str, list[float]], language: Column) -> Column:
    chosen = F.lit(None).cast("array<double>")
    for name, shares in table.items():
        chosen = F.when(language == name, F.array(*[F.lit(s) for s in shares])).otherwise(chosen)
    return chosen


def repeated_words(windows: Column) -> Column:
    """Words inside windows of three that occur again; ``windows`` are the windows' hashes.

    Hashes are sorted with their places; those with an equal neighbour give the places of
    repeated windows, and each such place adds the words up to the next, three at most.
    """
    longs = F.lit(0).cast("long")

    def places(s: Column) -> Column:
        last = F.size(s) - 1

        def place(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.try_element_at(s, F.greatest(i, F.lit(1)))["h"] == x["h"])
            after = (i < last) & (F.try_element_at(s, F.least(i + 2, last + 1))["h"] == x["h"])
            return F.when(before | after, x["p"])

        return F.array_compact(F.transform(s, place))

    def covered(p: Column) -> Column:
        # up to the next place, three words at most
        apart = F.transform(
            p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))
        )
        return F.aggregate(apart, longs, lambda a, x: a + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    found = let(placed, lambda s: F.sort_array(places(s)))
    return F.when(
        F.size(F.array_distinct(windows)) == F.size(windows), longs
    ).otherwise(let(found, covered))


def judged(docs: DataFrame, references: References) -> DataFrame:
    """Rows, hidden, beside n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance and kept.

    A null or empty text has no words, fails and isn't kept.  Languages that have no
    reference, as null and rare ones, are not judged by it: the distance is 0 then.  Rows
    are judged singly, repeated rows alike, and no column of theirs is read but text and
    lang.
    """
    rows = measured(docs)
    if isinstance(references.classes, DataFrame):
        rows = rows.join(references.classes, F.col("lang") == F.col("_lang"), "left")
    else:
        rows = rows.withColumn("reference", F.lit(None).cast("array<double>"))
        rows = rows.withColumn("most", F.lit(None).cast("double"))
    w = F.col("words")
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2])
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    rows = once(
        once(rows, windows=windows),
        n_repeat_words=repeated_words(F.col("windows")).cast("long"),
        n_dup_lines=let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        class_distance=_compared("classes", F.col("reference")),
        word_distance=_compared("common", _reference(references.words, F.col("language"))),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    near = F.coalesce(F.col("class_distance") <= F.col("most"), F.lit(True)) & (
        (F.col("n_words") < LEAST_FOR_WORDS) | (F.col("word_distance") <= MOST_WORD_DISTANCE)
    )
    return rows.select(
        *kept_columns(rows), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "class_distance", "word_distance",
        (~failed & near).alias("kept"),
    )


def _compared(name: str, reference: Column) -> Column:
    return F.coalesce(
        let(reference, lambda q: F.when(q.isNotNull(), distance(F.col(name), q))), F.lit(0.0)
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """Documents, all columns, that the rules keep."""
    rows = judged(docs, language_references(docs)).where("kept")
    return rows.select(*shown(rows))
