"""Text and encoding expressions.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARSET = "ISO-8859-1"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_per_key(items: Column, key: str) -> Column:
    """Structs of an array sorted, and of those with equal ``key`` only the last.

    ``key`` is the structs' first field, a position the second.
    """

    def last(s: Column) -> Column:
        following = F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None)))
        kept = F.zip_with(s, following, lambda a, b: F.when(b.isNull() | (a[key] != b[key]), a))
        return F.filter(kept, lambda x: x.isNotNull())

    return F.when(F.size(items) > 0, let(F.array_sort(items), last)).otherwise(items)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions run exactly once per row.

    Without this, a filter on a costly column is pushed below the projection
    that computes it, and the expression is copied into the filter, once per
    use.  A generator stops that; it stays inside whole-stage code.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))


def as_text(raw: Column) -> Column:
    """Bytes to text, one character per byte, so offsets and digests agree."""
    return F.decode(raw, CHARSET)


def as_bytes(text: Column) -> Column:
    return F.encode(text, CHARSET)


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines_of(text: Column) -> Column:
    """Lines without terminators; a final terminator starts no further line."""
    return F.split(F.regexp_replace(unix_lines(text), r"\n\z", ""), "\n", -1)


def sections(text: Column, start: str) -> Column:
    """Cut a text before each line matching ``start``.

    The first element is what precedes the first such line (after a newline).
    """
    return F.split(F.concat(F.lit("\n"), text), rf"(?<=\n)(?={start})", -1)


def fields_of(line: Column) -> Column:
    """Fields between single blanks; trailing blanks do not make fields."""
    return F.split(F.rtrim(line), " ", -1)


def first_body_line(text: Column) -> Column:
    """The first line that is not an annotation."""
    return F.regexp_extract(text, r"(?dm)\A(?:@[^\n]*\n)*([^@\n][^\n]*|)$", 1)


def last_line_value(text: Column, keyword: str) -> Column:
    """Rest of the last line starting with ``keyword`` and a blank, else null."""
    return F.try_element_at(
        F.regexp_extract_all(text, F.lit(rf"(?dm)^{keyword} (.*)$"), F.lit(1)), F.lit(-1)
    )


def is_hex(text: Column) -> Column:
    return text.rlike(r"\A(?:[0-9a-fA-F]{2})+\z")


def is_base64(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z0-9+/_=\s-]*\z")


def unbase64_unpadded(text: Column) -> Column:
    """Decode base64 whose padding may be missing."""

    plain = F.regexp_replace(F.translate(text, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    # a single character left over after groups of four is dropped
    whole = (F.floor((F.length(plain) + 2) / 4) * 4).cast("int")
    return F.unbase64(F.rpad(plain, whole, "="))


def base64_unpadded(raw: Column) -> Column:
    return F.rtrim(F.base64(raw), F.lit("="))


def base64_to_hex(text: Column) -> Column:
    """Lower-case hex of base64 whose padding may be missing; null when it is no base64."""
    whole = (F.floor((F.length(text) + 2) / 4) * 4).cast("int")
    padded = F.rpad(F.translate(text, "-_", "+/"), whole, "=")
    return F.lower(F.hex(F.try_to_binary(padded, F.lit("base64"))))


def file_path() -> Column:
    """Path of the file a row was read from, as file listings spell it.

    The metadata column encodes blanks and percent signs; a plus sign stays.
    """
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def parse_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))
