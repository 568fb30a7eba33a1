"""The file index: per-file facts, upkeep, and its export as a tree."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.formats import DELETION_GRACE
from descry.functions.digests import file_digest
from descry.functions.text import as_text, let, sections, unix_lines
from descry.functions.times import at
from descry.operators.archive import annotated_kind
from descry.operators.documents import document_time


def index_file(files: DataFrame) -> DataFrame:
    """Index facts of files (path, content, length, modificationTime).

    One file is one row, so types and times are found inside the row.  Documents
    in a file start with a type annotation; what precedes the first or does not
    parse is ignored.
    """
    return document_facts(files).select(
        "path",
        F.col("length").alias("size"),
        F.date_trunc("minute", "modificationTime").alias("last_modified"),
        "types",
        "first_published",
        "last_published",
        file_digest(F.col("content")).alias("sha256"),
    )


def index_parts(parts: DataFrame) -> DataFrame:
    """Index facts (without last_modified) of files from their parts (path, raw, size, sha256).

    Parts are members of an archive or pieces of a file, each a row; a last row has the size
    and the digest of the whole, in hex.  A file without such a row was not read to its end
    and is left out.  Types are few, so the sets are bounded.
    """
    facts = document_facts(parts.withColumnRenamed("raw", "content"))
    return (
        facts.groupBy("path")
        .agg(
            F.max("size").alias("size"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
            F.min("first_published").alias("first_published"),
            F.max("last_published").alias("last_published"),
            F.base64(F.unhex(F.max("sha256"))).alias("sha256"),
        )
        .filter(F.col("size").isNotNull())
    )


def document_facts(files: DataFrame) -> DataFrame:
    """Types and first and last time of the documents in ``content``, beside all columns."""
    text = unix_lines(as_text(F.col("content")))
    documents = F.filter(sections(text, "@type "), lambda d: d.startswith("@type "))

    def facts(document: Column) -> Column:
        body = F.regexp_replace(document, r"(?d)\A(?:@[^\n]*\n)+", "")
        kind_and_body = F.struct(annotated_kind(document).alias("kind"), body.alias("body"))
        return let(kind_and_body, lambda d: timed(document, d["kind"], d["body"]))

    def timed(document: Column, kind: Column, body: Column) -> Column:
        return let(
            document_time(kind, body),
            lambda time: F.struct(
                F.regexp_extract(document, r"\A@type (\S+ \d+\.\d+)", 1).alias("type"),
                kind.alias("kind"),
                time.alias("first"),
                F.when(kind == "transfer", _last_start(body)).otherwise(time).alias("last"),
            ),
        )

    readable = F.filter(
        "__facts",
        lambda f: f["kind"].isNotNull() & (f["first"].isNotNull() | (f["kind"] == "microdescriptor")),
    )
    return (
        files.withColumn("__facts", F.transform(documents, facts))
        .withColumn("__facts", readable)
        .select(
            *files.columns,
            F.array_sort(F.array_distinct(F.transform("__facts", lambda f: f["type"]))).alias("types"),
            F.array_min(F.transform("__facts", lambda f: f["first"])).alias("first_published"),
            F.array_max(F.transform("__facts", lambda f: f["last"])).alias("last_published"),
        )
    )


def _last_start(text: Column) -> Column:
    starts = F.regexp_extract_all(text, F.lit(r"(?:\A|[ \n])START=(\d+)"), F.lit(1))
    return F.timestamp_seconds(F.array_max(F.transform(starts, lambda s: s.try_cast("long"))))


def summarize_files(
    documents: DataFrame, file: str, kind: str, time: str, size: Column | None = None
) -> DataFrame:
    """Index facts of files from their documents as rows.

    Types per file are few (one per document kind), so the set is bounded.
    """
    if size is None:
        size = F.lit(0)
    return documents.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(size).alias("size"),
        F.min(time).alias("first_published"),
        F.max(time).alias("last_published"),
        F.array_sort(F.collect_set(kind)).alias("types"),
    )


def listable(listing: DataFrame, path: str = "path") -> DataFrame:
    """Files to index: neither hidden nor temporary, by their own name."""
    name = F.element_at(F.split(path, "/"), -1)
    return listing.filter(~name.startswith(".") & ~name.endswith(".tmp"))


def reconcile_index(
    index: DataFrame, listing: DataFrame, now: datetime, grace: timedelta = DELETION_GRACE
) -> DataFrame:
    """What to do with each file: index, keep, unmark, mark, wait or delete.

    ``index`` has path, last_modified, marked_for_deletion; ``listing`` path and
    last_modified of files that exist now.  Both are unique by path.
    """
    old, new, mark = F.col("__old"), F.col("__new"), F.col("marked_for_deletion")
    joined = index.select(
        "path", F.col("last_modified").alias("__old"), "marked_for_deletion", F.lit(1).alias("__i")
    ).join(
        listing.select("path", F.col("last_modified").alias("__new"), F.lit(1).alias("__l")),
        "path",
        "full_outer",
    )
    exists = F.col("__l").isNotNull()
    action = (
        F.when(exists & (F.col("__i").isNull() | ~new.eqNullSafe(old)), "index")
        .when(exists & mark.isNotNull(), "unmark")
        .when(exists, "keep")
        .when(mark.isNull(), "mark")
        .when(mark < at(now - grace), "delete")
        .otherwise("wait")
    )
    return joined.select(
        "path",
        F.when(exists, new).otherwise(old).alias("last_modified"),
        action.alias("action"),
        F.when(~exists, F.coalesce(mark, at(now))).alias("marked_for_deletion"),
    )


def apply_reconciliation(
    index: DataFrame, plan: DataFrame, indexed: DataFrame
) -> DataFrame:
    """The next index: kept rows, marks set and cleared, fresh rows of files indexed.

    ``indexed`` has the facts of files whose action is ``index``; a file that
    vanished meanwhile is not among them and is not published.
    """
    marks = plan.filter(~F.col("action").isin("index", "delete")).select(
        "path", "marked_for_deletion"
    )
    kept = index.drop("marked_for_deletion").join(marks, "path")
    fresh = indexed.join(plan.filter(F.col("action") == "index").select("path"), "path", "left_semi")
    return kept.unionByName(
        fresh.withColumn("marked_for_deletion", F.lit(None).cast("timestamp"))
    )


# --- tree export ----------------------------------------------------------------------


def _file_json(columns: list[str]) -> Column:
    """A file node; fields without content are left out."""

    def field(name: str) -> Column:
        if name in ("path", "__name"):
            return F.col("__name").alias("path")
        if name == "types":
            return F.when(F.size("types") > 0, F.col("types")).alias("types")
        if name in ("last_modified", "first_published", "last_published"):
            return F.date_format(name, "yyyy-MM-dd HH:mm").alias(name)
        return F.col(name)

    order = ["path", "size", "last_modified", "types", "first_published", "last_published", "sha256"]
    return F.to_json(F.struct(*[field(c) for c in order if c in columns]))


def index_tree(index: DataFrame) -> DataFrame:
    """The nested index as text fragments that form one JSON value in order.

    Rows are (sort_key, fragment).  Concatenating fragments in ``sort_key``
    order gives ``"files":[...],"directories":[{"path":...},...]`` without the
    outermost braces.  No directory is gathered: every file and every directory
    contributes its own fragments, and commas depend only on whether a node is
    the smallest of its siblings.
    """
    shown = index.filter(F.col("last_modified").isNotNull())
    if "marked_for_deletion" in index.columns:
        shown = shown.filter(F.col("marked_for_deletion").isNull())
    parts = F.split("path", "/")
    files = shown.withColumn("__name", F.element_at(parts, -1)).withColumn(
        "__dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    )
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size("__parts")), lambda n: F.array_join(F.slice("__parts", 1, n), "/")
    )
    directories = (
        files.filter(F.col("__dir") != "")
        .select(F.split("__dir", "/").alias("__parts"))
        .distinct()
        .select(F.explode(ancestors).alias("__dir"))
        .distinct()
        .withColumn("__name", F.element_at(F.split("__dir", "/"), -1))
        .withColumn(
            "__parent", F.regexp_extract(F.concat(F.lit("/"), "__dir"), r"\A/?(.*?)/?[^/]*\z", 1)
        )
    )
    # keys sort a directory's files (1) before its subdirectories (2) and both
    # before what closes it (3)
    base = lambda d: F.when(
        F.col(d) == "", ""
    ).otherwise(F.concat(F.lit("2"), F.replace(d, F.lit("/"), F.lit("\x012")), F.lit("\x01")))
    first_file = files.groupBy("__dir").agg(F.min("__name").alias("__name")).withColumn(
        "__first", F.lit(True)
    )
    first_dir = directories.groupBy("__parent").agg(F.min("__name").alias("__name")).withColumn(
        "__first", F.lit(True)
    )
    file_rows = files.join(first_file, ["__dir", "__name"], "left").select(
        F.concat(base("__dir"), F.lit("1"), "__name").alias("sort_key"),
        F.concat(
            F.when(F.col("__first"), '"files":[').otherwise(","), _file_json(index.columns)
        ).alias("fragment"),
    )
    file_ends = first_file.select(
        F.concat(base("__dir"), F.lit("1\U0010ffff")).alias("sort_key"), F.lit("]").alias("fragment")
    )
    has_files = first_file.select("__dir", F.lit(True).alias("__has_files"))
    opened = (
        directories.join(first_dir, ["__parent", "__name"], "left")
        .join(has_files, "__dir", "left")
        .join(
            has_files.select(
                F.col("__dir").alias("__parent"), F.lit(True).alias("__parent_has_files")
            ),
            "__parent",
            "left",
        )
    )
    dir_rows = opened.select(
        base("__dir").alias("sort_key"),
        F.concat(
            F.when(
                F.col("__first"),
                F.concat(
                    F.when(F.col("__parent_has_files"), ",").otherwise(""), F.lit('"directories":[')
                ),
            ).otherwise(","),
            F.lit('{"path":'),
            F.substr(F.to_json(F.struct(F.col("__name").alias("p"))), F.lit(6)),
        ).alias("fragment"),
    )
    # to_json closed the object after the path: reopen it
    dir_rows = dir_rows.withColumn(
        "fragment", F.concat(F.regexp_replace("fragment", r"\}\z", ""), F.lit(","))
    )
    dir_ends = opened.select(
        F.concat(base("__dir"), F.lit("3")).alias("sort_key"), F.lit("}").alias("fragment")
    )
    list_ends = first_dir.select(
        F.concat(base("__parent"), F.lit("2\U0010ffff")).alias("sort_key"),
        F.lit("]").alias("fragment"),
    )
    return (
        file_rows.unionByName(file_ends)
        .unionByName(dir_rows)
        .unionByName(dir_ends)
        .unionByName(list_ends)
    )
