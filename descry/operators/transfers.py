"""Transfer timings: a file counts only when every row agrees with its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators.keys import without_groups


def disagrees(source: Column, size: Column, date: Column) -> Column:
    """Whether a row's own source, size or start date differs from its file's."""
    return (
        ~source.eqNullSafe(F.col("source"))
        | ~size.eqNullSafe(F.col("filesize"))
        | ~date.eqNullSafe(F.to_date("start"))
    )


def validate_transfers(
    df: DataFrame,
    file: str = "path",
    source: str = "file_source",
    size: str = "file_size",
    date: str = "file_date",
) -> DataFrame:
    """Rows of files without a disagreeing row."""
    return without_groups(df, [file], disagrees(F.col(source), F.col(size), F.col(date)))


def rejected_transfer_files(
    df: DataFrame,
    file: str = "path",
    source: str = "file_source",
    size: str = "file_size",
    date: str = "file_date",
) -> DataFrame:
    """Rejected files and how many rows disagree."""
    bad = disagrees(F.col(source), F.col(size), F.col(date))
    return df.filter(bad).groupBy(file).agg(F.count(F.lit(1)).alias("n_bad"))


def validate_transfer_analysis(
    df: DataFrame, file: str = "path", source: str = "file_source"
) -> DataFrame:
    """Analysis documents are checked for their source only."""
    return without_groups(df, [file], ~F.col(source).eqNullSafe(F.col("source")))
