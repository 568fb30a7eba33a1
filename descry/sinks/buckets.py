"""State that grows by runs and expires by time: a folder for each day of its rows' time.

A run reads only days that are still wanted, appends what is new to the days it falls in,
and removes whole days that are over.  Nothing else is written again, so the work of a run
follows its input and the span of time kept, not the age of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from descry.functions.times import at
from descry.operators.keys import keep_first, skip_processed
from descry.session import checkpointed
from descry.sources.state import folder_names, read_table, remove_folder

BUCKET = "bucket"
#: What is timed later than this after a run is no document's time.
HORIZON = timedelta(days=366)
#: Files of a day from which they are put together.
MOST_FILES = 64


@dataclass(frozen=True)
class BucketedState:
    """A state table: columns as DDL, the key, the column of time.

    ``timed`` tells that a key always comes with the same time; only the days of incoming
    rows are searched for it then.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    time: str
    timed: bool = False

    def read(self, spark: SparkSession, since: datetime) -> DataFrame:
        """Rows of ``since`` or later; the folders of earlier days are not opened."""
        stored = read_table(spark, self.path, f"{self.schema}, {BUCKET} string")
        young = (F.col(BUCKET) >= since.strftime("%Y-%m-%d")) & (F.col(self.time) >= at(since))
        return stored.filter(young)

    def insert(
        self, rows: DataFrame, since: datetime, until: datetime | None = None
    ) -> DataFrame:
        """Append the rows of ``since`` or later, and before ``until``, whose key is not stored
        yet; returns them.

        What is stored wins, of equal keys in ``rows`` the one with the least other columns.
        A run that is repeated adds nothing.
        """
        spark = rows.sparkSession
        columns = StructType.fromDDL(self.schema).names
        time = F.col(self.time)
        kept = rows.select(*columns).filter(time >= at(since))
        if until is not None:
            kept = kept.filter(time < at(until))
        others = [c for c in columns if c not in self.keys]
        dated = keep_first(kept, self.keys, others or list(self.keys)).withColumn(
            BUCKET, F.date_format(time, "yyyy-MM-dd")
        )
        dated = checkpointed(dated)
        stored = self.read(spark, since)
        if self.timed:
            days = [r[0] for r in dated.select(BUCKET).distinct().collect()]
            stored = stored.filter(F.col(BUCKET).isin(*days))
        fresh = checkpointed(skip_processed(dated, stored, self.keys))
        fresh.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        return fresh.drop(BUCKET)

    def expire(self, spark: SparkSession, before: datetime) -> list[str]:
        """Remove the days that end before a time; returns them."""
        last = before.strftime("%Y-%m-%d")
        gone = [d for d in self.days(spark) if d < last]
        for day in gone:
            remove_folder(spark, f"{self.path}/{BUCKET}={day}")
        return gone

    def days(self, spark: SparkSession) -> list[str]:
        """Days that have a folder, the earliest first."""
        names = folder_names(spark, self.path)
        return sorted(n.removeprefix(f"{BUCKET}=") for n in names if n.startswith(f"{BUCKET}="))

    def compact(self, spark: SparkSession, most_files: int = MOST_FILES) -> list[str]:
        """Put together the files of days that have more than ``most_files``; returns the days."""
        done = []
        for day in self.days(spark):
            files = folder_names(spark, f"{self.path}/{BUCKET}={day}")
            if sum(n.endswith(".parquet") for n in files) <= most_files:
                continue
            rows = read_table(spark, self.path, f"{self.schema}, {BUCKET} string")
            whole = checkpointed(rows.filter(F.col(BUCKET) == day))
            (
                whole.hint("rebalance")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(BUCKET)
                .parquet(self.path)
            )
            done.append(day)
        return done
