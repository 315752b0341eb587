"""Helpers shared by the corpus operators: written tables, batch sizes, column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be long, so a batch stays far below Spark's 10 000 rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, ``spark.checkpoint.dir``.

    It must be one that the driver and all executors see, so there is no default; only a master on this machine alone,
    where every folder is seen by all, may leave it unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Intermediate tables of one job in a folder of its own; those that nothing reads any more can be deleted."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []
        self.count = 0

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Writes ``df`` as Parquet and reads it back: the lineage ends at files that outlive any executor."""
        self.count += 1
        path = f"{self.root}/{self.count}-{label}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        self.tables.append(table)  # while it is held, no other table has its id
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that ``write`` returned."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """One table in a folder of its own, which stays."""
    return Scratch(df.sparkSession, label).write(df, label)


def grows(table: DataFrame) -> DataFrame:
    """One side of a join that grows with the corpus: it is sorted and merged, and never broadcast because a small corpus makes it small."""
    return table.hint("merge")


def fresh(columns: Iterable[str], *labels: str) -> list[str]:
    """A column name for each label that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    found = []
    for label in labels:
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        found.append(label)
    return found


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their exact names, whatever characters those have."""
    return [F.col(quoted(c)) for c in columns]


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
