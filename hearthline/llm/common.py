"""What the training-data operators share: the shared folder, ASCII rules, input columns."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts, and their upper and lower case letters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only on a single machine may the setting be absent; a temporary folder is used then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="hearthline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Lets a query's shuffle files go when the query ends, instead of when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once. A batch of Spark's own 10,000 texts is held by the JVM and, with its copies, by the worker.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    own = {CLEANUP: "true", BATCH: str(BATCH_ROWS)}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    return _write(df, f"{shared_dir(df.sparkSession)}/hearthline/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables that only live within a ``with`` block; nothing that is lazily read later may depend on them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/hearthline/{name}-{uuid.uuid4().hex}"
        self.shared: list = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back; what was broadcast until now is let go."""
        out = _write(df, f"{self.folder}/{name}-{uuid.uuid4().hex}")
        self.release()
        return out

    def broadcast(self, value):
        """A value for the next table alone."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def release(self) -> None:
        """Lets go of what was broadcast."""
        while self.shared:
            self.shared.pop().destroy()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this scratch folder that are not needed any more."""
        for df in tables:
            for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if path.rpartition("/")[0].endswith(self.folder.rpartition("/")[2]):
                    self._delete(path)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)
