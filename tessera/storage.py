"""Cutting lineage with tables written to the shared checkpoint folder.

Iterative operators and operators that use one intermediate result several times
write it as Parquet under ``spark.checkpoint.dir``. Unlike blocks held by executors,
such a table survives the loss of any executor, and later reads prune its columns.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

ROUNDS, ROUND_ROWS = 4, 5_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session in one process (master ``local`` or ``local[..]``) may go without the setting;
    it then gets a temporary folder. On a cluster a missing setting is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tessera.shared.dir", None)
    if own:
        return own.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.tessera.shared.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def application_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all workspaces of this application."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Delete every workspace of this application. Results are read from them lazily, so write these first."""
    _delete(spark, application_dir(spark))


def round_count(rows: int) -> int:
    """In how many rounds a shuffle of so many rows goes, each of which reads the input again: one for up to
    ``ROUND_ROWS``, and never more than ``ROUNDS``, so that reading grows in proportion to the input."""
    return min(ROUNDS, max(1, -(-rows // ROUND_ROWS)))


class Workspace:
    """A folder of intermediate tables of one run of an operator; ``close`` deletes all of them."""

    def __init__(self, spark: SparkSession, name: str, at: str | None = None):
        self.spark = spark
        self.root = at or f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, by: list[str] = [], mode: str = "overwrite") -> DataFrame:
        """Write ``df``, in folders by the columns ``by``, and return a DataFrame that reads the written table."""
        df.write.mode(mode).partitionBy(*by).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def save_rounds(self, rounds: Iterable[DataFrame], table: str, by: list[str] = []) -> DataFrame:
        """Write all ``rounds`` and return a DataFrame that reads them. Shuffle files of a round are deleted before the next begins.

        Each is a table of its own, with its number behind the name; with ``by`` all are one table, as folders of several can't be read together."""
        paths = []
        for i, df in enumerate(rounds):
            name = table if by else f"{table}-{i}"
            self.save(df, name, by, "append" if by else "overwrite")
            self.release()
            paths.append(self.path(name))
        return self.spark.read.schema(df.schema).parquet(*dict.fromkeys(paths))

    def drop(self, table: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, self.path(table))

    def close(self) -> None:
        """Delete all tables."""
        _delete(self.spark, self.root)

    def release(self) -> None:
        """Have Spark delete the shuffle files of finished jobs now; otherwise they stay on disk until the
        driver happens to collect its garbage. What a job's end, told a little later, still holds is freed by the second call."""
        for wait in (0.5, 0):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(wait)
