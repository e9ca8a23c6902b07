"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None

#: Bytes of a written table of codes or walks above which joins merge. A file takes a small part of its rows' memory, and the planner judges
#: by the file whether the driver can build a table for a broadcast.
BROADCAST = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local runs only:
    on a cluster each machine would have its own."""
    global _own_folder
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="seqframe-")
        spark.sparkContext.setCheckpointDir(_own_folder)
    return _own_folder


class Tables:
    """Intermediate tables of one run of an operator; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.bucketed: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, merge: bool = False) -> DataFrame:
        """Writes df and reads it back. With `merge`, joins broadcast it only where its file is small."""
        path, schema = f"{self.at}/{name}", df.schema
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(schema).parquet(path)
        return kept.hint("merge") if merge and self.size(name) > BROADCAST else kept

    def size(self, name: str) -> int:
        """Bytes of a written table."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def keep_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Writes df, whose rows lie together by the key already, in as many buckets as a shuffle has partitions. Joins and groups on
        the key then don't move these rows again."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = re.sub(r"\W", "_", f"{self.at.rsplit('/', 1)[-1]}_{name}").lower()
        df.write.option("compression", "zstd").option("path", f"{self.at}/{name}").bucketBy(parts, key).format("parquet").saveAsTable(table)
        self.bucketed[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        sc = self.spark.sparkContext
        for name in names:
            if name in self.bucketed:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.bucketed.pop(name)}")
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Lets the context cleaner remove shuffle files whose rows have been written out, and gives it a moment to do so."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
