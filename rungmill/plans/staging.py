"""Tables written between jobs, in the folder all executors share.

Iterative operators cut their lineage here: a written table survives the loss of any executor and gives Catalyst true sizes to
plan with. The folder is spark.checkpoint.dir of the session; only a session whose executors live on this machine (tests) may do
without it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a folder of this process that goes at exit."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="rungmill-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


class Staging:
    """Written tables of one run of an operator.

    ``table`` writes and reads back; ``drop`` deletes a table that no later result reads. What a returned DataFrame still reads
    stays until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
