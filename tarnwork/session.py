"""Session helpers: local session factory and tables that cut lineage.

Iterative operators must not grow their lineage and must survive the loss of
executors, so intermediate states are written as parquet to the shared folder
named by ``spark.checkpoint.dir`` and read back with a known schema.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tarnwork", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is used only where none is
    set and the master is local; a cluster without a shared folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.environ.get("TARNWORK_LOCAL_DIR") or os.path.join(tempfile.gettempdir(), "tarnwork-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


class Workspace:
    """Written tables of one operator run.

    ``cut`` writes a frame and returns it read back, ``measured`` does so and
    returns figures observed while writing, so that a loop learns without a
    further job whether anything is left. ``drop`` removes tables that a later
    one has replaced; a frame derived from a table is no table. What is still
    there when the driver ends is removed then, since lazily returned results
    read from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        #: path -> the frame read from it, which is kept alive so that it stays itself
        self._held: dict[str, DataFrame] = {}
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            pass

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._held[path] = back
        return back

    def measured(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, Any]]:
        """``cut``, and the number of rows ``n`` with the given aggregates."""
        seen = Observation()
        back = self.cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in figures.items())))
        return back, seen.get

    def drop(self, *frames: DataFrame | None) -> None:
        for path in [p for p, held in self._held.items() if any(f is held for f in frames)]:
            del self._held[path]
            self._remove(path)

    @property
    def tables(self) -> int:
        """Tables that are still there."""
        return len(self._held)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
