"""Session helpers: the shared work folder and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "stallkit", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-node session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, one machine) a temporary folder is made and remembered in the session.
    """
    at = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not at:
        at = getattr(spark, "_stallkit_work", None)
        if not at:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="stallkit-")
            spark._stallkit_work = at
    return at.rstrip("/")


class Workspace:
    """Written tables of one run. ``cut`` writes a frame and reads it again, so later work starts from files.

    ``finish`` writes the result and removes the run's other tables; what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []
        atexit.register(self.close)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        self.names.append(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """The written result of a run whose other tables nothing reads any more."""
        out = self.cut(df, "result")
        for name in self.names[:-1]:
            self.drop(name)
        return out

    def drop(self, name: str) -> None:
        """Removes a table of this run that no later step reads."""
        self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all tables of this run, if the session is still there."""
        with suppress(Exception):
            self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a frame, as Spark estimates them, that make one range.
RANGE_BYTES = 128 << 20


def shuffle_width(df: DataFrame) -> int:
    """Partitions for a shuffle with a number of its own: the session's, or more where the frame is large for them."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Of a size it can't tell Spark says an enormous one.
    return max(least, -(-size // RANGE_BYTES)) if size < 1 << 55 else least
