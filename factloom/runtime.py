"""Session helper, table access and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "factloom", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that results rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; sets one only where none is set and all run on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/factloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder: iterations start from them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that cut gave, when nothing reads it any more."""
    plan = df._jdf.queryExecution().logical()
    if plan.nodeName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


class Artifacts:
    """What several analyses of one run need: built once, kept by checkpoint, dropped when the run ends.

    What failed is not kept, so the next that asks builds it again.
    """

    def __init__(self) -> None:
        self._kept: dict[str, DataFrame] = {}

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut(build())
        return self._kept[name]

    def close(self) -> None:
        while self._kept:
            drop(self._kept.popitem()[1])


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they can import it.

    The driver serves the file for as long as it runs; executors fetch it from the driver.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{root.name}_operators.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
