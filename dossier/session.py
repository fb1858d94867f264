"""Session helpers: builder, shared storage, shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to a Python worker; texts may be long.
ARROW_ROWS = 512
ARROW_BYTES = 4 << 20


def build(app: str = "dossier", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once, and bound the Arrow batches of the session."""
    sc = spark.sparkContext
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    if getattr(sc, "_dossier_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="dossier-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "dossier_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("dossier") / p.relative_to(root)))
    sc.addPyFile(target)
    sc._dossier_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_dossier_shared", None)
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="dossier-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc._dossier_shared = f"file://{own}"
    sc.setCheckpointDir(sc._dossier_shared)
    return sc._dossier_shared


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/dossier/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dossier_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialise() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_dossier_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
