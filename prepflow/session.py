"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Folders made up for local applications whose session names none.
MADE_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "prepflow", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    A machine-local folder is only made up for a local master, where driver and
    executors are the same process.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or MADE_FOLDERS.get(context.applicationId)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} to a folder all executors share before using ordered operators"
        )
    MADE_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="prepflow-")
    return MADE_FOLDERS[context.applicationId]


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/prepflow-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables (only those)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(path, True))
