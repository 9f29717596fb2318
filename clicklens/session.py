"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings that results or scale rely on. Cluster sizing stays with the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(name: str, cores: str = "8", **extra: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the call site of every column costs more than building the plan itself.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder every executor reaches.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without one, as in tests, gets a
    temporary folder, which goes when the process ends; on a cluster a machine's own folder would hide each
    executor's files from the others, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="clicklens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is; a missing one is fine."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below a folder; none if it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def rename_if_free(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file or folder a name that nothing has yet; False if the name is taken.

    Two callers of one name are told apart as far as the file system's rename does.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    source, target = hadoop.Path(source), hadoop.Path(target)
    files = target.getFileSystem(conf)
    context = hadoop.FileContext.getFileContext(files.getUri(), conf)
    options = spark._jvm.java.lang.reflect.Array.newInstance(
        spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
    )
    try:
        context.rename(files.makeQualified(source), files.makeQualified(target), options)
        return True
    except Exception:
        if not files.exists(target):
            raise
        return False
