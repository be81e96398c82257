"""Session settings this library is tuned for; callers may bring their own session."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  # folders by application
_shipped: set[str] = set()  # applications whose workers have this package
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, *, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster session comes from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only in local mode, as in tests, may it
    be unset: then one temporary folder is made per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="panelforge-")
    return _made[app]


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/panelforge/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for a table that is computed once: the shuffle files behind it are deleted as soon as it is written,
    so that the steps of a long build do not all lie on disk together."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return staged(df, name, compression="zstd")
    finally:
        conf.set(_CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to Python workers, once per application; for the few operators that need them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="panelforge-code-")) / "panelforge_workers.zip"
    with zipfile.ZipFile(file, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(file))
