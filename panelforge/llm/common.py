"""Helpers shared by the text operators: words, staged tables, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 2000  # rows a Python worker holds at once, of about so many bytes
BATCH_BYTES = 16 << 20
_made: dict[str, str] = {}
_shipped: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="panelforge-llm-")
    return "file://" + _made[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Interim:
    """Staged tables of one computation, deleted together once its result is a written table."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stage(df, name))
        return self.made[-1]

    def discard(self) -> None:
        for df in self.made:
            discard(df)
        self.made = []


def prepare(spark: SparkSession) -> None:
    """Send this package to the workers once per application, and keep Arrow batches of long texts small."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[1]
        file = Path(tempfile.mkdtemp(prefix="panelforge-code-")) / "panelforge_code.zip"
        with zipfile.ZipFile(file, "w") as z:
            for source in sorted(top.rglob("*.py")):
                z.write(source, source.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(file))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches; ``fn`` takes one RecordBatch and yields RecordBatches."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text; bytes.split() cuts at exactly the six ASCII blanks."""
    return data.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (the published SplitMix64 step), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per vertex of an edge table (``a``, ``b``): columns ``v``, ``c``.

    Each round hooks every vertex to its smallest neighbour if that is smaller than itself, follows
    hooks of hooks until they end at a root, and draws the edges anew between roots. A root that
    nothing hooked to has a smaller neighbour in the next round, so two rounds at least halve the
    vertices that still have edges, whatever the diameter; a chain of hooks halves with each step.
    Both loops run until nothing is left to do. Every state is a written table: no round recomputes
    the one before, joins read written tables and so can be split where a label is hot.
    Vertices without edges are not in the result. Empty edges give an empty table.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stage(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "edges")
    hooks: list[DataFrame] = []  # of each round; a vertex that hooked has no edges in later rounds
    while not left.isEmpty():
        hooks.append(_rooted(stage(left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c")), "labels")))
        ra = hooks[-1].select(F.col("v").alias("a"), F.col("c").alias("ra"))
        rb = hooks[-1].select(F.col("v").alias("b"), F.col("c").alias("rb"))
        ends = left.join(ra, "a", "left").join(rb, "b").select(F.coalesce("ra", "a").alias("a"), F.col("rb").alias("b"))
        after = stage(ends.where("a <> b").select(*ordered("a", "b")).distinct(), "edges")
        discard(left)
        left = after
    if not hooks:
        return left.select(F.col("b").alias("v"), F.col("a").alias("c"))
    discard(left)
    labels = hooks.pop()
    while hooks:  # back from the last round: a root of one round may have hooked in a later one
        earlier, top = hooks.pop(), labels.select(F.col("v").alias("w"), F.col("c").alias("top"))
        moved = earlier.join(top, earlier.c == top.w, "left").select("v", F.coalesce("top", "c").alias("c"))
        after = stage(moved.union(labels), "labels")
        discard(earlier)
        discard(labels)
        labels = after
    whole = stage(labels.union(labels.select(F.col("c").alias("v"), "c").distinct()), "labels")
    discard(labels)
    return whole


def _rooted(hooks: DataFrame) -> DataFrame:
    """Each vertex (``v``) with the end of its chain of hooks (``c``, smaller than ``v``)."""
    while True:
        top = hooks.select(F.col("v").alias("w"), F.col("c").alias("top"))
        joined = hooks.join(top, hooks.c == top.w, "left")
        after = stage(joined.select("v", F.coalesce("top", "c").alias("c"), F.col("top").isNotNull().alias("moved")), "labels")
        discard(hooks)
        hooks = after.select("v", "c")
        if after.where("moved").isEmpty():
            return hooks
