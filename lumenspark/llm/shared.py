"""Session helpers: kept tables, distributed ranks and connected components.

Intermediate tables are Parquet files in the folder that ``spark.checkpoint.dir`` names (shared by driver and executors),
under one folder for each application. Only in local mode, where that setting is missing as in tests, we make one of our own.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}
#: Settings while a table is computed: shuffle files go with their query, and batches of rows for Python stay small.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for tables. Raises on a cluster that names no shared folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = tempfile.mkdtemp(prefix="lumenspark-")
        base = _local[sc.applicationId]
    return f"{base.rstrip('/')}/lumenspark-{sc.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as its result is there; the session's settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into a table of the shared folder: its lineage is cut, and lost executors cost nothing.

    The files stay until ``free`` or ``clean``."""
    spark, schema = df.sparkSession, df.schema
    folder = new_folder(spark, "kept")
    with tidy(spark):
        df.write.parquet(folder)
    out = spark.read.schema(schema).parquet(folder)
    out._kept = folder
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(*frames: DataFrame) -> None:
    """Removes the files of kept frames that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, df._kept)


def clean(spark: SparkSession) -> None:
    """Removes all tables that this application's operators left (results that were not read yet too)."""
    remove(spark, shared_dir(spark))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list, name: str = "rank", weight: str | None = None) -> DataFrame:
    """Adds the 0-based global position of each row in ``order`` (or the sum of ``weight`` over earlier rows).

    The rows are dealt by ranges, counted per range, and numbered inside each range: no task sees them all. Only one row
    per range meets in a single task. Input columns come back unchanged.
    """
    spark = df.sparkSession
    step = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    dealt = keep(df.repartitionByRange(width(spark), *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.sum(step).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.sum(step).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - step
    # One row per range: the table's size is the number of partitions.
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


ONE_TASK_EDGES = 1 << 20


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """Smallest id reachable over undirected ``edges`` (a, b): one row (id, component) for each id in an edge. Kept.

    Each task first settles the edges that it has, in bounded pieces, which leaves at most one edge for each of their ids.
    What is left then goes in rounds: every id takes the smallest label among its neighbours and then the label of that
    label (pointer jumping), so labels fall along long paths in a number of rounds that grows with the logarithm of their
    length. Hot ids are pre-aggregated (``min``) before they are shuffled. Rounds end early where at most
    ``one_task_edges`` edges (16 MB) are left, which one task settles. Only counts reach the driver.
    """
    each = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").mapInArrow(_contract, "a long, b long").distinct())
    if each.count() <= one_task_edges:
        out = keep(each.coalesce(1).mapInArrow(_settle, "id long, component long"))
        free(each)
        return out
    both = keep(each.union(each.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        # The label is itself an id: its own label is at least as small. Also hook the old label onto the new one.
        hooks = lower.where("to < was").groupBy(F.col("was").alias("id")).agg(F.min("to").alias("hook"))
        step = keep(lower.join(hooks, "id", "left").select("id", "was", F.least("to", F.coalesce("hook", "to")).alias("to")))
        up = step.select(F.col("id").alias("to"), F.col("to").alias("up"))
        new = keep(step.join(up, "to", "left").select("id", "was", F.least("to", F.coalesce("up", "to")).alias("component")))
        free(step)
        moved = new.where("component != was").limit(1).count()
        free(labels)
        labels = new.select("id", "component")
        labels._kept = new._kept
        if not moved:
            free(each, both)
            return labels


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable from each of n places, by the same rounds on arrays."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _settled(ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, place = np.unique(np.concatenate(ends, 1), return_inverse=True)
    a, b = place.reshape(2, -1)
    return ids, ids[_labels(a, b, len(ids))]


def _ends(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy()))


def _contract(batches):
    """Edges of each piece of a task as stars around the smallest id."""
    held, n = [], 0

    def flush():
        ids, label = _settled(held)
        use = ids != label
        return pa.RecordBatch.from_arrays([pa.array(label[use]), pa.array(ids[use])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(_ends(batch))
            n += batch.num_rows
        if n >= 1 << 20:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _settle(batches):
    """Components of all edges of one task."""
    ends = [_ends(b) for b in batches if b.num_rows]
    if ends:
        ids, label = _settled(ends)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "component"])
