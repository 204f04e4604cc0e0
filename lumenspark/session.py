"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's code to the executors' Python workers, once per application.

    Workers then import it whatever folder or path the driver was started with. Where the session has Spark's own limit for
    batches of rows that go to Python (64 MB), it is lowered: long texts make large batches.
    """
    if spark.conf.get(ARROW_BYTES, None) == "67108864b":
        spark.conf.set(ARROW_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the archive as long as it runs
        shutil.copytree(root, Path(folder) / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}_code", "zip", Path(folder) / "tree"))
        _shipped.add(app)
    return spark
