"""SparkSession defaults for local runs; on a cluster the session is given."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the operators expect (AQE, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bookwarp")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BOOKWARP_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bookwarp-ckpt-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shipped(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers, unless they find it in the working folder or on PYTHONPATH.

    Once for each context; Spark's own file server passes the archive on to the executors.
    """
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    known = {Path.cwd().resolve(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)}
    if root in known or getattr(context, "_bookwarp_shipped", False):
        return spark
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.glob("bookwarp/**/*.py")):
            archive.write(path, path.relative_to(root))
    place = Path(tempfile.mkdtemp(prefix="bookwarp-")) / "bookwarp.zip"
    place.write_bytes(packed.getvalue())
    context.addPyFile(str(place))
    context._bookwarp_shipped = True
    return spark
