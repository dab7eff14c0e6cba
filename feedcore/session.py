"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "feedcore") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs more than building a plan of this size.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Scratch folders of local sessions, by application; a session's setting can't be changed.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster without
    the setting is an error, since its executors do not share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="feedcore-")
    return f"{base.rstrip('/')}/feedcore/{name}-{uuid.uuid4().hex}"
