"""Session settings the library is tuned for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's code to the session's executors, once per application.

    Functions that run in Python workers import it there, wherever the session was started from.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "antipode.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(top):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def build_session(app: str = "antipode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where already given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def local_session(cpus: int | None = None, app: str = "antipode-local") -> SparkSession:
    """Local-mode session for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        app,
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("ANTIPODE_DRIVER_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
