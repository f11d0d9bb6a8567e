"""A session with the settings that the engine's semantics rest on; any other session works too."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python this package, once for each application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='lamina-')}/{root.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, of the session or the context.

    Where it is unset, a local session gets a temporary one; a cluster's executors would write into their own disks, so that is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = known.get() if known.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="lamina-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC time, adaptive execution and Arrow transfer; conf overrides."""
    builder = SparkSession.builder.master(master or os.environ.get("LAMINA_MASTER", "local[*]")).appName("lamina")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    }
    for k, v in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())
