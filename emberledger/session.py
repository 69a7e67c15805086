"""Session helpers shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str = "emberledger", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster, build the session the usual way instead: the library needs no setting
    beyond ``spark.sql.session.timeZone=UTC`` and leaves AQE and shuffle sizing to it.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for streaming checkpoints, settled tables and cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a session in one process (tests, a
    laptop) gets a temporary folder of its own where that is unset; elsewhere executors and
    driver would each write to a disk of their own, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = os.path.abspath(tempfile.mkdtemp(prefix="emberledger-"))
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that were started without it, once for
    each application, as ``--py-files`` does."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "emberledger-package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
