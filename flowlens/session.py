"""Session settings shared by tests, the benchmark and jobs."""

from __future__ import annotations

import importlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(app: str = "flowlens", cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass in the session you have."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    Taken from ``spark.checkpoint.dir``. A temporary folder is used only where
    that setting is missing and the session is local, because a folder of one
    machine is of no use to executors on others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="flowlens-")


def ship_package(spark: SparkSession, *packages: str) -> None:
    """Makes packages (this one by default) importable in the Python workers of any cluster."""
    context = spark.sparkContext
    shipped = getattr(context, "_flowlens_shipped", set())
    missing = [p for p in packages or (__package__,) if p not in shipped]
    if not missing:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="flowlens-ship-"), "-".join(missing) + ".zip")
    with zipfile.ZipFile(archive, "w") as z:
        for package in missing:
            root = os.path.dirname(os.path.abspath(importlib.import_module(package).__file__))
            for folder, _, files in os.walk(root):
                for name in (f for f in files if f.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(package, os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._flowlens_shipped = shipped | set(missing)
