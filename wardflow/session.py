"""Session creation and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "wardflow", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_compiled_methods(spark: SparkSession) -> SparkSession:
    """The session, with stages whose generated method is too large for the JVM to compile run operator by operator.

    Wide decodes and renderings exceed the JVM's 8,000 bytes of bytecode; as one method they are interpreted for every row.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent on one machine (a local test session) a temporary folder takes its place; on a
    cluster every executor would write to its own disk, so the setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="wardflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one run's files."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
