"""Session settings the engine relies on, and the shared folder for durable intermediate data."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings that change answers, so they are applied to any session handed in.
REQUIRED_CONF = {
    # Minutes, dates and RFC 3339 text are all in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key is legal on the wire; the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only change speed.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime settings to an existing session."""
    for key, value in {**REQUIRED_CONF, **TUNING_CONF}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a configured session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which every executor can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
    return configured.rstrip("/")


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
