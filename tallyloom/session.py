"""Session factory and typed settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app_name: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` uses `_` for `.`-free keys or a dict."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    return spark.conf.get(key, default)


def int_setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def float_setting(spark: SparkSession, key: str, default: float) -> float:
    return float(spark.conf.get(key, str(default)))


def bool_setting(spark: SparkSession, key: str, default: bool) -> bool:
    text = spark.conf.get(key, str(default)).strip().lower()
    if text in ("1", "yes", "true", "on"):
        return True
    if text in ("0", "no", "false", "off"):
        return False
    raise ValueError(f"not a boolean: {key}={text}")
