"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI arithmetic (overflow is an error) and adaptive execution; dots in conf keys as '__'."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (own | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
