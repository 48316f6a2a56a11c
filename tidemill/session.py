"""The session every job of this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results, so that each job sets them.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's settings; keyword names use ``__`` for a dot."""
    builder = SparkSession.builder.appName("tidemill")
    if master:
        builder = builder.master(master)
    settings = SEMANTICS | {"spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def settle(spark: SparkSession) -> SparkSession:
    """Puts the settings that results depend on into a session made elsewhere."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark
