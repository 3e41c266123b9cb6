"""Session factory with the settings that the library is written for."""

from pyspark.sql import SparkSession


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; everything else is left to the cluster unless given (dots as double underscores)."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
