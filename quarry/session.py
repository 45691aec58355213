"""A Spark session with the settings that results depend on."""

from pyspark.sql import SparkSession


def session(app: str = "quarry", **options: str) -> SparkSession:
    """The running session or a new one, in UTC and with adaptive execution."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
