"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Java compiles no method of over 8,000 bytes, which then runs some ten times slower; Spark's own limit is eight times that.
#: Beyond this one Spark runs the operators one by one, in methods that are split.
METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(name: str = "tripforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, ANSI rules and adaptive execution; ``conf`` adds or overrides settings (``_`` for ``.``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        **METHODS,
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def limit_methods(spark: SparkSession) -> None:
    """Set the limit on methods in a session that was built elsewhere and has Spark's default; one that was set stays."""
    for key, value in METHODS.items():
        if spark.conf.get(key) == "65535":
            spark.conf.set(key, value)
