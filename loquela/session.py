"""Session builder for local runs, tests and the command line."""

from pyspark.sql import SparkSession


def get_session(app: str = "loquela", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; on a cluster, pass the cluster's own settings instead.

    Nulls are kept in JSON output because the transcript files list every field of a row.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.jsonGenerator.ignoreNullFields", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
