"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cohortry", **conf) -> SparkSession:
    """Get or create a session; keyword names use ``__`` in place of dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names.

    Only a local session without one gets a temporary folder, one per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{tempfile.gettempdir()}/cohortry-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop_path)
    files.deleteOnExit(hadoop_path)
    return path


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Used where one expensive frame feeds several later jobs. The lineage ends at the
    files, so lost executors cost only the tasks that read them.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark, label)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
