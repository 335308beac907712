"""Session helpers."""
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def local_session(cores: int = 8, name: str = "gridlake") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.checkpoint.dir", os.environ.get("GRIDLAKE_SHARED") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.driver.memory", os.environ.get("GRIDLAKE_DRIVER_MEMORY", "8g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tasks_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Partitions for so many rows: those of the session, or more where a task would have to sort more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a scratch folder on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _write(df: DataFrame, name: str, plain: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there, which also cuts the lineage;
    the files survive the loss of executors."""
    return _write(df, name, df)


def stored_with(df: DataFrame, name: str, **figures) -> tuple[DataFrame, dict]:
    """The same, with aggregates that are observed while the rows are written: an iterative
    operator needs no second job to see whether to go on."""
    seen = Observation()
    back = _write(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name, df)
    return back, seen.get
