"""Session settings and the two ways intermediate results are kept."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_FALLBACK: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where every task sees the
    same disk, may fall back to a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_FALLBACK:
        LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="siftline-")
    return LOCAL_FALLBACK[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner exact file sizes, so that
    the choice between broadcast and shuffle joins rests on real numbers.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/siftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table of a few rows as part of the plan itself, so that its size is known and no job makes it."""
    fields = StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], fields)
    columns = {name: list(values) for name, values in zip(fields.names, zip(*rows))}
    return spark.createDataFrame(pa.table(columns), schema=fields)
