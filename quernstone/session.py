"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "quernstone", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows a task, of tables whose rows are narrow and cost much each.
SPREAD_ROWS = 10_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key, into tasks of so many rows: a narrow table is few bytes, so by size alone a few tasks would do
    all the work that its rows bring. The count is read off the files' footers."""
    return rows.repartition(max(1, -(-rows.count() // SPREAD_ROWS)), key)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; on a single machine one of its own where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
