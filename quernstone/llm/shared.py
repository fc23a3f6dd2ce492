"""What the operators share: the folder all executors see, written intermediates, shipped code."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose texts a task holds as Python strings at a time, and their bytes (a longer text is alone).
ROWS, ROW_BYTES = 500, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; one of our own only where that is unset, on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quernstone-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back, so that
    what follows neither repeats the work nor depends on any executor's disk."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path  # type: ignore[attr-defined]
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; df can't be read afterwards."""
    if path := getattr(df, "_written_to", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches' rows, a few at a time: what is made of their texts in Python is bounded by that and not by Arrow's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if part.nbytes <= ROW_BYTES:
                yield part
                continue
            sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in part.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type))
            start, held = 0, 0
            for k, n in enumerate(sizes.tolist() if hasattr(sizes, "tolist") else [0] * part.num_rows):
                if held and held + n > ROW_BYTES:
                    yield part.slice(start, k - start)
                    start, held = k, 0
                held += n
            yield part.slice(start)


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def kept(df: DataFrame, without: list[str] | None = None) -> list[Column]:
    """All columns of df as they are, but for those `without` names (in any case)."""
    gone = {c.lower() for c in without or []}
    return [named(c) for c in df.columns if c.lower() not in gone]


def free(df: DataFrame, name: str) -> str:
    """A name for a column of our own that df has none of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: list[T.StructField] | None = None) -> DataFrame:
    """df through run(), which gets batches and yields columns: those of df and the added ones. For tables with any
    column names, dots and all; an added column takes the place of one of df's that has its name (in any case)."""
    fields = [*df.schema.fields, *(added or [])]
    inner = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names=inner.fieldNames())

    out = df.toDF(*inner.fieldNames()[: len(df.columns)]).mapInArrow(renamed, inner)
    new = {f.name.lower() for f in added or []}
    stay = [(k, f.name) for k, f in enumerate(fields) if k >= len(df.columns) or f.name.lower() not in new]
    return out.select(*[F.col(f"c{k}").alias(name) for k, name in stay])


def parts_for(df: DataFrame, part_bytes: int = 128 << 20) -> int:
    """Into how many parts df's rows are dealt: the session's number of shuffle partitions, more where they'd have more than
    part_bytes each by Spark's own estimate of df's size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size > 1 << 60 else max(least, -(-size // part_bytes))  # a plan of unknown size states the greatest number


def posix(path: str) -> str:
    """The folder that a file URI names. Raw files (token files, tar shards) need a mounted file system."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped and range-read files need a mounted folder, not {parts.scheme}://")
    return unquote(parts.path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, for sessions whose PYTHONPATH lacks it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="quernstone-code-")
    path = os.path.join(folder, f"{top.name}_code.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
