"""What a run writes: payloads once, the index by replacement, result caches by key."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.dedup import new_only
from quernstone.operators.keywords import normalised

#: Days that payloads and index entries stay.
TTL_DAYS = 9


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    """Entries without an expiry never expire."""
    return rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def new_payloads(batch: DataFrame, stored: DataFrame, key: str, now: Column, ordinal: str | None = None) -> DataFrame:
    """Rows of the batch of which no unexpired payload is stored, with their expiry; of the same id the first by the
    ordinal, or without one the smallest by all columns. A small batch goes to the store, not the store to the batch."""
    rest = new_only(batch, unexpired(stored, now), key)
    first = [ordinal] if ordinal else []
    best = F.min_by(F.struct(*rest.columns), F.struct(*first, *[F.col(c).cast("string") for c in rest.columns]))
    fresh = rest.groupBy(F.col(key).alias("_k")).agg(best.alias("_r")).select("_r.*")
    return fresh.withColumn("expires_at", now + F.expr(f"interval {TTL_DAYS} days"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop.Path


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """kind -> folder of what is published; empty before the first time."""
    fs, of = _files(spark, path)
    if not fs.exists(of(f"{path}/manifest.json")):
        return {}
    (line,) = spark.read.text(f"{path}/manifest.json").first()
    return json.loads(line)


def publish_index(entries: DataFrame, path: str) -> None:
    """Replaces the postings of every kind that the run touches and no others. The run's folder is written whole, and
    then the list of folders is renamed over the one before: readers see the old or the new. One writer at a time."""
    spark, run = entries.sparkSession, f"{path}/run-{uuid.uuid4().hex}"
    entries.write.partitionBy("kind").parquet(run)
    fs, of = _files(spark, path)
    kinds = [unquote(s.getPath().getName().split("=", 1)[1]) for s in fs.listStatus(of(run)) if "=" in s.getPath().getName()]
    fresh = f"{path}/manifest-{uuid.uuid4().hex}"
    out = fs.create(of(fresh), True)
    out.write(bytearray(json.dumps({**_manifest(spark, path), **{k: f"{run}/kind={quote(k, safe='')}" for k in kinds}}).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(of(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(of(fresh), of(f"{path}/manifest.json"), options)


def published_index(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """(kind, value, id) of all published kinds, or of some."""
    folders = {k: f for k, f in _manifest(spark, path).items() if kinds is None or k in kinds}
    parts = [spark.read.parquet(f).withColumn("kind", F.lit(k)).select("kind", "value", "id") for k, f in sorted(folders.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "kind string, value string, id string")


def accumulated(old: DataFrame, new: DataFrame) -> DataFrame:
    """The global set of ids only grows: what is new is added to what is there."""
    return old.select("id").unionByName(new_only(new.select("id").distinct(), old, "id"))


def orphans(ids: DataFrame, stored: DataFrame, key: str, now: Column) -> DataFrame:
    """Listed ids whose payload has expired or is missing: what a reader removes from the list."""
    return ids.select(key).distinct().join(unexpired(stored, now).select(key), key, "left_anti")


def payloads_of(ids: DataFrame, stored: DataFrame, key: str, now: Column, schema: str | None = None, json: str = "payload") -> DataFrame:
    """Payloads of the ids that have one; expired, missing and corrupt ones are left out."""
    rows = unexpired(stored, now).join(ids.select(key).distinct(), key, "left_semi")
    if schema:
        rows = rows.withColumn("_p", F.from_json(json, schema)).filter(F.col("_p").isNotNull() & F.try_parse_json(F.col(json)).isNotNull()).select(key, "_p.*")
    return rows


def sample_of(ids: DataFrame, key: str, n: int) -> DataFrame:
    """The n smallest ids; all of them where n isn't positive."""
    return ids.orderBy(key).limit(n) if n > 0 else ids


#: Seconds that a stored result is good for.
RESULT_SECONDS = 600


def result_cache(spark: SparkSession, root: str, key: str, make, seconds: float = RESULT_SECONDS) -> tuple[DataFrame, bool]:
    """The result stored under a key no longer ago than that, or made and stored; whether it was there. A key is stored by its hash, so it
    may hold anything. Each result is a folder of its own, named by its time, so that readers of an older one keep it; results that
    are twice as old as they may be are deleted when another is made."""
    fs, of = _files(spark, root)
    where, now = f"{root}/{hashlib.sha256(key.encode()).hexdigest()}", time.time()
    made = [float(s.getPath().getName()) for s in fs.listStatus(of(where))] if fs.exists(of(where)) else []
    good = [t for t in made if now - t < seconds and fs.exists(of(f"{where}/{t:.6f}/_SUCCESS"))]
    if good:
        return spark.read.parquet(f"{where}/{max(good):.6f}"), True
    make().write.parquet(f"{where}/{now:.6f}")
    for old in [t for t in made if now - t > 2 * seconds]:
        fs.delete(of(f"{where}/{old:.6f}"), True)
    return spark.read.parquet(f"{where}/{now:.6f}"), False


def save_keywords(keywords: DataFrame, path: str) -> None:
    """Replaces the stored search keywords (keyword, ordinal), which never expire."""
    normalised(keywords).write.mode("overwrite").json(path)


def load_keywords(spark: SparkSession, path: str, defaults: str | None = None) -> DataFrame:
    """The stored keywords; else those of a file {"KEYWORDS": [..]}; else none. keyword, ordinal."""
    fs, of = _files(spark, path)
    if fs.exists(of(path)):
        return spark.read.schema("keyword string, ordinal long").json(path)
    if defaults and fs.exists(of(defaults)):
        listed = spark.read.schema("KEYWORDS array<string>").json(defaults, multiLine=True)
        return normalised(listed.select(F.posexplode("KEYWORDS").alias("ordinal", "keyword")).select(F.col("ordinal").cast("long"), "keyword"))
    return spark.createDataFrame([], "keyword string, ordinal long")


def summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a run: adapters, keywords, jobs, errors, duration."""
    return runs.groupBy(*(by or [])).agg(F.countDistinct("adapter").alias("adapters"), F.countDistinct("keyword").alias("keywords"), F.sum("jobs").alias("jobs"), F.count_if("failed").alias("errors"), F.sum("seconds").alias("seconds"))
