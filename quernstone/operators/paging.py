"""Ordering, limits and pages. Orders are total: the result doesn't depend on partitions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 100


@dataclass(frozen=True)
class Page:
    page: int = 1
    limit: int = MOST

    @classmethod
    def parse(cls, page: str | int | None, limit: str | int | None) -> Page:
        """What isn't a number gets the default, as does zero; pages begin at 1; a page has at most MOST rows."""

        def number(x: str | int | None, default: int) -> int:
            digits = re.match(r"\s*([+-]?\d+)", str(x))
            return (int(digits[1]) if digits else 0) or default

        return cls(max(1, number(page, 1)), min(MOST, max(1, number(limit, MOST))))

    @classmethod
    def of_list(cls, page: int, size: int, total: int) -> Page:
        """A list's page: at most 50 rows, at least one page, the current one within them."""
        limit = min(50, max(1, size))
        return cls(min(max(1, page), max(1, -(-total // limit))), limit)

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit

    def totals(self, total: int) -> dict[str, int | bool]:
        pages = -(-total // self.limit)
        return {"page": self.page, "limit": self.limit, "total": total, "totalPages": pages, "hasNext": self.page < pages, "hasPrev": self.page > 1}


def page_of(rows: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """Offset and limit over a total order: Spark keeps the first offset + limit rows of each partition only."""
    return rows.orderBy(*order).offset(page.offset).limit(page.limit)


def list_page(rows: DataFrame, page: int, size: int) -> DataFrame:
    """The page that a list shows where one is asked for, as a row: page, size, total, pages. At most 50 rows a page, at least one
    page, the shown one within them. A count, not the rows."""
    limit = min(50, max(1, size))
    counted = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long"))
    return counted.select(F.least(F.greatest(F.lit(page), F.lit(1)).cast("long"), "pages").alias("page"), F.lit(limit).alias("size"), "total", "pages")


def nulls_last(column: str, descending: bool = False) -> Column:
    """Nulls and blanks last in both directions."""
    c = F.nullif(F.col(column), F.lit(""))
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def newest(rows: DataFrame, when: str, key: str, n: int) -> DataFrame:
    """The n newest; rows without a time count as the oldest."""
    return rows.orderBy(F.col(when).desc_nulls_last(), key).limit(n)


def rotating_slot(rows: DataFrame, position: str, total: int, size: int, turn: int) -> DataFrame:
    """`size` rows of `total`, beginning where turn number `turn` does, around the end."""
    start = turn * size % max(1, total)
    return rows.filter(F.pmod(F.col(position) - F.lit(start), F.lit(max(1, total))) < min(size, total))


# Pages of a large table in one order --------------------------------------------------------------


def publish_order(rows: DataFrame, order: list[Column], path: str, parts: int) -> None:
    """Writes rows in a total order, cut into ranges of about the same size: a folder a range, and how many rows each has. One sort of the
    table, for any number of pages."""
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged.write.partitionBy("_part").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(_with_part(rows)).parquet(f"{path}/rows")
    written.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).coalesce(1).write.parquet(f"{path}/counts")


def _with_part(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])


def page_at(spark: SparkSession, path: str, schema: T.StructType, order: list[Column], page: Page) -> DataFrame:
    """A page of what publish_order() wrote, however deep: prefix sums of the ranges' counts tell where it lies, and only these ranges
    are read. A row a range comes to the driver."""
    counts = sorted(tuple(r) for r in spark.read.parquet(f"{path}/counts").collect())
    ends = list(accumulate(n for _, n in counts))
    first, last = bisect_right(ends, page.offset), bisect_left(ends, page.offset + page.limit)
    mine = [part for part, _ in counts[first : last + 1]]
    before = ends[first - 1] if first else 0
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{path}/rows").filter(F.col("_part").isin(mine)).drop("_part")
    return rows.orderBy(*order).offset(page.offset - before).limit(page.limit)


def total_of(spark: SparkSession, path: str) -> int:
    """How many rows there are in all, from the same counts."""
    return spark.read.parquet(f"{path}/counts").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
