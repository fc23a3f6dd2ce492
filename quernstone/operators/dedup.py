"""Entity resolution of job records: a key, and one merged record for each.

The order in which records merge is the order of an ordinal column; the result doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import fold, longest, url_key

LONGEST = ("title", "company", "location", "url")


def merge_key(title: Column, company: Column, location: Column, url: Column, source: Column) -> Column:
    """By identity where title and company are there, else by address, else by all there is."""
    t, c, p, u = fold(title), fold(company), fold(location), url_key(url)
    identity = F.concat(F.lit("identity:"), t, F.lit("|"), c, F.lit("|"), F.when(p == "", F.lit("sem-local")).otherwise(p))
    fallback = F.concat(F.lit("fallback:"), F.concat_ws("|", t, c, p, fold(source)))
    return F.when((t != "") & (c != ""), identity).when(u != "", F.concat(F.lit("url:"), u)).otherwise(fallback)


def united(rows: DataFrame, keys: list[str], place: Column, lists: dict[str, Column], own: dict[str, Column] | None = None) -> DataFrame:
    """keys.., and for each list an array of (at, own, v): the distinct values of all rows' arrays, trimmed and without blank ones, each with
    the first place where it stands: the row's `place` and the position in its array. `own` has a value for rows whose array is empty,
    marked as such.

    Each value's first place is a minimum that is taken before the shuffle, so a key of very many rows brings its distinct values
    to a task, not a list a row."""
    none = F.expr("cast(array() as array<string>)")
    parts = []
    for kind, values in lists.items():
        filled = F.coalesce(values, none)
        entry = lambda mark, kind=kind: lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(mark).alias("own"), F.trim(v).alias("v"), F.struct(place.alias("row"), i.alias("i")).alias("at"))
        alone = F.array((own or {}).get(kind, F.lit(None)).cast("string"))
        parts.append(F.when(F.size(filled) > 0, F.transform(filled, entry(False))).otherwise(F.transform(alone, entry(True))))
    entries = rows.select(*keys, F.explode(F.concat(*parts)).alias("e")).select(*keys, "e.*").filter("v <> ''")
    firsts = entries.groupBy(*keys, "kind", "own", "v").agg(F.min("at").alias("at"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "own", "v"))))
    return firsts.groupBy(*keys).agg(*[of(kind).alias(kind) for kind in lists])


def _values(entries: Column) -> Column:
    """Distinct values of united()'s entries, in order; no entries are an empty array."""
    return F.coalesce(F.array_distinct(F.transform(entries, lambda x: x["v"])), F.expr("cast(array() as array<string>)"))


def merge_records(jobs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """jobs: ordinal, title, company, location, url, source, sources, keyword, keywords and any other columns.

    Title, company, location and url become the longest by bytes, the first of equals; sources and keywords the union in
    order; the rest comes from the first record. A first record without sources has its own source as one; a
    later one without sources adds none."""
    names = [c for c in jobs.columns if c not in {*LONGEST, ordinal, "source", "sources", "keyword", "keywords"}]
    keyed = jobs.withColumn("merge_key", merge_key(*[F.coalesce(F.col(c), F.lit("")) for c in (*LONGEST, "source")]))
    o = F.col(ordinal)
    first = F.min_by(F.struct(*[F.col(c) for c in [*names, "source", "keyword"]]), o)
    one = keyed.groupBy("merge_key").agg(*[longest(F.coalesce(F.col(c), F.lit("")), o).alias(c) for c in LONGEST], first.alias("_first"), F.min(o).alias(ordinal))
    lists = united(keyed, ["merge_key"], o, {"sources": F.col("sources"), "keywords": F.col("keywords")}, {"sources": F.col("source"), "keywords": F.col("keyword")})
    both = one.join(lists, "merge_key", "left")
    # a record's own source or keyword counts for the first record only
    sources, keywords = (_values(F.filter(c, lambda x: ~x["own"] | (x["at"]["row"] == o))) for c in ("sources", "keywords"))
    out = both.select("merge_key", ordinal, *LONGEST, sources.alias("sources"), keywords.alias("keywords"), *[F.col(f"_first.{c}").alias(c) for c in names], F.col("_first.keyword").alias("_kw"), F.col("_first.source").alias("_src"))
    merged = out.withColumn("source", F.when(F.size("sources") > 0, F.array_join("sources", ", ")).otherwise(F.col("_src")))
    return merged.withColumn("keyword", F.when(F.size("keywords") > 0, F.get("keywords", F.lit(0))).otherwise(F.col("_kw"))).drop("_kw", "_src")


def merge_listed(jobs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The merge of a list as a reader sees it, where the later record counts. jobs as in merge_records.

    Title, company, location and url become the longest, the first of equals. Of all other columns the last record that has a value counts, a null
    overwrites nothing. Keywords are the union, in order, of the records' keywords and of the parts of their keyword field; sources
    that of the records' sources and of their source field. `source` and `keyword` are these, joined; a single record keeps its source
    and its sources as they are."""
    names = [c for c in jobs.columns if c not in {*LONGEST, ordinal, "source", "sources", "keyword", "keywords"}]
    keyed = jobs.withColumn("merge_key", merge_key(*[F.coalesce(F.col(c), F.lit("")) for c in (*LONGEST, "source")]))
    o = F.col(ordinal)
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    best = [F.max_by(F.trim(F.coalesce(F.col(c), F.lit(""))), F.struct(size(c), -o)).alias(c) for c in LONGEST]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in [*names, "source", "sources"]]
    one = keyed.groupBy("merge_key").agg(*best, *last, F.min(o).alias(ordinal), F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*LONGEST), o).alias("_own"))
    none = F.expr("cast(array() as array<string>)")
    words = F.concat(F.coalesce("keywords", none), F.coalesce(F.split("keyword", "[,;|]+"), none))
    origins = F.concat(F.coalesce("sources", none), F.array(F.coalesce("source", F.lit(""))))
    lists = united(keyed, ["merge_key"], o, {"_s": origins, "_k": words})
    both = one.join(lists, "merge_key", "left").withColumns({"_s": _values(F.col("_s")), "_k": _values(F.col("_k"))})
    many = F.col("_n") > 1
    return both.select(
        "merge_key",
        ordinal,
        *[F.when(many, F.col(c)).otherwise(F.col(f"_own.{c}")).alias(c) for c in LONGEST],
        *names,
        F.when(many & (F.size("_s") > 0), F.array_join("_s", ", ")).otherwise(F.coalesce("source", F.lit(""))).alias("source"),
        F.when(many, F.when(F.size("_s") > 0, F.col("_s"))).otherwise(F.col("sources")).alias("sources"),
        F.array_join("_k", ", ").alias("keyword"),
        F.col("_k").alias("keywords"),
    )


def merge_found(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Records of one feed that several searches found: of each key the first by `order`, with the keywords of all, in order; what
    no keyword found goes. Without the order's columns."""
    place = F.struct(*order)
    names = [c for c in records.columns if c not in order and c != "keywords"]
    first = records.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*names), place).alias("_r"))
    lists = united(records.withColumn("_k", F.col(key)), ["_k"], place, {"keywords": F.col("keywords")})
    out = first.join(lists, "_k").select("_r.*", _values(F.col("keywords")).alias("keywords")).filter(F.size("keywords") > 0)
    return out.withColumn("keyword", F.get("keywords", F.lit(0))).select(*[c for c in records.columns if c not in order])


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key by a total order. One aggregation, no sort of whole groups."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(best.alias("_r")).select("_r.*")


def met(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Those of the rows' keys that exist. The large side is what is scanned: where the rows are few, Spark broadcasts their keys and what exists
    doesn't move; where they aren't, both sides shuffle by the key."""
    return existing.select(key).join(rows.select(key).distinct(), key, "left_semi").distinct()


def new_only(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key doesn't exist."""
    return rows.join(met(existing, rows, key), key, "left_anti")


def distinct_in_order(rows: DataFrame, value: Column, ordinal: str) -> DataFrame:
    """Distinct values with the ordinal at which each came first."""
    return rows.select(value.alias("value"), F.col(ordinal)).filter("value <> ''").groupBy("value").agg(F.min(ordinal).alias(ordinal))


def pages_taken(items: DataFrame, feed: list[str], page: str, place: str, key: Column, size: int | None = None) -> DataFrame:
    """The items of the pages that a reader takes, page by page, until a feed ends: at a page that is missing, at one whose signature an earlier
    page of the feed has had, and, where a page's `size` is given, after one that is short.

    A signature is of the keys of a page in their places, blank ones left out; a page without keys has none. Where a feed ends is a minimum over its
    page numbers, and so is where a signature came first: narrow rows, one a page."""
    known = F.nullif(F.trim(key), F.lit(""))
    keys = F.transform(F.array_sort(F.collect_list(F.when(known.isNotNull(), F.struct(F.col(place).alias("p"), known.alias("k"))))), lambda x: x["k"])
    pages = items.groupBy(*feed, page).agg(F.count(F.lit(1)).alias("_n"), F.when(F.size(keys) > 0, F.sha2(F.array_join(keys, "\n"), 256)).alias("_signature"))
    line = Window.partitionBy(*feed).orderBy(page)
    # the first of the pages with a signature, by feed; pages without one are told apart by their numbers
    same = Window.partitionBy(*feed, F.coalesce("_signature", F.col(page).cast("string")))
    seen = pages.withColumns({"_earlier": F.min(page).over(same), "_before": F.lag(page).over(line)})
    ends_before = (F.col("_earlier") < F.col(page)) | (F.col("_before").isNotNull() & (F.col("_before") < F.col(page) - 1))
    last = F.when(ends_before, F.col(page) - 1)
    if size is not None:
        last = last.when(F.col("_n") < size, F.col(page))
    ends = seen.groupBy(*feed).agg(F.min(last).alias("_last"))
    return items.join(ends, feed).filter(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).select(*items.columns)
