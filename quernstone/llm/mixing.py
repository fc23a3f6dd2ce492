"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's rows are cut into blocks of `block_rows` in order of a key. With whole-number weights a of
the sources and their sum A, block j (from 0) of a source has the release time floor(j A / a) and the
deadline ceil((j + 1) A / a). A schedule of one block a slot takes, in each slot, the released block of the
earliest deadline; every block then runs within its window, so after any number of slots a source
has had less than one block more or less than its share, as long as no source has run out.

Sources of equal weight are scheduled as one group, whose weight is their sum, and take its blocks in turn. With m of
them, block k of the group is block k div m of the source k mod m, and the group's window of it lies inside that source's: both
begin at k A / (m a) or before, and end at (k + 1) A / (m a) or after. So the earliest deadline is sought among as
many groups as there are different weights, however many sources there are.

The groups' pattern repeats after A slots, so one period is computed, by folds over ROUND slots each in one row (as many rounds
as the period has, and no further than the last block needs), and every block finds its slot by
arithmetic: no task sees a whole source. Places within a source follow a hash of the key; they come from counts of hash ranges,
their running sums and ranks inside a range, so a source with a third of all rows is spread like the rest.

When a source runs out its slots stay empty and the others keep their slots: all rows are returned,
none twice. `within` says that a block's slot comes before the first empty one, where the bound holds.

Defined results: a null source is a source of its own with the default weight; null keys are a key like any
other; repeated rows take places of their own (ties in the key are ordered by the other columns that were asked
for, equal rows in any order); an empty table gives no rows; extra columns pass through `mixed` untouched, and through `mix` and
`placed` but for those that have the name of a column they add, whose place that takes.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import documents, materialize

#: Target weights of the synthetic sources; any other source, null included, has weight 1.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
BLOCK_ROWS = 16
#: Rows of a source that a hash bucket holds, about.
BUCKET_ROWS = 2048
#: Slots that one row folds over, and that it appends to one array (each append copies the array).
ROUND, RUN = 1 << 20, 256

#: The columns that mix() adds.
ADDED = ["weight", "place", "block", "slot", "release", "deadline", "within"]


def weight_of(source: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in weights.items():
        out = F.when(source == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _round(given: list[int], shares: list[int], start: int, stop: int) -> Column:
    """The slots from start to stop: struct<given, runs: array<array<struct<i, place>>>>, where i is the group that a slot
    is given to, place which of the group's blocks runs in it, and given the groups' blocks before."""
    a = "array(" + ", ".join(f"{x}L" for x in shares) + ")"
    period = f"{sum(shares)}L"
    best = f"""
      array_min(filter(transform(s.given, (g, i) -> if(g * {period} div {a}[i] <= t,
        named_struct('deadline', ((g + 1) * {period} + {a}[i] - 1) div {a}[i], 'i', i), null)), x -> x is not null)).i"""
    run = f"""
      aggregate(sequence(t0, least(t0 + {RUN - 1}L, {stop - 1}L)), named_struct('given', r.given, 'slots', cast(array() as array<struct<i: int, place: bigint>>)),
        (s, t) -> element_at(transform(array({best}), b -> named_struct(
          'given', transform(s.given, (g, i) -> if(i = b, g + 1, g)),
          'slots', array_append(s.slots, named_struct('i', b, 'place', s.given[b])))), 1))"""
    return F.expr(f"""
      aggregate(sequence({start}L, {stop - 1}L, {RUN}L), named_struct('given', array({", ".join(f"{x}L" for x in given)}), 'runs', cast(array() as array<array<struct<i: int, place: bigint>>>)),
        (r, t0) -> element_at(transform(array({run}), x -> named_struct('given', x.given, 'runs', array_append(r.runs, x.slots))), 1))""")


def schedule(spark: SparkSession, shares: list[int], slots: int) -> DataFrame:
    """The first `slots` slots of groups with these shares: i (which share), place (which of its blocks), slot."""
    given, parts = [0] * len(shares), []
    for start in range(0, slots, ROUND):
        stop = min(slots, start + ROUND)
        one = spark.range(1).select(_round(given, shares, start, stop).alias("r")).select("r.*")
        if slots > ROUND:  # a round is read for its slots and for what the next one begins with
            one = materialize(one, "mix-round")
        if stop < slots:
            given = list(one.select("given").first()[0])
        parts.append(one.select(F.posexplode(F.flatten("runs")).alias("at", "s")).select("s.i", "s.place", (F.col("at") + F.lit(start)).cast("long").alias("slot")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return materialize(out, "mix-schedule")


def places(rows: DataFrame, source: str, order: list[str], size: DataFrame) -> DataFrame:
    """Adds `place`: 0, 1, .. within each source, in order of the md5 of the order columns together and then of the
    order columns. Ranges of the md5 are the buckets: a key that many rows share is dealt out by the other columns. size: a row a source with its number of rows, n."""
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("long")
    part = F.floor(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    # a key without nulls, so that the window and the join are dealt alike and the rows move once
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    sizes = size.select(named.alias("_key"), F.col("n").alias("_n"))
    dealt = rows.withColumns({"_md5": key, "_key": named}).join(sizes, "_key").withColumn("_bucket", part).drop("_n")
    counts = dealt.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_key", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy("_md5", *order)))
    out = ranked.join(base, ["_key", "_bucket"])
    return out.withColumn("place", (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_key", "_bucket", "_base", "_rank", "_md5")


def _mix(rows: DataFrame, source: str, order: list[str], weights: dict[str, int], default: int, block_rows: int) -> DataFrame:
    """rows, whose columns have none of ADDED's names, with those columns.

    A row a source and a row a slot of the period are written, and joined without a hint: Spark broadcasts them where their
    size allows it, and elsewhere splits what is frequent."""
    spark = rows.sparkSession
    size = materialize(rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    weighted = size.select(F.col(source).alias("source"), "n", weight_of(F.col(source), weights, default).alias("weight"))
    # a row a different weight: as many as the caller named, and the default
    groups = sorted(tuple(r) for r in weighted.groupBy("weight").agg(F.count(F.lit(1)), F.max("n")).collect())
    if not groups:
        return rows.select("*", *[F.lit(None).cast("boolean" if c == "within" else "long").alias(c) for c in ADDED])
    if groups[0][0] < 1:
        raise ValueError("weights must be positive")
    total = sum(w * m for w, m, _ in groups)
    unit = gcd(*[w * m for w, m, _ in groups])
    shares, period = [w * m // unit for w, m, _ in groups], total // unit
    # the block after a source's last one is the last whose slot is asked for
    last = max(-(-((-(-n // block_rows) + 1) * m) * period // a) for (_, m, n), a in zip(groups, shares))
    slots = schedule(spark, shares, min(period, last + 1))
    listed = spark.createDataFrame([(w, i, m, a) for i, ((w, m, _), a) in enumerate(zip(groups, shares))], "weight long, i int, many long, share long")
    members = places(weighted, "weight", ["source"], listed.select("weight", F.col("many").alias("n"))).withColumnRenamed("place", "turn")
    per = materialize(members.join(F.broadcast(listed), "weight").select(F.col("source").alias("_source"), "n", "weight", "i", "many", "share", "turn"), "mix-members")

    def timed(blocks: DataFrame) -> DataFrame:
        """blocks with their slot: that of the group's block, in the period it falls into."""
        own = F.expr("block * many + turn")
        asked = blocks.withColumns({"_round": F.expr("(block * many + turn) div share"), "place_": own % F.col("share")})
        found = asked.join(slots.withColumnRenamed("place", "place_").withColumnRenamed("slot", "slot_"), ["i", "place_"])
        return found.withColumn("slot", F.col("_round") * period + F.col("slot_")).drop("i", "place_", "_round", "slot_")

    gap = timed(per.withColumn("block", F.ceil(F.col("n") / block_rows).cast("long"))).agg(F.min("slot")).first()[0]
    dealt = places(rows, source, order, size).withColumn("block", F.expr(f"place div {block_rows}"))
    joined = timed(dealt.join(per, F.col(source).eqNullSafe(F.col("_source"))))
    out = joined.withColumns({"release": F.expr(f"block * {total} div weight"), "deadline": F.expr(f"((block + 1) * {total} + weight - 1) div weight"), "within": F.col("slot") < F.lit(gap)})
    return out.select(*rows.columns, *ADDED)


def _numbered(rows: DataFrame, source: str, order: list[str], how: dict) -> DataFrame:
    """_mix() of rows whose column k is named c<k>."""
    at = rows.columns.index
    return _mix(rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]), f"c{at(source)}", [f"c{at(c)}" for c in order], how.get("weights") or {}, how.get("default", 1), how.get("block_rows", BLOCK_ROWS))


def placed(rows: DataFrame, source: str = "source", order: list[str] | None = None, names: dict[str, str] | None = None, **how) -> DataFrame:
    """rows with some of mix()'s columns, under names of one's own: {column: name}."""
    names = names or {c: c for c in ADDED}
    out = _numbered(rows, source, order or ["doc_id"], how)
    new = {n.lower() for n in names.values()}
    stay = [F.col(f"c{k}").alias(c) for k, c in enumerate(rows.columns) if c.lower() not in new]
    return out.select(*stay, *[F.col(c).alias(n) for c, n in names.items()])


def mix(rows: DataFrame, source: str = "source", order: list[str] | None = None, weights: dict[str, int] | None = None, default: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with weight, place, block, slot, release, deadline and within. The mixed order is (slot, place)."""
    return placed(rows, source, order, weights=weights, default=default, block_rows=block_rows)


def mixed(rows: DataFrame, source: str = "source", order: list[str] | None = None, **how) -> DataFrame:
    """rows themselves, all of them and with their own columns only, in the mixed order."""
    out = _numbered(rows, source, order or ["doc_id"], how).orderBy("slot", "place")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rows.columns)])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars")
    out = mix(docs, order=["doc_id", "lang", "n_chars"], weights=WEIGHTS)
    return out.select("doc_id", "source", "weight", "block", "slot", "release", "deadline", "within")


OP4_SQL = """
WITH RECURSIVE sized AS (
  SELECT source, count(*) AS n, CAST(CASE source WHEN 'src0' THEN 6 WHEN 'src1' THEN 4 WHEN 'src2' THEN 3 WHEN 'src3' THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM documents GROUP BY source),
members AS (
  SELECT *, count(*) OVER (PARTITION BY weight) AS many, row_number() OVER (PARTITION BY weight ORDER BY md5(coalesce(source, '')), source NULLS FIRST) - 1 AS turn FROM sized),
listed AS (
  SELECT list({'weight': weight, 'share': weight * many} ORDER BY weight) AS s, CAST(sum(weight * many) AS BIGINT) AS period FROM (SELECT DISTINCT weight, many FROM members)),
fold AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS given, CAST(NULL AS BIGINT) AS k FROM listed WHERE len(s) > 0
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: CASE WHEN i = best THEN g + 1 ELSE g END), best
  FROM (SELECT f.t, f.given, list_min(list_transform(list_filter(range(1, len(l.s) + 1), lambda i: (f.given[i] * l.period) // l.s[i].share <= f.t),
          lambda i: {'deadline': -((-(f.given[i] + 1) * l.period) // l.s[i].share), 'i': i})).i AS best
        FROM fold f, listed l WHERE f.t < l.period) q),
slots AS (
  SELECT l.s[k].weight AS weight, t - 1 AS slot, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS place, l.period, l.s[k].share AS share FROM fold, listed l WHERE k IS NOT NULL),
placed AS (
  SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(lang, '') || '|' || coalesce(CAST(n_chars AS VARCHAR), '')), doc_id, lang, n_chars) - 1) // 16 AS block FROM documents),
gaps AS (
  SELECT min(((ceil(z.n / 16)::BIGINT * z.many + z.turn) // x.share) * x.period + x.slot) AS gap
  FROM members z JOIN slots x ON z.weight = x.weight AND x.place = (ceil(z.n / 16)::BIGINT * z.many + z.turn) % x.share)
SELECT p.doc_id, p.source, z.weight, p.block, ((p.block * z.many + z.turn) // x.share) * x.period + x.slot AS slot,
  p.block * x.period // z.weight AS release, ((p.block + 1) * x.period + z.weight - 1) // z.weight AS deadline,
  ((p.block * z.many + z.turn) // x.share) * x.period + x.slot < gap AS within
FROM placed p JOIN members z ON p.source IS NOT DISTINCT FROM z.source
JOIN slots x ON z.weight = x.weight AND x.place = (p.block * z.many + z.turn) % x.share, gaps
"""
