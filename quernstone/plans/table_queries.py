"""Queries over relational tables: search, match, paging, joins, counters, change events, writes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import secrets, text
from quernstone.operators import dedup, match, paging, relational, search
from quernstone.session import scratch, table
from quernstone.sources import sinks

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def part_index(spark: SparkSession, d: str) -> DataFrame:
    """Facets of the catalogue: family and technology, the words of the name as keywords, and all ids."""
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    words = F.transform(F.split(text.fold(F.col("p_name")), " "), lambda w: F.struct(F.lit("keyword").alias("kind"), w.alias("value")))
    entry = lambda kind, v: F.array(F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(entry("family", text.fold(F.col("p_type"))), entry("technology", text.fold(F.col("p_brand"))), words, entry("all", F.lit("")))
    return p.select(F.explode(every).alias("e"), "id").select("e.kind", "e.value", "id").distinct()


BRANDS = ["Brand#2", "brand 17", "Brand#5"]
TYPES = ["ECONOMY", "standard"]
FACET_SQL = "lower(p_type) IN ('economy', 'standard') AND lower(p_brand) IN ('brand#2', 'brand#17', 'brand#5')"


@query(f"SELECT p_partkey AS id, p_name, p_type, p_brand FROM part WHERE {FACET_SQL} ORDER BY id LIMIT 20 OFFSET 20")
def facet_search_page(spark, d):
    """Any value in a facet, all facets together, the second page of twenty by id."""
    ids = search.ids_of_facets(part_index(spark, d), search.Query(family=TYPES, technology=BRANDS).facets())
    rows = table(spark, d, "part").withColumnRenamed("p_partkey", "id").join(ids, "id", "left_semi").select("id", "p_name", "p_type", "p_brand")
    return paging.page_of(rows, [F.col("id")], paging.Page.parse("2", "20"))


@query(f"SELECT p_partkey AS id FROM part WHERE {FACET_SQL}")
def facet_intersect(spark, d):
    return search.ids_of_facets(part_index(spark, d), search.Query(family=TYPES, technology=BRANDS).facets())


@query("SELECT p_partkey AS id FROM part WHERE contains(' ' || lower(p_name) || ' ', ' red ') OR contains(' ' || lower(p_name) || ' ', ' ring ') OR lower(p_type) = 'promo' OR lower(p_brand) IN ('red', 'ring')")
def facet_union(spark, d):
    """Keywords are a union of all their variants, each term included."""
    return search.ids_of_keywords(part_index(spark, d), ["Red ring", "PROMO"])


@query(f"SELECT p_partkey AS id FROM part WHERE {FACET_SQL} AND contains(' ' || lower(p_name) || ' ', ' small ')")
def facet_keywords(spark, d):
    return search.ids_of_facets(part_index(spark, d), search.Query(family=TYPES, technology=BRANDS).facets(), ["small"])


def part_jobs(spark: SparkSession, d: str) -> DataFrame:
    classification = F.struct(F.lower("p_type").alias("primaryFamily"), F.array(F.lower("p_name")).alias("relatedFamilies"), F.array(text.fold(F.col("p_brand"))).alias("technologies"), F.lit("pleno").alias("seniority"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "Lisboa, Portugal").otherwise("Remote").alias("location"), F.when(F.col("p_size") % 3 == 0, "Híbrido").otherwise("").alias("modality"), F.col("p_type").alias("description"), classification.alias("classification"))


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE lower(p_type) = 'economy' AND p_size % 2 = 0 AND p_size % 3 = 0 ORDER BY id LIMIT 15")
def search_verify(spark, d):
    """Place and type aren't in the index here: the rows verify them."""
    q = search.Query(family=["economy"], location="Portugal", type=["hibrido"])
    jobs, ix = part_jobs(spark, d), part_index(spark, d)
    ids = search.ids_of_facets(ix, {"family": ["economy"]})
    rows = search.verify(jobs.join(ids, "id", "left_semi"), q)
    return paging.page_of(rows, [F.col("id")], paging.Page(1, 15)).select("id", "title")


@query("SELECT p_partkey AS id, p_name AS title, 'fallback' AS source FROM part WHERE p_size % 2 = 0 ORDER BY id LIMIT 10")
def search_fallback(spark, d):
    """No posting has the state, so all rows are verified, and the state is forgotten."""
    rows, source = search.search(part_jobs(spark, d), part_index(spark, d), search.Query(state="SP", country="Portugal"), paging.Page(1, 10))
    return rows.select("id", "title", F.lit(source).alias("source"))


PROFILE = [("Red", 4), ("ring", 0.5), ("small", 2), ("RED", 3)]
#: RED replaces Red: weights 3, 1 and 2
MATCH_SQL = """
SELECT id, CASE WHEN n = 0 THEN 45 ELSE least(99, 55 + CAST(floor(w / 6.0 * 35 + 0.5) AS INTEGER) + least(4 * n, 9)) END AS match_score FROM (
  SELECT p_partkey AS id, r + g + s AS n, 3 * r + g + 2 * s AS w FROM (
    SELECT p_partkey, CAST(contains(t, ' red ') AS INTEGER) AS r, CAST(contains(t, ' ring ') AS INTEGER) AS g, CAST(contains(t, ' small ') AS INTEGER) AS s
    FROM (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS t FROM part)))
"""


@query(f"""
SELECT id, title, match_score, 'keywords' AS source FROM ({MATCH_SQL.replace("lower(p_name) || ' ' AS t", "lower(p_name) || ' ' || lower(p_type) || ' ' AS t")}) m JOIN (SELECT p_partkey AS id, p_name AS title, p_type FROM part) p USING (id)
WHERE contains(' ' || lower(title) || ' ', ' red ') OR contains(' ' || lower(title) || ' ', ' ring ') OR lower(p_type) = 'promo' ORDER BY match_score DESC, id LIMIT 20
""")
def search_by_match(spark, d):
    """A request without facets: ids by keywords, best matches first."""
    q = search.Query.parse({"keywords": ["Red, ring", "PROMO"], "sort": "DESC"})
    rows, source = search.search(part_jobs(spark, d), part_index(spark, d), q, paging.Page.parse(None, "20"), PROFILE)
    return rows.select("id", "title", "match_score", F.lit(source).alias("source"))


@query("SELECT p_partkey AS id, p_name AS title, 'index' AS source FROM part WHERE lower(p_type) IN ('economy', 'promo') AND lower(p_brand) IN ('brand#2', 'brand#17') ORDER BY id LIMIT 10")
def search_indexed(spark, d):
    """A request whose facets the index answers; the rows verify them."""
    q = search.Query.parse({"family": ["ECONOMY", "promo, "], "technology": "Brand#2,brand 17", "level": "todos", "contractType": "all"})
    rows, source = search.search(part_jobs(spark, d), part_index(spark, d), q, paging.Page.parse("1", "10"))
    return rows.select("id", "title", F.lit(source).alias("source"))


@query(MATCH_SQL)
def match_score(spark, d):
    return match.score(table(spark, d, "part"), F.col("p_name"), PROFILE).select(F.col("p_partkey").alias("id"), "match_score")


@query(f"SELECT * FROM ({MATCH_SQL}) ORDER BY match_score DESC, id LIMIT 25")
def match_top(spark, d):
    rows = match.score(table(spark, d, "part").withColumnRenamed("p_partkey", "id"), F.col("p_name"), PROFILE)
    return paging.page_of(rows, [F.col("match_score").desc(), F.col("id")], paging.Page(1, 25)).select("id", "match_score")


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS user_id, p_name AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
p AS (SELECT DISTINCT user_id, lower(split_part(id, ' ', 1)) AS term FROM o),
t AS (SELECT id, unnest(list_distinct(string_split(lower(id), ' '))) AS term FROM (SELECT DISTINCT p_name AS id FROM part)),
h AS (SELECT user_id, id, count(*) AS n FROM p JOIN t USING (term) GROUP BY 1, 2), w AS (SELECT user_id, count(*) AS total FROM p GROUP BY 1),
s AS (SELECT user_id, id, CAST(least(99, 55 + floor(n * 35.0 / total + 0.5) + least(4 * n, 9)) AS INTEGER) AS match_score FROM h JOIN w USING (user_id))
SELECT user_id, id, match_score FROM s ANTI JOIN o USING (user_id, id) WHERE match_score >= 85
""")
def match_high_new(spark, d):
    """Users' profiles are words of what they ordered; high matches among the names that they haven't ordered yet."""
    o, li, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    bought = o.select("o_orderkey", F.col("o_custkey").alias("user_id")).join(li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")), "o_orderkey")
    owned = bought.join(p.select("p_partkey", F.col("p_name").alias("id")), "p_partkey").select("user_id", "id").distinct()
    profile = owned.select("user_id", F.lower(F.split("id", " ")[0]).alias("term")).distinct().withColumns({"years": F.lit(1.0), "ordinal": F.lit(0)})
    texts = p.select(F.col("p_name").alias("id"), F.lower("p_name").alias("text")).distinct()
    return match.high_matches(match.score_profiles(texts, profile, match.HIGH_SHARE), owned, ["user_id", "id"])


# Paging and order


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_orders(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", "o_totalprice")
    return paging.page_of(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], paging.Page.parse(3, "50"))


@query("SELECT 3 AS page, 50 AS page_limit, count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50) AS has_next FROM orders WHERE o_orderstatus = 'P'")
def page_totals(spark, d):
    n = table(spark, d, "orders").filter("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / 50)
    return n.select(F.lit(3).alias("page"), F.lit(50).alias("page_limit"), "total", pages.alias("total_pages"), (F.lit(3) < pages).alias("has_next"))


@query("SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END, '') AS seg FROM customer) ORDER BY seg DESC NULLS LAST, c_custkey")
def sort_nulls_last(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.nullif(F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("")).alias("seg"))
    return rows.orderBy(paging.nulls_last("seg", descending=True), "c_custkey")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 8")
def topk_newest(spark, d):
    return paging.newest(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 8)


@query("SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)")
def distinct_sorted(spark, d):
    return table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")).distinct().orderBy("keyword")


@query("SELECT p_partkey FROM part WHERE (p_partkey - 1999 + 4000) % 2000 < 37")
def rotating_slot(spark, d):
    """37 of the first 2,000 parts' positions, beginning at the last one and going on at the first."""
    return paging.rotating_slot(table(spark, d, "part").select("p_partkey"), "p_partkey", 2000, 37, 1999 * pow(37, -1, 2000) % 2000)


# Joins


@query("SELECT n_name AS resource, r_name AS action, CASE WHEN n_nationkey % 4 = 0 THEN 'admin' ELSE 'user' END AS min_role, n_nationkey % 4 = 0 AS customized FROM nation JOIN region ON n_regionkey = r_regionkey")
def rules_left_override(spark, d):
    base = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("resource"), F.col("r_name").alias("action"), F.lit("user").alias("min_role"))
    over = base.filter("n_nationkey % 4 = 0").select("resource", "action", F.lit("admin").alias("min_role"))
    return relational.overridden(base.drop("n_nationkey"), over, ["resource", "action"], "min_role")


@query("SELECT n_name AS resource, 'admin' AS min_role FROM nation WHERE n_nationkey % 4 = 0")
def rules_diff(spark, d):
    base = table(spark, d, "nation").select(F.col("n_name").alias("resource"), F.lit("user").alias("min_role"), "n_nationkey")
    now = base.withColumn("min_role", F.when(F.col("n_nationkey") % 4 == 0, "admin").otherwise(F.col("min_role")))
    return relational.changed_rules(now.drop("n_nationkey"), base.drop("n_nationkey"), ["resource"], "min_role")


@query("""
WITH roles AS (SELECT unnest(['user', 'support', 'manager', 'admin']) AS role, unnest([0, 1, 2, 3]) AS level)
SELECT role, level, (SELECT count(*) FROM nation WHERE n_nationkey % 5 <= level) AS allowed FROM roles
""")
def role_actions_theta(spark, d):
    roles = spark.createDataFrame([(r, k) for k, r in enumerate(relational.ROLES)], "role string, level int")
    rules = table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("min_level"))
    return relational.allowed_counts(roles, rules)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_saved(spark, d):
    saved = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(saved, "c_custkey", "left_anti")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_status(spark, d):
    return relational.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT n_name AS provider, count(c_custkey) > 0 AS connected, count(c_custkey) AS accounts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' AND c_acctbal < 0 GROUP BY n_name")
def connections_left(spark, d):
    providers = table(spark, d, "nation").select(F.col("n_name").alias("provider"), "n_nationkey")
    accounts = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY' and c_acctbal < 0").join(F.broadcast(providers), F.col("c_nationkey") == F.col("n_nationkey")).select("provider")
    return relational.connections(providers.select("provider"), accounts)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'detail ' || p_brand ELSE p_name END AS p_name, p_type FROM part")
def detail_overlay(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    detail = p.filter("p_size % 3 <> 1").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("detail "), "p_brand")).otherwise("  ").alias("p_name"), F.lit("").alias("p_type"))
    return relational.overlaid(p.drop("p_size", "p_brand"), detail, "p_partkey", ["p_name", "p_type"])


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_totalprice > 300000")
def provider_user(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey = 7").select("c_custkey", "c_name")
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return c.join(o, "c_custkey").select("c_name", "o_orderkey")


@query("SELECT p_partkey, p_name, coalesce(y, 1) AS years FROM part LEFT JOIN (SELECT lower(c_mktsegment) AS t, max(c_nationkey) AS y FROM customer GROUP BY 1) ON t = lower(p_type)")
def experience_left(spark, d):
    y = table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("t")).agg(F.max("c_nationkey").alias("y"))
    return table(spark, d, "part").join(y, F.lower("p_type") == F.col("t"), "left").select("p_partkey", "p_name", F.coalesce("y", F.lit(1)).alias("years"))


# Counters


@query("""
SELECT o_orderpriority, count(*) FILTER (s = 'saved') AS saved, count(*) FILTER (s IN ('applied', 'interviewing')) AS active, count(*) FILTER (s = 'interviewing') AS interviewing, count(*) FILTER (s = 'accepted') AS accepted
FROM (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'saved' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'applied' ELSE 'interviewing' END ELSE 'accepted' END AS s FROM orders) GROUP BY 1
""")
def status_counters(spark, d):
    return relational.status_counters(saved_jobs(spark, d), "status", ["o_orderpriority"])


def saved_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "saved").when(s == "O", F.when(F.col("o_orderkey") % 2 == 0, "applied").otherwise("interviewing")).otherwise("accepted")
    return table(spark, d, "orders").withColumn("status", status)


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS started, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1) AS interviewing,
  CAST(floor(count(*) FILTER (o_orderstatus <> 'F') * 100 / greatest(count(*), 1) + 0.5) AS BIGINT) AS started_pct,
  CAST(floor(count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1) * 100 / greatest(count(*), 1) + 0.5) AS BIGINT) AS interviewing_pct FROM orders
""")
def funnel_pct(spark, d):
    return relational.funnel(saved_jobs(spark, d), "status")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NOBODY"]


@query("SELECT " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS) + " FROM customer")
def role_pivot(spark, d):
    return relational.role_counts(table(spark, d, "customer"), "c_mktsegment", SEGMENTS)


@query("SELECT source, count(*) AS jobs, count(DISTINCT lang) AS langs, count(DISTINCT n_chars) AS sizes, arg_min(substr(text, 1, 40), doc_id) AS first_title FROM documents GROUP BY source")
def source_rollup(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("lang").alias("langs"), F.countDistinct("n_chars").alias("sizes"), F.min_by(F.substring("text", 1, 40), "doc_id").alias("first_title"))


@query("SELECT count(*) AS rows, count(*) FILTER (event_type IN ('error', 'signup')) AS critical, count(DISTINCT user_id) AS actors FROM events WHERE event_type <> 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def audit_stats(spark, d):
    rows = relational.filtered(table(spark, d, "events"), {"user_id": None}, "ts", "2024-01-05", "2024-01-12").filter("event_type <> 'view'")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.rlike("event_type", F.lit("error|signup"))).alias("critical"), F.countDistinct("user_id").alias("actors"))


@query("SELECT event_id, ts, event_type, value FROM events WHERE event_type = 'purchase' AND user_id = 7 ORDER BY ts DESC, event_id LIMIT 100")
def audit_page(spark, d):
    rows = relational.filtered(table(spark, d, "events"), {"event_type": "purchase", "user_id": 7, "value": None}).select("event_id", "ts", "event_type", "value")
    return paging.page_of(rows, [F.col("ts").desc(), F.col("event_id")], paging.Page.parse(None, "0"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS checked, count(*) AS total FROM lineitem GROUP BY 1")
def checklist_nested(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("checked"))).alias("items"))
    return nested.select("l_orderkey", F.size(F.filter("items", lambda x: x["checked"])).cast("long").alias("checked"), F.size("items").cast("long").alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS cards FROM orders WHERE o_custkey = 899 GROUP BY 1")
def kanban(spark, d):
    """One user's board: a column for each status."""
    rows = relational.owned(table(spark, d, "orders"), 899, "o_custkey")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("cards"))


@query("""
SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users, (SELECT count(*) FROM orders) AS jobs,
  (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16') AS today, (SELECT count(DISTINCT source) FROM documents) AS sources
""")
def overview_kpis(spark, d):
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_k", F.lit(1))
    users = one(table(spark, d, "customer"), F.count(F.lit(1)).alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active_users"))
    jobs = one(table(spark, d, "orders"), F.count(F.lit(1)).alias("jobs"))
    today = one(table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-15' and ts < timestamp_ntz'2024-01-16'"), F.count(F.lit(1)).alias("today"))
    sources = one(table(spark, d, "documents"), F.countDistinct("source").alias("sources"))
    return users.join(jobs, "_k").join(today, "_k").join(sources, "_k").drop("_k")


@query("SELECT role, count(*) AS n, count(*) FILTER (turn > 2) AS unread, max(length(text)) AS longest FROM conversations GROUP BY role")
def notifications_unread(spark, d):
    rows = table(spark, d, "conversations").withColumn("read_at", F.when(F.col("turn") <= 2, F.lit("2024-01-01").cast("timestamp")))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("read_at").isNull()).alias("unread"), F.max(F.length("text")).cast("long").alias("longest"))


USERS_SQL = "u AS (SELECT c_custkey AS id, c_name AS username, lower(c_mktsegment) || ' ' || c_custkey AS display_name, 'mail' || (c_custkey % 50) || '@x.example' AS email, c_mktsegment AS role, c_acctbal < 0 AS is_blocked FROM customer)"
KEY = "a key for tests"


def users(spark, d):
    email = F.concat(F.lit("mail"), (F.col("c_custkey") % 50).cast("string"), F.lit("@x.example"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string")).alias("display_name"), email.alias("email"),
        secrets.hmac_sha256(email, KEY).alias("email_hash"), F.col("c_mktsegment").alias("role"), (F.col("c_acctbal") < 0).alias("is_blocked"),
    )


@query(f"""
WITH {USERS_SQL}
SELECT 'name' AS search, id FROM u WHERE role = 'BUILDING' AND (username ILIKE '%r#0000000%' OR display_name ILIKE '%r#0000000%') UNION ALL SELECT 'shown', id FROM u WHERE display_name ILIKE '%ING 1%' AND NOT is_blocked
UNION ALL SELECT 'mail', id FROM u WHERE email = 'mail7@x.example' UNION ALL SELECT 'part of a mail', id FROM u WHERE username ILIKE '%@x.example%' UNION ALL SELECT 'any', id FROM u WHERE is_blocked
""")
def users_filter(spark, d):
    u = users(spark, d)
    asked = {"name": {"search": "R#0000000", "role": "BUILDING"}, "shown": {"search": "ing 1", "blocked": False}, "mail": {"search": " Mail7@X.example ", "key": KEY}, "part of a mail": {"search": "@x.example", "key": KEY}, "any": {"blocked": True}}
    parts = [relational.users_found(u, **how).select(F.lit(name).alias("search"), "id") for name, how in asked.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""
WITH {USERS_SQL}
SELECT 'mail' AS search, id FROM u WHERE contains(email, 'mail7@') AND role = 'BUILDING' UNION ALL SELECT 'name', id FROM u WHERE contains(display_name, 'ing 1') AND is_blocked UNION ALL SELECT 'active', id FROM u WHERE NOT is_blocked AND role = 'MACHINERY'
""")
def users_list_filter(spark, d):
    u = users(spark, d).withColumnRenamed("display_name", "name")
    asked = {"mail": ("MAIL7@", "BUILDING", "all"), "name": (" ing 1", "all", "blocked"), "active": (" ", "MACHINERY", "active")}
    return reduce(DataFrame.unionByName, [relational.users_listed(u, *how).select(F.lit(name).alias("search"), "id") for name, how in asked.items()])


@query("SELECT doc_id, sum(w * m) / sum(w) AS coverage FROM (SELECT doc_id, unnest([3, 2, 1]) AS w, unnest([CAST(contains(text, 'the ') AS INTEGER), CAST(contains(text, 'und ') AS INTEGER), CAST(contains(text, 'la ') AS INTEGER)]) AS m FROM documents) GROUP BY doc_id")
def weighted_coverage(spark, d):
    parts = F.array(*[F.struct(F.lit(w).alias("w"), F.contains("text", F.lit(t)).cast("int").alias("m")) for w, t in ((3, "the "), (2, "und "), (1, "la "))])
    total = F.aggregate("parts", F.lit(0), lambda a, x: a + x["w"])
    got = F.aggregate("parts", F.lit(0), lambda a, x: a + x["w"] * x["m"])
    return table(spark, d, "documents").select("doc_id", parts.alias("parts")).select("doc_id", (got / total).alias("coverage"))


# Writes


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer UNION ALL SELECT -1, 'NEW'")
def upsert_latest(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    rows = t.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("seg")).unionByName(spark.createDataFrame([(-1, "EARLIER"), (-1, "NEW"), (-1, "NEW")], "c_custkey long, seg string"))
    return relational.upserted(t, rows, ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'X' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def insert_ignore(spark, d):
    c = table(spark, d, "customer")
    t = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return relational.inserted_if_new(t, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("X").alias("seg")), ["c_custkey"])


@query("SELECT o_orderkey, o_orderstatus AS from_status, 'F' AS to_status FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F'")
def status_change_events(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = old.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")))
    return relational.status_changes(old, new, "o_orderkey", "o_orderstatus", F.lit("2024-02-01").cast("timestamp")).select("o_orderkey", "from_status", "to_status")


@query("SELECT p_partkey AS id, p_name AS payload FROM part WHERE p_partkey % 3 = 0 AND NOT (p_partkey % 2 = 0 AND p_size > 25)")
def savebatch_anti(spark, d):
    """Of a batch, what no unexpired payload has yet."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload"), "p_size")
    stored = p.filter("id % 2 = 0").withColumn("expires_at", F.when(F.col("p_size") > 25, F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("timestamp"))
    return sinks.new_payloads(p.filter("id % 3 = 0").drop("p_size"), stored, "id", F.lit("2024-01-15").cast("timestamp")).drop("expires_at")


@query("""
SELECT r.o_orderkey AS request, CASE WHEN p.c_custkey IS NOT NULL THEN p.c_custkey WHEN e.c_custkey IS NOT NULL THEN e.c_custkey END AS user_id,
  CASE WHEN p.c_custkey IS NOT NULL THEN 'provider' WHEN e.c_custkey IS NOT NULL THEN 'email' ELSE 'created' END AS how
FROM orders r LEFT JOIN customer p ON p.c_custkey = r.o_custkey AND p.c_custkey % 2 = 0 LEFT JOIN customer e ON e.c_custkey = r.o_custkey AND e.c_nationkey < 12
""")
def find_or_create(spark, d):
    c = table(spark, d, "customer")
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("provider_id"), F.col("o_custkey").alias("email"))
    by_provider = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("provider_id"), F.col("c_custkey").alias("user_id"))
    by_email = c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("email"), F.col("c_custkey").alias("user_id"))
    return relational.find_or_create(requests, by_provider, by_email).select("request", "user_id", "how")


@query("SELECT count(*) AS rows, count(*) FILTER (c_acctbal > 0 AND c_nationkey % 2 = 0) AS changed FROM customer")
def backfill_counts(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("mail"), F.when(F.col("c_nationkey") % 2 == 1, "set").alias("mail_hash"))
    out = relational.backfill(t, "mail", "mail_hash", F.sha2("mail", 256))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("changed"))


@query("SELECT conv_id, turn, turn > 1 AND role = 'user' AS now_read FROM conversations")
def mark_read(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lit(None).cast("timestamp").alias("read_at"))
    out = relational.marked_read(t, (F.col("turn") > 1) & (F.col("role") == "user"), F.lit("2024-01-15").cast("timestamp"))
    return out.select("conv_id", "turn", F.col("read_at").isNotNull().alias("now_read"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey")
def delete_cascade(spark, d):
    parents = table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return relational.without_children(parents, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def cross_run_new(spark, d):
    """Customers without an urgent order in progress."""
    existing = table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.new_only(table(spark, d, "customer").select("c_custkey"), existing, "c_custkey")


@query("WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) SELECT o_custkey, o_orderpriority, (count(*) OVER (PARTITION BY o_custkey)) - 1 + CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) THEN 1 ELSE 0 END > 0 AS allowed FROM a")
def last_method_guard(spark, d):
    passwords = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.disconnectable(table(spark, d, "orders"), passwords, "o_custkey", "o_orderpriority")


@query("SELECT key FROM (SELECT 'jobs:' || p_type || ':' || p_partkey AS key FROM part) WHERE key NOT LIKE 'jobs:PROMO:%' AND key NOT LIKE 'jobs:%:1_'")
def cleared_by_pattern(spark, d):
    keys = table(spark, d, "part").select(F.concat_ws(":", F.lit("jobs"), "p_type", F.col("p_partkey").cast("string")).alias("key"))
    return relational.cleared_keys(keys, "key", ["jobs:PROMO:*", "jobs:*:1?"])[0]


@query("SELECT lower(trim(p_name)) AS keyword, min(p_partkey) AS ordinal FROM part GROUP BY 1")
def keyword_store(spark, d):
    path = scratch(spark, "keywords")
    sinks.save_keywords(table(spark, d, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("keyword"), F.col("p_partkey").alias("ordinal")), path)
    return sinks.load_keywords(spark, path)


@query("SELECT 'family' AS kind, p_type AS value, p_partkey AS id FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'brand', p_brand, p_partkey FROM part")
def published_postings(spark, d):
    """A second run replaces the kind that it has and leaves the other."""
    p, path = table(spark, d, "part"), scratch(spark, "index")
    entries = lambda rows, kind, c: rows.select(F.lit(kind).alias("kind"), F.col(c).alias("value"), F.col("p_partkey").alias("id"))
    sinks.publish_index(entries(p, "family", "p_brand").unionByName(entries(p, "brand", "p_brand")), path)
    sinks.publish_index(entries(p.filter("p_size % 2 = 0"), "family", "p_type"), path)
    return sinks.published_index(spark, path)


@query("""
SELECT 3 AS page, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80) UNION ALL SELECT 30, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 1160)
UNION ALL SELECT 0, count(*), NULL FROM orders
""")
def page_deep(spark, d):
    """Two pages and the total of a table that was put in order once."""
    o, path = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), scratch(spark, "order")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    paging.publish_order(o, order, path, 16)
    pages = [paging.page_at(spark, path, o.schema, order, paging.Page(p, 40)).select(F.lit(p).alias("page"), "o_orderkey", "o_totalprice") for p in (3, 30)]
    total = o.limit(1).select(F.lit(0).alias("page"), F.lit(paging.total_of(spark, path)).cast("long").alias("o_orderkey"), F.lit(None).cast(o.schema["o_totalprice"].dataType).alias("o_totalprice"))
    return reduce(DataFrame.unionByName, [*pages, total])


@query("SELECT 'orphan' AS kind, c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 AND NOT (c_custkey % 2 = 0 AND c_acctbal > 0) UNION ALL SELECT 'payload', c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND c_acctbal > 0 UNION ALL SELECT 'all', c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 UNION ALL SELECT 'sample', id FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 ORDER BY 1 LIMIT 5)")
def stored_payloads(spark, d):
    """Listed ids with their payloads, those whose payload is gone, the set after a run, and a sample."""
    c, now = table(spark, d, "customer"), F.lit("2024-01-10").cast("timestamp")
    ids = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    expiry = F.when(F.col("c_acctbal") > 0, F.lit("2024-01-11")).otherwise(F.lit("2024-01-09")).cast("timestamp")
    stored = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.to_json(F.struct("c_name")).alias("payload"), expiry.alias("expires_at"))
    parts = {"orphan": sinks.orphans(ids, stored, "id", now), "payload": sinks.payloads_of(ids, stored, "id", now, "c_name string").filter("c_name LIKE 'Customer%'"), "all": sinks.accumulated(ids, c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"))), "sample": sinks.sample_of(ids, "id", 5)}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in parts.items()])


@query("SELECT o_orderpriority AS run, count(DISTINCT o_orderstatus) AS adapters, count(DISTINCT o_custkey % 20) AS keywords, sum(o_custkey % 3) AS jobs, count(*) FILTER (o_orderstatus = 'F') AS errors, sum(o_orderkey % 7) AS seconds FROM orders GROUP BY 1")
def run_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("adapter"), (F.col("o_custkey") % 20).alias("keyword"), (F.col("o_custkey") % 3).alias("jobs"), (F.col("o_orderstatus") == "F").alias("failed"), (F.col("o_orderkey") % 7).alias("seconds"))
    return sinks.summary(o, ["run"])


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def cached_result(spark, d):
    """Made once, then read; never made again while it is fresh."""
    root, made = scratch(spark, "results"), table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.result_cache(spark, root, "types", lambda: made)
    return sinks.result_cache(spark, root, "types", lambda: made.limit(0))[0]
