"""Queries over job postings made of the catalogue: feeds, filters, inference, classification, index kinds, views.

Titles, places and descriptions are picked from short lists by the part's number, so that every rule of the word lists is met;
the SQL states the rules again from the same lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import filters, infer, predicates, secrets, text
from quernstone.functions import taxonomy as T
from quernstone.operators import classify, index, paging, projections
from quernstone.plans.text_queries import any_sql, fold_sql, rules_sql, unescape_sql
from quernstone.session import spread, table
from quernstone.sources import feeds

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


TITLES = [
    "Desenvolvedor Backend Sênior", "Engenheiro de Software", "Software Engineer", "Estágio em Front-end", "Data Engineer Jr", "Motorista de Van", "Assistente Financeiro", "Analista de Sistemas", "React Native Developer",
    "QA Engineer / Tester", "Tech Lead", "Banco de Talentos - Devs", "Product Designer UI", "DevOps SRE (Hybrid)", "Trainee de Vendas", "Full-Stack Developer", "Cientista de Dados", " ",
]
DESCRIPTIONS = [
    "Go, Golang e PostgreSQL; API REST. Contrato CLT, home office.", "React, TypeScript e Next.js. Pessoa jurídica (PJ).", "Python, SQL, Spark &amp; Airflow on AWS, full-time", "Kubernetes, Docker, Terraform, CI/CD; híbrido", "",
    "Selenium, Cypress e Jest", "Kotlin, Swift, Flutter. Freelance contractor", "Vendas e atendimento presencial", "OWASP, SIEM, pentest, IAM; cooperativa", "Java, Spring Boot, Kafka, .NET, C#; worldwide", "node js, NestJS, MongoDB",
]
PLACES = ["São Paulo, SP", "Remoto", "Lisboa, Portugal", "Berlin, Germany", "Remote - USA", "Curitiba / PR", "", "New York, United States", "Ciudad de México, México", "Rio de Janeiro - RJ", "Singapore", "Global", "Porto Alegre (RS)"]
MODES = ["Remoto", "Híbrido", "Presencial", ""]
JOIN = "concat_ws(' ', title, company, location, modality, description)"


def picked(values: list[str], step: int = 1) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / step) % len(values) + 1).cast("int"))


def lit_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def picked_sql(values: list[str], step: int = 1) -> str:
    return "([" + ", ".join(map(lit_sql, values)) + f"])[(p_partkey // {step}) % {len(values)} + 1]"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """id, ordinal and the feeds' columns."""
    none = F.expr("cast(array() as array<string>)")
    p = spread(table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string")), "id")
    return p.select(
        "id", F.col("p_partkey").alias("ordinal"), picked(TITLES).alias("title"), F.col("p_brand").alias("company"), picked(PLACES, 3).alias("location"),
        F.lit("").alias("url"), picked(MODES, 7).alias("modality"), picked(DESCRIPTIONS, 2).alias("description"), F.lit("2024-02-29").alias("postedAt"), F.col("p_type").alias("source"),
        F.array("p_type").alias("sources"), F.col("p_name").alias("keyword"), F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(none).alias("keywords"),
    )


JOBS_SQL = f"""jobs AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ordinal, {picked_sql(TITLES)} AS title, p_brand AS company, {picked_sql(PLACES, 3)} AS location, {picked_sql(MODES, 7)} AS modality,
  {picked_sql(DESCRIPTIONS, 2)} AS description, p_type AS source, p_name AS keyword, p_size % 2 = 0 AS listed FROM part),
folded AS (SELECT *, {fold_sql(JOIN)} AS t, {fold_sql('title')} AS tt, {fold_sql('location')} AS tl FROM jobs)"""


# Inference


def place_sql(t: str) -> str:
    """country, location, continent, state and city of a folded place."""
    country = rules_sql(t, [(c, a) for c, _, a in T.COUNTRIES], "")
    continent = rules_sql(t, [(k, a) for _, k, a in T.COUNTRIES], "")
    return f"""(SELECT *, CASE WHEN named = '' AND state <> '' THEN 'Brasil' ELSE named END AS country,
      CASE WHEN named = '' AND state <> '' THEN 'Brasil' WHEN named <> '' THEN named WHEN remote THEN '{T.GLOBAL_LABEL}' ELSE '' END AS location,
      CASE WHEN named = '' AND state <> '' THEN 'América do Sul' WHEN land <> '' THEN land WHEN remote THEN '{T.GLOBAL_LABEL}' ELSE '' END AS continent
    FROM (SELECT id, t, tt, {country} AS named, {continent} AS land, {any_sql(t, T.GLOBAL_WORDS)} AS remote, {rules_sql(t, T.STATES, '')} AS state, {rules_sql(t, [(c, [c]) for c in T.CITIES], '')} AS city FROM folded))"""


def level_sql(t: str, trainee: list[str]) -> str:
    return rules_sql(t, [("estagio", trainee), ("senior", T.SENIOR), ("junior", T.JUNIOR)], "pleno")


def stems_sql(t: str, rules, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in words) + f" THEN '{value}'" for value, words in rules) + f" ELSE '{default}' END"


@query(f"""WITH {JOBS_SQL} SELECT id, {level_sql('t', T.TRAINEE_INDEX)} AS level, {level_sql('t', T.TRAINEE_CLASSIFIER)} AS seniority, {level_sql('tt', T.TRAINEE_SEARCH)} AS title_level,
  {rules_sql('t', T.MODEL_TOKENS, 'presencial')} AS model, {stems_sql('t', T.MODEL_STEMS, 'presencial')} AS search_model, {rules_sql('t', T.CONTRACTS, '')} AS contract, {rules_sql('tl', T.SEARCH_COUNTRIES, '')} AS search_country FROM folded""")
def infer_facets(spark, d):
    j = text.once(jobs(spark, d), "t", text.fold(F.concat_ws(" ", "title", "company", "location", "modality", "description")))
    t, title = F.col("t"), text.fold(F.col("title"))
    return j.select("id", infer.level_index(t).alias("level"), infer.seniority(t).alias("seniority"), infer.level_search(title).alias("title_level"), infer.model_index(t).alias("model"), infer.model_search(t).alias("search_model"), infer.contract(t).alias("contract"), infer.country_search(text.fold(F.col("location"))).alias("search_country"))


@query(f"WITH {JOBS_SQL} SELECT id, country, location, continent, state, city FROM {place_sql('tl')}")
def infer_places(spark, d):
    j = text.once(jobs(spark, d).select("id", "location"), "t", text.fold(F.col("location"))).select("id", infer.place(F.col("t")).alias("p"))
    return j.select("id", "p.country", "p.location", "p.continent", "p.state", "p.city")


@query(f"""
WITH {JOBS_SQL}, p AS {place_sql('tl')},
l AS (SELECT id, unnest([{{'kind': 'level', 'value': {level_sql('t', T.TRAINEE_INDEX)}}}, {{'kind': 'model', 'value': {rules_sql('t', T.MODEL_TOKENS, 'presencial')}}}, {{'kind': 'contract', 'value': {rules_sql('t', T.CONTRACTS, '')}}},
  {{'kind': 'country', 'value': country}}, {{'kind': 'location', 'value': location}}, {{'kind': 'continent', 'value': continent}}, {{'kind': 'state', 'value': state}}, {{'kind': 'city', 'value': city}}]) AS e FROM p)
SELECT DISTINCT kind, value, id FROM (SELECT e.kind AS kind, {fold_sql('e.value')} AS value, id FROM l) WHERE value NOT IN ('', 'todos', 'all')
""")
def index_structured(spark, d):
    return index.structured_index(jobs(spark, d), "id")


@query("SELECT p_partkey, CASE WHEN trim(p_brand) <> 'Brand#1' THEN trim(p_brand) WHEN p_size % 2 = 0 THEN trim(p_type) ELSE 'unknown' END AS source FROM part")
def source_fallback(spark, d):
    own = F.when(F.col("p_brand") == "Brand#1", F.lit(" ")).otherwise(F.col("p_brand"))
    lists = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.expr("cast(array() as array<string>)"))
    return table(spark, d, "part").select("p_partkey", infer.source_of(own, lists).alias("source"))


# Classification by the library's own families


def family_sql(f: str) -> str:
    parts = [f"CASE WHEN {any_sql('t', [term])} THEN {w} ELSE 0 END" for terms, w in zip(T.FAMILIES[f], classify.WEIGHTS) for term in terms]
    return " + ".join(parts)


TECH_SQL = "list_filter([" + ", ".join(f"CASE WHEN {any_sql('t', a)} THEN '{n}' END" for n, a in sorted(T.TECHNOLOGIES.items())) + "], lambda x: x IS NOT NULL)"
BLOCKED_SQL = "CASE " + " ".join(f"WHEN {any_sql('tt', [term])} THEN '{prefix}: {term}'" for prefix, terms in T.BLOCKED_TITLES for term in terms) + " END"
CLASSIFIED_SQL = f"""{JOBS_SQL},
scored AS MATERIALIZED (SELECT *, list_sort(list_filter([{", ".join(f"{{'minus': -({family_sql(f)}), 'family': '{f}'}}" for f in sorted(T.FAMILIES))}], lambda x: x.minus < 0)) AS s, {TECH_SQL} AS tech, {BLOCKED_SQL} AS blocked,
  {level_sql('t', T.TRAINEE_CLASSIFIER)} AS seniority FROM folded),
classified AS MATERIALIZED (SELECT *, blocked IS NOT NULL OR len(s) = 0 AS other, -s[1].minus AS best,
  list_distinct(list_concat(list_transform(list_filter(s[2:], lambda x: x.minus <= -3), lambda x: x.family), CASE WHEN s[1].family = 'mobile' AND list_contains(tech, 'react-native') THEN ['frontend'] ELSE [] END)) AS near FROM scored),
result AS MATERIALIZED (SELECT *, CASE WHEN other THEN 'other' ELSE s[1].family END AS primary_family, CASE WHEN other THEN [] ELSE near END AS related, CASE WHEN other THEN false ELSE best >= 2 END AS in_scope,
  CASE WHEN other THEN 0.0 ELSE round(least(0.99, 0.35 + best * 0.08), 2) END AS confidence,
  coalesce(blocked, CASE WHEN len(s) = 0 THEN 'nenhuma familia reconhecida' WHEN best < 2 THEN 'score abaixo do minimo' ELSE 'classificacao local por titulo descricao tecnologias' END) AS reason FROM classified)"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(jobs(spark, d))


@query(f"WITH {CLASSIFIED_SQL} SELECT id, primary_family, array_to_string(list_sort(related), ',') AS related, array_to_string(tech, ',') AS technologies, seniority, in_scope, CAST(confidence AS DOUBLE) AS confidence, reason FROM result")
def job_classification(spark, d):
    c = F.col("classification")
    return classified(spark, d).select("id", c["primaryFamily"].alias("primary_family"), F.array_join(F.array_sort(c["relatedFamilies"]), ",").alias("related"), F.array_join(c["technologies"], ",").alias("technologies"), c["seniority"].alias("seniority"), c["inScope"].alias("in_scope"), c["confidence"].alias("confidence"), F.get(c["reasons"], F.lit(0)).alias("reason"))


@query(f"WITH {CLASSIFIED_SQL} SELECT id, title FROM result WHERE in_scope")
def jobs_in_scope(spark, d):
    return classify.in_scope(classified(spark, d)).select("id", "title")


@query(f"""WITH {CLASSIFIED_SQL} SELECT source, count(*) AS input, count(*) FILTER (in_scope) AS approved, count(*) FILTER (NOT in_scope) AS rejected, count(*) FILTER (NOT in_scope AND trim(description) <> '') AS rejected_with_description,
  count(*) FILTER (NOT in_scope AND listed) AS rejected_with_keywords, count(*) FILTER (NOT in_scope AND len(tech) > 0) AS rejected_with_technologies FROM result GROUP BY source""")
def job_funnel(spark, d):
    return classify.funnel(classified(spark, d))


@query(f"""
WITH {CLASSIFIED_SQL}, f AS (SELECT id, list_distinct(list_concat([primary_family], related)) AS families, tech, seniority FROM result),
e AS (SELECT id, 'family' AS kind, unnest(families) AS v FROM f UNION ALL SELECT id, 'technology', unnest(tech) FROM f UNION ALL SELECT id, 'keyword', unnest(families) FROM f
  UNION ALL SELECT id, 'keyword', unnest(tech) FROM f UNION ALL SELECT id, 'seniority', seniority FROM f)
SELECT DISTINCT kind, {fold_sql('v')} AS value, id FROM e
""")
def index_classification(spark, d):
    return index.classification_index(classified(spark, d), "id")


@query("SELECT 'all' AS kind, '' AS value, CAST(p_partkey AS VARCHAR) AS id FROM part")
def index_global(spark, d):
    return index.global_index(jobs(spark, d), "id")


# Filters


def soft_sql(c: str) -> str:
    return rf"trim(regexp_replace(translate(lower({unescape_sql(c)}), '/-', '  '), '\s+', ' ', 'g'))"


def has_sql(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {lit_sql(w)})" for w in words) + ")"


@query(f"""WITH {JOBS_SQL} SELECT id FROM jobs WHERE contains({soft_sql("title || ' ' || description")}, 'engine') AND (modality = 'Remoto' OR contains({soft_sql('location')}, 'sp') OR contains({soft_sql('company')}, 'sp'))
  AND (source = '' OR lower(source) = 'promo')""")
def request_filter(spark, d):
    asked = filters.Request(keyword="Engine", language=" PROMO ", location=" SP ")
    own = filters.request_match(asked, F.concat_ws(" ", "title", "description"), F.col("modality") == "Remoto", [F.col("location"), F.col("company")], F.col("source"))
    return jobs(spark, d).filter(own).select("id")


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE modality = 'Remoto'")
def request_remote_only(spark, d):
    return jobs(spark, d).filter(filters.request_match(filters.Request(remote_only=True, location="x"), F.col("title"), F.col("modality") == "Remoto", [F.col("location")])).select("id")


@query(f"""
WITH {JOBS_SQL}, s AS (SELECT id, {soft_sql('title')} AS a, {soft_sql("title || ' ' || description")} AS b FROM jobs),
r AS (SELECT *, {has_sql('a', T.STRONG_ROLES)} AS strong, {has_sql('a', T.SIGNALS)} AND {has_sql('a', T.ROLE_SIGNALS)} AS paired, {has_sql('a', T.GENERIC_TITLES)} AND ({has_sql('b', T.STRONG_ROLES)} OR {has_sql('b', T.SIGNALS)}) AS generic FROM s)
SELECT id, a <> '' AND NOT {has_sql('a', T.NON_CONCRETE)} AND (strong OR paired OR (generic AND NOT {has_sql('a', T.HARD_NEGATIVE)})) AS accepted FROM r
""")
def technology_jobs(spark, d):
    return jobs(spark, d).select("id", filters.technology_job(F.col("title"), F.col("description")).alias("accepted"))


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE listed AND contains(keyword, 'red') AND contains({fold_sql('concat_ws(' + chr(39) + ' ' + chr(39) + ', title, company, location, keyword)')}, 'dev') AND contains({fold_sql('concat_ws(' + chr(39) + ' ' + chr(39) + ', title, company, location, keyword)')}, 'brand 1')")
def list_filter(spark, d):
    j = jobs(spark, d)
    ticked = j.select(F.col("keyword").alias("_ticked")).filter(F.contains("_ticked", F.lit("red"))).distinct()  # what a user ticked in the list of keywords
    some = j.select("*", F.explode(F.array_distinct("keywords")).alias("_keyword")).join(ticked, F.col("_keyword") == F.col("_ticked"), "left_semi")
    return some.filter(filters.list_match(F.col("keywords"), F.concat_ws(" ", "title", "company", "location", "keyword"), "Dév; /Brand#1", [])).select("id").distinct()


@query(f"WITH {JOBS_SQL} SELECT id, modality IN ('Remoto', 'Híbrido') AS flexible, true AS every, CASE modality WHEN '' THEN 'Todos' WHEN 'Remoto' THEN 'Remoto' WHEN 'Híbrido' THEN 'RemotoHibrido' ELSE 'RemotoPresencial' END AS filter FROM jobs")
def model_filters(spark, d):
    m = F.col("modality")
    kinds = F.when(m == "", F.expr("cast(array() as array<string>)")).otherwise(F.array(m, F.lit("Remoto")))
    return jobs(spark, d).select("id", filters.model_match(m, "RemotoHibrido").alias("flexible"), filters.model_match(m, "?").alias("every"), filters.model_filter_of(kinds).alias("filter"))


CONTINENT_SQL = "CASE " + " ".join(f"WHEN {has_sql('lower(trim(location))', words)} THEN '{name}'" for name, words in T.UI_CONTINENTS) + " ELSE 'Desconhecido' END"


@query(f"WITH {JOBS_SQL} SELECT id, {CONTINENT_SQL} AS continent, {CONTINENT_SQL} = 'Europa' AND contains(lower(trim(location)), 'portugal') AS in_portugal FROM jobs")
def continents_of_list(spark, d):
    place = F.col("location")
    return jobs(spark, d).select("id", filters.continent(place).alias("continent"), filters.place_match(place, "Europa", "Portugal").alias("in_portugal"))


@query("SELECT event_id, CASE WHEN contains(w, 'mentor') OR contains(w, 'mentoria') THEN 'mentor' WHEN contains(w, 'recruiter') OR contains(w, 'recrutador') OR contains(w, 'rh') THEN 'recruiter' ELSE 'system' END AS origin, CASE WHEN event_type = 'signup' THEN 'match' WHEN event_type = 'purchase' THEN 'success' ELSE 'info' END AS kind FROM (SELECT *, event_type || CASE event_id % 3 WHEN 0 THEN ' da Mentoria' WHEN 1 THEN ' do RH' ELSE '' END AS title, lower(event_type || ' ' || title) AS w FROM events)")
def message_origins(spark, d):
    title = F.concat("event_type", F.element_at(F.array(F.lit(" da Mentoria"), F.lit(" do RH"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")))
    kind = F.when(F.col("event_type") == "signup", "high_match").when(F.col("event_type") == "purchase", "job_applied").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", filters.message_origin(F.col("event_type"), title).alias("origin"), filters.notification_type(kind).alias("kind"))


# Views, secrets, names


MODEL_UI_SQL = stems_sql("regexp_replace(lower(strip_accents({})), '', '')", projections.MODELS, "Presencial")
LEVEL_UI_SQL = rules_sql("{}", projections.LEVELS, "Pleno")


@query(f"""
WITH {JOBS_SQL}, v AS (SELECT *, coalesce(nullif(trim(title), ''), '{projections.NO_TITLE}') AS j, coalesce(nullif(trim(location), ''), '{projections.NO_PLACE}') AS l FROM jobs)
SELECT ordinal, j AS job_title, l AS location, {MODEL_UI_SQL.replace('{}', "concat_ws(' ', j, l, nullif(modality, ''), nullif(description, ''))")} AS type, {LEVEL_UI_SQL.replace('{}', fold_sql('j'))} AS level,
  CAST(70 + (SELECT sum(unicode(x)) FROM unnest(string_split(j || ':' || company, '')) AS u(x)) % 26 AS INTEGER) AS score, trim(keyword) AS tags, '29/02/2024' AS posted, source FROM v
""")
def recommended_jobs(spark, d):
    r = projections.recommended(jobs(spark, d).withColumn("title", F.col("title")))
    return r.select(F.element_at(F.split("id", ":"), -1).cast("long").alias("ordinal"), F.col("jobTitle").alias("job_title"), "location", "type", "level", F.col("matchScore").alias("score"), F.array_join("tags", ",").alias("tags"), "posted", "source")


@query(f"SELECT o_orderkey AS id, coalesce(nullif(trim(CASE o_orderkey % 3 WHEN 0 THEN ' ' ELSE o_orderpriority END), ''), '{projections.NO_SAVED_TITLE}') AS title, '{projections.NO_PLACE}' AS location, 'Presencial' AS type, 'Pleno' AS level, coalesce(nullif(trim(o_orderstatus), ''), 'Geral') AS tags, 'Manual' AS source, '' AS notes FROM orders")
def saved_job_rows(spark, d):
    title = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), title.alias("jobTitle"), F.lit(None).cast("string").alias("company"), F.lit(" ").alias("location"), F.col("o_orderstatus").alias("keyword"), F.lit("saved").alias("status"), F.lit("#").alias("jobLink"), F.lit("").alias("source"), F.lit(None).cast("string").alias("notes"))
    return projections.saved(o).select("id", F.col("jobTitle").alias("title"), "location", "type", "level", F.array_join("tags", ",").alias("tags"), "source", "notes")


@query("SELECT p_partkey, trim(p_name) AS title, CASE WHEN p_size % 2 = 0 THEN 'Remoto' ELSE trim(p_brand) END AS location, 'A combinar' AS salary, CASE WHEN p_size % 3 = 0 THEN 'Geral' ELSE trim(p_type) || ',' || trim(p_brand) END AS tags, '#' AS link FROM part")
def form_defaults(spark, d):
    p = table(spark, d, "part").withColumns({"jobTitle": F.concat(F.lit(" "), "p_name"), "company": F.lit(""), "location": F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.col("p_brand")), "type": F.lit("Remoto"), "salary": F.lit(None).cast("string"), "tags": F.when(F.col("p_size") % 3 == 0, F.lit(" , ")).otherwise(F.concat("p_type", F.lit(", "), "p_brand", F.lit(","))), "jobLink": F.lit(""), "source": F.lit(""), "notes": F.lit("")})
    return projections.from_form(p).select("p_partkey", F.col("jobTitle").alias("title"), "location", "salary", F.array_join("tags", ",").alias("tags"), F.col("jobLink").alias("link"))


SEARCH_KEY, MASTER_KEY = "a key of searches", b"0123456789abcdef0123456789abcdef"


def _pad_sql(pad: int) -> str:
    return "from_hex('" + bytes(b ^ pad for b in SEARCH_KEY.encode().ljust(64, b"\0")).hex() + "')"


@query(f"SELECT c_custkey, sha256({_pad_sql(0x5C)} || from_hex(sha256({_pad_sql(0x36)} || encode(c_name)))) AS hash FROM customer")
def searchable_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", secrets.hmac_sha256(F.col("c_name"), SEARCH_KEY).alias("hash"))


@query("SELECT c_custkey, 'v1' AS version, 'default' AS key_id, 24 AS iv, 32 AS tag, CAST(2 * strlen(c_name) AS INTEGER) AS size, c_name AS plain FROM customer")
def encrypted_fields(spark, d):
    c = table(spark, d, "customer").select("c_custkey", secrets.encrypted(F.col("c_name"), MASTER_KEY).alias("e"))
    c = text.once(c, "payload", F.col("e"))
    part = F.split("payload", ":")
    n = lambda k: F.length(F.get(part, F.lit(k))).cast("int")
    return c.select("c_custkey", F.get(part, F.lit(0)).alias("version"), F.get(part, F.lit(1)).alias("key_id"), n(2).alias("iv"), n(3).alias("tag"), n(4).alias("size"), secrets.decrypted(F.col("payload"), MASTER_KEY).alias("plain"))


@query("SELECT c_custkey, c_name AS email, CASE WHEN c_custkey % 2 = 0 THEN 'plain ' || c_name ELSE c_mktsegment END AS level, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ',x' ELSE 'own' END AS technologies FROM customer")
def public_users(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("hidden").alias("email"), secrets.encrypted(F.col("c_name"), MASTER_KEY).alias("emailEncrypted"), F.concat(F.lit("plain "), "c_name").alias("level"), F.when(F.col("c_custkey") % 2 == 1, secrets.encrypted(F.col("c_mktsegment"), MASTER_KEY)).alias("levelEncrypted"), F.array(F.lit("own")).alias("technologies"), F.when(F.col("c_custkey") % 3 == 0, secrets.encrypted(F.to_json(F.array("c_mktsegment", F.lit("x"))), MASTER_KEY)).alias("technologiesEncrypted"))
    for name in ("emailEncrypted", "levelEncrypted", "technologiesEncrypted"):  # as if they were stored
        c = text.once(c.withColumnRenamed(name, "_e"), name, F.col("_e")).drop("_e")
    return projections.public_user(c, MASTER_KEY, ["email", "level"], ["technologies"]).select("c_custkey", "email", "level", F.array_join("technologies", ",").alias("technologies"))


@query("""
WITH b AS (SELECT c_custkey, lower(c_mktsegment) AS base FROM customer),
t AS (SELECT lower(c_mktsegment) || CASE k WHEN 0 THEN '' ELSE '_' || k END AS username FROM (SELECT DISTINCT c_mktsegment FROM customer), range(0, 3) r(k) WHERE k < length(c_mktsegment) % 4),
n AS (SELECT base, min(k) AS k FROM (SELECT DISTINCT base FROM b), range(0, 21) r(k) WHERE base || CASE k WHEN 0 THEN '' ELSE '_' || k END NOT IN (SELECT username FROM t) GROUP BY base)
SELECT c_custkey, base || CASE k WHEN 0 THEN '' ELSE '_' || k END AS username FROM b JOIN n USING (base)
""")
def free_usernames(spark, d):
    c = table(spark, d, "customer")
    taken = c.select("c_mktsegment").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).filter(F.col("k") < F.length("c_mktsegment") % 4)
    taken = taken.select(F.concat(F.lower("c_mktsegment"), F.when(F.col("k") == 0, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("k").cast("string")))).alias("username"))
    return projections.usernames(c.select("c_custkey", "c_mktsegment"), taken, "c_mktsegment").select("c_custkey", "username")


@query("""
SELECT least(greatest(p, 1), greatest(1, CAST(ceil(n / 50) AS BIGINT))) AS page, 50 AS size, n AS total, CAST(greatest(1, ceil(n / 50)) AS BIGINT) AS pages FROM (SELECT count(*) AS n FROM supplier), (SELECT unnest([2, 1000000000, -3]) AS p)
""")
def page_of_list(spark, d):
    s = table(spark, d, "supplier")
    return reduce(DataFrame.unionByName, [paging.list_page(s, p, 70) for p in (2, 10**9, -3)])


# Feeds: documents made of the catalogue, read and projected


def _raw(spark: SparkSession, d: str, doc: Column) -> DataFrame:
    return spread(table(spark, d, "part"), "p_partkey").select(F.to_json(doc).alias("value"), F.col("p_type").alias("keyword"), F.lit("ACME").alias("board"))


def _read(spark: SparkSession, d: str, feed: str, doc: Column) -> DataFrame:
    jobs_ = feeds.READERS[feed](feeds.parsed(_raw(spark, d, doc), feed))
    return jobs_.select(*[F.array_join(c, ",").alias(c) if c in ("sources", "keywords") else c for c in feeds.JOB])


def feed_sql(source: str, **fields: str) -> str:
    own = {"source": f"'{source}'", "sources": f"'{source}'", "keyword": "p_type", "keywords": "p_type", **fields}
    return "SELECT " + ", ".join(f"{own.get(c, chr(39) * 2)} AS {c}" for c in feeds.JOB) + " FROM part"


S = F.struct


def even() -> Column:
    return F.col("p_size") % 2 == 0


@query(feed_sql("Adzuna", id="'http://x/' || p_partkey", title="p_name", company="p_mfgr", location="p_container", url="'http://x/' || p_partkey", salary="CASE WHEN p_size % 2 = 0 THEN p_size || '-' || (p_size + 0.5) ELSE '' END", postedAt="'2024-01-01'").replace("p_mfgr", "p_brand").replace("p_container", "p_type"))
def feed_adzuna(spark, d):
    url = F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))
    low = F.when(even(), F.col("p_size").cast("double")).otherwise(F.lit(0.0))
    r = S(F.concat(F.lit(" "), "p_name").alias("title"), S(F.col("p_brand").alias("display_name")).alias("company"), S(F.col("p_type").alias("display_name")).alias("location"), F.lit(" ").alias("redirect_url"), url.alias("url"), low.alias("salary_min"), F.when(even(), low + 0.5).otherwise(F.lit(0.0)).alias("salary_max"), F.lit("2024-01-01").alias("created"))
    return _read(spark, d, "adzuna", S(F.array(r).alias("results")))


@query(feed_sql("Greenhouse", id="CASE WHEN p_size % 2 = 0 THEN 'http://g/' || p_partkey WHEN p_partkey > 0 THEN 'greenhouse:' || p_partkey ELSE p_name END", title="p_name", company="'ACME'", location="'Remote' || ' | ' || p_brand || ' | HQ'", url="CASE WHEN p_size % 2 = 0 THEN 'http://g/' || p_partkey ELSE '' END", modality="'Remoto'", description="'Build ' || p_type || chr(10) || chr(10) || 'Departamentos: Eng' || chr(10) || chr(10) || 'Escritórios: HQ - ' || p_brand || chr(10) || chr(10) || 'Metadados: Size: ' || p_size", postedAt="'2024-01-01'", keyword="p_type", keywords="p_type"))
def feed_greenhouse(spark, d):
    content = F.concat(F.lit("&lt;p&gt;Build&lt;/p&gt; &lt;b&gt;"), "p_type", F.lit("&lt;/b&gt;"))
    link = F.when(even(), F.concat(F.lit("http://g/"), F.col("p_partkey").cast("string"))).otherwise(F.lit(""))
    meta = F.array(S(F.lit("Size").alias("name"), F.col("p_size").cast("string").alias("value")), S(F.lit("x").alias("name"), F.lit(" ").alias("value")))
    job = S(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), content.alias("content"), link.alias("absolute_url"), F.lit("2024-01-01").alias("updated_at"), meta.alias("metadata"), F.array(S(F.lit("Eng").alias("name")), S(F.lit("ENG ").alias("name"))).alias("departments"), F.array(S(F.lit("HQ").alias("name"), F.col("p_brand").alias("location"))).alias("offices"), S(F.lit("Remote").alias("name")).alias("location"))
    return _read(spark, d, "greenhouse", S(F.array(job).alias("jobs")))


@query(feed_sql("Lever", id="'lever:' || p_partkey", title="p_name", company="'ACME'", location="p_brand || ' | BR'", url="'http://a'", salary="'A partir de ' || p_size || ' USD year'", modality="CASE WHEN p_size % 2 = 0 THEN 'Híbrido' ELSE 'Full' END", description="'Hi ' || p_type || chr(10) || chr(10) || 'Must: Go'", postedAt="'2023-11-14T22:13:20Z'"))
def feed_lever(spark, d):
    doc = S(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.lit("http://a").alias("applyUrl"), F.lit(1_700_000_000_000).alias("createdAt"), F.lit("BR").alias("country"),
        S(F.col("p_brand").alias("location"), F.lit("Full").alias("commitment"), F.array("p_brand").alias("allLocations")).alias("categories"), F.concat(F.lit("<b>Hi</b> "), "p_type").alias("description"),
        F.array(S(F.lit("Must").alias("text"), F.lit("<li>Go</li>").alias("content"))).alias("lists"), S(F.col("p_size").cast("double").alias("min"), F.lit("USD").alias("currency"), F.lit("year").alias("interval")).alias("salaryRange"), F.when(even(), F.lit("hybrid")).otherwise(F.lit("")).alias("workplaceType"),
    )
    return _read(spark, d, "lever", doc)


@query(
    feed_sql("Gupy", id="'gupy:' || p_partkey", title="p_name", company="p_brand", location="p_type || ' / BR'", url="'http://j/' || p_partkey", modality="CASE WHEN p_size % 2 = 0 THEN 'Remoto' ELSE 'Presencial' END", description="p_type", postedAt="'2024-01-01'")
    + " UNION ALL SELECT "
    + ", ".join(f"{x} AS {c}" for c, x in {**dict.fromkeys(feeds.JOB, "''"), "id": "'http://s/' || p_size", "title": "'Shared'", "url": "'http://s/' || p_size", "source": "'Gupy'", "sources": "'Gupy'", "keyword": "min(p_type)", "keywords": "string_agg(DISTINCT p_type, ',' ORDER BY p_type)"}.items())
    + " FROM part GROUP BY p_size"
)
def feed_gupy(spark, d):
    """Each document has a job of its own, one without an id that other keywords find, too, and two that lack a title or an address."""
    job = S(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("careerPageName"), F.lit("http://c").alias("careerPageUrl"), F.concat(F.lit("http://j/"), F.col("p_partkey").cast("string")).alias("jobUrl"), F.col("p_type").alias("city"), F.lit("").alias("state"), F.lit("BR").alias("country"), F.lit("on-site").alias("workplaceType"), even().alias("isRemoteWork"), F.lit("2024-01-01").alias("publishedDate"), F.col("p_type").alias("description"))
    bare = lambda name, url: S(F.lit("").alias("id"), F.lit(name).alias("name"), F.lit("").alias("careerPageName"), F.lit("").alias("careerPageUrl"), url.alias("jobUrl"), *[F.lit("").alias(c) for c in ("city", "state", "country", "workplaceType")], F.lit(False).alias("isRemoteWork"), F.lit("").alias("publishedDate"), F.lit("").alias("description"))
    shared = bare("Shared", F.concat(F.lit("http://s/"), F.col("p_size").cast("string")))
    return _read(spark, d, "gupy", S(F.array(shared, job, bare("", F.lit("http://x")), bare("No address", F.lit(""))).alias("data")))


@query(feed_sql("InHire", id="'inhire:acme:' || p_partkey", title="p_name", company="'acme'", location="p_brand", url="'https://acme.inhire.app/vagas/' || p_partkey || '/' || replace(p_name, ' ', '-')", modality="'Remoto'", description="'Published' || chr(10) || 'Remote'") + " WHERE p_size % 2 = 0")
def feed_inhire(spark, d):
    job = S(F.col("p_name").alias("displayName"), F.col("p_partkey").cast("string").alias("jobId"), F.when(even(), F.lit("Published")).otherwise(F.lit("draft")).alias("status"), F.lit("Remote").alias("workplaceType"), F.col("p_brand").alias("location"))
    return _read(spark, d, "inhire", S(F.lit("acme").alias("slug"), F.lit("").alias("tenantName"), F.array(job).alias("jobsPage")))


@query(feed_sql("Jooble", id="CASE WHEN p_size % 2 = 0 AND p_partkey > 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name || '|' || p_brand || '|' || p_type END", title="p_name", company="p_brand", location="p_type", salary="'10'", modality="'Full'", description="p_type", postedAt="'2024'"))
def feed_jooble(spark, d):
    job = S(F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"), F.col("p_type").alias("snippet"), F.lit("10").alias("salary"), F.lit("Full").alias("type"), F.lit("2024").alias("updated"), F.when(even(), F.col("p_partkey")).otherwise(F.lit(0)).alias("id"))
    return _read(spark, d, "jooble", S(F.lit(1).alias("totalCount"), F.array(job).alias("results")))


@query(feed_sql("The Muse", id="CAST(p_partkey AS VARCHAR)", title="p_name", company="p_brand", location="'A, ' || p_type", url="'http://m/' || p_partkey", description="'About ' || p_type || ' Data Senior'", postedAt="'2024-01-01'"))
def feed_themuse(spark, d):
    job = S(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), S(F.col("p_brand").alias("name")).alias("company"), S(F.concat(F.lit("http://m/"), F.col("p_partkey").cast("string")).alias("landing_page")).alias("refs"), F.array(S(F.lit("A").alias("name")), S(F.col("p_type").alias("name"))).alias("locations"), F.array(S(F.lit("Data").alias("name"))).alias("categories"), F.array(S(F.lit("Senior").alias("name"))).alias("levels"), F.concat(F.lit("<p>About</p> "), "p_type").alias("contents"), F.lit("2024-01-01").alias("publication_date"))
    return _read(spark, d, "themuse", S(F.array(job).alias("results")))


PLACE_SQL = "p_type || CASE p_size % 4 WHEN 0 THEN ', Porto' WHEN 1 THEN ', BRASIL' WHEN 2 THEN ' &Aacute;vila' ELSE '' END"
ASKED_SQL = f"""CASE WHEN p_size % 5 = 0 THEN p_type || CASE p_size % 4 WHEN 0 THEN ', Porto' WHEN 1 THEN ', BRASIL' WHEN 2 THEN ' Ávila' ELSE '' END
  WHEN p_size % 4 IN (0, 1) THEN {PLACE_SQL} WHEN p_size % 4 = 2 THEN p_type || ' Ávila, Brasil' ELSE p_type || ', Brasil' END"""


@query(feed_sql("LinkedIn", id="'http://l/' || p_partkey", title="p_name", company="p_brand", location=ASKED_SQL, url="'http://l/' || p_partkey", postedAt="'2024-01-01'", keyword="''", keywords="''"))
def feed_linkedin(spark, d):
    """Cards with and without a place that was asked for: some have it already, some tell a country of their own."""
    k = F.col("p_size") % 4
    place = F.concat("p_type", F.when(k == 0, ", Porto").when(k == 1, ", BRASIL").when(k == 2, " &Aacute;vila").otherwise(""))
    card = F.concat(F.lit('<ul><li><a href="http://l/'), F.col("p_partkey").cast("string"), F.lit('/?ref=1"></a><h3 class="base-search-card__title"> '), "p_name", F.lit('</h3><h4 class="base-search-card__subtitle">'), "p_brand", F.lit('</h4><span class="job-search-card__location">'), place, F.lit('</span><time class="x" datetime="2024-01-01">now</time></li><li>none</li></ul>'))
    asked = F.when(F.col("p_size") % 5 == 0, " ").otherwise(" Brasil ")
    out = feeds.linkedin(spread(table(spark, d, "part"), "p_partkey").select(card.alias("html"), asked.alias("search_location")))
    return out.select(*[F.array_join(c, ",").alias(c) if c in ("sources", "keywords") else c for c in feeds.JOB])


TOKENS_SQL = "list_contains(regexp_extract_all(lower(t), '[a-z0-9+#.]+'), '{}')"


def asked_sql(*groups: list[str]) -> str:
    one = lambda w: f"contains(lower(t), '{w}')" if any(c in w for c in ".#+") else TOKENS_SQL.format(w)
    return " AND ".join("(" + " OR ".join(map(one, g)) + ")" for g in groups)


@query(f"""
WITH p AS (SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN ' Golang Engineer' WHEN 1 THEN ' Go-dev' WHEN 2 THEN ' NodeJS/software' WHEN 3 THEN ' x.net C#2' WHEN 4 THEN ' Cargo Engineers' ELSE ' node.js server' END AS t FROM part)
SELECT p_partkey, {asked_sql(["golang", "go"], ["developer", "engineer", "dev", "software"])} AS go_developer, {asked_sql(["node.js", "nodejs", "node"])} AS node, {asked_sql(["c#", "csharp"], [".net", "dotnet"])} AS net, true AS every, false AS none FROM p
""")
def feed_synonyms(spark, d):
    """A feed's keywords with what stands for their terms."""
    k = F.col("p_size") % 6
    t = F.concat("p_name", F.when(k == 0, " Golang Engineer").when(k == 1, " Go-dev").when(k == 2, " NodeJS/software").when(k == 3, " x.net C#2").when(k == 4, " Cargo Engineers").otherwise(" node.js server"))
    asked = {"go_developer": " Go Developer", "node": "Node", "net": "C# .NET", "every": " ", "none": "é!"}
    return table(spark, d, "part").select("p_partkey", *[predicates.synonym_match(t, w).alias(n) for n, w in asked.items()])


@query("SELECT slug, arg_min(name, n) AS name FROM (SELECT lower(p_brand) AS slug, p_name AS name, p_partkey AS n FROM part WHERE p_size % 5 > 0) GROUP BY slug")
def board_catalog(spark, d):
    p = table(spark, d, "part")
    return feeds.catalog(p.select(F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.lower("p_brand")).alias("slug"), F.lit("").alias("name"), F.col("p_name").alias("companyName"), F.col("p_partkey").alias("ordinal")))


@query("SELECT DISTINCT s_name, t AS token FROM (SELECT s_name, unnest([replace(b, '-', ''), b, replace(b, '-', '_'), replace(b, '-', '') || 'inc']) AS t FROM (SELECT s_name, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS b FROM supplier))")
def board_tokens(spark, d):
    return feeds.board_candidates(table(spark, d, "supplier"), "s_name")


@query("""
WITH c AS (SELECT DISTINCT s_name, t AS token FROM (SELECT s_name, unnest([replace(b, '-', ''), b, replace(b, '-', '_'), replace(b, '-', '') || 'inc']) AS t FROM (SELECT s_name, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS b FROM supplier))),
v AS (SELECT replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-', '_') AS token FROM supplier WHERE s_suppkey % 9 = 1)
SELECT token, s_name, token IN (SELECT token FROM v) AS valid FROM c ORDER BY valid DESC, token LIMIT 40
""")
def boards_probed(spark, d):
    """The first forty candidates, those with a board before the others."""
    s = table(spark, d, "supplier")
    boards = s.filter("s_suppkey % 9 = 1").select(F.replace(text.slug(F.col("s_name")), F.lit("-"), F.lit("_")).alias("token"))
    return feeds.probed(feeds.board_candidates(s, "s_name"), boards).limit(40)


@query("SELECT family, count(*) AS n FROM (SELECT ['Adzuna', 'Green House', 'Lever', 'The Muse', 'linkedin', 'Jooble', 'My Lever'][p_size % 7 + 1] AS family FROM part) GROUP BY 1")
def adapter_families(spark, d):
    named_ = F.element_at(F.array(*map(F.lit, ("Adzuna BR", "Green House (x)", "Lever", "The Muse 2", "LinkedIn jobs", "Jooble", "My Lever"))), (F.col("p_size") % 7 + 1).cast("int"))
    return table(spark, d, "part").groupBy(infer.adapter_family(named_).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH p AS (SELECT page_id, '<script id="__NEXT_DATA__">{"a": ["' || url || '", {"b": "x&amp;y <b>z</b>", "n": 1}], "s": "no"}</script><style>p {}</style><p>Page ' || page_id || '</p><script>var x</script>' AS h, url FROM pages)
SELECT page_id, url || ' x&y z Page ' || page_id AS detail FROM p
""")
def page_details(spark, d):
    parts = [F.lit('<script id="__NEXT_DATA__">{"a": ["'), F.col("url"), F.lit('", {"b": "x&amp;y <b>z</b>", "n": 1}], "s": "no"}</script><style>p {}</style><p>Page '), F.col("page_id").cast("string"), F.lit("</p><script>var x</script>")]
    return table(spark, d, "pages").select("page_id", text.detail_text(F.concat(*parts)).alias("detail"))
