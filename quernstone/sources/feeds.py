"""Job feeds as one schema. Each reader takes the feed's JSON (or HTML) as read by Spark and projects job records.

Fields that a feed lacks are empty strings, never null; ids that may be numbers or strings are read as strings.
One feed that can't be read doesn't keep the others back: malformed rows have null fields and are left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators.dedup import merge_found

JOB = ["id", "title", "company", "location", "url", "salary", "modality", "description", "postedAt", "source", "sources", "keyword", "keywords"]

#: Schemas of the feeds' documents (fixed values).
SCHEMAS = {
    "adzuna": "results array<struct<title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,url:string,salary_min:double,salary_max:double,created:string>>",
    "greenhouse": "jobs array<struct<id:bigint,title:string,content:string,absolute_url:string,updated_at:string,language:string,requisition_id:string,metadata:array<struct<name:string,value:string>>,departments:array<struct<name:string>>,offices:array<struct<name:string,location:string>>,location:struct<name:string>>>",
    "lever": "id string, text string, hostedUrl string, applyUrl string, createdAt bigint, country string, categories struct<team:string,department:string,location:string,commitment:string,level:string,allLocations:array<string>>, description string, descriptionPlain string, descriptionBodyPlain string, openingPlain string, additionalPlain string, salaryDescription string, lists array<struct<text:string,content:string>>, salaryRange struct<min:double,max:double,currency:string,interval:string>, workplaceType string",
    "gupy": "data array<struct<id:string,name:string,careerPageName:string,careerPageUrl:string,jobUrl:string,city:string,state:string,country:string,workplaceType:string,isRemoteWork:boolean,publishedDate:string,description:string>>",
    "inhire": "slug string, tenantName string, about string, jobsPage array<struct<displayName:string,jobId:string,status:string,workplaceType:string,location:string,careerPageId:string>>",
    "jooble": "totalCount int, jobs array<struct<title:string,location:string,snippet:string,source:string,type:string,link:string,company:string,updated:string,salary:string,id:bigint>>, results array<struct<title:string,location:string,snippet:string,source:string,type:string,link:string,company:string,updated:string,salary:string,id:bigint>>",
    "themuse": "results array<struct<id:string,name:string,company:struct<name:string>,refs:struct<landing_page:string>,locations:array<struct<name:string>>,categories:array<struct<name:string>>,levels:array<struct<name:string>>,contents:string,description:string,publication_date:string>>",
}

REMOTE, HYBRID, ONSITE = ["remote", "remoto"], ["hybrid", "hibrido"], ["onsite", "on site"]


def s(c: Column | str) -> Column:
    """Trimmed, empty for null."""
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def items(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("array()"))


def names(c: str) -> Column:
    return text.non_empty(F.transform(F.coalesce(F.transform(F.col(c), lambda x: x["name"]), F.expr("cast(array() as array<string>)")), lambda x: F.coalesce(x, F.lit(""))))


def filled(parts: list[Column]) -> Column:
    return F.array(*[s(p) for p in parts])


def has(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def modality(c: Column, default: Column, remote_first: bool = False, remote: list[str] = REMOTE) -> Column:
    rules = [(HYBRID, "Híbrido"), (remote, "Remoto")]
    if remote_first:
        rules.reverse()
    out = F.when(has(c, rules[0][0]), rules[0][1]).when(has(c, rules[1][0]), rules[1][1])
    return out.when(has(c, [*ONSITE, "presencial"]), "Presencial").otherwise(default)


def records(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    """The common schema; `keyword` may be a column of rows: what the feed was asked for."""
    asked = s("keyword") if "keyword" in rows.columns else F.lit("")
    fields = {**fields, "source": F.lit(source), "sources": F.array(F.lit(source)), "keyword": asked, "keywords": text.non_empty(F.array(asked))}
    return rows.select(*[fields.get(c, F.lit("")).alias(c) for c in [*JOB, *(c for c in fields if c not in JOB)]])


def adzuna(raw: DataFrame) -> DataFrame:
    r = raw.withColumn("r", F.explode("results"))
    link = F.coalesce(F.nullif(s("r.redirect_url"), F.lit("")), s("r.url"))
    low, high = F.coalesce("r.salary_min", F.lit(0.0)), F.coalesce("r.salary_max", F.lit(0.0))
    number = lambda x: F.regexp_replace(x.cast("decimal(18,4)").cast("string"), r"\.?0+$", "")
    salary = F.when((low != 0) | (high != 0), F.concat_ws("-", F.coalesce(F.nullif(number(low), F.lit("")), F.lit("0")), F.coalesce(F.nullif(number(high), F.lit("")), F.lit("0")))).otherwise("")
    return records(r, "Adzuna", id=link, title=s("r.title"), company=s("r.company.display_name"), location=s("r.location.display_name"), url=link, salary=salary, postedAt=s("r.created"))


def greenhouse(raw: DataFrame, company: str = "board") -> DataFrame:
    """raw may have a column named by `company` with the board's company."""
    r = raw.withColumn("r", F.explode("jobs")).withColumns({c: F.col(f"r.{c}") for c in ("departments", "offices", "metadata")})
    own = s(company) if company in raw.columns else F.lit("")
    offices = F.coalesce(F.col("offices"), F.expr("cast(array() as array<struct<name:string,location:string>>)"))
    metadata = F.coalesce(F.col("metadata"), F.expr("cast(array() as array<struct<name:string,value:string>>)"))
    office_names = text.unique_ci(F.transform(offices, lambda o: text.join_non_empty(" - ", o["name"], o["location"])))
    pairs = text.unique_ci(F.transform(F.filter(metadata, lambda m: (s(m["name"]) != "") & (s(m["value"]) != "")), lambda m: F.concat(s(m["name"]), F.lit(": "), s(m["value"]))))
    listed = lambda title, values, sep: F.when(F.size(values) > 0, F.concat(F.lit(title), F.array_join(values, sep)))
    places = F.concat(F.array(s("r.location.name")), F.flatten(F.transform(offices, lambda o: F.array(s(o["location"]), s(o["name"])))))
    body = text.join_non_empty("\n\n", text.strip_html(s("r.content")), listed("Departamentos: ", text.unique_ci(names("departments")), ", "), listed("Escritórios: ", office_names, ", "), listed("Metadados: ", pairs, "; "))
    searched = text.soft(F.concat_ws(" ", s("r.title"), s("r.content"), s("r.location.name"), F.array_join(names("departments"), " "), F.array_join(office_names, " "), F.array_join(pairs, " ")))
    key = F.coalesce(F.nullif(s("r.absolute_url"), F.lit("")), F.when(F.coalesce("r.id", F.lit(0)) != 0, F.concat(F.lit("greenhouse:"), F.col("r.id").cast("string"))), s("r.title"))
    return records(r, "Greenhouse", id=key, title=s("r.title"), company=own, location=F.array_join(text.unique_ci(places), " | "), url=s("r.absolute_url"), modality=modality(searched, F.lit(""), remote=[*REMOTE, "anywhere", "worldwide", "global"]), description=body, postedAt=s("r.updated_at"))


def lever(raw: DataFrame, company: str = "board") -> DataFrame:
    c = F.col("categories")
    all_places = F.coalesce(c["allLocations"], F.expr("cast(array() as array<string>)"))
    places = text.unique_ci(F.concat(F.array(s(c["location"])), F.transform(all_places, s), F.array(s("country"))))
    location = F.array_join(F.when(F.size(places) > 0, places).otherwise(text.non_empty(F.array(s(c["department"])))), " | ")
    plain = [s("openingPlain"), s("descriptionPlain"), s("descriptionBodyPlain")]
    lists = F.coalesce(F.col("lists"), F.expr("cast(array() as array<struct<text:string,content:string>>)"))
    section = lambda x: text.join_non_empty(": ", s(x["text"]), text.strip_tags(s(x["content"])))
    opening = text.join_non_empty("\n\n", *plain)
    body = text.join_non_empty("\n\n", F.when(opening == "", text.strip_tags(s("description"))).otherwise(opening), F.array_join(text.non_empty(F.transform(lists, section)), "\n\n"), s("additionalPlain"), s("salaryDescription"))
    where = text.soft(F.concat_ws(" ", s("workplaceType"), s(c["location"]), F.array_join(all_places, " ")))
    key = F.coalesce(F.nullif(s("hostedUrl"), F.lit("")), F.when(s("id") != "", F.concat(F.lit("lever:"), s("id"))), s("text"))
    r = F.col("salaryRange")
    return records(
        raw,
        "Lever",
        id=key,
        title=s("text"),
        company=s(company) if company in raw.columns else F.lit(""),
        location=location,
        url=F.coalesce(F.nullif(s("hostedUrl"), F.lit("")), s("applyUrl")),
        salary=text.salary_range(r["min"], r["max"], F.coalesce(r["currency"], F.lit("")), F.coalesce(r["interval"], F.lit("")), s("salaryDescription")),
        modality=modality(where, s(c["commitment"])),
        description=body,
        postedAt=F.coalesce(text.epoch_ms(F.col("createdAt")), F.lit("")),
    )


def gupy(raw: DataFrame) -> DataFrame:
    """A job that several keywords found is one record with all of them: by its native id, else by its address, the first by keyword and
    place in the document. Jobs without an address or a title are left out."""
    r = raw.select("*", F.posexplode("data").alias("_place", "r"))
    url = F.coalesce(F.nullif(s("r.jobUrl"), F.lit("")), s("r.careerPageUrl"))
    kind = text.soft(s("r.workplaceType"))
    own = F.when(F.coalesce("r.isRemoteWork", F.lit(False)), "Remoto").otherwise(modality(kind, s("r.workplaceType"), remote_first=True))
    key = F.coalesce(F.when(s("r.id") != "", F.concat(F.lit("gupy:"), s("r.id"))), url)
    found = records(r, "Gupy", id=key, title=s("r.name"), company=s("r.careerPageName"), location=text.join_non_empty(" / ", s("r.city"), s("r.state"), s("r.country")), url=url, modality=own, description=s("r.description"), postedAt=s("r.publishedDate"), place=F.col("_place"))
    asked = found.filter((F.col("url") != "") & (F.col("title") != "")).withColumn("_asked", F.col("keyword"))
    if "keyword" not in raw.columns:
        asked = asked.withColumn("keywords", F.array(F.lit("-")))
    merged = merge_found(asked, "id", ["_asked", "place"])
    return merged if "keyword" in raw.columns else merged.withColumns({"keyword": F.lit(""), "keywords": F.expr("cast(array() as array<string>)")})


def inhire(raw: DataFrame) -> DataFrame:
    """Published jobs, or those without a status, of each tenant."""
    r = raw.withColumn("r", F.explode("jobsPage")).filter(F.lower(s("r.status")).isin("", "published"))
    slug, job = s("slug"), s("r.jobId")
    url = F.when((slug == "") | (job == ""), F.lit("")).otherwise(F.concat(F.lit("https://"), slug, F.lit(".inhire.app/vagas/"), job, F.lit("/"), text.slug(s("r.displayName"))))
    key = F.when(job != "", F.concat(F.lit("inhire:"), slug, F.lit(":"), job)).otherwise(url)
    own = modality(text.soft(s("r.workplaceType")), s("r.workplaceType"), remote_first=True)
    return records(r, "InHire", id=key, title=s("r.displayName"), company=F.coalesce(F.nullif(s("tenantName"), F.lit("")), slug), location=s("r.location"), url=url, modality=own, description=text.join_non_empty("\n", s("r.status"), s("r.workplaceType"), s("r.careerPageId")))


def jooble(raw: DataFrame) -> DataFrame:
    r = raw.withColumn("r", F.explode(F.when(F.size(F.coalesce("jobs", F.expr("array()"))) > 0, F.col("jobs")).otherwise(F.col("results"))))
    key = F.coalesce(F.when(F.coalesce("r.id", F.lit(0)) != 0, F.col("r.id").cast("string")), F.nullif(s("r.link"), F.lit("")), F.concat_ws("|", s("r.title"), s("r.company"), s("r.location")))
    return records(r, "Jooble", id=key, title=s("r.title"), company=s("r.company"), location=s("r.location"), url=s("r.link"), salary=s("r.salary"), modality=s("r.type"), description=s("r.snippet"), postedAt=s("r.updated"))


def themuse(raw: DataFrame, detail: DataFrame | None = None) -> DataFrame:
    """detail: (id, contents) of jobs read one by one; what isn't blank there goes before the list's."""
    r = raw.withColumn("r", F.explode("results")).withColumns({c: F.col(f"r.{c}") for c in ("locations", "categories", "levels")}).withColumn("_id", s("r.id"))
    contents = s("r.contents")
    if detail is not None:
        r = r.join(detail.select(s("id").alias("_id"), s("contents").alias("_contents")), "_id", "left")
        contents = F.coalesce(F.nullif(s("_contents"), F.lit("")), contents)
    url = s("r.refs.landing_page")
    body = text.join_non_empty(" ", text.strip_tags(contents), text.strip_tags(s("r.description")), F.array_join(names("categories"), " "), F.array_join(names("levels"), " "))
    return records(r, "The Muse", id=F.coalesce(F.nullif(F.col("_id"), F.lit("")), url), title=s("r.name"), company=s("r.company.name"), location=F.array_join(names("locations"), ", "), url=url, description=body, postedAt=s("r.publication_date"))


#: Parts of locations that tell a country (fixed values).
KNOWN_PLACES = [
    "estados unidos", "united states", "usa", "eua", "florida", "miami", "new york", "california", "texas", "boston", "seattle", "chicago", "atlanta", "denver", "portugal", "lisboa", "porto", "canada",
    "toronto", "vancouver", "reino unido", "united kingdom", "london", "france", "paris", "germany", "berlin",
]


def searched_location(location: Column, asked: Column) -> Column:
    """A card's location with the one that was asked for, unless it has that already or tells a country of its own."""
    own, where = s(location), s(asked)
    known = F.contains(F.lower(own), F.lower(where)) | has(text.accents_pt(own), KNOWN_PLACES)
    return F.when(where == "", own).when(own == "", where).when(known, own).otherwise(F.concat(own, F.lit(", "), where))


def linkedin(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cards of result pages: the fields by their classes, with the fallbacks of older pages. pages may have a column search_location: where was asked for."""
    card = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1)))
    r = pages.withColumn("c", card)
    fields = {"_title": ["base-search-card__title", "job-title", "sr-only"], "_company": ["base-search-card__subtitle", "company-name"], "_location": ["job-search-card__location", "location"]}
    for name, marks in fields.items():  # each step once a card, however often the next one uses it; fallbacks only where they are needed
        r = r.withColumn(name, F.lit(""))
        for m in marks:
            r = text.once(r, "_raw", F.when(F.col(name) == "", F.regexp_extract("c", rf'(?s)<(\w+)[^>]*class="[^"]*{m}[^"]*"[^>]*>(.*?)</\1>', 2)))
            r = text.once(r.withColumnRenamed(name, "_was"), name, F.coalesce(text.tag_text(F.col("_raw")), "_was")).drop("_raw", "_was")
    url = text.url_key(F.regexp_extract("c", r'<a[^>]*href="([^"]+)"', 1))
    asked = F.col("search_location") if "search_location" in pages.columns else F.lit("")
    out = records(r, "LinkedIn", id=url, title=F.col("_title"), company=F.col("_company"), location=searched_location(F.col("_location"), asked), url=url, postedAt=F.regexp_extract("c", r'<time[^>]*datetime="([^"]+)"', 1))
    return out.filter("title <> ''")


READERS: dict[str, Callable[..., DataFrame]] = {"adzuna": adzuna, "greenhouse": greenhouse, "lever": lever, "gupy": gupy, "inhire": inhire, "jooble": jooble, "themuse": themuse, "linkedin": linkedin}


def parsed(raw: DataFrame, feed: str, json: str = "value") -> DataFrame:
    """Rows of JSON text as the feed's document; corrupt rows are left out. Other columns stay."""
    doc = F.from_json(json, SCHEMAS[feed], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.withColumn("_doc", doc)
    fields = rows.schema["_doc"].dataType.fieldNames()
    first = reduce(lambda a, b: a | b, [F.col(f"_doc.{f}").isNotNull() for f in fields])
    return rows.filter(first).select(*[c for c in raw.columns if c != json], "_doc.*")


def unified(feeds: dict[str, DataFrame], enabled: list[str] | None = None) -> DataFrame:
    """All enabled feeds in one frame."""
    parts = [READERS[name](df) for name, df in feeds.items() if enabled is None or name in enabled]
    return reduce(DataFrame.unionByName, parts)


def board_candidates(companies: DataFrame, name: str) -> DataFrame:
    """Tokens under which a company's board may be found: joined, dashed, without a suffix, and so on."""
    base = text.slug(F.col(name))
    bare = F.regexp_replace(base, "-(inc|ltd|llc|sa|group|labs)$", "")
    tokens = F.array_distinct(F.array(F.replace(base, F.lit("-"), F.lit("")), base, F.replace(base, F.lit("-"), F.lit("_")), F.replace(bare, F.lit("-"), F.lit("")), bare, F.concat(F.replace(bare, F.lit("-"), F.lit("")), F.lit("inc"))))
    return companies.select(name, F.explode(F.filter(tokens, lambda t: t != "")).alias("token"))


def probed(candidates: DataFrame, boards: DataFrame) -> DataFrame:
    """Candidates with `valid`, whether a board of that token answers, valid ones first and then by token."""
    found = boards.select("token").distinct().withColumn("_found", F.lit(True))
    return candidates.join(found, "token", "left").withColumn("valid", F.coalesce("_found", F.lit(False))).drop("_found").orderBy(F.desc("valid"), "token")


def catalog(raw: DataFrame) -> DataFrame:
    """Companies of a board's catalogue: the slug or the site, the name or the company name; the first of a slug stays."""
    names_ = set(raw.columns)
    pick = lambda *cs: F.coalesce(*[F.nullif(s(c), F.lit("")) for c in cs if c in names_], F.lit(""))
    rows = raw.select(pick("slug", "site").alias("slug"), pick("name", "companyName").alias("name"), *(["ordinal"] if "ordinal" in names_ else [F.monotonically_increasing_id().alias("ordinal")]))
    return rows.filter("slug <> ''").groupBy("slug").agg(F.min_by("name", "ordinal").alias("name")).orderBy("slug")
