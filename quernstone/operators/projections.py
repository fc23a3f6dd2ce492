"""Rows as a dashboard shows them: defaults for what is missing, inferred model and level, a stable score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import secrets, text
from quernstone.functions import taxonomy as T
from quernstone.functions.infer import first_rule
from quernstone.functions.predicates import any_substring

#: What an empty field shows (fixed values).
NO_TITLE, NO_SAVED_TITLE, NO_COMPANY, NO_PLACE, NO_SALARY, NO_TAGS = "Oportunidade sem título", "Oportunidade salva", "Empresa não informada", "Local não informado", "A combinar", "Geral"
NO_DATE, SEARCHED, TYPED, JUST_NOW = "Não informado", "Busca automática", "Manual", "Agora mesmo"
MODELS = [("Híbrido", ["hibrid", "hybrid"]), ("Remoto", ["remot", "home office", "teletrabalho", "anywhere", "worldwide"])]
LEVELS = [("Estágio/Trainee", T.TRAINEE_SEARCH), ("Sênior", T.SENIOR), ("Júnior", T.JUNIOR)]
#: Where addresses begin that are made for jobs without one.
BASE = "https://jobs.invalid/"
#: Tags that a row shows, at most (a limit of the view).
TAGS = 6


def or_else(value: Column, fallback: str) -> Column:
    """Trimmed, or the fallback where nothing is left."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback))


def model(*parts: Column) -> Column:
    return first_rule(text.ui_text(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])), MODELS, "Presencial", any_substring)


def level(title: Column) -> Column:
    return first_rule(text.fold(title), LEVELS, "Pleno")


def tags_of(*lists: Column) -> Column:
    tags = F.slice(text.unique_trimmed(F.transform(F.concat(*lists), lambda x: F.coalesce(x, F.lit("")))), 1, TAGS)
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(NO_TAGS)))


def _link(title: Column, company: Column, location: Column, source: Column, url: Column, ordinal: Column, base: str) -> Column:
    """The address, or one made of what identifies the job where that isn't an absolute one."""
    made = F.concat(F.lit(base), F.replace(F.url_encode(text.join_non_empty("|", title, company, location, source, ordinal.cast("string"))), F.lit("+"), F.lit("%20")))
    return F.when(F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), F.trim(url)).otherwise(made)


def recommended(jobs: DataFrame, ordinal: str = "ordinal", base: str = BASE) -> DataFrame:
    """Found jobs (the feeds' columns, and matchScore where it is known) as rows of the recommendations. base begins the addresses made
    for jobs that have none."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    title, place = or_else(c("title"), NO_TITLE), or_else(c("location"), NO_PLACE)
    none = F.expr("cast(array() as array<string>)")
    source = F.coalesce(F.nullif(F.trim(c("source")), F.lit("")), F.nullif(F.trim(F.get("sources", F.lit(0))), F.lit("")))
    link = _link(c("title"), c("company"), c("location"), F.coalesce(source, F.lit("unknown")), c("url"), F.col(ordinal), base)
    known = F.col("matchScore").cast("int") if "matchScore" in jobs.columns else F.lit(None).cast("int")
    return jobs.select(
        F.concat(F.lit("recommended:"), link, F.lit(":"), F.col(ordinal).cast("string")).alias("id"),
        title.alias("jobTitle"),
        or_else(c("company"), NO_COMPANY).alias("company"),
        place.alias("location"),
        F.lit(NO_SALARY).alias("salary"),
        model(title, place, c("modality"), c("description")).alias("type"),
        level(title).alias("level"),
        F.coalesce(known, text.char_sum_score(F.concat(title, F.lit(":"), c("company")))).alias("matchScore"),
        tags_of(F.array(c("keyword")), F.coalesce(F.col("keywords"), none)).alias("tags"),
        text.date_label(c("postedAt")).alias("posted"),
        F.lit("saved").alias("status"),
        link.alias("jobLink"),
        F.coalesce(source, F.lit(SEARCHED)).alias("source"),
    )


def saved(rows: DataFrame) -> DataFrame:
    """Saved jobs (id, jobTitle, company, location, keyword, status, jobLink, source, notes) as rows of the board."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    title, place = or_else(c("jobTitle"), NO_SAVED_TITLE), or_else(c("location"), NO_PLACE)
    return rows.select(
        "id", title.alias("jobTitle"), or_else(c("company"), NO_COMPANY).alias("company"), place.alias("location"), F.lit(NO_SALARY).alias("salary"), model(title, place).alias("type"),
        level(title).alias("level"), text.char_sum_score(F.concat(title, F.lit(":"), c("company"))).alias("matchScore"), tags_of(F.array(c("keyword"))).alias("tags"), F.lit(NO_DATE).alias("posted"),
        "status", "jobLink", or_else(c("source"), TYPED).alias("source"), F.trim(c("notes")).alias("notes"),
    )


def from_form(rows: DataFrame) -> DataFrame:
    """What a form was filled in with (jobTitle, company, location, salary, type, tags, jobLink, source, notes): trimmed, with fallbacks."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    tags = text.split_csv(c("tags"))
    filled = {
        "jobTitle": F.trim(c("jobTitle")), "company": F.trim(c("company")), "location": F.coalesce(F.nullif(F.trim(c("location")), F.lit("")), c("type")), "salary": or_else(c("salary"), NO_SALARY),
        "tags": F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(NO_TAGS))), "posted": F.lit(JUST_NOW), "status": F.lit("saved"), "jobLink": or_else(c("jobLink"), "#"),
        "source": or_else(c("source"), TYPED), "notes": F.trim(c("notes")),
    }
    return rows.withColumns(filled)


def public_user(users: DataFrame, key: bytes, fields: list[str], lists: list[str]) -> DataFrame:
    """Users with each field from its encrypted twin (`<field>Encrypted`) where that is filled, lists from theirs as JSON."""
    plain = {f: secrets.decrypted_or_plain(F.col(f"{f}Encrypted"), F.col(f), key) for f in fields}
    arrays = {f: F.coalesce(F.from_json(secrets.decrypted(F.col(f"{f}Encrypted"), key), "array<string>"), F.col(f)) for f in lists}
    return users.withColumns({**plain, **arrays}).drop(*[f"{f}Encrypted" for f in [*fields, *lists]])


def usernames(asked: DataFrame, taken: DataFrame, base: str, tries: int = 20) -> DataFrame:
    """asked with `username`: the base's own form, or with the first of _1 .. _tries that nobody has, or else a random number.
    Of several that ask for the same name at once all get the same; writing it is what settles them."""
    plain = F.coalesce(F.nullif(text.username(F.coalesce(F.col(base), F.lit(""))), F.lit("")), F.lit("user"))
    known = taken.select("username").distinct().withColumn("_taken", F.lit(True))
    names = asked.select(plain.alias("_base")).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(tries)))).withColumn("username", F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_k").cast("string"))))
    free = names.join(known, "username", "left").filter("_taken is null").groupBy("_base").agg(F.min_by("username", "_k").alias("username"))
    chance = F.concat(F.col("_base"), F.lit("_"), F.floor(F.rand() * 10_000).cast("string"))
    return asked.withColumn("_base", plain).join(free, "_base", "left").withColumn("username", F.coalesce("username", chance)).drop("_base")
