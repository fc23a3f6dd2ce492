"""Reporting over relational tables: filters that may be absent, overrides, guards, change events, upserts, counters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.secrets import hmac_sha256

#: Roles from the lowest level up (fixed values).
ROLES = ["user", "support", "manager", "admin"]
#: Verbs of critical audit actions (fixed values).
CRITICAL = ["delete", "block", "role", "permission", "clear", "reset"]


def role_level(role: Column, roles: Sequence[str] = ROLES) -> Column:
    """0 and up; an unknown role has no level."""
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in roles]), role).cast("int"), F.lit(0)) - 1


def filtered(rows: DataFrame, equals: dict[str, object], when: str | None = None, since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Equalities for the values that are given; the time range only where both bounds are."""
    for name, value in equals.items():
        if value not in (None, ""):
            rows = rows.filter(F.col(name) == F.lit(value))
    if when and since is not None and until is not None:
        rows = rows.filter(F.col(when).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return rows


def users_found(users: DataFrame, search: str | None = None, role: str | None = None, blocked: bool | None = None, key: str = "") -> DataFrame:
    """users (username, display_name, email_hash, role, is_blocked) by a part of a name in any case, or by the whole mail address: what
    has an @ is hashed by the key as the stored addresses are, and never compared in clear."""
    rows = filtered(users, {"role": role, "is_blocked": blocked})
    if not search:
        return rows
    part = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.col("username").ilike(part) | F.col("display_name").ilike(part)
    if "@" in search:
        found = found | (F.col("email_hash") == hmac_sha256(F.lit(search.strip().lower()), key))
    return rows.filter(F.coalesce(found, F.lit(False)))


def users_listed(users: DataFrame, search: str = "", role: str = "all", status: str = "all") -> DataFrame:
    """A page's own filter over the users it has (name, email, username, role, is_blocked): a part of any of three columns, role and status."""
    term = search.strip().lower()
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term))
    own = F.lit(True) if not term else has("name") | has("email") | has("username")
    if role != "all":
        own = own & (F.col("role") == role)
    if status != "all":
        own = own & (F.coalesce("is_blocked", F.lit(False)) == (status == "blocked"))
    return users.filter(own)


def owned(rows: DataFrame, user: object, column: str = "user_id") -> DataFrame:
    return rows.filter(F.col(column) == F.lit(user))


def overridden(defaults: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every default with its override where there is one; `customized` says which."""
    o = overrides.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_set"))
    return defaults.join(o, keys, "left").withColumn(value, F.coalesce("_new", value)).withColumn("customized", F.coalesce("_set", F.lit(False))).drop("_new", "_set")


def changed_rules(current: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    b = baseline.select(*keys, F.col(value).alias("_was"))
    return current.join(b, keys).filter(~F.col(value).eqNullSafe(F.col("_was"))).drop("_was")


def allowed_counts(roles: DataFrame, rules: DataFrame) -> DataFrame:
    """How many rules each role's level reaches. Rules are counted by level first: what meets is levels, not rules."""
    levels = rules.groupBy("min_level").agg(F.count(F.lit(1)).alias("n"))
    return roles.join(levels, F.col("level") >= F.col("min_level"), "left").groupBy("role", "level").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("allowed"))


def connections(providers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every provider, connected or not."""
    a = accounts.groupBy("provider").agg(F.count(F.lit(1)).alias("accounts"))
    return providers.join(a, "provider", "left").select("provider", (F.col("accounts").isNotNull()).alias("connected"), F.coalesce("accounts", F.lit(0)).alias("accounts"))


def overlaid(base: DataFrame, detail: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Details that aren't blank go over the base's fields."""
    d = detail.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(d, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(f"_{c}")), F.lit("")), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def status_counters(rows: DataFrame, status: str, by: list[str] | None = None) -> DataFrame:
    s = F.col(status)
    return rows.groupBy(*(by or [])).agg(F.count_if(s == "saved").alias("saved"), F.count_if(s.isin("applied", "interviewing")).alias("active"), F.count_if(s == "interviewing").alias("interviewing"), F.count_if(s == "accepted").alias("accepted"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up, of at least one."""
    return F.floor(part * 100 / F.greatest(whole, F.lit(1)) + 0.5).cast("long")


def funnel(rows: DataFrame, status: str) -> DataFrame:
    s = F.col(status)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(s != "saved").alias("started"), F.count_if(s == "interviewing").alias("interviewing"))
    return counts.withColumns({"started_pct": percent(F.col("started"), F.col("total")), "interviewing_pct": percent(F.col("interviewing"), F.col("total"))})


def role_counts(users: DataFrame, role: str, roles: Sequence[str]) -> DataFrame:
    """One row: users of each role, zeros included."""
    return users.agg(*[F.count_if(F.col(role) == r).alias(r.lower()) for r in roles])


def latest(rows: DataFrame, keys: list[str], when: list[str], columns: Sequence[str]) -> DataFrame:
    """Each key's last row by time and then id: one aggregation."""
    last = F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(w) for w in when]))
    return rows.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """table with rows put in or over what has the same key; nulls in a key are equal. Of rows with the same key the last by `order` counts,
    and of those that are equal in it, or without one, the largest by all columns."""
    place = F.struct(*[F.col(c) for c in order or []], *[F.col(c) for c in rows.columns])
    fresh = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*rows.columns), place).alias("_r")).select("_r.*")
    known = fresh.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return table.join(known, same, "left_anti").unionByName(fresh)


def inserted_if_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and the rows whose key it doesn't have; of rows with the same key the smallest by all columns."""
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.groupBy(*keys).agg(F.min(F.struct(*fresh.columns)).alias("_r")).select("_r.*"))


def status_changes(old: DataFrame, new: DataFrame, key: str, status: str, at: Column) -> DataFrame:
    """An event for each row whose status is another now."""
    o = old.select(key, F.col(status).alias("from_status"))
    return new.select(key, F.col(status).alias("to_status")).join(o, key).filter(~F.col("from_status").eqNullSafe(F.col("to_status"))).withColumn("created_at", at)


def cleared(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows go."""
    return table.filter(~F.coalesce(condition, F.lit(False))), table.agg(F.count_if(condition).alias("deleted"))


def marked_read(table: DataFrame, condition: Column, at: Column) -> DataFrame:
    """Unread rows that meet the condition get a time."""
    return table.withColumn("read_at", F.when(F.col("read_at").isNull() & condition, at).otherwise(F.col("read_at")))


def without_children(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """The children whose parent is there still."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")


def find_or_create(requests: DataFrame, by_provider: DataFrame, by_email: DataFrame) -> DataFrame:
    """user_id by provider account, else by mail, else new: `how` says which."""
    p = by_provider.select("provider_id", F.col("user_id").alias("_p"))
    e = by_email.select("email", F.col("user_id").alias("_e"))
    found = requests.join(p, "provider_id", "left").join(e, "email", "left")
    return found.withColumn("how", F.when(F.col("_p").isNotNull(), "provider").when(F.col("_e").isNotNull(), "email").otherwise("created")).withColumn("user_id", F.coalesce("_p", "_e")).drop("_p", "_e")


def backfill(table: DataFrame, plain: str, filled: str, value: Column) -> DataFrame:
    """Fills a column from a plain one and empties that; `changed` marks the rows, for a dry run's count."""
    due = F.col(plain).isNotNull() & F.col(filled).isNull()
    return table.withColumn("changed", due).withColumn(filled, F.when(due, value).otherwise(F.col(filled))).withColumn(plain, F.when(F.col("changed"), F.lit(None)).otherwise(F.col(plain)))


def disconnectable(accounts: DataFrame, passwords: DataFrame, user: str, provider: str) -> DataFrame:
    """(user, provider, allowed) of each account: whether another way to sign in is left without that provider."""
    own = accounts.select(user, provider).distinct()
    known = passwords.select(user).distinct().withColumn("_password", F.lit(1))
    many = own.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).join(known, user, "left")
    return own.join(many, user).select(user, provider, (F.col("_n") - 1 + F.coalesce("_password", F.lit(0)) > 0).alias("allowed"))


def glob(pattern: str) -> str:
    """A key pattern with * and ? as a regular expression for whole keys."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def cleared_keys(table: DataFrame, key: str, patterns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """cleared() of the rows whose key meets one of the patterns."""
    return cleared(table, F.rlike(F.col(key), F.lit("(?s)" + "|".join(map(glob, patterns)))))


def critical(action: Column) -> Column:
    return F.rlike(F.lower(action), F.lit("|".join(CRITICAL)))
