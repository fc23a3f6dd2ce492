"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of the same role merge by an array
aggregation; and the text is one concatenation:

    <turn:ROLE>TEXT</turn>            a turn, followed by a line break
    TEXT<also>TEXT                    texts of merged turns

Control strings inside roles and texts are escaped, and a backslash first, so that texts read back as they were:
`\\` becomes `\\b`; the `<` of `<turn:`, `</turn>` and `<also>` becomes `\\l`; in roles `>` becomes `\\g`.
An escaped text has no control string, and each backslash in it is followed by its letter, so that unescaping
is a replacement of the letters' pairs and last of the backslash's.

The loss mask is an array of (start, length) spans of the formatted text, in code points: the texts of the
assistant's turns, each of a merged turn for itself.

Defined results: a null text or role counts as empty; turns are in order of their number, ties in order of role and text, and
repeated rows are turns of their own; a null turn number comes first; a row with a null conversation id is a
conversation of its own (however many there are, they are spread like any other); an empty table gives no rows; other columns are not read.

A conversation is one row of the output and so one task's work; the number of conversations, not their length, spreads it. The work on
one grows in proportion to its turns, but for the running sums of lengths, which are taken in runs of the square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import named

#: The role whose texts are learned from.
LEARNED = "assistant"
CONTROL = ("<turn:", "</turn>", "<also>")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit("\\l" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often and deep inside lambdas the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged(turns: Column) -> Column:
    """array<struct<role, text>> -> array<struct<role, texts>>: adjacent turns of a role become one."""
    order = F.filter(F.sequence(F.lit(0), F.greatest(F.size(turns) - 1, F.lit(0))), lambda i: i < F.size(turns))
    firsts = F.filter(order, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def blocks(starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(turns))
        texts = lambda i, k: F.transform(F.slice(turns, i + 1, stop(k) - i), lambda x: x["text"])
        return F.transform(starts, lambda i, k: F.struct(F.get(turns, i)["role"].alias("role"), texts(i, k).alias("texts")))

    return let(firsts, blocks)


def running(lengths: Column) -> Column:
    """array<int> -> the sum of all before each. Appending copies an array, so the sums are taken in runs."""
    run = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    runs = F.transform(F.filter(F.sequence(F.lit(0), F.size(lengths), run), lambda a: a < F.size(lengths)), lambda a: F.slice(lengths, a + 1, run))
    none = F.expr("cast(array() as array<int>)")

    def sums(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), none.alias("before"))
        return F.aggregate(values, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["before"], s["at"]).alias("before")), lambda s: s["before"])

    def joined(cut: Column) -> Column:
        totals = F.transform(cut, lambda r: F.aggregate(r, F.lit(0), lambda s, n: s + n))
        return let(sums(totals, F.lit(0)), lambda starts: F.flatten(F.transform(cut, lambda r, k: sums(r, F.get(starts, k)))))

    return let(runs, joined)


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation: conv_id, formatted, loss (array of start, length from 0)."""
    string = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    rows = turns.select(named(conv).alias("conv_id"), F.when(named(conv).isNull(), F.monotonically_increasing_id()).alias("alone"), F.struct(named(turn).alias("turn"), string(role).alias("role"), string(text).alias("text")).alias("t"))
    one = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = F.transform("turns", lambda x: F.struct(F.replace(escaped(x["role"]), F.lit(">"), F.lit("\\g")).alias("role"), escaped(x["text"]).alias("text")))
    # pieces in order: what is written, and whether it is learned from
    texts = lambda b: F.flatten(F.transform(b["texts"], lambda t, i: F.array(F.struct(F.when(i > 0, F.lit("<also>")).otherwise("").alias("s"), F.lit(False).alias("learned")), F.struct(t.alias("s"), (b["role"] == LEARNED).alias("learned")))))
    mark = lambda s: F.array(F.struct(s.alias("s"), F.lit(False).alias("learned")))
    pieces = F.flatten(F.transform(let(plain, merged), lambda b: F.concat(mark(F.concat(F.lit("<turn:"), b["role"], F.lit(">"))), texts(b), mark(F.lit("</turn>\n")))))

    def laid(p: Column) -> Column:
        learned = F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: F.coalesce(F.get(p, i)["learned"], F.lit(False)))
        span = lambda before: F.transform(learned, lambda i: F.struct(F.get(before, i).alias("start"), F.length(F.get(p, i)["s"]).alias("length")))
        spans = let(running(F.transform(p, lambda x: F.length(x["s"]))), span)
        return F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), spans.alias("loss"))

    return one.select("conv_id", let(pieces, laid).alias("laid")).select("conv_id", "laid.formatted", "laid.loss")


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and learned (array of texts), from formatted and loss alone."""
    blocks = F.filter(F.split(F.col("formatted"), "</turn>\n"), lambda b: b.startswith("<turn:"))
    role = lambda b: F.substring_index(F.substr(b, F.lit(len("<turn:") + 1)), ">", 1)
    body = lambda b: F.substr(b, F.length(role(b)) + F.lit(len("<turn:") + 2))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), "<also>"), lambda t: F.struct(unescaped(role(b)).alias("role"), unescaped(t).alias("text")))))
    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return rows.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A conversation that looks like a template's own marks, added to the table by the query.
TRICKY = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    back = read_back(formatted(table.unionByName(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
escaped AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\b'), '<turn:', '\lturn:'), '</turn>', '\l/turn>'), '<also>', '\lalso>')) AS text_chars,
    length(replace(replace(replace(replace(replace(role, '\', '\b'), '<turn:', '\lturn:'), '</turn>', '\l/turn>'), '<also>', '\lalso>'), '>', '\g')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS before
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before IS NOT DISTINCT FROM role AND before IS NOT NULL THEN 6 ELSE role_chars + 15 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id, alone
"""
