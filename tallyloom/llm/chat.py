"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its text under the loss mask. A conversation that does not end
with an assistant turn also gives one example without target, so that no turn is
lost. A turn is written as ``### role: text </turn>`` and a line break, with
``\\``, ``#`` and ``<`` in role and text as ``\\\\``, ``\\h`` and ``\\l`` (and ``:``
in roles as ``\\c``); neither ``#`` nor ``<`` is left in a text, so that markers
cannot be imitated, and the escapes can be undone.

A conversation is gathered by its key, which its format needs; conversations
share nothing, so a first turn that many have in common does no harm.

Defined results: null role or text is empty; null conv_id is a conversation;
turns that tie are ordered by role, then text, and repeated rows stay; an empty
table has no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_text(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    """Undoes both. Split at doubled backslashes from the left, no part holds one that is not an escape's."""
    part = F.split(c, r"\\\\", -1)

    def undo(p: Column) -> Column:
        for a, b in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            p = F.replace(p, F.lit(a), F.lit(b))
        return p

    return F.array_join(F.transform(part, undo), "\\")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape_text(text), F.lit(CLOSE))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), text, loss_start and loss_length in characters, last.

    loss_start is null where there is no target. ``last`` marks the example that ends with the last turn."""
    empty = F.lit("")
    turns = (
        conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape_text(t["text"]).alias("body"), turn_text(t["role"], t["text"]).alias("line"))).alias("turns"))
    )
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n))
    each = turns.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    own = F.element_at("turns", F.col("upto"))
    target = own["role"] == "assistant"
    return each.select(
        "conv_id",
        "example",
        F.array_join(F.transform(F.slice("turns", 1, F.col("upto")), lambda t: t["line"]), "").alias("text"),
        target.alias("target"),
        F.char_length(own["body"]).alias("loss_length"),
        (F.col("upto") == n).alias("last"),
    ).select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("target"), F.char_length("text") - len(CLOSE) - F.col("loss_length")).alias("loss_start"),
        F.when(F.col("target"), F.col("loss_length")).alias("loss_length"),
        "last",
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    lines = F.filter(F.split(text, CLOSE, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        inner = F.substring(x, F.lit(len(OPEN) + 1), F.char_length(x))
        cut = F.instr(inner, MIDDLE)
        return F.struct(
            unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(inner, cut + len(MIDDLE), F.char_length(inner))).alias("text"),
        )

    return F.transform(lines, turn)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest, computed from the formatted examples alone."""
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = expand(table.unionByName(extra))
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length"))))
    turns = read_back(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = out.select(
        "conv_id", "example", loss.alias("loss"), F.char_length("text").cast("bigint").alias("chars"),
        F.when(F.col("last"), F.size(turns)).cast("bigint").alias("n"), F.when(F.col("last"), said).alias("said"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    return read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.sha2(F.max("said"), 256).alias("turns_sha256"),
        F.char_length(joined).cast("bigint").alias("loss_chars"), F.sha2(joined, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({0}, '\\', '\\\\'), '#', '\\h'), '<', '\\l')"
OP9_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
             count(*) OVER (PARTITION BY conv_id) AS n,
             4 + length(replace({_ESC.format("role")}, ':', '\\c')) + 2 + length({_ESC.format("text")}) + 9 AS len FROM t),
p AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
