"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered as `### role:`, a line break, the text, a line break, `</turn>` and a line break. The
deterministic parser splits on the closing line, reads the role up to the first colon and refuses a text
that holds a control string without a backslash before it. Every turn is rendered as it is, parsed back and
compared; a turn that does not come back identical has its control strings escaped (one more backslash
before each) and is tried again. The whole conversation is then parsed and compared once more.

Rows: null texts are empty, null roles are an empty role, null turns come first; a null conv_id is a
conversation of its own. Repeated rows stay repeated turns, ties of a turn number go by role, then text.
An empty table gives an empty result. Extra columns of the input are ignored. A conversation is one
training example, hence one output row and one string; only that needs its rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from razao.llm.common import table

OPEN, CLOSE, LOSS_ROLE = "###", "</turn>", "assistant"
_CONTROL = r"(#{3,}|</turn>)"  # a longer run of the opening sign is one control string
_BARE = r"(?<![\\#])#{3,}|(?<!\\)</turn>"
_END = f"\n{CLOSE}\n"
PROBE_TEXT = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    """One more backslash before every control string."""
    return F.regexp_replace(text, rf"(\\*){_CONTROL}", r"\\$1$2")


def unescape(text: Column) -> Column:
    """One backslash less before every control string that has one."""
    return F.regexp_replace(text, rf"\\(\\*){_CONTROL}", "$1$2")


def _escape_role(role: Column) -> Column:
    for raw, coded in (("\\", "\\\\"), (":", "\\c"), ("\n", "\\n")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def _unescape_role(role: Column) -> Column:
    # A doubled backslash is set aside first, so that what follows it is not taken for a code.
    parts = F.split(role, r"\\\\")
    plain = F.transform(
        parts, lambda p: F.replace(F.replace(p, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n"))
    )
    return F.array_join(plain, "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(f"{OPEN} "), _escape_role(role), F.lit(":\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered text: an array of (role, text); text is null where the grammar is broken."""
    pieces = F.split(formatted, _END, -1)

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, ":\n")
        body = F.substr(piece, colon + 2)
        fine = (colon > 0) & piece.startswith(f"{OPEN} ") & ~body.rlike(_BARE)
        start = F.lit(len(OPEN) + 2)
        return F.struct(
            _unescape_role(F.substr(piece, start, colon - start)).alias("role"),
            F.when(fine, unescape(body)).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def _back(role: Column, body: Column, text: Column) -> Column:
    """Whether one rendered turn parses back to exactly this turn."""
    got = parse(F.concat(_head(role), body, F.lit(_END)))
    return (F.size(got) == 1) & got[0]["role"].eqNullSafe(role) & got[0]["text"].eqNullSafe(text)


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (code points, end exclusive)."""
    turns = conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    body = F.when(_back(role, text, text), text)
    again = escape(text)  # one escape makes any text conform; a text for which it does not is an error
    body = F.coalesce(body, F.when(_back(role, again, text), again))
    body = F.coalesce(body, F.raise_error(F.lit("a turn does not survive the round trip")).cast("string"))
    pieces = turns.withColumn("body", body).withColumn("head", _head(role))
    length = F.length("head") + F.length("body") + F.lit(len(_END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "conv_id", "role", "text", "head", "body",
        F.row_number().over(order).alias("n"),
        F.coalesce(F.sum(length).over(before), F.lit(0)).alias("at"),
    )
    each = F.struct("n", "role", "text", "head", "body", "at")
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("t"))
    chats = chats.withColumn(
        "formatted",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(_END))), ""),
    )
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    loss = F.transform(
        F.filter("t", lambda t: t["role"] == loss_role),
        lambda t: F.struct(
            (t["at"] + F.length(t["head"])).alias("start"),
            (t["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
        ),
    )
    same = parse(F.col("formatted")) == source
    return chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.when(same, F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string"))
        .alias("formatted"),
        loss.alias("loss_spans"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, read back from the rendered text."""
    cut = F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return F.array_join(cut, "")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe that holds the template's own marks."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_chats(rows.unionByName(probe))
    turns = F.array_join(
        F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (
  SELECT *, regexp_replace(text, '(\\*)(#{3,}|</turn>)', '\\\1\2', 'g') AS body,
    length(replace(replace(replace(role, '\', '\\'), ':', '\c'), chr(10), '\n')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + role_chars + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""
