"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example whose context is all preceding turns
and whose reply alone is trainable.  A record reads
``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  ``&`` and ``<`` of roles and
texts (and line ends of roles) are escaped, so that no control string can come
from data and every record can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"
#: Escapes in the order they are made; undone in reverse.
ESCAPES = [("&", "&amp;"), ("<", "&lt;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]


def escape(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, n_context, formatted, loss_start, loss_end (code points of ``formatted``; end exclusive).

    Turns are taken in order of (turn, role, text); null roles and texts are
    empty, null turns come first, and rows with a null conv_id form one
    conversation.  Repeated rows are turns of their own.  A conversation that
    does not end with an assistant turn gets a last record with an empty loss
    span, so that no turn is lost.  Other columns are not read.  A record
    needs its conversation in one row; conversations are the only groups.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, escape(F.col("text"), ESCAPES), F.lit(END)))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "rendered"))).alias("t"))
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["role"] == TARGET)
    open_end = F.when(F.element_at("t", -1)["role"] == TARGET, F.array().cast("array<int>")).otherwise(F.array(F.size("t")))
    conv = conv.select("conv_id", "t", F.size(places).alias("n_targets"), F.posexplode(F.concat(places, open_end)).alias("example", "at"))
    trained = F.col("example") < F.col("n_targets")
    text = F.array_join(F.transform(F.slice("t", 1, F.col("at")), lambda x: x["rendered"]), "")
    out = conv.select("conv_id", "example", F.when(trained, F.col("at") - 1).otherwise(F.col("at")).alias("n_context"), text.alias("formatted"), F.element_at("t", F.col("at")).alias("x"), trained.alias("trained"))
    out = out.withColumn("chars", F.length("formatted"))
    start = F.col("chars") - F.length("x.rendered") + F.col("x.head")
    stop = F.col("chars") - len(END)
    return out.select("conv_id", "example", "n_context", "formatted", F.when(F.col("trained"), start).otherwise(0).alias("loss_start"), F.when(F.col("trained"), stop).otherwise(0).alias("loss_end"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a record."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2_147_483_647)
        cut = F.instr(body, F.lit("\n"))
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"), unescape(F.substring(body, cut + 1, F.lit(2_147_483_647)), ESCAPES).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, end - start), ESCAPES)


def digests(records: DataFrame) -> DataFrame:
    """Per conversation, what its records say when read back; see the query op9."""
    told = records.select("conv_id", "example", "formatted", F.length("formatted").alias("chars"), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    conv = told.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = parse(F.col("last"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = """
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, 12 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + 1
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 11 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS n_all
  FROM t0
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR n = n_all THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
