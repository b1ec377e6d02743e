"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation becomes one formatted text: `<turn ROLE>` TEXT `</turn>` for each turn. Inside roles and texts, `%`
becomes `%25` and `<` becomes `%3C` (in roles `>` becomes `%3E`, too), so no control string can stand there, and unescaping is exact. Each assistant
turn is an example of its own: its context is all text before the reply (the preceding turns and the mark that opens
the reply), its target the reply and the mark that ends it, and only the reply is trainable. Where replies stand comes
from running sums over a conversation's turns. Examples are explode()d from the formatted conversation, each with its
context, reply and place. Contexts of a conversation of n turns are n copies of parts of its text, as the method asks;
they are cut as rows stream by and aren't shuffled, and whoever doesn't select `context` pays for none.

A conversation's turns meet in one row, as its text does in the output; nothing else is gathered.

Defined cases: null text and null role are empty; turns with equal numbers follow role, then text (nulls first);
repeated rows are turns of their own; rows of null conv_id are one conversation; a conversation without an assistant
turn has no example, and an empty loss text; very long texts are turns like any other; an empty table gives none; of
the turns only the four named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.llm.common import column, table

OPEN, CLOSE, END = "<turn ", ">", "</turn>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%3E"), F.lit(">")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row a conversation: its id, `formatted`, and `replies`, an array of (start, chars): where in it each trainable reply stands, from 0."""
    own = turns.select(column(conv_col).alias("conv"), column(turn_col).alias("turn"), column(role_col).alias("role"), column(text_col).alias("text"))
    own = own.select(
        "*", F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(">"), F.lit("%3E")), F.lit(CLOSE)).alias("head"), escape(F.col("text")).alias("body"), F.coalesce(F.col("role") == TRAINED, F.lit(False)).alias("trained"),
    )
    in_order = W.partitionBy("conv").orderBy("turn", "role", "text")
    chars = F.length("head") + F.length("body") + F.lit(len(END))
    before = F.coalesce(F.sum(chars).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = own.select("conv", F.struct(
        F.row_number().over(in_order).alias("n"), F.concat("head", "body", F.lit(END)).alias("shown"), "trained", (before + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("chars"),
    ).alias("t"))
    # the groups are those of the window: no second shuffle
    whole = placed.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    replies = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"], t["chars"]))
    return whole.select(F.col("conv").alias(conv_col), F.array_join("turns.shown", "").alias("formatted"), replies.alias("replies"))


def examples(formatted: DataFrame, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """A row an assistant turn: the columns `keep` (all but formatted and replies), example (from 0), start, chars, context (all text before the reply) and reply, the trainable text, unescaped.

    outer: a conversation without such a turn is a row with a null example.
    """
    rest = keep if keep is not None else [c for c in formatted.columns if c not in ("formatted", "replies")]
    kept = F.struct(*[column(c) for c in rest]).alias("kept")
    explode = F.posexplode_outer if outer else F.posexplode
    cut = formatted.select(kept, "formatted", explode("replies").alias("example", "own"))
    reply = unescape(F.substr("formatted", (F.col("own.start") + 1).cast("int"), F.col("own.chars").cast("int")))
    return cut.select(*([] if not rest else ["kept.*"]), "example", "own.start", "own.chars", context(F.col("formatted"), F.col("own.start")).alias("context"), reply.alias("reply"))


def context(formatted: Column, start: Column) -> Column:
    return F.substr(formatted, F.lit(1), start.cast("int"))


def target(formatted: Column, start: Column, chars: Column) -> Column:
    """The reply as it stands and the mark that ends it; the mark isn't trainable."""
    return F.substr(formatted, (start + 1).cast("int"), (chars + len(END)).cast("int"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted text."""
    pieces = F.slice(F.split(formatted, OPEN, -1), 2, 1 << 30)
    body = lambda p: F.substring_index(p, CLOSE, 1)
    return F.transform(pieces, lambda p: F.struct(unescape(body(p)).alias("role"), unescape(F.substr(p, F.length(body(p)) + 2, F.length(p) - F.length(body(p)) - F.lit(1 + len(END)))).alias("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    formatted = format_conversations(turns)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    turns_text = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("conv_id", "formatted", "replies", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), digest(turns_text).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    own = examples(read, ["conv_id", "n_turns", "turns_sha256", "formatted_chars"], outer=True)
    # the groups are those that the conversations were gathered by: no second shuffle
    whole = own.groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")], F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("found"),
        F.count("example").alias("n_examples"), F.coalesce(F.sum(F.length("context").cast("long")), F.lit(0)).alias("context_chars"),
    )
    loss = F.array_join("found.reply", "")
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, '<turn ' || replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') || '>' AS head, replace(replace(text, '%', '%25'), '<', '%3C') || '</turn>' AS tail FROM t),
p AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS context FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(head) + length(tail)) AS BIGINT) AS formatted_chars,
count(*) FILTER (role = 'assistant') AS n_examples, CAST(coalesce(sum(context) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM p GROUP BY conv_id
"""
