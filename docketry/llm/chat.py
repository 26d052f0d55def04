"""Chat formatting by event-sourced reconstruction.

Events (conv_id, seq, kind, msg, role, text) are partitioned by conversation and sorted by sequence. ``message`` opens
message msg, ``delta`` appends to it, ``edit`` puts new text in its place, ``regenerate`` also drops every message that
was opened after it and before the regeneration. What is left, in order of opening, is rendered. A conversation is
rendered as one string, so its own text is the least that one task can hold; all conversations are independent.

Nulls and odd rows: a null text or role is empty; a null conv_id is a conversation of its own; rows that repeat are
turns of their own (equal turns go by role, then text); an empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Control strings start with < or [; after escaping neither is left in a text. & comes first here and last in unescape.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def as_events(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as events: each opens a message and streams its text as one delta."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select("conv_id", place.alias("msg"), "role", "text")
    both = F.array(
        F.struct((2 * F.col("msg") - 1).alias("seq"), F.lit("message").alias("kind"), F.lit("").alias("text")),
        F.struct((2 * F.col("msg")).alias("seq"), F.lit("delta").alias("kind"), F.col("text").alias("text")),
    )
    return rows.select("conv_id", "msg", "role", F.explode(both).alias("e")).select("conv_id", "e.seq", "e.kind", "msg", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, place (sequence of opening), role, text."""
    resets = F.col("kind").isin("message", "edit", "regenerate")
    per = events.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("place"),
        F.min_by("role", "seq").alias("role"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("log"),
    )
    last = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    per = per.withColumn("text", F.array_join(F.transform(last, lambda e: e["text"]), ""))
    earlier = Window.partitionBy("conv_id").orderBy("place", "msg").rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.max("again").over(earlier)
    return per.withColumn("cut", dropped).filter("cut is null or cut < place").select("conv_id", "msg", "place", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of each assistant text, still escaped)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(CLOSE))
    body = escape(F.col("text"))
    one = messages.select("conv_id", "place", "msg", "role", head.alias("head"), body.alias("body"))
    one = one.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("conv_id").orderBy("place", "msg").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("place", "msg", F.concat("head", "body", F.lit(END)).alias("piece"))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length")))
    grouped = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p):
        role = F.substring_index(p, CLOSE, 1)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"), unescape(F.substr(p, F.length(role) + len(CLOSE) + 1)).alias("text"))

    return F.transform(pieces, turn)


def op10_chat_events(spark, sf_dir) -> DataFrame:
    """Contract query: digests read back from every formatted conversation, and from conversation -1."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], turns.schema)
    done = render(fold(as_events(turns.unionByName(probe)))).withColumn("back", read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return done.withColumn("loss", loss).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
OP10_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(OPEN + CLOSE + END)} + length(replace({_ESC.format("role")}, chr(10), '&#10;')) + length({_ESC.format("text")}))::BIGINT AS formatted_chars
  FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
