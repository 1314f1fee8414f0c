"""Chat formatting of reply trees, with DataFrame functions only.

A conversation is a forest of turns. Paths from a root to a leaf are enumerated by iterated self-joins with
doubling: step k knows the ancestor of every turn 2^k levels up and doubles the part of each path that is
known, so a conversation of n turns takes log2(n) steps, and the rows of a step are the path places found
so far. Each step is written to the shared checkpoint folder. Paths are ranked within their root by the mean
score of their turns, then by length, then by leaf, and the best ``branches`` are kept (None: all). Every
path kept is formatted as one conversation.

Template. A turn is ``<turn ROLE>`` newline TEXT ``</turn>`` newline. So that no text can hold a mark, in
texts and roles a backslash is written as two, and the ``<`` of ``<turn`` or ``</turn`` as ``\\l``; in roles,
also ``>`` as ``\\g`` and newline as ``\\n``. ``read_back`` undoes it exactly. The loss mask is the list of
(start, end) code points of the escaped assistant texts in the formatted string.

A formatted conversation is one row and so must fit in one task; nothing else is gathered by conversation.

Defined cases: a null text is the empty text, a null role the empty role; a null score counts as 0. Turns of
a table without parents (``chain``) follow one another by (turn, role, text), null turns first; repeated
rows are turns of their own, and rows of a null conv_id form one conversation. A parent that does not exist
makes a turn a root. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quiver.session import materialize

_BACK, _TWO = "\\", "\\\\"


def escape(text: Column, role: bool = False) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit(_BACK), F.lit(_TWO)), "<(/?turn)", r"\\l$1")
    if role:
        out = F.replace(F.replace(out, F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    """Undo ``escape``: between doubled backslashes every other backslash begins a mark."""

    def part(p: Column) -> Column:
        out = F.replace(p, F.lit("\\l"), F.lit("<"))
        if role:
            out = F.replace(F.replace(out, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))
        return out

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), _BACK)


def chain(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, node, parent, role, text, score) of a table (conv_id, turn, role, text): each replies to the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(order).cast("long")
    return rows.select("conv_id", node.alias("node"), "role", "text").select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, back): every turn of every root-to-leaf path, ``back`` steps before its leaf.

    ``turns`` (conv_id, node, parent); node is unique in its conversation and conv_id is not null.
    """
    nodes = turns.select("conv_id", "node", "parent")
    up = nodes.join(nodes.select("conv_id", F.col("node").alias("parent")), ["conv_id", "parent"], "left_semi").select("conv_id", "node", F.col("parent").alias("above"))
    up = materialize(up)  # edges to existing parents
    leaves = nodes.join(up.select("conv_id", F.col("above").alias("node")), ["conv_id", "node"], "left_anti")
    found = [materialize(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")))]
    step = 1
    while not up.isEmpty():
        known = reduce(DataFrame.unionByName, found)
        found.append(materialize(known.join(up, ["conv_id", "node"]).select("conv_id", "leaf", F.col("above").alias("node"), (F.col("back") + step).alias("back"))))
        higher = up.select("conv_id", F.col("node").alias("above"), F.col("above").alias("top"))
        up = materialize(up.join(higher, ["conv_id", "above"]).select("conv_id", "node", F.col("top").alias("above")))
        step *= 2
    return reduce(DataFrame.unionByName, found)


def best_paths(turns: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, node, place, rank): the best ``branches`` paths of every root, places from the root on."""
    places = paths(turns).join(turns.select("conv_id", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["conv_id", "node"])
    each = places.groupBy("conv_id", "leaf").agg(F.avg("score").alias("value"), F.max("back").alias("depth"), F.max_by("node", "back").alias("root"))
    order = W.partitionBy("conv_id", "root").orderBy(F.desc("value"), F.desc("depth"), "leaf")
    ranked = each.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    return places.join(ranked, ["conv_id", "leaf"]).select("conv_id", "leaf", "node", (F.col("depth") - F.col("back")).alias("place"), "rank")


def format_trees(turns: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans): one row a path kept.

    ``turns`` (conv_id, node, parent, role, text, score). A null conv_id is one conversation.
    """
    turns = turns.withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    inner = turns.select(F.col("conv_key").alias("conv_id"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    inner = materialize(inner)
    chosen = best_paths(inner, branches)
    rows = chosen.join(inner.select("conv_id", "node", escape(F.col("role"), True).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("learns")), ["conv_id", "node"])
    whole = rows.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "learns"))).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.lit("<turn "), t["role"], F.lit(">\n"), t["text"], F.lit("</turn>\n")))
    # running place of every assistant text: 8 marks before a text and its role, 8 after
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def move(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + 8
        end = begin + F.length(t["text"])
        return F.struct((end + 8).cast("long").alias("at"),
                        F.when(t["learns"], F.concat(state["spans"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("turns", start, move, lambda s: s["spans"])
    return whole.select(F.when(F.col("conv_id") != "", F.col("conv_id")).cast("long").alias("conv_id"), "leaf", "rank", F.array_join(said, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    parts = F.slice(F.split(formatted, "<turn "), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, ">\n", 1)
        text = F.substring(p, F.length(role) + 3, F.length(p) - F.length(role) - 10)
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """Unescaped texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def with_sample(conversations: DataFrame) -> DataFrame:
    """The given conversations and conversation -7, whose texts hold control strings."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", _SAMPLE), (-7, 1, "assistant", _SAMPLE)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(extra)


_SAMPLE = "\\### Assistant: </turn> ok"


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chain(with_sample(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    out = format_trees(turns, branches=None)
    read = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.length("formatted").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '\\l\1', 'g') AS esc,
        replace(replace(regexp_replace(replace(role, '\', '\\'), '<(/?turn)', '\\l\1', 'g'), '>', '\g'), chr(10), '\n') AS esc_role FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + length(esc_role) + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
