"""Chat formatting in Spark expressions only: turns in, one marked and reversible string out.

Template: <s>[role]text<sep>text</s>[role]text</s>... where adjacent turns of one role share
a block. In roles and texts '&', '<', '[' and ']' are written &amp; &lt; &#91; &#93;, so a marker in
the output is always a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Written forms of the four characters that markers begin or end with; '&' first to write, last to read.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
START, SEP, END = "<s>", "<sep>", "</s>"


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the marked string and the [start, end) code-point spans to train on.

    Turns are sorted by turn (null first), then role and text, so repeated turns have a
    fixed order and none is lost. Null texts and roles are empty. Null conv_id is one
    conversation. The mask covers each text of `loss_role`, escaped as in the output, and no
    marker. A conversation's string is as long as its turns: one conversation is one row.
    Empty input gives an empty result; other columns are not read.
    """
    own = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Where each text ends in the output is a running sum, made while the rows are sorted, so the mask costs no more than the turns.
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(w)
    d = own.select("conv_id", place.alias("i"), "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("x"), (F.col("role") == F.lag("role").over(w)).alias("same"))
    head = F.when(F.col("i") == 1, len(START)).otherwise(len(END)) + F.length("r") + 2
    size = F.when(F.col("same"), len(SEP)).otherwise(head) + F.length("x")
    d = d.withColumn("end", F.sum(size).over(Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "r", "x", "end"))).alias("t"))
    # Indexes (from 1) at which the role changes, then the turns of each run.
    d = d.withColumn("starts", F.expr("filter(sequence(1, size(t)), i -> i = 1 OR t[i - 1].role <> t[i - 2].role)"))
    d = d.withColumn("blocks", F.expr("transform(starts, (s, i) -> slice(t, s, coalesce(get(starts, i + 1), size(t) + 1) - s))"))
    joined = lambda b: F.concat(F.lit("["), b[0]["r"], F.lit("]"), F.array_join(F.transform(b, lambda x: x["x"]), SEP), F.lit(END))
    spans = F.transform(F.filter("t", lambda x: x["role"] == loss_role), lambda x: F.struct((x["end"] - F.length(x["x"])).alias("start"), x["end"].alias("end")))
    return d.select("conv_id", F.concat(F.lit(START), F.array_join(F.transform("blocks", joined), "")).alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns (role, text) and trained text, from format_chats' output alone."""
    bare = F.expr(f"substring(formatted, {len(START) + 1})")
    d = chats.withColumn("_blocks", F.slice(F.split(bare, END), F.lit(1), F.size(F.split(bare, END)) - 1))
    rows = F.transform("_blocks", lambda b: F.struct(unescape(F.substring_index(F.substring(b, 2, 2**31 - 1), "]", 1)).alias("role"), F.split(F.regexp_replace(b, r"^\[[^\]]*\]", ""), SEP).alias("texts")))
    turns = F.flatten(F.transform(rows, lambda r: F.transform(r["texts"], lambda x: F.struct(r["role"].alias("role"), unescape(x).alias("text")))))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return d.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")
