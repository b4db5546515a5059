"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it are context, and only its
reply is under the loss mask. Turns after the last reply (or a conversation without replies) form one more example
with nothing under the mask, so that the examples hold the whole conversation.

A turn is written <s>[role]text</s>. In roles and texts the characters & < [ ] are written as entities, so no
control string of this or a similar template can occur in them, and reading them back is exact. Only DataFrame
functions are used. The turns of one conversation meet in one task (they must, to be one text); examples are made
from them row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, CLOSE = "<s>[", "</s>"


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to examples: conv_id, example (from 1), text, loss_start, loss_chars, final.

    loss_start and loss_chars are code points of `text`; `final` marks a conversation's last example. Null texts and
    roles are empty; turns order by turn (null first), then role, then text, so repeated rows are turns of their own;
    rows without conv_id are one conversation; an empty table gives no rows; other columns are ignored.
    """
    empty = F.lit("")
    row = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    written = F.transform("rows", lambda r: F.concat(F.lit(OPEN), escape(r["role"]), F.lit("]"), escape(r["text"]), F.lit(CLOSE)))
    replies = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.get("rows", i - 1)["role"] == "assistant")
    ends = F.when(F.element_at("rows", -1)["role"] == "assistant", replies).otherwise(F.concat(replies, F.array(F.size("rows"))))
    loss = lambda r: F.when(r["role"] == "assistant", F.length(escape(r["text"]))).otherwise(0).cast("long")
    ends = F.transform(ends, lambda i: F.struct(i.alias("at"), loss(F.get("rows", i - 1)).alias("loss_chars")))
    # an example's row carries the written turns alone, and not the turns as well
    conv = conv.select("conv_id", written.alias("written"), ends.alias("ends"))
    ex = conv.select("conv_id", "written", F.size("ends").alias("n"), F.posexplode("ends").alias("i", "end"))
    ex = ex.select("conv_id", (F.col("i") + 1).cast("long").alias("example"), F.array_join(F.slice("written", 1, F.col("end.at")), "").alias("text"), "end.loss_chars", (F.col("i") + 1 == F.col("n")).alias("final"))
    return ex.select("conv_id", "example", "text", (F.length("text") - len(CLOSE) - F.col("loss_chars")).cast("long").alias("loss_start"), "loss_chars", "final")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, read back: an array of (role, text)."""
    parts = F.filter(F.split(text, CLOSE), lambda x: x != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "]", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "]") + 1)).alias("text")))


def loss_text(text: str = "text", start: str = "loss_start", chars: str = "loss_chars") -> Column:
    """What is under the loss mask, unescaped."""
    return unescape(F.substr(F.col(text), (F.col(start) + 1).cast("int"), F.col(chars).cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation, read from their text and mask alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    back = F.when(F.col("final"), read_turns(F.col("text")))
    ex = examples.select("conv_id", "example", back.alias("turns"), F.length("text").cast("long").alias("chars"), F.when(F.col("loss_chars") > 0, loss_text()).otherwise(F.lit("")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    ex = ex.select("conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("sha"))
    per = ex.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
