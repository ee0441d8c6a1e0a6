"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted by turn, merged where neighbours have the same role (array
aggregation), and concatenated:

    <s>[ROLE]user[TEXT]first[NEXT]merged second[END][ROLE]assistant[TEXT]answer[END]</s>

Control strings inside a role or text are escaped by one backslash after their first character
(``[END]`` becomes ``[\\END]``, and what looks so already gets one more), so no control string is
left in it and the text comes back exactly. ``[INST]``, ``[/INST]``, ``<s>`` and ``</s>`` count too.

The loss mask is an array of booleans, one for each piece between control strings of the output, true
for texts of the trained role. Null texts and roles count as empty. Turns with equal numbers sort by
role, then text; null turn numbers first. An empty table gives an empty result. A conversation is
one output row, so its turns meet in one task; partial lists are collected before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

MARKS = r"/?s>|/?INST\]|ROLE\]|TEXT\]|NEXT\]|END\]"
CONTROL = rf"(?:<|\[)(?:{MARKS})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({MARKS})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({MARKS})", "$1$2$3")


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_mask of each conversation in rows of conv_id, turn, role, text."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # sorted as they are, then escaped
    grouped = grouped.select("conv_id", F.transform("t", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    # Where a run of turns of one role starts, counted from 1; then each run as role and texts.
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = F.transform("starts", lambda s, k: F.struct(F.element_at("turns", s)["role"].alias("role"), F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s)["text"].alias("texts")))
    merged = grouped.withColumn("starts", starts).select("conv_id", runs.alias("runs"))
    one = lambda r: F.concat(F.lit("[ROLE]"), r["role"], F.lit("[TEXT]"), F.array_join(r["texts"], "[NEXT]"), F.lit("[END]"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("runs", one), ""), F.lit("</s>"))
    # Pieces between control strings: before <s>; before [ROLE], the role and the texts of each run; before and after </s>.
    no = F.array(F.lit(False))
    masks = F.transform("runs", lambda r: F.concat(no, no, F.array_repeat(r["role"] == escaped(F.lit(trained_role)), F.size(r["texts"]))))
    return merged.select("conv_id", formatted.alias("formatted"), F.concat(no, F.flatten(masks), no, no).alias("loss_mask"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, in order) and loss_text of rows that format_conversations made."""
    run = lambda g: F.split(F.substring_index(g, "[END]", 1), r"\[(?:TEXT|NEXT)\]")
    runs = F.transform(F.slice(F.split("formatted", r"\[ROLE\]"), 2, F.length("formatted")), run)
    turn = lambda r: F.transform(F.slice(r, 2, F.size(r)), lambda t: F.struct(unescaped(r[0]).alias("role"), unescaped(t).alias("text")))
    pieces = F.arrays_zip(F.split("formatted", CONTROL).alias("piece"), F.col("loss_mask").alias("on"))
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["on"]), lambda p: unescaped(p["piece"])), "")
    return formatted.withColumn("runs", runs).withColumn("pieces", pieces).select("conv_id", F.flatten(F.transform("runs", turn)).alias("turns"), loss.alias("loss_text"), "formatted")


#: The conversation that the query adds to the table's.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written, and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = table.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    stored = Workspace(spark, "chat").table("formatted", format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_conversations(stored).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
