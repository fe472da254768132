"""Chat formatting (2), by DataFrame functions only: prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context, and only its reply is trainable (loss_start and loss_end, in code
points of `formatted`). A conversation that does not end with an assistant turn
has one more example, of all its turns with nothing trainable, so no turn is lost.

A turn reads <|turn|>role\\ntext<|end|>\\n. Control strings of this and of other
common templates are escaped in roles and texts by a backslash after their first
character, once backslashes are doubled; unescaped() undoes it for every string.
A line break in a role becomes [\\N].

Defined results: null roles and texts are empty; turns go by number (nulls
first), equal numbers by role and text, repeated rows stay; rows without conv_id
are one conversation. The examples of a conversation of n turns hold n * n / 2
turns: that is the expansion; a conversation's turns meet in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: What follows the first character, < or [, of a control string.
_TAIL = r"(/?s>|/?INST\]|<SYS>>|</SYS>>|\|)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + _TAIL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + _TAIL, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("[\\N]"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (its last turn's place, from 1), formatted, loss_start, loss_end (equal: nothing trainable)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    own = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body")))
    grouped = rows.groupBy("conv_id").agg(own.alias("t")).withColumn("segments", F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))))
    last = F.size("t")
    wanted = F.filter(F.sequence(F.lit(1), last), lambda i: (F.get("t", i - 1)["role"] == "assistant") | (i == last))
    out = grouped.withColumn("example", F.explode(wanted)).withColumn("target", F.get("t", F.col("example") - 1))
    out = out.withColumn("formatted", F.array_join(F.slice("segments", F.lit(1), F.col("example")), ""))
    end = F.length("formatted") - len(END)
    start = F.when(F.col("target.role") == "assistant", end - F.length("target.body")).otherwise(end)
    return out.select("conv_id", "example", "formatted", start.alias("loss_start"), end.alias("loss_end"))


def parsed(formatted: Column) -> Column:
    """Turns read back from a formatted text: an array of (role, text)."""

    def one(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - len(END))
        return F.struct(F.replace(unescaped(F.replace(head, F.lit("[\\N]"), F.lit("[\\\\N]\n"))), F.lit("[\\N]\n"), F.lit("\n")).alias("role"), unescaped(body).alias("text"))

    parts = F.split(formatted, r"<\|turn\|>")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)


def read_back(rows: DataFrame) -> DataFrame:
    """Digests of each conversation, from its examples alone."""
    learnt = unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    by = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", learnt.alias("text")))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    by = by.withColumn("turns", parsed(F.col("whole"))).withColumn("loss", F.array_join(F.transform("replies", lambda x: x["text"]), ""))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
