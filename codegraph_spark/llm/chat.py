"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable. Turns after the
last reply become a final example without a target, so that the output holds the whole conversation.

A turn is written ``[INST]role\\ntext[/INST]``, an assistant turn ``<s>role\\ntext</s>``. In roles and texts a backslash is doubled, a
control string gets a backslash after its first character, and a line feed in a role is written ``\\n``; no control string can then occur
inside a turn, and the way back is exact.

Defined results: null texts and roles are empty; turns are in order of turn, role and text, nulls first; repeated rows are repeated
turns; a null ``conv_id`` is one conversation like any other; a conversation without an assistant turn gives one example without a
target; an empty table gives no example; other columns do not matter. A conversation has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
# Control strings of the template and the common ones around them.
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROLS):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A pair of backslashes is set aside while ``\\n`` turns into a line feed; U+0001 doubles as the mark and is escaped for that."""
    aside = F.replace(F.replace(role, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\\\\"), F.lit("\x01\x03"))
    back = F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\x01\x03"), F.lit("\\\\")), F.lit("\x01\x02"), F.lit("\x01"))
    return unescape(back)


def render(role: Column, text: Column) -> Column:
    body = F.concat(escape_role(role), F.lit("\n"), escape(text))
    return F.when(role == ASSISTANT, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted string."""
    pieces = F.filter(F.split(formatted, r"(?<=\[/INST\])|(?<=</s>)"), lambda p: p != "")
    body = lambda p: F.regexp_replace(F.regexp_replace(p, r"^(?:\[INST\]|<s>)", ""), r"(?:\[/INST\]|</s>)$", "")
    bodies = F.transform(pieces, body)
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(bodies, lambda b: F.struct(unescape_role(role(b)).alias("role"), unescape(F.substr(b, F.length(role(b)) + 2)).alias("text")))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), ``context`` and ``target`` (formatted text; null target: nothing is trained)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _by_turn).alias("turns"))
    lines = whole.select(
        "conv_id", F.transform("turns", lambda t: render(t["role"], t["text"])).alias("lines"), F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("replies")
    )
    n = F.size("lines")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("replies", i))
    rest = F.when(F.element_at("replies", -1), F.array().cast("array<int>")).otherwise(F.array(n + 1))
    cuts = lines.select("conv_id", "lines", F.posexplode_outer(F.concat(replies, rest)).alias("example", "at"))
    return cuts.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.array_join(F.slice("lines", 1, F.col("at") - 1), "").alias("context"), F.get("lines", F.col("at") - 1).alias("target")
    )


def _by_turn(a: Column, b: Column) -> Column:
    less = lambda x, y: F.when(x.isNull() & y.isNotNull() | (x < y), -1).when(y.isNull() & x.isNotNull() | (x > y), 1)
    return F.coalesce(less(a["turn"], b["turn"]), less(a["role"], b["role"]), less(a["text"], b["text"]), F.lit(0))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turns, their digest, the trained text and its digest, and the characters written."""
    written = F.length("context") + F.coalesce(F.length("target"), F.lit(0))
    one = formatted.groupBy("conv_id").agg(
        F.max_by(F.concat("context", F.coalesce("target", F.lit(""))), "example").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("targets"),
        F.sum(written).cast("long").alias("formatted_chars"),
    )
    read = one.select(
        "conv_id", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("targets", lambda t: read_turns(t["target"])[0]["text"]), "").alias("trained"), "formatted_chars"
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars"
    )
