"""Chat transcripts from event logs, with DataFrame functions only.

A log has conv_id, message (any key of a message within its conversation), seq (any ordered
value, unique within a conversation), kind, role and text. Kinds: ``open`` starts a message,
``delta`` appends to it, ``edit`` replaces all of it, ``regenerate`` starts its text anew,
``delete`` removes it. A transcript is one string: ``### role: text</turn>`` and a line feed per
turn, with ``\\``, ``<`` and ``#`` of texts (and ``:`` of roles) escaped so that no text can look like
a mark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Character and escape; the backslash comes first when escaping and last when undoing it.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
HEAD, BETWEEN, TAIL = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(text, F.lit("")))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), [(":", "\\c"), *reversed(ESCAPES)], text)


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, at (seq of the first event), role, text.

    Deltas before a message's last open, edit or regenerate are superseded; deltas without one
    append to nothing. A message whose last open or delete is a delete is gone. Null texts are
    empty, unknown kinds are ignored; of events with one seq, the greater text counts as later.
    """
    event = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    is_base = F.col("kind").isin("open", "edit", "regenerate")
    message = log.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.max(F.when(is_base, event)).alias("base"),
        F.collect_list(F.when(F.col("kind") == "delta", event)).alias("deltas"),
        F.max(F.when(F.col("kind").isin("open", "delete"), F.struct("seq", "kind"))).alias("life"),
    )
    live = message.where("life is null or life.kind <> 'delete'")
    later = F.filter(F.array_sort("deltas"), lambda d: F.col("base").isNull() | (d["seq"] > F.col("base.seq")))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return live.select("conv_id", "at", F.coalesce("role.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One transcript per conversation and its loss mask: spans of code points of ``loss_role`` texts."""
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(BETWEEN), escaped(F.col("text")), F.lit(TAIL))
    turns = messages.select("conv_id", "at", "role", piece.alias("piece"), F.length(escaped_role(F.col("role"))).alias("role_chars"))
    placed = turns.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    start = F.col("offset") + len(HEAD) + F.col("role_chars") + len(BETWEEN)
    chars = F.length("piece") - len(HEAD) - F.col("role_chars") - len(BETWEEN) - len(TAIL)
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), chars.alias("chars")))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "loss_spans")


def parse(transcripts: DataFrame) -> DataFrame:
    """Adds the turns (role, text) that a transcript holds and the unescaped text under its mask."""
    parts = F.split("formatted", "</turn>\n")
    body = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(HEAD) + 1)))
    turn = lambda p: F.struct(
        unescaped(F.substring_index(p, ":", 1)).alias("role"), unescaped(F.substr(p, F.length(F.substring_index(p, ":", 1)) + 1 + len(BETWEEN))).alias("text")
    )
    masked = F.array_join(F.transform("loss_spans", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), s["chars"].cast("int"))), "")
    return transcripts.withColumn("turns", F.transform(body, turn)).withColumn("loss_text", unescaped(masked))


def as_log(conversations: DataFrame, chunk: int = 512) -> DataFrame:
    """A log as a chat service would have written it for these finished rows (conv_id, turn, role, text).

    Assistant texts are first begun, then regenerated and streamed in chunks; others are begun and
    then edited. Rows are ordered by turn, equal turns by role and hash of the text; equal rows stay apart.
    """
    text, spoken = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("")) == "assistant"
    rows = conversations.groupBy("conv_id", "turn", "role", text.alias("text")).count()
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    event = lambda step, kind, t: F.struct(step.cast("int").alias("step"), F.lit(kind).alias("kind"), t.alias("text"))
    count = F.ceil(F.length("text") / chunk).cast("int")
    opened = event(F.lit(0), "open", F.lit(""))
    draft = event(F.lit(1), "delta", F.substring("text", 1, 40))
    streamed = F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), lambda i: event(i + 3, "delta", F.substr("text", i * chunk + 1, F.lit(chunk))))
    events = F.when(spoken, F.concat(F.array(opened, draft, event(F.lit(2), "regenerate", F.lit(""))), streamed)).otherwise(F.array(opened, draft, event(F.lit(2), "edit", F.col("text"))))
    key = F.struct("turn", "role", F.xxhash64("text").alias("said"), "copy")
    out = rows.select("conv_id", "role", key.alias("message"), F.explode(events).alias("event"))
    seq = F.struct("message.turn", "message.role", "message.said", "message.copy", "event.step")
    return out.select("conv_id", "message", seq.alias("seq"), F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"))
