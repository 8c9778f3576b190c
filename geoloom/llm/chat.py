"""Chat formatting from an event log.

A log row is (conv_id, seq, message, kind, role, text). Rows are grouped by conversation and message, sorted by seq and
folded: `message` sets role and text, `delta` appends, `edit` replaces the text, `regenerate` empties the message and
takes back every event of later messages logged before it, `delete` removes the message. The final messages are rendered with a
template whose control strings are escaped inside roles and texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: <s>[INST]role[/INST]text</s> for every message.
CONTROL = r"/?(?:s>|INST\])"
STUFF, UNSTUFF = rf"([<\[])(\\*)({CONTROL})", rf"([<\[])\\(\\*)({CONTROL})"
LOG_KINDS = ("message", "delta", "edit", "regenerate", "delete")
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    """A backslash goes between the bracket of a control string and its name, one more where some stand there already, so taking one away gives the text back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), STUFF, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(UNSTUFF, r"\1\2\3", text)


def fold(log: DataFrame) -> DataFrame:
    """The final messages: conv_id, message, role, text.

    Null texts are empty, null roles empty strings, null kinds `message`; events with equal seq are taken by kind, role
    and text. A message whose first event is no `message` starts empty. Null conv_ids make one conversation.
    """
    conv = Window.partitionBy("conv_id").orderBy("message")
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    regenerated = F.array_max(F.transform(F.filter("events", lambda e: e.kind == "regenerate"), lambda e: e.seq))
    valid = F.filter("events", lambda e: F.col("_taken_back").isNull() | e.seq.isNull() | (e.seq > F.col("_taken_back")))
    last = F.array_max(F.transform(F.col("events"), lambda e, i: F.when(e.kind.isin("message", "edit", "regenerate", "delete"), i)))
    tail = F.expr("slice(events, coalesce(_last, 0) + 1, size(events))")
    text = F.array_join(F.transform(tail, lambda e: F.when(e.kind.isin("regenerate", "delete"), "").otherwise(e.text)), "")
    roles = F.filter(F.transform("events", lambda e: e.role), lambda r: r != "")
    deleted = F.coalesce(F.element_at("events", F.coalesce(F.col("_last"), F.lit(0)) + 1).kind == "delete", F.lit(False))
    return (
        log.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("events"))
        .withColumn("_taken_back", F.max(regenerated).over(conv.rowsBetween(Window.unboundedPreceding, -1)))
        .select("conv_id", "message", valid.alias("events")).where("size(events) > 0")
        .withColumn("_last", last).where(~deleted)
        .select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (begin and end, in code points, of each text to learn from).

    Messages are ordered by message, null first; equal numbers by role and text. A conversation is one row, so memory
    holds one whole conversation a task.
    """
    head = F.concat(F.lit("<s>[INST]"), escaped(F.col("role")), F.lit("[/INST]"))
    body = escaped(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = messages.withColumns({"_head": head, "_body": body}).withColumn("_piece", F.concat("_head", "_body", F.lit("</s>")))
    placed = pieces.withColumn("_begin", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)) + F.length("_head")).withColumn("_row", F.row_number().over(order))
    loss = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("_begin").alias("begin"), (F.col("_begin") + F.length("_body")).alias("end")))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("_row"), F.col("_piece"), loss.alias("loss")))).alias("_rows"))
    return grouped.select("conv_id", F.array_join(F.transform("_rows", lambda r: r._piece), "").alias("formatted"), F.filter(F.transform("_rows", lambda r: r.loss), lambda x: x.isNotNull()).alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each message; no control string stands inside an escaped role or text."""
    found = re.findall(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", formatted, re.DOTALL)
    return [(unescape(role), unescape(text)) for role, text in found]


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and their loss masks hold: see READ_SCHEMA."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, text, spans in zip(frame["conv_id"], frame["formatted"], frame["loss"], strict=True):
                turns, learned = parse(text), [unescape(text[s["begin"] : s["end"]]) for s in spans]
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                loss = "".join(learned)
                out.append((None if pd.isna(conv) else int(conv), len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            made = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield made.astype({"conv_id": "Int64"})

    return rendered.mapInPandas(read, READ_SCHEMA)


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A log of rows by turn: each row is a `message` event, equal turns one after the other by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn"), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), F.row_number().over(order).cast("long").alias("message"), F.lit("message").alias("kind"), "role", "text")
