"""Chat formatting: conversations are rebuilt from their events, then rendered, with DataFrame functions only.

An event is (conversation, sequence, kind, role, text).  Events of one conversation are folded in order of their
sequence number, message by message:

* ``message``: starts a message;
* ``delta``: appends to the message (starts one if there is none, also after a ``delete``);
* ``edit`` and ``regenerate``: replace the text of the message so far (an answer made anew drops the old deltas);
* ``delete``: takes the message away.

``message_col`` says which events belong to one message, so that the first grouping has (conversation, message) as
its key and a conversation with a very large number of rows is folded by many tasks; only its final messages meet
in the second grouping, as a conversation is one string in the end.  There they stand in the order of their first events.

The template.  A turn is ``### Role: text</turn>`` and a new line.  In role and text three characters are written
as codes: backslash as ``\\b``, ``<`` as ``\\l`` and ``#`` as ``\\h``; so neither ``###`` nor ``</turn>`` can appear in a
text, and the way back is exact; in a role a colon is written ``\\\\c`` as well.  The loss mask covers the texts of assistant turns, without markers.

Defined results: a null text is empty; a null role is the role ``""``; a null conversation id is a conversation of
its own; equal sequence numbers of one message are ordered by kind (message, delta, edit, regenerate, delete), role and text, so repeated rows give repeated turns;
messages that start at one sequence number are ordered by role, text and key; an unknown kind comes first and replaces the
text as an edit does; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Kinds of events, in the order in which those of one sequence number are folded.
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _fold(groups: DataFrame) -> DataFrame:
    """Adds ``part``, the final messages of each group's ordered ``events``, as array<struct<role, text>>.

    Runs of deltas are joined to the event before them at once, so a message of many deltas is not copied for each.
    """
    n = F.size("events")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("events", i)["kind"] != "delta"))

    def piece(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("heads", k + 1), n)
        run, head = F.slice("events", at + 1, end - at), F.get("events", at)
        joined = lambda part: F.array_join(F.transform(part, lambda e: e["text"]), "")
        later = F.slice("events", at + 2, F.greatest(end - at - 1, F.lit(0)))
        removed = head["kind"] == "delete"
        return F.struct(head["kind"].alias("kind"), F.when(removed, F.coalesce(F.get("events", at + 1)["role"], F.lit(""))).otherwise(head["role"]).alias("role"), F.when(removed, joined(later)).otherwise(joined(run)).alias("text"), (end - at > 1).alias("more"))

    def step(done: Column, e: Column) -> Column:
        fresh = F.array(F.struct(e["role"].alias("role"), e["text"].alias("text")))
        last, head = F.try_element_at(done, F.lit(-1)), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        replaced = F.concat(head, F.array(F.struct(last["role"].alias("role"), e["text"].alias("text"))))
        starts = e["kind"].isin("message", "delta") | (F.size(done) == 0)
        return F.when(e["kind"] == "delete", F.when(e["more"], F.concat(head, fresh)).otherwise(head)).when(starts, F.concat(done, fresh)).otherwise(replaced)

    plain = F.transform("events", lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
    folded = F.aggregate("pieces", F.array().cast("array<struct<role:string,text:string>>"), step)
    some = groups.withColumn("plain", F.forall("events", lambda e: e["kind"] == "message")).withColumn("heads", F.when(~F.col("plain"), heads))
    return some.withColumn("pieces", F.transform("heads", piece)).withColumn("part", F.when(F.col("plain"), plain).otherwise(folded))


def reconstruct(events: DataFrame, conv_col: str = "conv_id", message_col: str = "turn", seq_col: str = "seq", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, messages array<struct<role, text>>), the final messages in the order of their first events."""
    rows = events.select(
        F.col(conv_col).alias("conv"), F.col(message_col).alias("message"), F.col(seq_col).alias("seq"),
        F.coalesce(F.col(kind_col), F.lit("message")).alias("kind"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    step = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    groups = rows.groupBy("conv", "message").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", step.alias("step"), "kind", "role", "text"))).alias("events"))
    whole = _fold(groups).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "part", "message"))).alias("parts"))
    return whole.select(F.col("conv").alias(conv_col), F.flatten(F.transform("parts", lambda p: p["part"])).alias("messages"))


def render(conversations: DataFrame, messages_col: str = "messages") -> DataFrame:
    """Adds ``formatted``, the whole conversation as one string."""
    turn = lambda m: F.concat(F.lit(OPEN), F.replace(escape(m["role"]), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE), escape(m["text"]), F.lit(CLOSE))
    return conversations.withColumn("formatted", F.array_join(F.transform(messages_col, turn), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>; the first ``: `` of a turn ends its role."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: t != "")

    def parse(turn: Column) -> Column:
        body = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn))
        cut = F.position(F.lit(MIDDLE), body)
        role = F.substring(body, F.lit(1), cut - 1)
        text = F.substring(body, cut + len(MIDDLE), F.length(body))
        return F.struct(unescape(F.replace(role, F.lit("\\c"), F.lit(":"))).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, parse)


def digest(rendered: DataFrame, conv_col: str = "conv_id", formatted_col: str = "formatted", loss_role: str = "assistant") -> DataFrame:
    """What a reader of the rendered strings gets back: turns, their hash, and the text under the loss mask."""
    read = rendered.select(F.col(conv_col), F.col(formatted_col).alias("formatted"), read_back(F.col(formatted_col)).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
