"""Chat formatting: event-sourced reconstruction of conversations, then a reversible template. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template. Each begins with `<` or `[`.
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]", "</s>"

#: Turns that are put together at a time, before the pieces of a conversation are.
PIECE = 64


def escape(text: Column) -> Column:
    r"""Write `\` after each `<`, `[` and `\`, so that no control string can occur in a text."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Fold a log of events into final messages: rows (chat, piece, turn, part, role, text); `chat` holds the conv_id.

    `events`: conv_id, turn, part (tells messages of the same turn apart), seq, event, role, text. `seq` orders the
    events of a conversation and may have any type that can be ordered. In its order: `open` begins a message with its
    role, `delta` appends to it, `edit` replaces what it holds, `regenerate` empties it for new deltas and takes away
    all messages of later turns that were opened before, `delete` takes the message away. What a message holds is the
    text of its last `open`, `edit` or `regenerate` and of all later deltas.

    Events without a seq come first. Those of equal seq are taken by event and text. Null texts are empty, a null
    turn comes before all others, a null conv_id is one conversation, and a message that was never opened has an empty
    role and was there from the start. Repeated events count each, other columns are not read, and an empty log gives
    an empty result.

    Messages are folded first. Of regenerations only their places in the sequence then travel along the conversation:
    inside pieces of 64 turn numbers, and from piece to piece, so no task holds a whole conversation's texts.
    """
    resets = F.col("event").isin("open", "edit", "regenerate", "delete")
    seq = F.struct(F.col("seq").isNotNull().alias("known"), "seq")
    opened = F.struct(seq.alias("seq"), F.coalesce("role", F.lit("")).alias("role"))
    held = F.struct(seq.alias("seq"), "event", F.coalesce("text", F.lit("")).alias("text"))
    by = events.groupBy(F.struct("conv_id").alias("chat"), "turn", "part").agg(
        F.max(F.when(resets, F.struct(seq.alias("seq"), "event"))).alias("last"),
        F.max(F.when(F.col("event") == "open", opened)).alias("opened"),
        F.max(F.when(F.col("event") == "regenerate", seq)).alias("again"),
        F.sort_array(F.collect_list(held)).alias("log"),
    )
    kept = F.filter("log", lambda e: F.col("last").isNull() | (e["seq"] > F.col("last.seq")) | ((e["seq"] == F.col("last.seq")) & (e["event"] >= F.col("last.event"))))
    order = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62)))
    messages = by.select(
        "chat", F.floor(order / PIECE).alias("piece"), order.alias("order"), "turn", "part", F.col("opened.seq").alias("opened"), "again",
        F.coalesce(F.col("last.event") == "delete", F.lit(False)).alias("gone"), F.coalesce("opened.role", F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )
    # The last regeneration in earlier turns of the piece, and in earlier pieces.
    inside = Window.partitionBy("chat", "piece").orderBy("order").rangeBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("chat").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    tops = messages.groupBy("chat", "piece").agg(F.max("again").alias("top")).select("chat", "piece", F.max("top").over(along).alias("before"))
    messages = messages.withColumn("upto", F.max("again").over(inside)).join(tops, ["chat", "piece"])
    last = F.greatest("upto", "before")  # nulls are skipped
    stays = ~F.col("gone") & (F.col("opened").isNull() | last.isNull() | (F.col("opened") > last))
    return messages.filter(F.coalesce(stays, F.lit(True))).select("chat", "piece", "turn", "part", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """Render messages (as from `fold_events`) as one formatted text a conversation.

    Returns conv_id, formatted and loss_spans: an array of (start, end) in code points of the formatted text, one
    for each assistant message, its text alone. Turns are sorted by turn (null first), then part. A conversation
    is put together from pieces of 64 turn numbers, so a long one spreads over many tasks before its one row is
    made; null roles and texts are empty.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(ROLE_END))
    body = escape(F.coalesce("text", F.lit("")))
    turn = messages.select("chat", "piece", "turn", "part", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    # Where texts begin: running sums inside pieces, and over pieces.
    size = F.length("head") + F.length("body") + len(CLOSE)
    inside = Window.partitionBy("chat", "piece").orderBy("turn", "part", "head", "body", "loss").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("start", (F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.length("head")).cast("int"))
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"))
    pieces = turn.groupBy("chat", "piece").agg(
        F.sort_array(F.collect_list(F.struct("turn", "part", "head", "body", "loss"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("spans"),
        F.sum(size).alias("size"),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    along = Window.partitionBy("chat").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("chat", "piece", formatted.alias("formatted"), "spans", F.coalesce(F.sum("size").over(along), F.lit(0)).cast("int").alias("before"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("before")).alias("start"), (s["end"] + F.col("before")).alias("end")))
    whole = pieces.select("chat", "piece", "formatted", moved.alias("spans")).groupBy("chat").agg(F.sort_array(F.collect_list(F.struct("piece", "formatted", "spans"))).alias("pieces"))
    return whole.select(
        F.col("chat.conv_id").alias("conv_id"),
        F.array_join(F.transform("pieces", lambda p: p["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: p["spans"])).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    parts = F.split(formatted, F.lit(CLOSE))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bare = F.transform(turns, lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.length(t)))
    end = F.lit(ROLE_END)

    def cut(t: Column) -> Column:
        at = F.instr(t, end)
        return F.struct(
            unescape(F.substring(t, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(t, at + len(ROLE_END), F.length(t))).alias("text"),
        )

    return F.transform(bare, cut)


def format_chats(events: DataFrame) -> DataFrame:
    """From an event log to formatted conversations: `fold_events`, then `render`. Empty logs give an empty result."""
    return render(fold_events(events))


def to_events(conversations: DataFrame) -> DataFrame:
    """A log that rebuilds `conversations` (conv_id, turn, role, text), with all kinds of events in it.

    Each row is opened and streamed by halves in the wrong order. Assistant rows are then regenerated and streamed
    again, after a reply to the first try was begun in the next turn, which that takes away. Other rows are put right
    by an edit, beside a message that is deleted. Rows of one turn are told apart by role and text; repeated rows are
    numbered, so each stays a message.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal rows are counted, not numbered in a window: the count tells how many messages they are.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    nothing = F.lit(None).cast("string")

    def event(k: int, name: str, text: Column = nothing, kind: int = 0) -> Column:
        """`kind`: 0 for the row's own message, 1 for one to be deleted beside it, 2 for one in the next turn."""
        return F.struct(F.lit(k).alias("k"), F.lit(name).alias("event"), text.alias("text"), F.lit(kind).alias("kind"))

    start = [event(0, "open"), event(1, "delta", second), event(2, "delta", first)]
    reply = [event(3, "open", kind=2), event(4, "delta", F.lit("what?"), 2)]
    other = F.array(*start, event(3, "open", kind=1), event(4, "delta", F.lit("never mind"), 1), event(5, "delete", kind=1), event(6, "edit", F.col("text")))
    assistant = F.array(*start, *reply, event(5, "regenerate"), event(6, "delta", first), event(7, "delta", second))
    # Without a turn there is no next one.
    log = F.explode(F.when(F.col("role") != "assistant", other).when(F.col("turn").isNull(), F.filter(assistant, lambda e: e["kind"] == 0)).otherwise(assistant))
    own = F.col("e.kind") == 0
    part = F.struct("role", F.when(own, F.col("text")).otherwise(F.lit("")).alias("text"), F.when(own, F.col("copy")).otherwise(-F.col("copy")).alias("copy"))
    turn = F.when(F.col("e.kind") == 2, F.col("turn") + 1).otherwise(F.col("turn"))
    return rows.select("conv_id", "turn", "role", "text", "copy", log.alias("e")).select(
        "conv_id", turn.alias("turn"), part.alias("part"), F.struct("turn", "e.k").alias("seq"), "e.event", "role", F.col("e.text").alias("text")
    )
