"""Conversations: turns, windows over them, summaries, transcripts and memory chunks.

`conversations` everywhere: conv_id, turn (position), role, text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import chunking as C

ROLES = ("system", "user", "assistant")


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def clean_messages(conversations: DataFrame, include_system: bool = False) -> DataFrame:
    """Known roles in lower case and stripped texts; blank messages, other roles and (by default) system ones go."""
    roles = ROLES if include_system else ROLES[1:]
    cleaned = conversations.select("conv_id", "turn", F.lower(F.trim("role")).alias("role"), _strip(F.col("text")).alias("text"))
    return cleaned.filter(F.col("role").isin(*roles) & (F.col("text") != ""))


def segment_turns(conversations: DataFrame, include_system: bool = False) -> DataFrame:
    """Number the turns (turn_no from 0): each user message begins one, what precedes the first is one as well."""
    messages = clean_messages(conversations, include_system)
    by = Window.partitionBy("conv_id").orderBy("turn")
    begins = ((F.col("role") == "user") | (F.row_number().over(by) == 1)).cast("int")
    messages = messages.withColumn("_b", begins)
    return messages.withColumn("turn_no", (F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_b")


def last_turns(conversations: DataFrame, n: int) -> DataFrame:
    """All system messages, and the messages of each conversation's last `n` turns."""
    turns = segment_turns(conversations)
    last = turns.groupBy("conv_id").agg(F.max("turn_no").alias("last"))
    kept = turns.join(last, "conv_id").filter(F.col("turn_no") > F.col("last") - n).select("conv_id", "turn", "role", "text")
    system = clean_messages(conversations, include_system=True).filter("role = 'system'")
    return kept.unionByName(system)


def older_batches(conversations: DataFrame, n: int, m: int) -> DataFrame:
    """Turns before the last `n`, in batches of max(m - n, 1): the batches a summary is folded over. m must exceed n."""
    if m <= n:
        raise ValueError("m must be greater than n")
    turns = segment_turns(conversations)
    last = turns.groupBy("conv_id").agg(F.max("turn_no").alias("last"))
    old = turns.join(last, "conv_id").filter(F.col("turn_no") <= F.col("last") - n).drop("last")
    return old.withColumn("batch", F.floor(F.col("turn_no") / (m - n)))


def fold_summaries(conversations: DataFrame, n: int, m: int, summarise: Callable[[str, str], str]) -> DataFrame:
    """Fold older batches through `summarise(previous summary, batch text)`: conv_id, summary, n_batches."""
    old = older_batches(conversations, n, m)

    def start():
        state = {"summary": "", "batch": None, "held": [], "n": 0}

        def close():
            if state["held"]:
                state["summary"] = summarise(state["summary"], "\n".join(state["held"]))
                state["n"] += 1
            state["held"] = []

        def add(row):
            if row["batch"] != state["batch"]:
                close()
                state["batch"] = row["batch"]
            state["held"].append(C.labelled(row["role"], row["text"]))
            return ()

        def end():
            close()
            yield {"summary": state["summary"], "n_batches": state["n"]}

        return add, end

    return _in_order(old, start, "summary string, n_batches long", ["batch"])


def history(conversations: DataFrame, drop_last: int = 0) -> DataFrame:
    """Messages to send again: the last `drop_last` are cut, then user and assistant messages that aren't blank stay."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = conversations.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") > drop_last)
    return clean_messages(kept.drop("_n"))


def overview(conversations: DataFrame, title: int = 34, preview: int = 46) -> DataFrame:
    """Per conversation: user messages, a title (the first of them), a preview (the last message), the last turn."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    clean = conversations.select("conv_id", "turn", "role", F.regexp_replace(_strip(F.col("text")), r"(?U)\s+", " ").alias("text"))
    held = clean.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), first.alias("f"), F.max_by("text", "turn").alias("l"), F.max("turn").alias("last_turn"))
    return held.select("conv_id", "n_user", cut(F.coalesce("f", F.lit("")), title).alias("title"), cut(F.coalesce("l", F.lit("")), preview).alias("preview"), "last_turn")


def recent_questions(conversations: DataFrame, n: int = 4) -> DataFrame:
    """Each conversation's last `n` user messages in order: conv_id, questions."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    asked = clean_messages(conversations).filter("role = 'user'").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    held = asked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("q"))
    return held.select("conv_id", F.transform("q", lambda q: q["text"]).alias("questions"))


def highlights(text: Column, most: int = 2, width: int = 90) -> Column:
    """The first list items of a text, else its first sentences, cut with an ellipsis."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    items = F.transform(F.filter(lines, lambda x: x.rlike(r"^(?:[-*+]|\d+[.、)])\s+")), lambda x: F.regexp_replace(x, r"^(?:[-*+]|\d+[.、)])\s+", ""))
    sentences = F.filter(F.transform(F.split(text, r"[。！？!?\n]+|\.\s"), lambda x: F.trim(x)), lambda x: x != "")
    cut = lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("…"))).otherwise(x)
    return F.transform(F.slice(F.when(F.size(items) > 0, items).otherwise(sentences), 1, most), cut)


def summaries(conversations: DataFrame, n: int = 4) -> DataFrame:
    """Per conversation: its number of turns, its last `n` questions, and two highlights of each of its last `n` answers, six in all."""
    newest = Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"))
    last = clean_messages(conversations).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    held = last.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("q"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", highlights(F.col("text")).alias("h"))))).alias("a"),
    )
    counts = segment_turns(conversations).groupBy("conv_id").agg((F.max("turn_no") + 1).alias("n_turns"))
    return held.join(counts, "conv_id").select("conv_id", "n_turns", F.transform("q", lambda q: q["text"]).alias("questions"), F.slice(F.flatten(F.transform("a", lambda a: a["h"])), 1, 6).alias("highlights"))


def label(role: Column) -> Column:
    return F.create_map(*(F.lit(v) for r, name in C.ROLE_LABELS.items() for v in (r, name)))[role]


def transcripts(conversations: DataFrame) -> DataFrame:
    """Rendered conversations: messages of a turn on lines, turns parted by a blank line: conv_id, n_turns, transcript."""
    turns = segment_turns(conversations).withColumn("line", F.concat(label(F.col("role")), F.lit(": "), F.col("text")))
    one = turns.groupBy("conv_id", "turn_no").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("m"))
    one = one.select("conv_id", "turn_no", F.array_join(F.transform("m", lambda m: m["line"]), "\n").alias("t"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_no", "t"))).alias("t"))
    return whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["t"]), "\n\n").alias("transcript"))


def _in_order(messages: DataFrame, start: Callable, schema: str, more: list[str]) -> DataFrame:
    """Run a sequential algorithm over each conversation's messages in order.

    Conversations are dealt out by key and sorted; the rows then pass through one by one, so a task holds one
    algorithm's state and not a conversation. `start()` gives (add, end), both yielding result rows.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    fields = [f.split()[0] for f in schema.split(", ")]
    target = messages.sparkSession.createDataFrame([], f"conv_id {kind}, chunk_index long, {schema}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, add, end, out = object(), 0, None, None, []

        def put(rows):
            nonlocal n
            for r in rows:
                out.append({"conv_id": current, "chunk_index": n} | {f: r[f] for f in fields})
                n += 1

        def pack():
            held = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return held

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    if end:
                        put(end())
                    current, n = row["conv_id"], 0
                    add, end = start()
                put(add(row))
            if out:
                yield pack()
        if end:
            put(end())
        if out:
            yield pack()

    ordered = messages.select("conv_id", "turn", "role", "text", *more).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInArrow(run, target)


def memory_chunks(conversations: DataFrame, size: int = C.CHAT_SIZE, overlap: int = C.CHAT_OVERLAP, include_system: bool = False) -> DataFrame:
    """Greedy chunks of labelled messages: conv_id, chunk_index, text, turn_start, turn_end, message_count.

    turn_start and turn_end are positions of messages among those that count.
    """
    names = ("text", "turn_start", "turn_end", "message_count")

    def start():
        packer = C.ChatPacker(size, overlap)
        row = lambda c: dict(zip(names, c, strict=True))
        return lambda r: map(row, packer.add(r["role"], r["text"])), lambda: map(row, packer.close())

    return _in_order(clean_messages(conversations, include_system), start, "text string, turn_start long, turn_end long, message_count long", [])


def semantic_chunks(
    conversations: DataFrame, changes_topic: Callable[[str, str], bool], summarise: Callable[[str], object], limit: int = C.MEMORY_TOKENS, skip_last: int = 0
) -> DataFrame:
    """Memories by topic: turns are buffered until `changes_topic(held, next)` or more than `limit` estimated tokens.

    With `skip_last` only turns older than each conversation's last such number count.
    """
    turns = segment_turns(conversations)
    if skip_last:
        last = turns.groupBy("conv_id").agg(F.max("turn_no").alias("last"))
        turns = turns.join(last, "conv_id").filter(F.col("turn_no") <= F.col("last") - skip_last).drop("last")

    def start():
        packer = C.TopicPacker(changes_topic, summarise, limit)
        state: dict = {"no": None, "held": []}

        def close():
            if state["held"]:
                yield from packer.add("\n".join(state["held"]))
            state["held"] = []

        def add(r):
            if r["turn_no"] != state["no"]:
                yield from close()
                state["no"] = r["turn_no"]
            state["held"].append(C.labelled(r["role"], r["text"]))

        def end():
            yield from close()
            yield from packer.close()

        return add, end

    schema = "topic string, summary string, transcript string, text string, turn_start long, turn_end long, message_count long, trigger_reason string"
    return _in_order(turns, start, schema, ["turn_no"])
