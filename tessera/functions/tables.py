"""Table functions for SQL: conversations packed into memories, one partition's messages after the other.

    register(spark)
    SELECT * FROM memory_chunks(TABLE(conversations) PARTITION BY conv_id ORDER BY turn, size => 500, overlap => 80)

The table argument has conv_id, turn, role and text, and may have more; conv_id keeps its type. A partition's rows pass
through one by one, so a task holds one packer's state and not a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.functions import chunking as C

NEEDED = ("conv_id", "turn", "role", "text")
#: White space as in the Unicode property, which the DataFrame operators strip.
SPACE = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_CHUNK = (("text", StringType()), ("turn_start", LongType()), ("turn_end", LongType()), ("message_count", LongType()))
_MEMORY = (("topic", StringType()), ("summary", StringType()), ("transcript", StringType()), *_CHUNK, ("trigger_reason", StringType()))


def _schema(table: AnalyzeArgument, fields) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...) PARTITION BY conv_id ORDER BY turn")
    have = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in NEEDED if c not in have]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return AnalyzeResult(StructType([StructField("conv_id", have["conv_id"]), StructField("chunk_index", LongType()), *(StructField(n, k) for n, k in fields)]))


def _cleaned(row, system: bool = False) -> tuple[str, str] | None:
    """Role and text of a message that counts."""
    role, text = (row["role"] or "").strip(" ").lower(), (row["text"] or "").strip(SPACE)
    return (role, text) if text and role in (("system", "user", "assistant") if system else ("user", "assistant")) else None


class MemoryChunks:
    """Greedy chunks of labelled messages; see operators.conversations.memory_chunks."""

    def __init__(self) -> None:
        self.packer, self.key, self.n = None, None, 0

    @staticmethod
    def analyze(messages: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, include_system: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, value in (("size", size), ("overlap", overlap)):
            if value is not None and (not value.isConstantExpression or value.value is None or value.value < 0):
                raise ValueError(f"{name} is a constant of 0 or more")
        return _schema(messages, _CHUNK)

    def _rows(self, chunks) -> Iterator[tuple]:
        for c in chunks:
            yield self.key, self.n, *c
            self.n += 1

    def eval(self, messages, size: int = C.CHAT_SIZE, overlap: int = C.CHAT_OVERLAP, include_system: bool = False) -> Iterator[tuple]:
        if self.packer is None:
            self.packer, self.key = C.ChatPacker(size, overlap), messages["conv_id"]
        told = _cleaned(messages, include_system)
        if told:
            yield from self._rows(self.packer.add(*told))

    def terminate(self) -> Iterator[tuple]:
        if self.packer is not None:
            yield from self._rows(self.packer.close())


def semantic_chunks(changes_topic: Callable[[str, str], bool], summarise: Callable[[str], object]) -> type:
    """The table function `semantic_chunks` with a model's two judgements; see operators.conversations.semantic_chunks."""

    class SemanticChunks:
        def __init__(self) -> None:
            self.packer, self.key, self.n, self.turn = None, None, 0, []

        @staticmethod
        def analyze(messages: AnalyzeArgument, token_limit: AnalyzeArgument | None = None) -> AnalyzeResult:
            return _schema(messages, _MEMORY)

        def _rows(self, memories) -> Iterator[tuple]:
            for m in memories:
                yield self.key, self.n, *(m[n] for n, _ in _MEMORY)
                self.n += 1

        def _close(self) -> Iterator[tuple]:
            if self.turn:
                yield from self._rows(self.packer.add("\n".join(self.turn)))
            self.turn = []

        def eval(self, messages, token_limit: int = C.MEMORY_TOKENS) -> Iterator[tuple]:
            if self.packer is None:
                self.packer, self.key = C.TopicPacker(changes_topic, summarise, token_limit), messages["conv_id"]
            told = _cleaned(messages)
            if told:
                if told[0] == "user":
                    yield from self._close()
                self.turn.append(C.labelled(*told))

        def terminate(self) -> Iterator[tuple]:
            if self.packer is not None:
                yield from self._close()
                yield from self._rows(self.packer.close())

    return SemanticChunks


def register(spark: SparkSession, changes_topic: Callable[[str, str], bool] | None = None, summarise: Callable[[str], object] | None = None) -> None:
    """Register `memory_chunks` and, where a model's judgements are given, `semantic_chunks` for the session's SQL."""
    spark.udtf.register("memory_chunks", udtf(MemoryChunks))
    if changes_topic is not None and summarise is not None:
        spark.udtf.register("semantic_chunks", udtf(semantic_chunks(changes_topic, summarise)))
