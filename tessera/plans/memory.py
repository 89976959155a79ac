"""Conversation memory end to end: chunk conversations, embed the chunks, and keep vectors and lifecycle records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.functions import text as X
from tessera.lexicon import CHINESE, Lexicon
from tessera.operators import conversations as conv
from tessera.operators import embedding, memory, recall
from tessera.storage import stored

#: Columns of a memory vector.
VECTOR_COLUMNS = (
    "memory_id", "chunk_index", "source_name", "text", "embedding", "user_id", "conversation_id", "session_id", "chunk_type", "topic",
    "turn_start", "turn_end", "created_at",
)


def memory_rows(
    chunks: DataFrame, owners: DataFrame, as_of: datetime, source_name: str = "conversation", chunk_type: str = "dialogue", topic: str = "", version: str | None = None
) -> DataFrame:
    """Chunks of conversations (conv_id, chunk_index, text, turn_start, turn_end, maybe topic) as rows to be stored.

    `owners` has conv_id, user_id and session_id, a row a conversation. Conversations without a user and blank chunks
    are left out. Each write has a version of its own in its memory ids, so that storing a conversation again leaves no
    two rows alike; a chunk without a topic takes the given one.
    """
    told = F.nullif(F.trim("topic"), F.lit("")) if "topic" in chunks.columns else F.lit(None).cast("string")
    known = owners.filter(F.coalesce(F.trim("user_id"), F.lit("")) != "").select("conv_id", F.trim("user_id").alias("user_id"), F.coalesce("session_id", F.lit("")).alias("session_id"))
    rows = chunks.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")).join(known, "conv_id")
    conversation, index = F.col("conv_id").cast("string"), F.col("chunk_index")
    return rows.select(
        F.concat_ws(":", "user_id", conversation, index.cast("string"), F.lit(version or uuid.uuid4().hex)).alias("memory_id"),
        index.cast("int").alias("chunk_index"), F.lit(source_name).alias("source_name"), "text", "user_id", conversation.alias("conversation_id"), "session_id",
        F.lit(chunk_type).alias("chunk_type"), F.coalesce(told, F.lit(topic.strip())).alias("topic"), "turn_start", "turn_end", F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def _store(rows: DataFrame, vectors: DataFrame | None, records: DataFrame, as_of: datetime, make: Callable[[], embedding.Embedder] | None, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    rows = stored(rows)
    embedded = embedding.with_vectors(rows, **({"make": make} if make else {}), text="text").select(*VECTOR_COLUMNS)
    return (embedded if vectors is None else vectors.select(*VECTOR_COLUMNS).unionByName(embedded)), memory.register_events(records, rows, as_of, lexicon)


def store_conversations(
    conversations: DataFrame, owners: DataFrame, records: DataFrame, as_of: datetime, vectors: DataFrame | None = None, include_system: bool = False,
    size: int = C.CHAT_SIZE, overlap: int = C.CHAT_OVERLAP, make: Callable[[], embedding.Embedder] | None = None, lexicon: Lexicon = CHINESE, **named: str,
) -> tuple[DataFrame, DataFrame]:
    """Chunk whole conversations, embed the chunks and register them: the tables of vectors and records after it.

    `conversations`: conv_id, turn, role, text; `named`: source_name, chunk_type, topic or version of `memory_rows`.
    """
    chunks = conv.memory_chunks(conversations, size, overlap, include_system)
    return _store(memory_rows(chunks, owners, as_of, **named), vectors, records, as_of, make, lexicon)


def store_topics(
    conversations: DataFrame, owners: DataFrame, records: DataFrame, as_of: datetime, changes_topic: Callable[[str, str], bool], summarise: Callable[[str], object],
    vectors: DataFrame | None = None, short_window: int = 5, limit: int = C.MEMORY_TOKENS, make: Callable[[], embedding.Embedder] | None = None, lexicon: Lexicon = CHINESE, **named: str,
) -> tuple[DataFrame, DataFrame]:
    """The same by topics, of the turns that are older than each conversation's last `short_window`."""
    chunks = conv.semantic_chunks(conversations, changes_topic, summarise, limit, short_window)
    return _store(memory_rows(chunks, owners, as_of, **{"chunk_type": "semantic"} | named), vectors, records, as_of, make, lexicon)


# Questions for the user's name, words that ask to remember, keys of names, and what is said with memories.
NAME_QUESTIONS = ("我叫什么", "我叫什么名字", "我的名字", "你记得我叫什么", "还记得我叫什么", "记得我叫", "我叫啥")
REMEMBER = (
    "记住", "记得", "帮我记", "请记", "以后", "下次", "我的名字", "我叫", "叫我", "我的偏好", "我喜欢", "我不喜欢", "我习惯", "忘记", "别记", "删除记忆", "清除记忆",
)
NAME_KEYS = ("profile.name", "profile.username", "profile.real_name")
NAME_ANSWER, NO_NAME = "当然记得，你叫{}。", "我目前没有查到你已保存的姓名，请再告诉我一次。"
PROFILE_HEAD = "以下是当前用户已确认的个性化记忆，仅在相关时参考："
MEMORY_HEAD = "以下是与当前问题相关的长期记忆，仅在相关时参考，不能把未确认信息当作事实："
#: Memories that a chat recalls, and profile facts that it is told.
RECALLED, FACTS = 3, 20


def _bare(query: str | None) -> str:
    return re.sub(r"\s+", "", (query or "").strip().lower())


def asks_for_name(query: str | None) -> bool:
    return any(q in _bare(query) for q in NAME_QUESTIONS)


def asks_to_remember(query: str | None) -> bool:
    """Whether profile facts are to be looked for in what was said."""
    return any(t in _bare(query) for t in REMEMBER)


@dataclass(frozen=True)
class Memories:
    """A user's memory as a chat sees it: records, vectors (see VECTOR_COLUMNS), the time, and how queries are embedded."""

    user_id: str
    records: DataFrame
    vectors: DataFrame
    as_of: datetime
    conversation_id: str | None = None
    session_id: str | None = None
    make: Callable[[], embedding.Embedder] | None = None

    def facts(self) -> list[tuple[str, str]]:
        """(key, content) of the user's live profile facts, the most important first."""
        rows = memory.active_profiles(self.records, self.user_id, self.as_of, FACTS).select("memory_key", "content").collect()
        return [(r["memory_key"] or "profile", r["content"] or "") for r in rows]

    def name_answer(self, query: str) -> str | None:
        """The answer to a question for the user's name; none to other questions."""
        if not asks_for_name(query):
            return None
        names = [content.strip() for key, content in self.facts() if key.lower() in NAME_KEYS and content.strip()]
        return NAME_ANSWER.format(names[0]) if names else NO_NAME

    def recall(self, query: str, k: int = RECALLED) -> DataFrame:
        """The k nearest memories of the user (and conversation or session, if given) whose records are live events.

        Rows: memory_id, content, live_rank. Vectors are filtered before they are compared; some more neighbours than k
        are taken, since records may have expired.
        """
        own = memory.memory_filter(self.vectors, self.user_id, self.conversation_id, self.session_id)
        asked = own.sparkSession.createDataFrame([("q", query)], "query_id string, content string")
        near = recall.dense_retrieve(own, embedding.with_vectors(asked, **({"make": self.make} if self.make else {})), 3 * k, "memory_id")
        return memory.live_hits(near, self.records, k, self.as_of).select("memory_id", "content", "live_rank")

    def messages(self, query: str, k: int = RECALLED) -> tuple[list[str], list[str]]:
        """Lines for a model: of profile facts, and of recalled memories in short; empty where there are none."""
        facts = [f"- {key}: {content}" for key, content in self.facts()]
        held = self.recall(query, k).select("live_rank", X.compact_memory(F.col("content")).alias("text")).orderBy("live_rank").collect()
        lines = [f"{n}. {r['text']}" for n, r in enumerate(held, 1)]
        return ([PROFILE_HEAD, *facts] if facts else []), ([MEMORY_HEAD, *lines] if lines else [])


def forget(vectors: DataFrame, records: DataFrame, user_id: str, conversation_id: str, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """Delete a conversation's vectors and mark its active events deleted; profile facts stay."""
    return memory.delete_vectors(vectors, user_id, conversation_id), memory.forget(records, user_id, conversation_id, as_of)


def forget_ids(vectors: DataFrame, records: DataFrame, user_id: str, memory_ids: Sequence[str], as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """The same by a list of memory ids of one user."""
    return memory.delete_vectors(vectors, user_id, memory_ids=memory_ids), memory.forget(records, user_id, None, as_of, memory_ids)
