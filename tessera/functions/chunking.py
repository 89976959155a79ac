"""Chunking of one text: recursive splitting, sections, tables and parent/child chunks. Plain Python, called from Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

# Separators, file kinds, sizes and heading patterns that chunks depend on.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
ARTICLE_SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "：", "，", ".", "!", "?", ";", ":", " ", "")
ARTICLE_TYPES = frozenset(("pdf", "doc", "docx", "md", "txt", "html", "htm", "rtf", "markdown"))
TABLE_TYPES = frozenset(("csv", "tsv", "xls", "xlsx"))
SIZE, OVERLAP = 600, 100
ARTICLE_SIZE, ARTICLE_OVERLAP = 280, 50
PARENT_SIZE, PARENT_OVERLAP = 500, 60
CHILD_SIZE, CHILD_OVERLAP = 150, 30
LEAST_BODY = 120
SHEET_LINE = re.compile(r"^\[Sheet\]\s*(.+?)\s*$", re.IGNORECASE)
SECTION_MARK = "[章节] "
_MARKDOWN = re.compile(r"^(#{1,6})\s+(\S.{0,80})$")
_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)(?:、|[.．])\s*\S.{0,70}$")
_TOP_LEVEL = (
    re.compile(r"^第[一二三四五六七八九十百千万0-9]+[章节条部分][、.．\s:：-]*\S.{0,70}$"),
    re.compile(r"^[一二三四五六七八九十]+[、.．]\s*\S.{0,70}$"),
)
_SECOND_LEVEL = re.compile(r"^[（(][一二三四五六七八九十0-9]+[）)]\s*\S.{0,70}$")


def pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, so that it stays at the start of the piece after it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def packed(parts: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Fill chunks up to `size` from small parts; each begins with as much of the one before as `overlap` allows."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            if joined := "".join(held).strip():
                yield joined
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if joined := "".join(held).strip():
        yield joined


def _recursive(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    small: list[str] = []
    for part in pieces(text, separators[at]):
        if len(part) < size:
            small.append(part)
            continue
        yield from packed(small, size, overlap)
        small = []
        if separators[at + 1 :]:
            yield from _recursive(part, size, overlap, separators[at + 1 :])
        else:
            yield part
    yield from packed(small, size, overlap)


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters where the separators allow it, stripped, blank ones dropped."""
    bare = (text or "").strip()
    return [c for c in map(str.strip, _recursive(bare, size, overlap, separators)) if c] if bare else []


def heading(line: str) -> tuple[int, str] | None:
    """The level and the text of a heading line."""
    text = re.sub(r"\s+", " ", line.strip())
    if not text or len(text) > 140 or any(c in text for c in "。；;"):
        return None
    if m := _MARKDOWN.match(text):
        return len(m[1]), m[2].strip()
    if m := _NUMBERED.match(text):
        return m[1].count(".") + 1, text
    if any(p.match(text) for p in _TOP_LEVEL):
        return 1, text
    return (2, text) if _SECOND_LEVEL.match(text) else None


def sections(text: str | None) -> list[tuple[str, str]]:
    """(path of headings, body) in order; empty where no line is a heading."""
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []
    seen = False

    def close(last: bool = False) -> None:
        joined = "\n".join(body).strip()
        if joined or (last and path):
            out.append((" / ".join(title for _, title in path), joined))
        body.clear()

    for line in map(str.strip, (text or "").splitlines()):
        if not line:
            if body and body[-1]:
                body.append("")
        elif found := heading(line):
            close()
            level, title = found
            path = [p for p in path if p[0] < level] + [(level, re.sub(r"^#{1,6}\s*", "", title).strip())]
            seen = True
        else:
            body.append(line)
    close(last=True)
    return out if seen else []


def split_sections(text: str | None, size: int, overlap: int, separators: Sequence[str]) -> list[str] | None:
    """Chunks within sections, each with its path; sections of a title alone are dropped. None without headings."""
    found = sections(text)
    if not found:
        return None
    out: list[str] = []
    for path, body in found:
        if not path.strip():
            out += split_text(body, size, overlap, separators)
        elif body:
            prefix = SECTION_MARK + path.strip()
            room = max(LEAST_BODY, size - len(prefix) - 1)
            out += [f"{prefix}\n{c}".strip() for c in split_text(body, room, min(overlap, room // 3), separators)]
    return out


def sheets(text: str | None) -> list[tuple[str, list[str]]]:
    """(sheet name, lines) in order; lines before the first marker have an empty name."""
    out: list[tuple[str, list[str]]] = []
    name, held = "", []
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        if m := SHEET_LINE.match(line):
            if name or held:
                out.append((name, held))
            name, held = m[1].strip(), []
        else:
            held.append(line)
    if name or held:
        out.append((name, held))
    return out


def _table_head(name: str, header: str) -> list[str]:
    return [x for x in (f"[Sheet] {name}" if name else "", header) if x]


def split_table(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Whole rows packed by sheet, marker and header repeated; without a marker, split as plain text."""
    found = sheets(text)
    if not any(name for name, _ in found):
        return split_text(text, size, overlap)
    out: list[str] = []
    for name, (header, *rows) in ((n, ls) for n, ls in found if ls):
        head = _table_head(name, header)
        room = max(LEAST_BODY, size - len("\n".join(head)) - 1)
        held: list[str] = []
        for row in rows:
            if held and len("\n".join([*held, row])) > room:
                out.append("\n".join(head + held))
                held = []
            held.append(row)
        if held or not rows:
            out.append("\n".join(head + held))
    return [c for c in map(str.strip, out) if c]


def split_rows(text: str | None, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> list[str]:
    """A chunk a data row, with marker and header; rows that begin with a bracket are left out."""
    found = sheets(text)
    if not any(name for name, _ in found):
        return split_text(text, size, overlap)
    return ["\n".join([*_table_head(name, ls[0]), row]) for name, ls in found for row in ls[1:] if not row.startswith("[")]


def file_kind(file_type: str | None) -> str:
    return (file_type or "").strip().lower().lstrip(".")


def split_document(text: str | None, size: int = SIZE, overlap: int = OVERLAP, file_type: str | None = None) -> list[str]:
    """Chunks by the kind of file: articles by section or sentence, tables by row, others as plain text."""
    kind = file_kind(file_type)
    if kind in ARTICLE_TYPES:
        size = ARTICLE_SIZE if size == SIZE else size
        overlap = ARTICLE_OVERLAP if overlap == OVERLAP else overlap
        found = split_sections(text, size, overlap, ARTICLE_SEPARATORS)
        return split_text(text, size, overlap, ARTICLE_SEPARATORS) if found is None else found
    if kind in TABLE_TYPES and (found := split_table(text, size, overlap)):
        return found
    return split_text(text, size, overlap)


def parent_children(
    text: str | None,
    file_type: str | None = None,
    parent: tuple[int, int] = (PARENT_SIZE, PARENT_OVERLAP),
    child: tuple[int, int] = (CHILD_SIZE, CHILD_OVERLAP),
) -> list[tuple[str, list[str]]]:
    """Each parent chunk with its children; a parent without any is its own child."""
    overlap = min(child[1], child[0] // 3)
    split = split_rows if file_kind(file_type) in TABLE_TYPES else lambda t, s, o: split_document(t, s, o, file_type)
    return [(p, split(p, child[0], overlap) or [p]) for p in split_document(text, *parent, file_type)]


# Conversations

# Labels of roles and marks of a memory text.
ROLE_LABELS = {"system": "系统", "user": "用户", "assistant": "助手"}
CHAT_SIZE, CHAT_OVERLAP, MEMORY_TOKENS = 500, 80, 700
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")


def estimated_tokens(text: str) -> int:
    return max(1, len(_TOKEN.findall(text))) if text.strip() else 0


def labelled(role: str, text: str) -> str:
    return f"{ROLE_LABELS[role]}: {text}"


def message_blocks(role: str, text: str, size: int = CHAT_SIZE, overlap: int = CHAT_OVERLAP) -> list[str]:
    """A message as labelled blocks of at most `size` characters."""
    if len(labelled(role, text)) <= size:
        return [labelled(role, text)]
    taken = len(ROLE_LABELS[role]) + 2
    return [labelled(role, p) for p in split_text(text, max(size - taken, 1), max(overlap - taken, 0))]


class ChatPacker:
    """Packs the blocks of one conversation's messages into chunks, given one message after the other."""

    def __init__(self, size: int = CHAT_SIZE, overlap: int = CHAT_OVERLAP):
        self.size, self.overlap, self.held, self.at = size, overlap, [], 0

    def _fits(self, block: str) -> bool:
        return len("\n\n".join([*(b for _, b in self.held), block])) <= self.size

    def _chunk(self, blocks: list[tuple[int, str]]) -> tuple[str, int, int, int]:
        at = [i for i, _ in blocks]
        return "\n\n".join(b for _, b in blocks), min(at), max(at), len(set(at))

    def _tail(self) -> list[tuple[int, str]]:
        """The last blocks that `overlap` has room for, one at least."""
        keep, length = 0, 0
        for _, block in reversed(self.held):
            length += len(block) + (2 if keep else 0)
            if keep and length > self.overlap:
                break
            keep += 1
            if length >= self.overlap:
                break
        return self.held[-keep:] if self.overlap > 0 else []

    def add(self, role: str, text: str) -> Iterator[tuple[str, int, int, int]]:
        """Chunks (text, first message, last message, messages) that this message completes."""
        for block in message_blocks(role, text, self.size, self.overlap):
            if self.held and not self._fits(block):
                yield self._chunk(self.held)
                self.held = self._tail()
                if self.held and not self._fits(block):
                    self.held = []
            if not self.held and len(block) > self.size:
                yield self._chunk([(self.at, block)])
            else:
                self.held.append((self.at, block))
        self.at += 1

    def close(self) -> Iterator[tuple[str, int, int, int]]:
        if self.held:
            yield self._chunk(self.held)


def memory_text(summary: str, transcript: str, topic: str = "") -> str:
    head = [f"【主题】{topic.strip()}"] if topic.strip() else []
    return "\n".join([*head, f"【摘要】{summary.strip()}", "【原文】", transcript.strip()]).strip()


def summary_of(told: object) -> tuple[str, str]:
    """(topic, summary) out of what a summariser gave: a mapping, a tuple or a text."""
    if isinstance(told, dict):
        found = told.get("topic"), told.get("summary")
    elif isinstance(told, tuple) and told:
        found = (told[0], told[1]) if len(told) > 1 else ("", told[0])
    else:
        found = "", told
    return str(found[0] or "").strip(), str(found[1] or "").strip()


class TopicPacker:
    """Buffers the turns of one conversation until the topic changes or a token limit is reached."""

    def __init__(self, changes_topic, summarise, limit: int = MEMORY_TOKENS):
        self.changes, self.summarise, self.limit, self.held, self.start, self.at = changes_topic, summarise, limit, [], 0, 0

    def _memory(self, turns: list[str], start: int, reason: str) -> dict:
        transcript = "\n\n".join(turns)
        topic, summary = summary_of(self.summarise(transcript))
        summary = summary or transcript[:120].strip()
        topic = topic or summary
        return {
            "topic": topic, "summary": summary, "transcript": transcript, "text": memory_text(summary, transcript, topic),
            "turn_start": start, "turn_end": start + len(turns) - 1, "message_count": len(turns), "trigger_reason": reason,
        }

    def add(self, turn: str) -> Iterator[dict]:
        """Memories that this turn (its rendered text) completes."""
        at = self.at
        self.at += 1
        if not turn.strip():
            return
        reason = "token_limit"
        if self.held:
            current = "\n\n".join(self.held)
            if self.changes(current, turn):
                reason = "topic_change"
            elif estimated_tokens(f"{current}\n\n{turn}") <= self.limit:
                self.held.append(turn)
                return
            yield self._memory(self.held, self.start, reason)
            self.held = []
        if estimated_tokens(turn) > self.limit:
            yield self._memory([turn], at, reason)
        else:
            self.held, self.start = [turn], at

    def close(self) -> Iterator[dict]:
        if self.held:
            yield self._memory(self.held, self.start, "flush")
