"""Driver-side understanding of one query string: identifiers, terms, keywords, focus, variants and routing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

from tessera.lexicon import CHINESE, Lexicon

# The patterns and limits of query understanding.
IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Za-z]{1,12}[-_ ]?\d{2,}[A-Za-z0-9_-]*|\d{4,}[A-Za-z0-9_-]*)(?![A-Za-z0-9])"
)
PUNCTUATION = re.compile(r"[\s\-_.,;:!?，。！？；：、“”‘’\"'`~…·/\\|()[\]{}<>《》]+")
WORD_OR_RUN = re.compile(r"[A-Za-z0-9]+|[一-鿿]{2,}")
CJK_RUN = re.compile(r"[一-鿿]+")
MOST_VARIANTS, ORIGINAL_WEIGHT, VARIANT_WEIGHT = 4, 1.4, 0.75


def normalize(text: str | None) -> str:
    return PUNCTUATION.sub("", (text or "").strip().lower())


def _distinct(values: Iterable[str], limit: int | None = None) -> list[str]:
    """First occurrences in order, at most `limit`."""
    return list(dict.fromkeys(values))[:limit]


def grams(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def identifiers(query: str | None) -> list[str]:
    """Identifiers with and without separators, as written and in either case."""
    return _distinct(
        form
        for found in IDENTIFIER.findall((query or "").strip())
        for base in (re.sub(r"\s+", "", found), re.sub(r"[\s_-]+", "", found))
        for form in (base, base.upper(), base.lower())
        if form
    )


def canonical_identifiers(query: str | None) -> list[str]:
    """One form of each identifier."""
    by_key: dict[str, str] = {}
    for form in identifiers(query):
        by_key.setdefault(re.sub(r"[\s_-]+", "", form).lower(), form)
    return list(by_key.values())


def is_identifier_query(query: str | None, lexicon: Lexicon = CHINESE) -> bool:
    text = (query or "").strip().lower()
    if not text:
        return False
    hinted = any(h in text for h in lexicon.identifier_hints)
    return hinted or bool(identifiers(query)) or re.search(r"(?<![A-Za-z0-9])id(?![A-Za-z0-9])", text) is not None


def query_terms(query: str | None, limit: int = 16) -> list[str]:
    """Identifiers, words and CJK runs with their grams, the longest first."""
    text = (query or "").strip().lower()
    found = identifiers(query) if text else []
    for part in WORD_OR_RUN.findall(text):
        found.append(part)
        if CJK_RUN.fullmatch(part):
            if len(part) >= 4:
                found += grams(part, 2)
            if len(part) >= 6:
                found += grams(part, 3)
    return _distinct((t.strip() for t in sorted(found, key=len, reverse=True) if t.strip()), limit)


def bare_query(query: str | None, lexicon: Lexicon = CHINESE) -> str:
    """The normalised query without question words, stop words and what only tells the kind of answer."""
    text = normalize(query)
    for old, new in lexicon.replacements:
        text = text.replace(old, new)
    if lexicon.final_questions:
        text = re.sub(lexicon.final_questions, "", text)
    for terms in (lexicon.stop_terms, lexicon.intent_terms):
        for term in sorted(terms, key=len, reverse=True):
            text = text.replace(term, "")
    for old, new in lexicon.replacements[-1:]:
        text = text.replace(old, new)
    return text.strip(lexicon.edge_characters) if lexicon.edge_characters else text


def keywords(query: str | None, limit: int = 24, lexicon: Lexicon = CHINESE) -> list[str]:
    """Domain terms, the whole query if short, its grams without filler characters, and the query's terms."""
    text, filler = bare_query(query, lexicon), set(lexicon.filler_characters)

    def candidates() -> Iterator[str]:
        yield from (t for t in lexicon.domain_terms if t in text)
        if 2 <= len(text) <= 16:
            yield text
        for n in (4, 3, 2):
            yield from (g for g in grams(text, n) if not filler & set(g))
        for term in map(normalize, query_terms(text, limit * 4)):
            mixed = CJK_RUN.fullmatch(term) and (set(term) <= filler or len(term) >= 3 and filler & set(term))
            if not mixed and term not in lexicon.stop_terms:
                yield term

    return _distinct((t for t in map(normalize, candidates()) if len(t) >= 2), limit)


def word_keywords(query: str | None, limit: int = 24, lexicon: Lexicon | None = None) -> list[str]:
    """For languages that part their words: the distinct words of two letters or more, without stop words."""
    stop = set(lexicon.stop_terms) if lexicon else set()
    return _distinct((w for w in re.findall(r"[a-z0-9]+", (query or "").lower()) if len(w) >= 2 and w not in stop), limit)


def focus_terms(query: str | None, limit: int = 8, lexicon: Lexicon = CHINESE) -> list[str]:
    """Phrases of adjoining domain terms, then specific domain terms, else keywords that aren't generic."""
    text, generic = bare_query(query, lexicon), set(lexicon.generic_terms)
    at = sorted(((text.find(t), -len(t), t) for t in lexicon.domain_terms if t in text))
    phrases = []
    for i, (start, _, _) in enumerate(at):
        end = start
        for begin, _, term in at[i:]:
            if begin > end + 1:
                break
            end = max(end, begin + len(term))
        if end - start >= 4:
            phrases.append(text[start:end])
    specific = []
    for term in lexicon.domain_terms:
        if term in text and term not in generic:
            specific += [term] + ([term[2:]] if term in ("城市交通", "市内出行") else [])
    found = _distinct((t for t in map(normalize, phrases + specific) if len(t) >= 2), limit)
    if found:
        return found
    rest = (t for t in keywords(query, 32, lexicon) if t not in generic and (len(t) == 2 or t in lexicon.domain_terms or t == text))
    return _distinct(rest, limit)


def recall_terms(query: str | None, limit: int = 12, lexicon: Lexicon = CHINESE) -> list[str]:
    """Terms that a candidate must contain one of: identifiers, then what is left without question words, with 3-grams."""
    text = (query or "").strip().lower()
    if lexicon.recall_noise:
        text = re.sub(lexicon.recall_noise, " ", text)
    small = set(lexicon.recall_characters)
    text = "".join(" " if c in small else c for c in text)
    found = identifiers(query)
    for part in WORD_OR_RUN.findall(text):
        found.append(part)
        if len(part) >= 4 and CJK_RUN.fullmatch(part):
            found += [g for g in grams(part, 3) if not small & set(g)]
    found = [t.strip() for t in found if t.strip()]
    return _distinct((t for t in found if len(t) >= 2), limit) or _distinct(found, limit)


def candidate_limit(k: int) -> int:
    return max(8 * k, k + 20, 60)


def scan_limit(k: int) -> int:
    return max(30 * k, 80)


def is_structured_lookup(query: str | None, lexicon: Lexicon = CHINESE) -> bool:
    """Whether a query asks for a field of a table: an identifier, or a field's name in at most 32 characters."""
    text = re.sub(r"\s+", "", query or "")
    return bool(text) and (is_identifier_query(text, lexicon) or len(text) <= 32 and any(h in text for h in lexicon.field_hints))


def is_structured_summary(query: str | None, lexicon: Lexicon = CHINESE) -> bool:
    text = re.sub(r"\s+", "", query or "")
    return is_structured_lookup(text, lexicon) and any(t in text for t in lexicon.summary_terms)


# Subjects of tables, the words that show them, and the names that tables of them go by.
SUBJECTS = {
    "salary": ("工资", "薪资", "薪酬", "月薪", "应发", "实发", "奖金", "扣款"),
    "employee": ("员工", "人员", "人事", "花名册", "名册"),
    "department": ("部门", "组织", "通讯录", "架构"),
    "role": ("负责人", "主管", "上级"),
    "count": ("统计", "总数", "总人数", "数量", "多少", "共有", "一共"),
    "list": ("名单", "列表", "清单", "明细", "分别", "有哪些", "有谁", "是谁"),
}
ALIASES: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (("salary",), ("工资明细", "薪资明细", "实发工资", "应发工资", "员工工资")),
    (("employee",), ("员工名单", "员工花名册", "员工明细")),
    (("employee", "count"), ("员工人数", "员工总数", "员工统计")),
    (("department",), ("部门通讯录", "部门负责人", "部门名单", "部门数量", "部门统计")),
    (("role",), ("负责人名单", "各部门负责人")),
    (("count", "employee"), ("在职员工人数",)),
    (("count", "department"), ("部门数量统计",)),
    (("list", "employee"), ("员工明细",)),
    (("list", "department"), ("部门清单",)),
)


def aliases(query: str | None) -> list[str]:
    """Other names of the table that a query is about."""
    text = re.sub(r"\s+", "", query or "")
    shown = {s for s, words in SUBJECTS.items() if any(w in text for w in words)}
    return [a for a in _distinct(a for needs, names in ALIASES if shown.issuperset(needs) for a in names) if a != text]


def clean_variants(candidates: Iterable[str], query: str | None, limit: int = MOST_VARIANTS) -> list[str]:
    """Distinct variants without leading numbers; the query itself comes first where it is missing."""
    base = re.sub(r"\s+", " ", (query or "").strip())
    by_key: dict[str, str] = {}
    for c in candidates:
        text = re.sub(r"^[\s\d.\-、:：]+", "", re.sub(r"\s+", " ", str(c or "")).strip()).strip()
        if text and len(by_key) < max(1, limit):
            by_key.setdefault(text.lower(), text)
    found = list(by_key.values())
    return ([base] if base and base.lower() not in by_key else []) + found if len(found) < limit or base.lower() in by_key else [base, *found][:limit]


# What variants leave out.
_LEAD = re.compile(
    r"^(请问|麻烦|帮我|帮忙|查询|检索|搜索|查一下|查找|根据|基于|结合)(一下|一下子|知识库|文档|资料|上传文档|企业知识库|公司资料)?[：:\s，,]*"
)
_CORPUS = re.compile(r"(根据|基于|结合)?(知识库|企业知识库|文档|资料|上传文档|公司资料)(里面|中|里)?")
_QUESTION = re.compile(r"(是什么|有哪些|如何|怎么|为什么|是否|能否|可以吗|吗|呢|请说明|请解释|介绍一下|说明一下)")
_EDGE = " ：:，,。？?"


def heuristic_variants(query: str | None, limit: int = MOST_VARIANTS, lexicon: Lexicon = CHINESE) -> list[str]:
    """The query, without its polite opening, without its question, table aliases, and its bare terms."""
    base = re.sub(r"\s+", " ", (query or "").strip())
    if not base:
        return []
    cleaned = base
    for _ in range(2):
        cleaned = _LEAD.sub("", cleaned).strip()
    cleaned = _CORPUS.sub("", cleaned).strip(_EDGE)
    focus = _QUESTION.sub("", cleaned or base).strip(_EDGE)
    bare = re.sub(lexicon.recall_noise, " ", focus or cleaned or base) if lexicon.recall_noise else focus or base
    small = set(lexicon.recall_characters)
    terms = _distinct(WORD_OR_RUN.findall("".join(" " if c in small else c for c in bare)), 8)
    return clean_variants([base, cleaned, focus, *aliases(base), " ".join(terms)], base, limit)


def variants(query: str | None, llm: Callable[[str], str] | None = None, limit: int = MOST_VARIANTS) -> list[str]:
    """Query variants to retrieve with. Identifiers get a query each; a model is asked only if heuristics give one."""
    base = re.sub(r"\s+", " ", (query or "").strip())
    if is_identifier_query(base):
        own = [base, *canonical_identifiers(base)]
        return clean_variants(own, base, max(limit, len(own)))
    found = heuristic_variants(base, limit)
    if llm is None or len(found) >= 2 or not base:
        return found
    given = load_json(llm(base)).get("queries", [])
    told = clean_variants(given if isinstance(given, list) else [], base, limit)
    return told if len(told) >= 3 else found


def load_json(text: str | None) -> dict:
    """A JSON object out of an answer, fences and prose around it allowed; empty where there is none."""
    held = text or ""
    a, b = held.find("{"), held.rfind("}")
    try:
        found = json.loads(held[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


@dataclass(frozen=True)
class Intent:
    """Whether a query needs retrieval, and why."""

    retrieve: bool
    reason: str
    source: str = "rule"
    confidence: float = 1.0
    rewritten: str = ""


def rule_intent(query: str | None, use_retrieval: bool = True, lexicon: Lexicon = CHINESE) -> Intent:
    """Route by words alone: what opposes itself goes to retrieval with low confidence."""
    text = (query or "").strip()
    if not use_retrieval or not text:
        return Intent(False, "retrieval_disabled" if not use_retrieval else "empty_query")
    direct, knowledge = (any(t in text for t in terms) for terms in (lexicon.direct_terms, lexicon.knowledge_terms))
    if direct and knowledge:
        return Intent(True, "signal_conflict", confidence=0.2, rewritten=text)
    if is_identifier_query(text, lexicon):
        return Intent(True, "identifier_query", rewritten=text)
    if direct:
        return Intent(False, "direct_keyword")
    return Intent(True, "knowledge_keyword", rewritten=text) if knowledge else Intent(False, "direct_default")


# Names under which a router's answer gives its decision and the query it wrote, and what the decision may be.
_ROUTE_NAMES, _QUERY_NAMES = ("route", "intent", "decision", "action"), ("query", "rewritten_query", "search_query", "retrieval_query")
_RETRIEVE, _DIRECT = ("rag", "retrieve", "retrieval", "knowledge", "kb"), ("direct", "chat", "answer", "none", "no_rag")


def _one_line(value: object) -> str:
    return re.sub(r"\s+", " ", str(value or "")).strip()


def _first(payload: dict, names: Sequence[str]) -> object:
    return next((payload[n] for n in names if payload.get(n)), "")


def intent_of(payload: dict, source: str = "llm") -> Intent | None:
    """A router's parsed answer as an intent: synonyms of route and query, confidence clamped to 0..1; None without a decision."""
    route = str(_first(payload, _ROUTE_NAMES)).strip().lower()
    flag = next((payload[n] for n in ("needs_retrieval", "use_rag", "rag") if isinstance(payload.get(n), bool)), None)
    retrieve = True if route in _RETRIEVE else False if route in _DIRECT else flag
    if retrieve is None:
        return None
    try:
        sure = None if payload.get("confidence") in (None, "") else max(0.0, min(1.0, float(payload["confidence"])))
    except (TypeError, ValueError):
        sure = None
    reason = _one_line(payload.get("reason") or payload.get("explanation") or route)
    return Intent(retrieve, f"{source}:{reason}" if reason else source, source, sure if sure is not None else 0.5, _one_line(_first(payload, _QUERY_NAMES)) if retrieve else "")


def route_intent(query: str | None, use_retrieval: bool = True, llm: Callable[[str], str] | None = None, lexicon: Lexicon = CHINESE) -> Intent:
    """Rules first; a model decides conflicts and queries without a sign, and rules again if it gives no answer."""
    ruled = rule_intent(query, use_retrieval, lexicon)
    if llm is None or ruled.reason not in ("signal_conflict", "direct_default"):
        return ruled
    told = intent_of(load_json(llm(query or "")))
    if told is not None:
        return replace(told, rewritten=told.rewritten or (query or "").strip())
    retrieve = ruled.reason == "signal_conflict"
    return Intent(retrieve, f"fallback:{ruled.reason}", "fallback", 0.0, (query or "").strip() if retrieve else "")


def written_query(answer: str) -> str:
    """The query in a model's answer: of its JSON object, or its text unless that is fenced."""
    value = _one_line(_first(load_json(answer), _QUERY_NAMES)) or _one_line(answer)
    return "" if value.startswith("```") else value


def resolve_query(query: str, intent: Intent, llm: Callable[[str, Sequence[dict]], str] | None = None, history: Sequence[dict] = (), lexicon: Lexicon = CHINESE) -> str:
    """What is searched for: the router's query if it keeps the focus, the query itself after rules or without a model,
    else what `llm(query, messages of the last three turns)` writes, if that keeps the focus.
    """
    text = query.strip()
    if intent.rewritten and intent.source != "rule" and keeps_focus(text, intent.rewritten, lexicon=lexicon):
        return intent.rewritten
    if intent.source == "rule" or llm is None:
        return text
    begins = [i for i, m in enumerate(history) if m["role"] == "user"]
    told = written_query(llm(text, list(history[begins[-3] if len(begins) >= 3 else 0 :])))
    return told if told and keeps_focus(text, told, lexicon=lexicon) else text


def keeps_focus(original: str | None, rewritten: str | None, generic: Sequence[str] = (), lexicon: Lexicon = CHINESE) -> bool:
    """Whether a rewritten query has enough of the first eight specific terms of the original."""
    a, b = (re.sub(r"\s+", " ", (t or "").strip()) for t in (original, rewritten))
    if not a or not b or a == b:
        return bool(a and b)
    terms = [t for t in keywords(a, 24, lexicon) if t not in generic]
    if not terms:
        return len(b) <= max(3 * len(a), 24)
    return sum(t in normalize(b) for t in terms[:8]) >= (1 if len(terms) <= 2 else 2)


# Labels that open a paragraph of an answer.
_LABEL = re.compile(r"^(?:\*\*)?(?:结论|答案|流程|步骤|操作|条件|材料|注意|补充|依据|建议|处理方式)(?:\*\*)?[:：]")
_ITEM, _HEADING = re.compile(r"^(?:[-*+]|\d+[.、)])\s+"), re.compile(r"^#{1,6}\s+")


def tidy_answer(text: str | None) -> str:
    """Tidy white space and blank lines of an answer; fenced code stays as it is."""
    out: list[str] = []
    fenced = False
    for raw in re.split(r"\r\n|\r|\n", text or ""):
        line = re.sub(r"[ \t]{2,}", " ", raw.strip())
        if line.startswith("```"):
            fenced = not fenced
        elif fenced:
            line = raw.rstrip()
        else:
            before = out[-1] if out else ""
            if not line and not before:
                continue
            opens = any(p.match(line) for p in (_ITEM, _HEADING, _LABEL))
            if opens and before and not _ITEM.match(before):
                out.append("")
        out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
