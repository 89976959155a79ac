"""Reranking by explainable relevance signals, the keyword gate, and the final filter."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.lexicon import CHINESE, Lexicon

# Weights and limits of the final score.
LEAST_SCORE, SCORE_SHARE = 0.28, 0.62
CITATIONS, STRUCTURED_CITATIONS = 3, 12
#: Queries ranked in one plan; what is known of them is broadcast.
MOST_QUERIES = 2000


@dataclass(frozen=True)
class Asked:
    """A query as ranking sees it."""

    text: str
    keywords: list[str]
    focus: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    structured: bool = False

    @classmethod
    def of(cls, text: str, lexicon: Lexicon = CHINESE, words: bool = False) -> Asked:
        """`words`: keywords are the words of the query, for languages that part them."""
        known = Q.word_keywords(text, lexicon=lexicon) if words else Q.keywords(text, lexicon=lexicon)
        return cls(text, known, Q.focus_terms(text, lexicon=lexicon) if not words else known[:2], Q.identifiers(text), Q.is_structured_lookup(text, lexicon))


def source_score(score: Column, source: Column) -> Column:
    """Raw scores of the routes on comparable scales."""
    positive = F.greatest(F.lit(0.0), score)
    dense = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)) + 1) / 2
    return F.when(source == "sparse", positive / (positive + 1)).when(source == "dense", dense).otherwise(positive)


def min_max(value: Column, by: Sequence[str]) -> Column:
    """Position between the least and greatest value of a group; without a span 1 for positive values, else 0."""
    group = Window.partitionBy(*by)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(high - low > 1e-9, (value - low) / (high - low)).otherwise(F.when(value > 0, 1.0).otherwise(0.0))


def with_asked(results: DataFrame, asked: Asked | Mapping[str, Asked], lexicon: Lexicon = CHINESE) -> DataFrame:
    """Results with what ranking needs to know of their query as the struct `_q`.

    One query's own `Asked`, or those of many by query_id: a stated query set of at most MOST_QUERIES, joined as a small
    table. Results of a query that is not among them are left out.
    """
    kinds = {"text": "string", **dict.fromkeys(("keywords", "focus", "identifiers", "names", "fields"), "array<string>"), "structured": "boolean"}

    def known(one: Asked) -> tuple:
        fields = schema_terms(one.text, lexicon) if one.structured else []
        return (one.text, one.keywords, one.focus, [Q.normalize(i) for i in one.identifiers], Q.canonical_identifiers(one.text), fields, one.structured)

    if isinstance(asked, Asked):
        literal = lambda v, kind: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kind)
        return results.withColumn("_q", F.struct(*(literal(v, kind).alias(c) for v, (c, kind) in zip(known(asked), kinds.items(), strict=True))))
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"{len(asked)} queries; at most {MOST_QUERIES} at a time")
    schema = f"query_id string, _q struct<{', '.join(f'{c}:{kind}' for c, kind in kinds.items())}>"
    return results.join(F.broadcast(results.sparkSession.createDataFrame([(q, known(one)) for q, one in asked.items()], schema)), "query_id")


def most_of(asked: Asked | Mapping[str, Asked], count: Callable[[Asked], int]) -> int:
    return max(map(count, [asked] if isinstance(asked, Asked) else asked.values()), default=0)


def specificity(terms: Column, most: int, normalized: Column, by: Sequence[str]) -> Column:
    """The share of keywords that occur, weighted by rarity among a group's candidates and by length.

    `terms` is an array of at most `most` terms, the same in all rows of a group.
    """
    group = Window.partitionBy(*by)
    total = F.count("*").over(group)
    has = F.transform(terms, lambda t: F.contains(normalized, t).cast("int"))
    df = F.array(*(F.coalesce(F.sum(F.get(has, i)).over(group), F.lit(0)) for i in range(most))).cast("array<long>")
    held = F.zip_with(X.weighted(terms, 8), F.slice(df, F.lit(1), F.size(terms)), lambda t, n: F.struct(t["term"].alias("term"), ((F.log((total + 1) / (n + 1)) + 1) * t["weight"]).alias("weight")))
    share = X.total_weight(F.filter(held, lambda t: F.contains(normalized, t["term"]))) / X.total_weight(held)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.least(F.lit(1.0), share))


def signals(results: DataFrame, lexicon: Lexicon = CHINESE) -> DataFrame:
    """Add the relevance signals of a query to its results (content, source_name, _q of `with_asked`, ...)."""
    body = X.normalize(X.search_text(F.col("source_name"), F.col("content")))
    head = X.normalize(X.heading_text(F.col("content")))
    keywords, focus, whole = F.col("_q.keywords"), F.col("_q.focus"), X.normalize(F.col("_q.text"))
    found = results.withColumns({"_body": body, "_head": head})
    return found.withColumns(
        {
            "keyword_hits": X.count_terms(keywords, F.col("_body")),
            "long_hits": X.count_terms(F.filter(keywords, lambda k: F.length(k) >= 3), F.col("_body")),
            "focus_hits": X.count_terms(focus, F.col("_body")),
            "keyword_coverage": X.coverage(keywords, F.col("_body")),
            "focus_coverage": X.coverage(focus, F.col("_body")),
            "heading_coverage": X.coverage(keywords, F.col("_head")),
            "heading_focus_coverage": X.coverage(focus, F.col("_head")),
            "exact_match": (whole != "") & F.contains(F.col("_body"), whole),
            "reference_index": X.is_reference_index(F.col("content"), lexicon.index_markers),
        }
    )


def gate() -> Column:
    """Whether a result is about a query's words; needs the columns of `signals`."""
    few = (F.col("keyword_hits") >= 1) | (F.col("keyword_coverage") >= 0.28)
    many = (F.col("long_hits") >= 1) | (F.col("keyword_hits") >= 2) | (F.col("keyword_coverage") >= 0.22)
    enough = F.when(F.size("_q.keywords") <= 2, few).otherwise(many)
    astray = (F.size("_q.focus") >= 2) & (F.col("focus_hits") < 2) & (F.col("focus_coverage") < 0.18) & (F.col("heading_coverage") < 0.30)
    about = F.when(F.size("_q.keywords") == 0, True).otherwise(F.col("exact_match") | (enough & ~astray))
    return F.when(F.size("_q.identifiers") > 0, X.count_terms(F.col("_q.identifiers"), F.col("_body")) > 0).otherwise(about)


def rerank(results: DataFrame, asked: Asked | Mapping[str, Asked], lexicon: Lexicon = CHINESE, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Score queries' results anew: final_score, gate_passed and final_rank beside the signals.

    `results`: by columns, content, source_name, score, source and position (their order so far); `asked`: the one
    query, or many by query_id, all in one plan. Blank contents are left out. Windows hold one query's candidate
    pool, which is bounded.
    """
    pool = results.filter(F.coalesce(F.col("content"), F.lit("")).rlike(r"(?U)\S"))
    pool = signals(with_asked(pool, asked, lexicon), lexicon).withColumn("raw", source_score(F.col("score"), F.col("source")))
    pool = pool.withColumns({"raw": min_max(F.col("raw"), by), "gate_passed": gate()})
    pool = pool.withColumn("specificity", specificity(F.col("_q.keywords"), most_of(asked, lambda a: len(a.keywords)), F.col("_body"), by))
    bonus = F.when(F.col("source") == "hybrid", 0.02).when(F.col("source").isin("dense", "sparse"), 0.03).otherwise(0.0)
    final = (
        0.20 * F.col("raw")
        + 0.20 * F.col("keyword_coverage")
        + 0.24 * F.col("specificity")
        + 0.16 * F.col("focus_coverage")
        + 0.08 * F.col("heading_coverage")
        + 0.12 * F.col("heading_focus_coverage")
        + F.when(F.col("exact_match"), 0.25).otherwise(0.0)
        + F.when(F.col("gate_passed"), 0.22).otherwise(-0.22)
        + bonus
        - F.when(F.col("reference_index"), 0.10).otherwise(0.0)
    )
    pool = pool.withColumn("final_score", final).drop("raw", "_body", "_head", "_q")
    best = Window.partitionBy(*by).orderBy(F.desc(F.round("final_score", 12)), F.desc("score"), "position")
    return pool.withColumn("final_rank", F.row_number().over(best))


def schema_score(content: Column, terms: Sequence[str] | Column) -> Column:
    """How well a table's header and sheet name fit a query's field terms (normalised)."""
    found, terms = X.lines(content), X.term_array(terms)
    first = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
    marked = first.startswith(X.SHEET)
    sheet = X.normalize(F.when(marked, F.regexp_replace(first, r"(?i)^\[Sheet\]\s*", "")).otherwise(F.lit("")))
    header = X.normalize(F.when(marked, F.try_element_at(found, F.lit(2))).otherwise(first))
    weight = lambda t: F.when(F.contains(header, t["term"]), t["weight"]).when(F.contains(sheet, t["term"]), 0.65 * t["weight"]).otherwise(0.0)
    held = X.weighted(terms, 8)
    hit = F.aggregate(held, F.lit(0.0), lambda s, t: s + weight(t))
    fields = X.count_terms(terms, header)
    data_sheet = X.count_terms(DATA_SHEETS, sheet) > 0
    meta = X.count_terms(META_TERMS, F.concat(sheet, header)) + X.count_terms(META_HEADERS, header)
    score = hit / X.total_weight(held) + F.when(data_sheet & (fields >= 2), 0.15).otherwise(0.0)
    fit = F.least(F.lit(1.0), F.when((meta >= 2) & (fields < 2), 0.25 * score).otherwise(score))
    return F.when((sheet.eqNullSafe("") & header.eqNullSafe("")) | (F.size(terms) == 0), 0.0).otherwise(fit)


# Words of tables that explain other tables, and of tables that hold data.
META_TERMS = ("说明", "填表说明", "字段说明", "版本", "变更", "速查", "索引", "目录", "faq", "常见问题", "检索提示", "回答参考")
META_HEADERS = ("字段", "用途", "填写规则", "问题", "答案", "关键词", "优先命中表", "检索提示")
DATA_SHEETS = ("明细", "名单", "名册", "花名册", "通讯录", "清单", "台账", "总表")
COUNT_WORDS = ("名单", "列表", "清单", "统计", "总数", "总人数", "数量", "多少", "共有", "一共")
SCHEMA_TERMS: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (
        ("工资", "薪资", "薪酬", "月薪", "应发", "实发", "奖金", "扣款"),
        ("工资", "薪资", "薪酬", "基本工资", "应发工资", "实发工资", "奖金", "扣款", "个税", "社保", "公积金"),
    ),
    (
        ("员工", "人员", "人事", "花名册", "名册", "姓名", "工号"),
        ("员工", "人员", "员工号", "工号", "姓名", "员工姓名", "部门", "岗位", "职位", "状态", "入职", "邮箱", "电话"),
    ),
    (
        ("部门", "组织", "通讯录", "架构", "负责人", "主管"),
        ("部门", "负责人", "主管", "直属主管", "办公地点", "办公", "地点", "联系人", "电话", "邮箱"),
    ),
)


def schema_terms(query: str, lexicon: Lexicon = CHINESE) -> list[str]:
    """Field names that a table about a query may have."""
    text = "".join(query.split())
    found = [t for shown, names in SCHEMA_TERMS if any(s in text for s in shown) for t in names]
    found += Q.keywords(query, 32, lexicon)
    return list(dict.fromkeys(t for t in map(Q.normalize, found) if len(t) >= 2 and t not in COUNT_WORDS))


def fitting_tables(routes: DataFrame, n: int = 3, least: float = 0.12) -> DataFrame:
    """Of each route (query_id, route, rank) of a lookup its first `n` tables whose fields fit the query better than `least`.

    `routes` has content, file_type, reference_index and `_q` as from `signals`. Other queries' routes have none.
    """
    fits = F.col("_q.structured") & X.is_structured(F.col("file_type"), F.col("content")) & ~F.col("reference_index") & (schema_score(F.col("content"), F.col("_q.fields")) > least)
    place = F.row_number().over(Window.partitionBy("query_id", "route").orderBy("rank"))
    return routes.filter(fits).withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def filter_results(ranked: DataFrame, asked: Asked | Mapping[str, Asked], k: int, lexicon: Lexicon = CHINESE) -> DataFrame:
    """The results to cite: reranked ones above the score floor, identifiers' best first, without repeats.

    `ranked` comes from `rerank` for the same queries. Lookups of table fields prefer tables whose header fits; where
    no result passes the gate, the first `k` stay. Returns the rows with `cite_rank`.
    """
    one = Window.partitionBy("query_id")
    held = with_asked(ranked, asked, lexicon).withColumns(
        {
            "_table": X.is_structured(F.col("file_type"), F.col("content")),
            "_gated": F.max(F.col("gate_passed").cast("int")).over(one) > 0,
        }
    )
    structured, names = F.col("_q.structured"), F.size("_q.names")
    most = F.greatest(F.when(structured, STRUCTURED_CITATIONS).otherwise(CITATIONS), names)
    k = F.greatest(F.lit(1), F.least(F.greatest(F.lit(k), names), most))
    # The pool: all, for lookups or where nothing passes the gate; else what passes it.
    pool = held.filter(structured | F.col("gate_passed") | ~F.col("_gated"))
    pool = pool.withColumn("_best", F.max("final_score").over(one))
    floor = F.greatest(F.lit(LEAST_SCORE), SCORE_SHARE * F.col("_best"))
    first = F.row_number().over(one.orderBy("final_rank"))
    plain = F.when(~F.col("_gated"), first <= k).otherwise((F.col("final_score") >= floor) | ((F.col("_best") >= LEAST_SCORE) & (F.col("_best") < floor) & (first == 1)))
    # Lookups: the tables whose fields fit best.
    pool = pool.withColumn("_fit", F.when(structured & F.col("_table"), schema_score(F.col("content"), F.col("_q.fields"))))
    data = F.max((F.col("_table") & ~F.col("reference_index")).cast("int")).over(one) > 0
    pool = pool.withColumn("_use", structured & F.col("_table") & (~F.col("reference_index") | ~data))
    pool = pool.withColumn("_top", F.max(F.when(F.col("_use"), F.col("_fit"))).over(one))
    fits = F.col("_use") & ((F.col("_top") <= 0) | (F.col("_fit") >= F.greatest(F.lit(0.25), 0.5 * F.col("_top"))))
    keep = F.when(structured & F.col("_top").isNotNull(), fits).otherwise(plain)
    order = F.struct(F.coalesce(F.when(F.col("_top") > 0, -F.col("_fit")), F.lit(0.0)).alias("a"), F.col("final_rank").alias("b"))
    # An identifier's first result comes before the rest, in the order of the query.
    guard = F.lit(None).cast("int")
    for i in reversed(range(most_of(asked, lambda a: len(Q.canonical_identifiers(a.text))))):
        name = F.get("_q.names", i)
        has = name.isNotNull() & X.contains_identifier(F.col("content"), F.col("source_name"), F.col("document_id"), name)
        pool = pool.withColumn(f"_id{i}", F.min(F.when(has, F.col("final_rank"))).over(one))
        guard = F.when(F.col("final_rank") == F.col(f"_id{i}"), F.lit(i)).otherwise(guard)
    pool = pool.withColumns({"_guard": guard, "_keep": keep, "_order": order}).filter(F.col("_guard").isNotNull() | F.col("_keep"))
    place = F.when(structured, F.col("parent_id").cast("string")).otherwise(F.col("source_name").cast("string"))
    turn = [F.col("_guard").asc_nulls_last(), F.col("_order")]
    pool = pool.withColumn("_place", place).withColumn("_copy", F.row_number().over(Window.partitionBy("query_id", "document_id", "_place", "child_id").orderBy(*turn))).filter("_copy = 1")
    pool = pool.withColumn("cite_rank", F.row_number().over(one.orderBy(*turn))).filter(F.col("cite_rank") <= k)
    return pool.drop(*(c for c in pool.columns if c.startswith("_")))
