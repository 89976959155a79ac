"""Evidence around hits: parents, whole sheets, budgeted contexts and grouped sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.lexicon import CHINESE, Lexicon

# Limits of contexts and of sheet evidence.
CONTEXT_CHARS, TABLE_CONTEXT_CHARS, LEAST_BLOCK = 6500, 30000, 120
SHEET_PARENTS, SHEET_CHARS, SHEET_BONUS = 200, 24000, 0.08


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a given order. Sums are made before the shuffle, so a hot key is a row a task."""
    others = [c for c in rows.columns if c not in key]
    place = F.struct(*order, *(c for c in others if c not in order))
    found = rows.groupBy(*key).agg(F.min(place).alias("r"))
    return found.select(*key, *(F.col(f"r.{c}").alias(c) for c in others)).select(*rows.columns)


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Attach each child's parent text (parent_context); a child hit twice counts once, by its best rank."""
    once = first_wins(hits, ["query_id", "document_id", "child_id", "content"], ["rank"])
    texts = parents.select("parent_id", F.col("parent_text").alias("parent_context")).dropDuplicates(["parent_id"])
    return once.join(texts, "parent_id", "left")


def sheet_evidence(hits: DataFrame, parents: DataFrame, queries: str | Mapping[str, str], lexicon: Lexicon = CHINESE) -> DataFrame:
    """Replace a query's first hit of each (document, sheet) by the whole sheet: fields, counts and rows, matching ones first.

    `queries` are texts by query_id, or the one text that all hits are of. `hits`: query_id, document_id, content, file_type, score, rank; parents: document_id, parent_index,
    parent_text. Hits that are no table, or that explain other tables, stay as they are. A sheet's first 200 parents
    count; repeated rows count once by their normalised text; rows are written up to 24000 characters.
    """
    marked = hits.withColumns(
        {
            "sheet": F.when(
                X.is_structured(F.col("file_type"), F.col("content")) & ~X.is_reference_index(F.col("content"), lexicon.index_markers),
                F.nullif(X.sheet_name(F.col("content")), F.lit("")),
            )
        }
    )
    anchors = first_wins(marked.filter(F.col("sheet").isNotNull() & (F.col("document_id").cast("string") != "")).select("query_id", "document_id", "sheet", "rank", "score"), ["query_id", "document_id", "sheet"], ["rank"])
    own = parents.select("document_id", "parent_index", "parent_text", X.sheet_name(F.col("parent_text")).alias("sheet")).filter("sheet <> ''")
    own = own.join(anchors.select("document_id", "sheet").distinct(), ["document_id", "sheet"], "left_semi")
    by_sheet = Window.partitionBy("document_id", "sheet")
    own = own.withColumn("n", F.row_number().over(by_sheet.orderBy("parent_index"))).filter(F.col("n") <= SHEET_PARENTS)
    line = own.select("document_id", "sheet", "n", F.posexplode(X.lines(F.col("parent_text"))).alias("at", "line"))
    line = line.filter(~F.col("line").rlike(r"(?i)^\[Sheet\]\s*\S")).withColumn("key", X.normalize(F.col("line")))
    header = line.groupBy("document_id", "sheet").agg(F.min(F.struct("n", "at", "line", "key")).alias("h"))
    body = line.join(header, ["document_id", "sheet"]).filter("key <> '' and key <> h.key")
    body = first_wins(body.select("document_id", "sheet", "key", "n", "at", "line"), ["document_id", "sheet", "key"], ["n", "at"])
    # Rows are prepared once a sheet; what a query asks for tells which come first for it.
    body = body.join(anchors.select("query_id", "document_id", "sheet"), ["document_id", "sheet"])
    terms = lambda text: F.array(*(F.lit(t) for t in Q.keywords(text, 32, lexicon) if t not in lexicon.generic_rows)).cast("array<string>")
    if isinstance(queries, str):
        wanted = terms(queries)
    else:
        wanted = F.create_map(*(v for q, text in queries.items() for v in (F.lit(q), terms(text))))[F.col("query_id")] if queries else F.lit(None).cast("array<string>")
    body = body.withColumn("wanted", wanted).withColumn("hit", F.coalesce(F.exists("wanted", lambda t: F.contains(F.col("key"), t)), F.lit(False))).drop("wanted")
    turn = Window.partitionBy("query_id", "document_id", "sheet").orderBy(F.desc("hit"), "n", "at")
    used = F.sum(F.length("line") + 1).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    body = body.withColumns({"used": used, "place": F.row_number().over(turn)})
    shown = F.when(F.col("used") <= SHEET_CHARS, F.struct("place", "line"))
    whole = body.groupBy("query_id", "document_id", "sheet").agg(F.count("*").alias("rows"), F.count_if("hit").alias("matched"), F.sort_array(F.collect_list(shown)).alias("shown"))
    whole = whole.filter(F.size("shown") > 0).join(header, ["document_id", "sheet"])
    fields = F.array_join(F.filter(F.transform(F.split("h.line", ","), lambda x: F.trim(x)), lambda x: x != ""), "、")
    text = F.concat(
        F.lit("[Sheet] "), F.col("sheet"), F.lit("\n字段: "), fields, F.lit("\n去重记录数: "), F.col("rows").cast("string"), F.lit("\n优先匹配行数: "),
        F.col("matched").cast("string"), F.lit("\n数据行:\n"), F.array_join(F.transform("shown", lambda s: s["line"]), "\n"),
    )
    evidence = anchors.join(whole, ["query_id", "document_id", "sheet"]).select("query_id", "document_id", "rank", text.alias("evidence"))
    out = marked.join(evidence, ["query_id", "document_id", "rank"], "left").drop("sheet")
    return out.withColumns(
        {
            "aggregated": F.col("evidence").isNotNull(),
            "content": F.coalesce("evidence", "content"),
            "score": F.when(F.col("evidence").isNotNull(), F.greatest(F.col("score"), F.lit(0.0)) + SHEET_BONUS).otherwise(F.col("score")),
        }
    ).drop("evidence")


def assemble_context(results: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """One context a query: query_id, context, n_blocks, n_chars.

    Results (query_id, rank, content, source_name, document_id, chunk_index and, where known, parent_context) become
    numbered blocks in order of rank. Blocks go in whole while they fit; the first that doesn't is cut if more than
    120 characters are left. White space is collapsed; the joining blank lines aren't counted.
    """
    squeeze = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    one = Window.partitionBy("query_id").orderBy("rank")
    parent = squeeze(F.col("parent_context")) if "parent_context" in results.columns else F.lit("")
    content = squeeze(F.col("content"))
    named = F.coalesce(F.nullif("source_name", F.lit("")), F.nullif(F.col("document_id").cast("string"), F.lit("")), F.lit("未知来源"))
    chunk = F.when(F.col("chunk_index").isNotNull(), F.concat(F.lit(" / chunk: "), F.col("chunk_index").cast("string"))).otherwise("")
    body = F.when((parent != "") & (parent != content), F.concat(F.lit("[命中行] "), content, F.lit("\n[父块上下文] "), parent)).otherwise(content)
    block = F.concat(F.lit("[资料"), F.row_number().over(one).cast("string"), F.lit("] 来源: "), named, chunk, F.lit("\n"), body)
    blocks = results.withColumn("block", block)
    before = F.coalesce(F.sum(F.length("block")).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("left", most - before)
    fits = F.length("block") <= F.col("left")
    cut = F.rtrim(F.substring(F.col("block"), F.lit(1), F.col("left").cast("int")))
    taken = blocks.withColumn("part", F.when(fits, F.col("block")).when(F.col("left") > LEAST_BLOCK, cut)).filter("part is not null and left > 0")
    joined = taken.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    parts = F.transform("parts", lambda p: p["part"])
    chars = F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))
    return joined.select("query_id", F.array_join(parts, "\n\n").alias("context"), F.size(parts).cast("long").alias("n_blocks"), chars.cast("long").alias("n_chars"))


def reassemble(chunks: DataFrame, key: str = "document_id", order: str = "chunk_index", text: str = "content") -> DataFrame:
    """Documents out of their chunks in order, blank ones left out, joined by blank lines: key, n_chunks, content."""
    held = chunks.filter(F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")).groupBy(key)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return held.agg(ordered.alias("c")).select(key, F.size("c").cast("long").alias("n_chunks"), F.array_join(F.transform("c", lambda c: c["t"]), "\n\n").alias("content"))


def content_cascade(documents: DataFrame, *sources: DataFrame) -> DataFrame:
    """Each document's content (document_id, content) from the first source that has any that isn't empty."""
    out, names = documents, []
    for i, s in enumerate(sources):
        names.append(f"_c{i}")
        out = out.join(s.select("document_id", F.nullif("content", F.lit("")).alias(names[-1])), "document_id", "left")
    return out.withColumn("content", F.coalesce(*names) if names else F.lit(None).cast("string")).drop(*names)


def group_sources(hits: DataFrame, most: int = 3) -> DataFrame:
    """Sources for display: hits by (query_id, source_name, parent_id, else document and chunk), first seen first.

    Returns query_id, position, source_name, n_hits, max_score and the distinct chunk numbers of the first `most`.
    """
    one = F.when(F.coalesce("parent_id", F.lit("")) != "", F.concat(F.lit("p:"), F.col("parent_id"))).otherwise(
        F.concat_ws(":", F.lit("c"), F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
    )
    groups = hits.groupBy("query_id", "source_name", one.alias("part")).agg(
        F.min("rank").alias("seen"), F.count("*").alias("n_hits"), F.max("score").alias("max_score"), F.sort_array(F.collect_set("chunk_index")).alias("chunks")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "source_name", "part"))
    return groups.withColumn("position", place).filter(F.col("position") <= most).select("query_id", "position", "source_name", "n_hits", "max_score", "chunks")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first `n` rows of each group, with their rank. Spark cuts each task's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def score_floor(results: DataFrame, score: str = "score", least: float = 0.28, share: float = 0.62) -> DataFrame:
    """Results of each query at or above max(least, share of its best); the best alone where none is but it reaches `least`."""
    one = Window.partitionBy("query_id")
    best = results.withColumn("_best", F.max(score).over(one))
    floor = F.greatest(F.lit(least), share * F.col("_best"))
    first = F.row_number().over(one.orderBy(F.desc(score), "rank")) == 1
    return best.withColumn("_first", first).filter((F.col(score) >= floor) | (F.col("_first") & (F.col("_best") >= least))).drop("_best", "_first")


def page(rows: DataFrame, order: Sequence, skip: int, limit: int) -> tuple[int, DataFrame]:
    """The number of all rows, and one page of them."""
    return rows.count(), rows.orderBy(*order).offset(skip).limit(limit)


def serialize(results: DataFrame, fields: Sequence[str] = ("content", "score", "source")) -> DataFrame:
    """Results as answers show them: `fields`, and the other columns as the map `metadata` of texts.

    Columns that begin with `_` are inner ones and left out, as are nulls.
    """
    rest = [c for c in results.columns if c not in fields and not c.startswith("_")]
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rest)).cast("array<struct<k:string,v:string>>")
    return results.select(*(c for c in fields if c in results.columns), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("metadata"))
