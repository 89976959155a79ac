"""Column expressions over text. All of them run in the JVM, within whole-stage code generation where Spark can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that matching depends on.
CJK = "一-鿿"
PUNCTUATION = r"(?U)[\s\-_.,;:!?，。！？；：、“”‘’\"'`~…·/\\|()\[\]{}<>《》]+"
TOKEN = rf"[A-Za-z0-9]+|[{CJK}]+"
SHEET = "[Sheet]"


def normalize(text: Column) -> Column:
    """Lower case, without white space and punctuation; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order; none for shorter texts."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>")
    )


def tokens(text: Column) -> Column:
    """Lower-case ASCII words; runs of CJK characters as they are, those over two with their 2-grams, over three with 3-grams."""

    def parts(run: Column) -> Column:
        alone = F.array(run)
        cjk = run.rlike(f"^[{CJK}]")
        longer = F.concat(alone, ngrams(run, 2), F.when(F.length(run) >= 4, ngrams(run, 3)).otherwise(F.array().cast("array<string>")))
        return F.when(cjk & (F.length(run) > 2), longer).otherwise(alone)

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), parts))


def estimated_tokens(text: Column) -> Column:
    """Word runs and single CJK characters, 1 at least unless the text is blank."""
    bare = F.coalesce(text, F.lit(""))
    n = F.regexp_count(bare, F.lit(f"[A-Za-z0-9_]+|[{CJK}]"))
    return F.when(bare.rlike(r"(?U)\S"), F.greatest(n, F.lit(1))).otherwise(0)


def search_text(source_name: Column, content: Column) -> Column:
    """Source name and content on lines of their own, empty ones left out."""
    return F.concat_ws("\n", F.nullif(source_name, F.lit("")), F.nullif(content, F.lit("")))


def lines(text: Column) -> Column:
    """The lines of a text that aren't blank, stripped."""
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def heading_text(content: Column) -> Column:
    """The first line, and the second too where the first marks a sheet."""
    found = lines(content)
    first = F.try_element_at(found, F.lit(1))
    return F.coalesce(F.when(first.startswith(SHEET), F.array_join(F.slice(found, 1, 2), "\n")).otherwise(first), F.lit(""))


def sheet_name(content: Column) -> Column:
    """The sheet that the first line names, else empty."""
    first = F.coalesce(F.try_element_at(lines(content), F.lit(1)), F.lit(""))
    return F.trim(F.regexp_extract(first, r"(?i)^\[Sheet\]\s*(.+?)\s*$", 1))


def is_reference_index(content: Column, markers: Sequence[str]) -> Column:
    """Whether at least two of the markers occur."""
    return count_terms(markers, F.coalesce(content, F.lit(""))) >= 2


def is_structured(file_type: Column, content: Column) -> Column:
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(file_type, F.lit("")))), r"^\.+", "")
    return kind.isin("csv", "tsv", "xls", "xlsx") | F.ltrim(F.coalesce(content, F.lit(""))).startswith(SHEET)


def identifier_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s_-]+", ""))


def contains_identifier(content: Column, source_name: Column, document_id: Column, identifier: str | Column) -> Column:
    """Whether a result has an identifier, whatever its case and separators."""
    held = F.concat_ws("\n", F.coalesce(content, F.lit("")), F.coalesce(source_name, F.lit("")), F.coalesce(document_id, F.lit("")))
    return F.contains(identifier_key(held), identifier_key(identifier if isinstance(identifier, Column) else F.lit(identifier)))


def term_array(terms: Sequence[str] | Column) -> Column:
    """Terms as an array column: a literal list, or each row's own."""
    return terms if isinstance(terms, Column) else F.array(*map(F.lit, terms)).cast("array<string>")


def weighted(terms: Sequence[str] | Column, most: int) -> Column:
    """Terms with weights: their length, as a share of `most` characters, at most 1."""
    return F.transform(term_array(terms), lambda t: F.struct(t.alias("term"), (F.least(F.length(t), F.lit(most)) / float(most)).alias("weight")))


def total_weight(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["weight"])


def count_terms(terms: Sequence[str] | Column, text: Column) -> Column:
    """How many of the terms occur."""
    return F.size(F.filter(term_array(terms), lambda t: F.contains(text, t)))


def coverage(terms: Sequence[str] | Column, normalized: Column) -> Column:
    """The weighted share of (normalised) terms that occur; the first three in a row add 1; at most 1."""
    kept = F.filter(term_array(terms), lambda t: t != "")
    held = weighted(kept, 12)
    hits = total_weight(F.filter(held, lambda t: F.contains(normalized, t["term"])))
    phrase = F.when(F.contains(normalized, F.array_join(F.slice(kept, 1, 3), "")), 1.0).otherwise(0.0)
    return F.when((normalized == "") | (F.size(kept) == 0), 0.0).otherwise(F.least(F.lit(1.0), (phrase + hits) / total_weight(held)))


def count_occurrences(text: Column, markers: Sequence[str]) -> Column:
    """Non-overlapping occurrences of all markers."""
    n = F.lit(0)
    for m in markers:
        n = n + (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    return n.cast("int")


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds; a default where it is no number."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value.try_cast("double"), F.lit(default))))


def compact_memory(content: Column) -> Column:
    """`topic：summary` out of a memory text, one of the two, or its first 240 characters on one line."""
    topic = F.nullif(F.trim(F.regexp_extract(content, r"(?m)^\s*【主题】(.*)$", 1)), F.lit(""))
    summary = F.nullif(F.trim(F.regexp_extract(content, r"(?m)^\s*【摘要】(.*)$", 1)), F.lit(""))
    both = F.when(topic.isNotNull() & summary.isNotNull(), F.concat(topic, F.lit("："), summary))
    return F.coalesce(both, summary, topic, F.substring(F.replace(F.trim(content), F.lit("\n"), F.lit(" ")), 1, 240), F.lit(""))
