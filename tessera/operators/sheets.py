"""Spreadsheets as rows: header inference, unique headers, column profiles and forward fill.

Tables here have sheet, row_no and cells (array of strings), one row of the sheet each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.lexicon import CHINESE, Lexicon

NUMBER = r"^[-+]?(?:\d+(?:\.\d+)?|\.\d+)(?:%|元|万元|万)?$"


def looks_numeric(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit("")).rlike(NUMBER)


def _full(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def _scored(rows: DataFrame, group: str | list[str]) -> DataFrame:
    """Rows with their width and score as a header."""
    by = Window.partitionBy(group).orderBy("row_no")
    held = rows.withColumn("v", _full(F.col("cells"))).withColumn("width", F.size("v"))
    text = F.size(F.filter("v", lambda c: ~looks_numeric(c))) / F.col("width")
    distinct = F.size(F.array_distinct(F.transform("v", lambda c: F.lower(c)))) / F.col("width")
    held = held.withColumn("score", F.when(F.col("width") >= 2, 2.0 * F.col("width") + 3.0 * distinct + 3.0 * text)).drop("v")
    least = F.greatest(F.lit(2), F.floor(F.col("width") * 0.5))
    similar = sum(((F.lead("width", i, 0).over(by) >= least) & (F.lead("width", i, 0).over(by) > 0)).cast("int") for i in (1, 2, 3))
    widest = F.max("width").over(Window.partitionBy(group))
    bonus = F.when(F.col("width") >= F.greatest(F.lit(2), F.floor(widest * 0.5)), 4.0).otherwise(0.0)
    return held.withColumn("score", F.col("score") + 2.0 * similar + bonus).filter("width > 0")


def _best() -> Column:
    """The best score's row, as (s, width, -row_no)."""
    return F.max(F.when(F.col("score").isNotNull(), F.struct(F.round("score", 9).alias("s"), "width", (-F.col("row_no")).alias("n"))))


def infer_header(rows: DataFrame, group: str = "sheet") -> DataFrame:
    """The header's row of each sheet: sheet, header_row.

    Rows are scored by their width, by distinct and by textual values, by how many of the next three rows are at
    least half as wide, and by 4 more if they are at least half as wide as the widest; ties go to the wider, then
    the earlier row. Rows of one value never win while a wider one exists; without any the first row that isn't
    blank does.
    """
    found = _scored(rows, group).groupBy(group).agg(_best().alias("b"), F.min("row_no").alias("f"))
    return found.select(group, F.coalesce(-F.col("b.n"), F.col("f")).alias("header_row"))


def with_header(rows: DataFrame, group: str | list[str] = "sheet") -> DataFrame:
    """Rows that aren't blank with their sheet's header_row, as `infer_header` finds it, where the sheet's rows lie anyway."""
    over = Window.partitionBy(group)
    found = _scored(rows, group).withColumns({"_b": _best().over(over), "_f": F.min("row_no").over(over)})
    return found.select(*rows.columns, F.coalesce(-F.col("_b.n"), F.col("_f")).alias("header_row"))


def unique_headers(headers: DataFrame, group: str | list[str] = "sheet") -> DataFrame:
    """Name the columns (sheet, position from 0, header): blank or `unnamed` ones by position, repeats with `_k`."""
    bare = F.trim(F.regexp_replace(F.coalesce("header", F.lit("")), r"(?U)\s+", " "))
    name = F.when((bare == "") | F.lower(bare).startswith("unnamed"), F.concat(F.lit("列"), (F.col("position") + 1).cast("string"))).otherwise(bare)
    named = headers.withColumn("name", name)
    n = F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group), "name").orderBy("position"))
    return named.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def fill_hint(header: Column, lexicon: Lexicon = CHINESE) -> Column:
    """Whether a column is to be filled down, as far as its name says; null where the name doesn't."""
    name = F.lower(F.regexp_replace(header, r"(?U)\s+", ""))
    hinted = lambda terms: X.count_terms(terms, name) > 0
    return F.when(name == "", False).when(hinted(lexicon.no_fill_columns), False).when(hinted(lexicon.fill_columns), True)


def profile_columns(cells: DataFrame, lexicon: Lexicon = CHINESE) -> DataFrame:
    """Per column of long cells (sheet, header, row_no, value): shares, and whether it is one to fill down.

    Returns sheet, header, n_rows, text_ratio, blank_ratio, repeated_ratio and fill. Counts of equal values are
    summed before the shuffle, so a column of one value is a row a task.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    counted = cells.groupBy("sheet", "header", value.alias("v")).agg(F.count("*").alias("n"))
    full = F.when(F.col("v") != "", F.col("n")).otherwise(0)
    found = counted.groupBy("sheet", "header").agg(
        F.sum("n").alias("n_rows"),
        F.sum(full).alias("full"),
        F.sum(F.when(looks_numeric(F.col("v")), 0).otherwise(full)).alias("text"),
        F.max(full).alias("most"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    found = found.withColumns({"text_ratio": share("text", "full"), "blank_ratio": (F.col("n_rows") - F.col("full")) / F.col("n_rows"), "repeated_ratio": share("most", "full")})
    shape = (F.col("full") >= 2) & (F.col("text_ratio") >= 0.7) & (F.col("blank_ratio") >= 0.25) & (F.col("repeated_ratio") >= 0.25)
    return found.select("sheet", "header", "n_rows", "text_ratio", "blank_ratio", "repeated_ratio", F.coalesce(fill_hint(F.col("header"), lexicon), shape).alias("fill"))


def column_names(cells: DataFrame, group: list[str], lexicon: Lexicon = CHINESE) -> DataFrame:
    """Per column of long cells (group, position, title, value; `head`: the header's own): group, position, name and least.

    Values are counted only later, for columns that the name, numbers and blanks don't rule out: `least` is 0 where the
    name says that the column is filled down, the number of values of which a quarter must be equal where that decides,
    and null where the column stays.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    full = ~F.col("head") & (value != "")
    found = cells.groupBy(*group, "position", F.col("title").alias("header")).agg(
        F.count_if(~F.col("head")).alias("n_rows"),
        F.count_if(full).alias("full"),
        F.count_if(F.when(full, ~looks_numeric(value))).alias("text"),
    )
    hint = fill_hint(F.col("name"), lexicon)
    shape = F.when(F.col("full") >= 2, (F.col("text") / F.col("full") >= 0.7) & ((F.col("n_rows") - F.col("full")) / F.col("n_rows") >= 0.25))
    least = F.when(hint, F.lit(0).cast("long")).when(hint.isNull() & shape, F.col("full"))
    return unique_headers(found, group).select(*group, "position", "name", least.alias("least"))


def forward_fill(rows: DataFrame, columns: list[str], group: list[str], order: str) -> DataFrame:
    """Fill blank or null values down from the last one above in the same group."""
    by = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(by) for c in columns})


def render_sheet(rows: DataFrame, group: str = "sheet") -> DataFrame:
    """Structured text of a sheet: its marker, then each row in CSV: sheet, content."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.array_join(F.transform("cells", lambda c: quoted(F.coalesce(c, F.lit("")))), ",")
    held = rows.filter(F.size(_full(F.col("cells"))) > 0).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("row_no", line.alias("l")))).alias("r"))
    return held.select(group, F.concat(F.lit("[Sheet] "), F.col(group), F.lit("\n"), F.array_join(F.transform("r", lambda r: r["l"]), "\n")).alias("content"))
