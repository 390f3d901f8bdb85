"""Rows of table cells (as found on PDF pages) to parsed rows.

Input: (file_id, page_no, table_no, row_no, cells). The wrapped lines of a row are
folded into it by a running count of anchors (gaps and islands) and an ordered fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from .files import parsed, with_names

TABLE = ("file_id", "page_no", "table_no")
# Fixed values.
HEADER_WORDS = ("date", "narration", "description", "particulars", "debit", "credit", "transaction", "sr.no", "sr no", "opening balance")


def clean_cells(cells: Column) -> Column:
    """Cells with single spaces and plain hyphens; null is ''.

    From the right, a cell of one to three characters is added to its left neighbour
    if that isn't empty.
    """
    plain = F.transform(cells, lambda c: s.collapse(F.translate(F.coalesce(c, F.lit("")), "\f‑", " -")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("short"))

    def step(a: Column, c: Column) -> Column:
        # ``short``: what the right neighbour hands over to this cell.
        whole = F.when((c != "") & (a["short"] != ""), F.concat(c, F.lit(" "), a["short"])).otherwise(c)
        kept = F.when((c == "") & (a["short"] != ""), F.concat(F.array(a["short"]), a["done"])).when(a["short"] != "", F.concat(F.array(F.lit("")), a["done"])).otherwise(a["done"])
        pass_on = (whole != "") & (F.length(whole) <= 3)
        return F.struct(F.when(pass_on, kept).otherwise(F.concat(F.array(whole), kept)).alias("done"), F.when(pass_on, whole).otherwise(F.lit("")).alias("short"))

    return F.aggregate(F.reverse(plain), start, step, lambda a: F.when(a["short"] != "", F.concat(F.array(a["short"]), a["done"])).otherwise(a["done"]))


def has_date(cells: Column, first: int = 2) -> Column:
    return F.exists(F.slice(cells, 1, first), lambda c: s.parse_date(c).isNotNull())


def is_header_row(cells: Column) -> Column:
    """No date in the first two cells, and a word of a table's head in any cell."""
    text = F.lower(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " "))
    word = F.lit(False)
    for w in HEADER_WORDS:
        word = word | text.contains(w)
    return ~has_date(cells) & word


def merge_continuation_rows(rows: DataFrame) -> DataFrame:
    """One row for each anchor; the text of the rows after it goes to its third cell (the first of one or two).

    A row without a date in its first two cells and without an amount in its last three
    continues the row before it, unless it is a table's first. Two parts of which one ends
    and the other begins with a digit or slash are joined without a space.
    """
    w = rows.filter(F.size("cells") > 0).withColumn("cells", clean_cells(F.col("cells")))
    tail = F.when(F.size("cells") >= 3, F.slice("cells", F.size("cells") - 2, F.lit(3))).otherwise(F.col("cells"))
    amount = F.exists(tail, lambda c: c.rlike(r"\d[\d,]*\.\d+"))
    by = Window.partitionBy(*TABLE).orderBy("row_no")
    anchor = has_date(F.col("cells")) | amount | (F.row_number().over(by) == 1)
    w = w.withColumn("anchor", anchor).withColumn("island", F.sum(F.col("anchor").cast("int")).over(by))
    text = F.trim(F.array_join(F.filter("cells", lambda c: c != ""), " "))
    parts = F.array_sort(F.collect_list(F.when(~F.col("anchor") & (text != ""), F.struct(F.col("row_no").alias("no"), text.alias("text")))))
    g = w.groupBy(*TABLE, "island").agg(F.min("row_no").alias("row_no"), F.max(F.when(F.col("anchor"), F.col("cells"))).alias("cells"), parts.alias("parts"))
    at = F.when(F.size("cells") > 2, 2).otherwise(0)

    def join(a: Column, p: Column) -> Column:
        split = a.rlike(r"[\d/]$") & p["text"].rlike(r"^[\d/]")
        return F.when(split, F.concat(a, p["text"])).otherwise(F.trim(F.concat(a, F.lit(" "), p["text"])))

    folded = F.aggregate("parts", F.get("cells", at), join)
    return g.withColumn("_lf_at", at).withColumn("_lf_text", folded).withColumn("cells", F.transform("cells", lambda c, i: F.when(i == F.col("_lf_at"), F.col("_lf_text")).otherwise(c))).drop("_lf_at", "_lf_text", "parts", "island")


def map_grid_rows(merged: DataFrame) -> DataFrame:
    """Parsed rows of merged tables.

    The date stands in the first or second cell; the widest row of a table tells which cells follow
    it (seven or more, six, or five columns). Headers, rows with the date elsewhere
    and opening balances are left out. ``source_row`` counts a file's rows that aren't headers.
    """
    w = merged.withColumn("wide", F.max(F.size("cells")).over(Window.partitionBy(*TABLE))).filter(~is_header_row(F.col("cells")))
    w = w.withColumn("source_row", F.row_number().over(Window.partitionBy("file_id").orderBy("page_no", "table_no", "row_no")))
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    w = w.withColumn("dates", F.transform(F.slice("cells", 1, 4), s.parse_date))
    dated = [F.get("dates", F.lit(k)) for k in range(4)]
    w = w.withColumn("date_col", F.coalesce(*[F.when(d.isNotNull(), F.lit(k)) for k, d in enumerate(dated)])).filter("date_col < 2")
    kind = F.when(F.col("date_col") == 1, "second").when(F.col("wide") >= 7, "7col").when(F.col("wide") == 6, "6col").otherwise("5col")
    w = w.withColumn("kind", kind)

    def pick(**cells: int | None) -> Column:
        cases = [F.when(F.col("kind") == k.lstrip("_"), cell(v)) for k, v in cells.items() if v is not None]
        return F.coalesce(*cases, F.lit(""))

    debit, credit = pick(second=4, _7col=4, _6col=3, _5col=2), pick(second=5, _7col=5, _6col=4, _5col=3)
    balance = pick(second=6, _7col=6, _6col=5, _5col=4)
    w = w.select(
        "file_id",
        F.when(F.col("date_col") == 0, dated[0]).otherwise(dated[1]).alias("txn_date"),
        F.when(F.col("kind") == "7col", dated[1]).alias("value_date"),
        F.when(F.col("kind") == "7col", s.parse_time(cell(2))).alias("txn_time"),
        pick(second=2, _7col=3, _6col=2, _5col=1).alias("narration_raw"),
        s.parse_amount(debit).alias("debit"),
        s.parse_amount(credit).alias("credit"),
        s.parse_amount(balance).alias("balance"),
        s.parse_balance_type(balance).alias("balance_type"),
        pick(second=3, _7col=7, _6col=1).alias("reference"),
        "source_row",
        F.to_json(F.struct(F.col("cells").alias("raw_cells"))).alias("bank_json_data"),
    )
    return parsed(with_names(w.filter(~F.lower("narration_raw").contains("opening balance"))))


def parse_grid(rows: DataFrame) -> DataFrame:
    return map_grid_rows(merge_continuation_rows(rows))
