"""Statement files to parsed rows: routing, CSV, fixed-width, delimited and plain text lines.

Small text files are read whole, so the format is told from the array of lines before it is exploded. Large ones
are read in byte ranges: lines are numbered within a range, and sums over ranges make those numbers the file's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import scalars as s
from ..functions.staging import once, staged

# Fixed values.
FILE_TYPES = {"csv": ("csv", "xlsx", "xls"), "pdf": ("pdf",), "rpt": ("rpt",), "image": ("jpg", "jpeg", "png")}
ALIASES = {
    "txn_date": ("date", "txndate", "transactiondate", "valuedate", "postingdate"),
    "narration": ("narration", "description", "particulars", "details", "remarks"),
    "debit": ("debit", "withdrawal", "withdrawalamt", "debitamount", "dr", "paid"),
    "credit": ("credit", "deposit", "depositamt", "creditamount", "cr", "received"),
    "balance": ("balance", "closingbalance", "runningbalance", "availablebalance"),
    "reference": ("reference", "chequeno", "refno", "utr", "transactionref", "chqno"),
}
#: Begin and end (exclusive) of each field. ``corrected`` agrees with the printed totals of such reports.
LAYOUTS = {
    "corrected": {"gl_date": (1, 11), "value_date": (13, 23), "instrument": (23, 39), "particulars": (39, 97), "debit": (97, 112), "credit": (112, 133), "balance": (133, 155), "entry_user": (156, 166)},
    "compat": {"gl_date": (1, 11), "value_date": (13, 23), "instrument": (23, 39), "particulars": (39, 99), "debit": (105, 118), "credit": (118, 131), "balance": (131, 155), "entry_user": (156, 166)},
}
#: Header and footer lines of fixed-width reports.
REPORT_LINES = (
    r"(?i)GL\.\s*Date|Page Total|B/F Balance|Opening Balance|Service Out|Account No|Peg Review|------|PUNJAB NATIONAL BANK|Customer Account Ledger"
    r"|Report To|SolId|Set Id|Gl Sub Head|Acct Range|Currency Code|Account Label|Open/Closed|Period|Limit Details|Order by|REP31|Page\s+\d+"
)


def route_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``file_type`` by extension: csv, pdf, rpt, image or unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kind = F.coalesce(*[F.when(ext.isin(*e), F.lit(k)) for k, e in FILE_TYPES.items()], F.lit("unknown"))
    return files.withColumn("file_type", kind)


def header_column(columns: list[str], field: str) -> str | None:
    """The column of a header that stands for ``field``: the first alias, in their order, that is there."""
    plain = {c.lower().replace(" ", "").replace(".", "").replace("_", ""): c for c in columns}
    return next((plain[a] for a in ALIASES[field] if a in plain), None)


def plain_header(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ ._]", "")


def field_places(header: Column) -> Column:
    """For the names of a header, the place of each field from 1: of its first alias, in their order, that is there; null if none is."""
    names = F.transform(header, lambda c: plain_header(F.coalesce(c, F.lit(""))))
    place = lambda aliases: F.coalesce(*[F.nullif(F.array_position(names, a), F.lit(0)) for a in aliases])
    return F.struct(*[place(aliases).alias(field) for field, aliases in ALIASES.items()])


def numbered_in_parts(rows: DataFrame, key: str, part: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: the number of each row of ``key``, from 1, by part and then by order; nobody sorts more than one part of a key.

    Rows are numbered within their part; how many rows the parts before have is a sum over one row a part.
    """
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias("_lf_n")).withColumn("_lf_before", F.coalesce(F.sum("_lf_n").over(before), F.lit(0))).drop("_lf_n")
    own = F.row_number().over(Window.partitionBy(key, part).orderBy(order))
    return rows.withColumn("_lf_own", own).join(counts, [key, part]).withColumn(name, F.col("_lf_before") + F.col("_lf_own")).drop("_lf_own", "_lf_before")


def read_csv_statement(spark: SparkSession, path: str | list[str], width: int = 64) -> DataFrame:
    """Parsed rows of CSV files, each with a header of its own, in one scan. Missing fields are null; rows without a date stay.

    Records may have line feeds within quotes and ``width`` cells at most; a file without records gives no rows.
    """
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.csv(path, header=False, schema=cells, multiLine=True, escape='"')
    return csv_files(raw.select(F.col("_metadata.file_path").alias("file_id"), F.monotonically_increasing_id().alias("_lf_no"), F.array(*[F.col(c) for c in cells.names]).alias("cells")))


def csv_files(records: DataFrame) -> DataFrame:
    """Parsed rows of records (file_id, _lf_no, cells): the first record of each file is its header, by which the others are read."""
    head = records.groupBy("file_id").agg(F.min_by("cells", "_lf_no").alias("_lf_head"), F.min("_lf_no").alias("_lf_first"))
    w = records.join(head.select("file_id", "_lf_first", field_places(F.col("_lf_head")).alias("_lf_at")), "file_id").filter(F.col("_lf_no") > F.col("_lf_first"))
    return csv_fields(w, lambda name: F.when(F.col(f"_lf_at.{name}").isNotNull(), F.get("cells", F.col(f"_lf_at.{name}") - 1)))


def csv_rows(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Parsed rows of a table with one bank's header, a ``file_id`` and the order ``_lf_no``."""

    def field(name: str) -> Column:
        c = header_column(columns, name)
        return F.col(f"`{c}`") if c else F.lit(None).cast("string")

    return csv_fields(raw, field)


def csv_fields(raw: DataFrame, field: Callable[[str], Column]) -> DataFrame:
    """Parsed rows whose fields ``field`` gives as texts.

    ``source_row`` counts from 2, the line after the header. An amount of zero is null here.
    """
    money = lambda n: F.nullif(s.parse_amount(field(n)), F.lit(0).cast(s.MONEY))
    no = F.row_number().over(Window.partitionBy("file_id").orderBy("_lf_no")) + 1
    return parsed(
        raw.select(
            "file_id",
            s.parse_date(field("txn_date")).alias("txn_date"),
            s.strip(F.coalesce(field("narration"), F.lit(""))).alias("narration_raw"),
            money("debit").alias("debit"),
            money("credit").alias("credit"),
            money("balance").alias("balance"),
            s.strip(F.coalesce(field("reference"), F.lit(""))).alias("reference"),
            no.alias("source_row"),
        )
    )


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with all columns of PARSED in their order and types; those it lacks are null, texts ''."""
    empty = {"balance_type", "reference", "txn_mode", "counterparty_name", "narration_raw"}
    out = []
    for field in T._parse_datatype_string(schema.PARSED).fields:
        c, kind = field.name, field.dataType
        if c in df.columns:
            out.append(F.coalesce(F.col(c), F.lit("")).alias(c) if c in empty else F.col(c).cast(kind).alias(c))
        elif c == "quality_flag":
            out.append(s.quality_flag(F.lit(None).cast("string"), F.col("narration_raw")).alias(c))
        else:
            out.append((F.lit("") if c in empty else F.lit(None).cast(kind)).alias(c))
    return df.select(*out)


def read_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, lines): each file's lines in order, any line ends; bytes that aren't UTF-8 are replaced."""
    raw = spark.read.text(path, wholetext=True).withColumn("file_id", F.col("_metadata.file_path"))
    return raw.select("file_id", F.split("value", r"\r\n|\r|\n").alias("lines"))


def read_rpt_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, line_no from 1, text)."""
    return read_text_files(spark, path).select("file_id", F.posexplode("lines").alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line_no"), "text")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, part, _lf_p, text) of text files of any size: each byte range of a file is read by a task of its own.

    The reader begins at the first line of its range; ``part`` is where the range begins and ``_lf_p`` the number of the line in the
    file, from 0. Lines end in line feeds, carriage returns or both; bytes that aren't UTF-8 are replaced.
    """
    return numbered_lines(ranges_of_files(spark.read.text(path)))


def ranges_of_files(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("text"))


def numbered_lines(raw: DataFrame) -> DataFrame:
    """(file_id, part, _lf_p, text) of ``ranges_of_files``, not yet moved between tasks.

    A range is read by one task, so its rows have numbers without gaps; what is summed by file is one row a range.
    """
    raw = staged(raw.withColumn("_lf_id", F.monotonically_increasing_id()))
    before = F.sum("_lf_n").over(Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = raw.groupBy("file_id", "part").agg(F.count(F.lit(1)).alias("_lf_n"), F.min("_lf_id").alias("_lf_first"))
    parts = staged(parts.select("file_id", "part", (F.coalesce(before, F.lit(0)) - F.col("_lf_first")).alias("_lf_shift")))
    return raw.join(parts, ["file_id", "part"]).select("file_id", "part", (F.col("_lf_id") + F.col("_lf_shift")).alias("_lf_p"), "text")


def wide_line(text: Column) -> Column:
    return (F.length(text) > 140) & F.substring(text, 132, 24).rlike(r"\d.*?(Cr|Dr)")


#: What each of the first ten lines with text has to hold (fixed values).
DELIMITED = {"pipe": r"\|", "tab": "\t", "multispace": r"\s{2,}"}


def detect_rpt_format(lines: Column) -> Column:
    """fixed, pipe, tab, multispace or generic, for an array of lines."""
    wide = F.size(F.filter(lines, wide_line))
    sample = F.slice(F.filter(lines, lambda x: s.strip(x) != ""), 1, 10)
    every = lambda p: (F.size(sample) > 0) & F.forall(sample, lambda x: x.rlike(p))
    return F.coalesce(F.when(wide >= 2, "fixed"), *[F.when(every(p), kind) for kind, p in DELIMITED.items()], F.lit("generic"))


def detect_formats(lines: DataFrame) -> DataFrame:
    """(file_id, format) of lines (file_id, _lf_p, text): the same rule as ``detect_rpt_format``, without a file in one place."""
    first = Window.partitionBy("file_id").orderBy("_lf_p")
    sample = lines.filter(s.strip(F.col("text")) != "").withColumn("_lf_k", F.row_number().over(first)).filter("_lf_k <= 10")
    every = sample.groupBy("file_id").agg(*[F.bool_and(F.col("text").rlike(p)).alias(kind) for kind, p in DELIMITED.items()])
    wide = lines.groupBy("file_id").agg(F.count_if(wide_line(F.col("text"))).alias("_lf_wide"))
    kind = F.coalesce(F.when(F.col("_lf_wide") >= 2, "fixed"), *[F.when(F.col(k), k) for k in DELIMITED], F.lit("generic"))
    return wide.join(every, "file_id", "left").select("file_id", kind.alias("format"))


def numbered(files: DataFrame) -> DataFrame:
    return files.select("file_id", "format", F.posexplode("lines").alias("_lf_p", "text"))


def counted(df: DataFrame) -> DataFrame:
    """``source_row``: the number of the row among a file's kept rows."""
    if "part" in df.columns:
        return numbered_in_parts(staged(df), "file_id", "part", "_lf_p", "source_row")
    return df.withColumn("source_row", F.row_number().over(Window.partitionBy("file_id").orderBy("_lf_p")))


def with_names(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_mode", s.extract_mode(F.col("narration_raw"))).withColumn("counterparty_name", s.extract_counterparty(F.col("narration_raw")))


def parse_fixed_width(lines: DataFrame, layout: str | dict[str, tuple[int, int]] = "corrected") -> DataFrame:
    """Parsed rows of (file_id, _lf_p, text); ``layout`` names or gives begin and end of each field.

    Header and footer lines, lines of under 100 characters and lines without a date are
    left out; a field that ends beyond its line is ''.
    """
    places = LAYOUTS[layout] if isinstance(layout, str) else layout
    line = F.rtrim(F.regexp_replace("text", r"\s+$", ""))
    w = once(lines, "_lf_line", line).filter((F.length("_lf_line") >= 100) & ~F.col("_lf_line").rlike(REPORT_LINES))

    def field(name: str) -> Column:
        a, b = places[name]
        return F.when(F.length("_lf_line") >= b, s.strip(F.substring("_lf_line", a + 1, b - a))).otherwise("")

    w = once(w, "txn_date", s.parse_date(field("gl_date"))).filter("txn_date is not null")
    extra = F.to_json(F.struct(field("value_date").alias("value_date"), field("instrument").alias("instrument_number"), field("entry_user").alias("entry_user_id"), F.col("text").alias("raw_line")))
    w = w.select(
        *[c for c in ("file_id", "part", "_lf_p") if c in w.columns],
        "txn_date",
        s.parse_date(field("value_date")).alias("value_date"),
        field("particulars").alias("narration_raw"),
        s.parse_amount(field("debit")).alias("debit"),
        s.parse_amount(field("credit")).alias("credit"),
        s.parse_amount(field("balance")).alias("balance"),
        s.parse_balance_type(field("balance")).alias("balance_type"),
        field("instrument").alias("reference"),
        extra.alias("bank_json_data"),
    )
    return parsed(with_names(counted(w)))


def rows_of_cells(w: DataFrame) -> DataFrame:
    """Fields of a ``cells`` array: date, narration, debit, credit, balance, reference."""
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    w = w.withColumn("txn_date", s.parse_date(cell(0))).filter("txn_date is not null")
    w = w.withColumns({"narration_raw": cell(1), "debit": s.parse_amount(cell(2)), "credit": s.parse_amount(cell(3)), "balance": s.parse_amount(cell(4)), "balance_type": s.parse_balance_type(cell(4)), "reference": cell(5)})
    return with_names(w.withColumn("bank_json_data", F.to_json(F.struct(F.col("text").alias("raw_line")))))


def parse_delimited(lines: DataFrame) -> DataFrame:
    """Parsed rows of (file_id, format, _lf_p, text) with pipes, tabs or runs of spaces; ``source_row`` is the line's number."""
    strip_all = lambda c: F.transform(c, s.strip)
    cells = (
        F.when(F.col("format") == "pipe", strip_all(F.split("text", r"\|")))
        .when(F.col("format") == "tab", strip_all(F.split("text", "\t")))
        .otherwise(F.split(s.strip(F.col("text")), r"\s{2,}"))
    )
    return parsed(rows_of_cells(lines.withColumn("cells", cells)).withColumn("source_row", F.col("_lf_p") + 1))


def parse_text_lines(lines: DataFrame) -> DataFrame:
    """Parsed rows of lines split at runs of spaces, those that begin with a date; no reference."""
    w = rows_of_cells(lines.withColumn("cells", F.split(s.strip(F.col("text")), r"\s{2,}"))).withColumn("reference", F.lit(""))
    return parsed(counted(w))


def parse_rpt(files: DataFrame, layout: str = "corrected") -> DataFrame:
    """Parsed rows of whole text files (file_id, lines), each by its format."""
    n = numbered(files.withColumn("format", detect_rpt_format(F.col("lines"))))
    fixed = parse_fixed_width(n.filter("format = 'fixed'"), layout)
    cells = parse_delimited(n.filter("format in ('pipe', 'tab', 'multispace')"))
    return fixed.unionByName(cells).unionByName(parse_text_lines(n.filter("format = 'generic'")))


def parse_report_files(spark: SparkSession, path: str | list[str], layout: str = "corrected") -> DataFrame:
    """Parsed rows of text files, each by its format, that are read, numbered and parsed in byte ranges: no task holds a file."""
    return parse_ranges(read_lines(spark, path), layout)


def parse_ranges(lines: DataFrame, layout: str = "corrected") -> DataFrame:
    """Parsed rows of lines numbered by file and byte range (file_id, part, _lf_p, text), each file by its format."""
    n = lines.join(staged(detect_formats(lines)), "file_id")
    fixed = parse_fixed_width(n.filter("format = 'fixed'"), layout)
    cells = parse_delimited(n.filter("format in ('pipe', 'tab', 'multispace')"))
    return fixed.unionByName(cells).unionByName(parse_text_lines(n.filter("format = 'generic'")))


def store_transactions(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Writes parsed rows: texts without nulls, the quality flag set."""
    texts = [c for c in ("narration_raw", "balance_type", "reference", "txn_mode", "counterparty_name") if c in rows.columns]
    out = rows.fillna("", texts).withColumn("quality_flag", s.quality_flag(F.col("quality_flag"), F.col("narration_raw")))
    out.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)
