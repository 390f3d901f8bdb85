"""Recognised words and lines of scanned pages to parsed rows.

Everything is by page. Only the grouping of words into lines, whose lines move as words
join, and the repair of dates run as small vectorized helpers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as s
from ..functions.staging import once, staged
from ..functions.helpers import group_lines
from ..sources.files import parsed, with_names
from .balance import balance_suspect, correct_from_balance

PAGE = ("file_id", "page_no")
# Fixed values.
SKIPPED_LINES = (
    r"(?i)page \d+ of|account:|opening balance|brought forward|report for the period|report to|service outlet|account number|union bank|punjab national"
    r"|finacle|^\s*date\s|particulars.*debit.*credit|^\s*[|;.\]]\s*$"
)
SKIPPED_BOX_LINES = (
    r"(?i)service\s+outlet|account\s+num(ber)?|customer\s+id|brought\s+forward|opening\s+balance|union\s+bank|transaction\s+details|\bfinacle\b|https?://"
    r"|debit\s+amt|credit\s+amt|balance\s+amt|\bparticulars\b|\bcontra\b|account\s+opening|station\s+road|\brepor[t]\s+to\b|report\s+for\s+the\s+period"
)
HEADER_WORDS = (
    "Brought", "Forward", "Opening", "Tran", "Ref", "Balance", "Report", "UNION", "BANK", "Page", "Details", "Particulars",
    "REP", "Account", "Service", "Manager", "Signature", "finacle", "https", "Date",
)
#: Right borders of the column zones, of a page 1654 wide.
ZONES = {"ref": 370, "particulars": 750, "debit": 940, "credit": 1150}
ZONE_WIDTH = 1654
MONEY_TOKEN = r"^[\d,]+\.\d{2}(CR|DR)?$"
DIRTY_TOKEN = r"^[\d,]+\.\w{2}[A-Za-z]{0,3}$"
FUZZY_PREFIX = r"^[\dOoCcQlIiSsBbgG]{2}[-~][\dOoCcQlIiSsBbgG]{2}[-~][\dOoCcQlIiSsBbgG]{4}"


def skip_ocr_lines(lines: DataFrame, pattern: str = SKIPPED_LINES, least: int = 8) -> DataFrame:
    """Lines of at least ``least`` characters that aren't headers or footers, stripped."""
    return lines.withColumn("text", s.strip(F.col("text"))).filter((F.length("text") >= least) & ~F.col("text").rlike(pattern))


def carry_forward_date(lines: DataFrame) -> DataFrame:
    """Adds ``txn_date`` and ``date_carried``: a line without a date takes the last one above it on its page; lines before any go."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    own = s.extract_ocr_date(F.col("text"))
    out = lines.withColumn("_lf_own", own).withColumn("txn_date", F.last("_lf_own", ignorenulls=True).over(w))
    return out.withColumn("date_carried", F.col("_lf_own").isNull()).filter("txn_date is not null").drop("_lf_own")


def parse_ocr_lines(lines: DataFrame) -> DataFrame:
    """Parsed rows of recognised lines (file_id, page_no, line_no, text): balance and flags, no debit or credit."""
    w = carry_forward_date(skip_ocr_lines(lines)).withColumn("a", s.extract_ocr_amounts(F.col("text")))
    w = w.select("*", "a.*").drop("a").filter("balance is not null")
    w = balance_suspect(w)
    w = w.withColumn("source_row", F.row_number().over(Window.partitionBy("file_id").orderBy("page_no", "line_no")))
    extra = F.to_json(F.struct(F.col("text").alias("raw_line"), F.col("txn_amount").alias("ocr_txn_amount_guess"), F.col("date_carried").alias("date_carried_forward"), "balance_suspect", F.col("balance_diff").alias("balance_diff_from_prev")))
    return parsed(with_names(w.withColumn("bank_json_data", extra).withColumn("narration_raw", F.col("text")).withColumn("balance", F.col("balance").cast(s.MONEY))))


def angle_variances(bin_px: float):
    """For the places of a page's words the variance of their counts in bins of height under each angle, given by its tangent."""

    def one(x: np.ndarray, y: np.ndarray, turn: np.ndarray) -> list:
        heights = y - x * turn[:, None]
        placed = ~np.isnan(heights[0])
        lost = len(placed) - placed.sum()
        if not placed.any():
            return [None] * len(turn)
        h = np.sort(heights[:, placed], axis=1)
        at = np.floor((h - h[:, :1]) / bin_px)
        bins = at[:, -1] + 1
        # Equal bins stand together; the sum of squared counts needs where each run of them starts.
        edge = np.append(np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1], axis=1)
        start = np.flatnonzero(edge)
        runs = np.diff(np.append(start, edge.size))
        squares = np.add.reduceat(runs * runs, np.searchsorted(start, np.arange(len(at)) * h.shape[1]))
        mean = len(placed) / bins
        return ((squares + lost * lost) / bins - mean * mean).tolist()

    @F.pandas_udf("array<double>")
    def variances(left: pd.Series, top: pd.Series, tans: pd.Series) -> pd.Series:
        floats = lambda v: np.asarray(v, dtype="float64")
        return pd.Series([one(floats(x), floats(y), floats(t)) for x, y, t in zip(left, top, tans, strict=True)], dtype=object)

    return variances


def page_words(words: DataFrame) -> DataFrame:
    """(file_id, page_no, w): the words of each page as one array of structs, so that a page's words are exchanged once for all steps."""
    return words.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in words.columns if c not in PAGE])).alias("w"))


def with_angle(pages: DataFrame, bin_px: float = 4.0) -> DataFrame:
    """Adds ``angle`` to pages of words (``w``); pages without text go."""
    angles = [math.radians(-3.0 + 0.2 * k) for k in range(31)]
    tans = F.array(*[F.tan(F.lit(a)) for a in angles])
    found = pages.withColumn("_lf_t", F.filter("w", lambda x: F.trim(x["text"]) != "")).filter(F.size("_lf_t") > 0)
    found = found.withColumn("_lf_v", angle_variances(bin_px)(F.col("_lf_t.left"), F.col("_lf_t.top"), tans))
    best = F.array_max(F.transform("_lf_v", lambda v, k: F.struct(F.round(v, 9).alias("variance"), (-k).alias("k"))))
    return found.withColumn("angle", F.get(F.array(*map(F.lit, angles)), -best["k"])).drop("_lf_t", "_lf_v")


def skew_angle(words: DataFrame, bin_px: float = 4.0) -> DataFrame:
    """(file_id, page_no, angle): of 31 angles from -3 to 3 degrees the one under which the words' heights bunch most.

    The measure is the variance of the counts in bins of 4 px, empty bins included (words without a place are one more); ties go
    to the first. A page's words are exchanged once, not once for each angle.
    """
    return with_angle(page_words(words.select(*PAGE, "left", "top", "text").filter(F.trim("text") != "")), bin_px).select(*PAGE, "angle")


def deskew_words(words: DataFrame) -> DataFrame:
    """Adds ``top_adj`` and ``bottom_adj``, the heights on the upright page."""
    shift = F.col("left") * F.tan("angle")
    turned = with_angle(page_words(words)).select(*PAGE, "angle", F.inline("w"))
    return turned.withColumn("top_adj", F.col("top") - shift).withColumn("bottom_adj", F.col("top") + F.col("height") - shift).drop("angle")


def lines_of_page(top: np.ndarray, bottom: np.ndarray, height: np.ndarray, word_no: np.ndarray) -> np.ndarray:
    """The line of each word, numbered from the top by the mean height of the words."""
    order = np.lexsort((word_no, top))
    line = np.empty(len(top), int)
    line[order] = group_lines(top[order].tolist(), bottom[order].tolist(), height[order].tolist())
    there = ~np.isnan(top)
    with np.errstate(invalid="ignore"):
        mean = np.bincount(line[there], top[there], line.max() + 1) / np.bincount(line[there], minlength=line.max() + 1)
    return np.argsort(np.argsort(mean, kind="stable"))[line]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line_numbers(top: pd.Series, bottom: pd.Series, height: pd.Series, word_no: pd.Series, left: pd.Series, tan: pd.Series) -> pd.Series:
    """The lines of a page's words, whose heights are first moved by ``left`` times ``tan``."""
    floats = lambda v: np.asarray(v, dtype="float64")
    out = []
    for t, b, h, n, x, turn in zip(top, bottom, height, word_no, left, tan, strict=True):
        shift = floats(x) * turn
        out.append(lines_of_page(floats(t) - shift, floats(b) - shift, floats(h), np.asarray(n)).astype("int32"))
    return pd.Series(out, dtype=object)


def lined(pages: DataFrame, lines: Column) -> DataFrame:
    """The words of pages, each with its ``line``."""
    found = pages.withColumn("_lf_l", lines)
    return found.withColumn("w", F.transform("w", lambda x, k: x.withField("line", F.get("_lf_l", k)))).select(*PAGE, F.inline("w"))


def group_words_into_lines(words: DataFrame) -> DataFrame:
    """Adds ``line`` to deskewed words, numbered from the top by the mean height of each line's words."""
    w = F.col("w")
    return lined(page_words(words), line_numbers(w["top_adj"], w["bottom_adj"], w["height"], w["word_no"], w["top_adj"], F.lit(0.0)))


def zone_columns(words: DataFrame) -> DataFrame:
    """Parsed rows of words with lines: the date in front, the other columns by place; corrected by the balance of the page."""
    by = (*PAGE, "line")
    one = F.struct("left", "word_no", "text")
    lines = words.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("w"), F.first("page_width").alias("width"))
    lines = once(lines, "d", s.robust_date(F.transform(F.slice("w", 1, 4), lambda x: x["text"]))).filter("d.txn_date is not null")
    text = lambda c, sep: F.array_join(F.transform(c, lambda x: x["text"]), sep)
    lines = lines.withColumn("raw_line", text(F.col("w"), " ")).filter(~F.col("raw_line").rlike(SKIPPED_BOX_LINES))
    rest = F.slice("w", F.col("d.n_words") + 1, F.size("w"))
    lines = once(lines, "rest", rest)
    edge = {k: F.floor(F.col("width") * F.lit(v / ZONE_WIDTH)) for k, v in ZONES.items()}

    def zone(low: Column | None, high: Column | None) -> Column:
        inside = lambda x: (F.lit(True) if low is None else x["left"] >= low) & (F.lit(True) if high is None else x["left"] < high)
        return F.filter("rest", inside)

    ref = s.strip(text(zone(None, edge["ref"]), " "))
    texts = {
        "reference": F.when(F.coalesce("d.trail", F.lit("")) != "", F.col("d.trail")).otherwise(ref),
        "narration_raw": s.strip(text(zone(edge["ref"], edge["particulars"]), " ")),
        "debit_raw": text(zone(edge["particulars"], edge["debit"]), ""),
        "credit_raw": text(zone(edge["debit"], edge["credit"]), ""),
        "balance_raw": text(zone(edge["credit"], None), ""),
    }
    lines = once(lines, "z", F.struct(*[c.alias(name) for name, c in texts.items()])).select("*", "z.*")
    amounts = F.struct(*[s.parse_amount_ocr(F.col(f"{c}_raw")).alias(c) for c in ("debit", "credit", "balance")])
    lines = once(lines, "a", amounts)
    rows = lines.select(
        *PAGE,
        "line",
        F.col("d.txn_date").alias("txn_date"),
        "narration_raw",
        "reference",
        "a.debit",
        "a.credit",
        "a.balance",
        s.balance_type_ocr(F.col("balance_raw")).alias("balance_type"),
        s.extract_mode_ocr(F.concat_ws(" ", "reference", "narration_raw")).alias("txn_mode"),
        s.extract_counterparty_ocr(F.col("narration_raw")).alias("counterparty_name"),
        F.lit("OCR_UNION_BANK").alias("quality_flag"),
        F.to_json(F.struct(F.col("page_no").alias("page_num"), "raw_line", "debit_raw", "credit_raw", "balance_raw")).alias("bank_json_data"),
    ).filter("balance is not null")
    rows = rows.withColumn("source_row", F.row_number().over(Window.partitionBy("file_id").orderBy("page_no", "line")))
    return correct_from_balance(rows)


def parse_word_boxes(words: DataFrame) -> DataFrame:
    """Parsed rows of recognised words; the angle and the lines of a page are found on one array of its words."""
    words = words.filter(F.trim("text") != "").select(*PAGE, "word_no", "text", "left", "top", "height", "page_width")
    w, bottom = F.col("w"), F.transform("w", lambda x: x["top"] + x["height"])
    lines = line_numbers(w["top"], bottom, w["height"], w["word_no"], w["left"], F.tan("angle"))
    return parsed(zone_columns(lined(with_angle(page_words(words)), lines)))


def lines_from_words(words: DataFrame) -> DataFrame:
    """(file_id, page_no, line_key, top, words, text): recognised lines, their top the upper median of their words'."""
    by = (*PAGE, "block_num", "par_num", "line_num")
    one = F.struct("left", F.trim("text").alias("text"), "conf")
    g = words.filter(F.trim("text") != "").groupBy(*by).agg(F.sort_array(F.collect_list("top")).alias("tops"), F.array_sort(F.collect_list(one)).alias("words"))
    middle = F.get("tops", F.call_function("div", F.size("tops"), F.lit(2)).cast("int"))
    return g.select(*PAGE, F.struct("block_num", "par_num", "line_num").alias("line_key"), middle.alias("top"), "words", F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"))


def match_text_to_numeric_lines(text_lines: DataFrame, numeric_lines: DataFrame, header_px: float = 18, match_px: float = 30) -> DataFrame:
    """Rows of two passes over the same pages: amounts from the numeric lines, the rest from the nearest text line.

    A numeric line counts if it has two money tokens, the last with CR or DR, and no header
    line of the text pass within ``header_px``. Lines meet in buckets of height, so a page is no cross product.
    """
    money = F.filter("words", lambda x: x["text"].rlike(MONEY_TOKEN))
    n = numeric_lines.withColumn("m", money).filter(F.size("m") == 2)
    kind = F.regexp_extract(F.get("m", 1)["text"], "(CR|DR)$", 1)
    conf = F.transform(F.filter("m", lambda x: x["conf"] >= 0), lambda x: x["conf"])
    mean = F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf)).otherwise(0.0)
    n = n.select(*PAGE, "top", F.get("m", 0)["text"].alias("amount"), F.regexp_replace(F.get("m", 1)["text"], "(CR|DR)$", "").alias("balance"), kind.alias("dr_cr"), F.round(mean, 1).alias("confidence"), F.monotonically_increasing_id().alias("_lf_row")).filter("dr_cr <> ''")
    n = staged(n)  # read twice: the row numbers must be the same
    width = max(header_px, match_px)
    bucket = lambda c: F.floor(c / F.lit(width))
    header = F.exists("words", lambda x: x["text"].isin(*HEADER_WORDS))
    t = text_lines.select(*PAGE, F.col("top").alias("t_top"), F.col("words").alias("t_words"), header.alias("header")).withColumn("b", bucket(F.col("t_top")))
    near = n.withColumn("b", F.explode(F.array(*[bucket(F.col("top")) + k for k in (-1, 0, 1)]))).join(t, [*PAGE, "b"])
    gap = F.abs(F.col("top") - F.col("t_top"))
    found = near.groupBy("_lf_row").agg(F.bool_or(F.col("header") & (gap <= header_px)).alias("in_header"), F.min(F.when(gap <= match_px, F.struct(gap.alias("gap"), F.col("t_top"), F.col("t_words").alias("w")))).alias("best"))
    rows = n.join(found, "_lf_row", "left").filter(~F.coalesce("in_header", F.lit(False)))
    tokens = F.filter(F.transform("best.w", lambda x: F.regexp_replace(x["text"], r"^[;|.,]+|[;|.,]+$", "")), lambda x: x != "")
    rows = rows.withColumn("tokens", F.coalesce(tokens, F.array().cast("array<string>")))
    first = F.coalesce(*[F.when(s.fuzzy_date(F.get("tokens", F.lit(k))) != "", F.lit(k)) for k in range(3)])
    rows = rows.withColumn("at", first).withColumn("date", F.when(F.col("at").isNotNull(), s.fuzzy_date(F.get("tokens", F.col("at")))).otherwise(""))
    glued = F.regexp_replace(F.get("tokens", F.col("at")), FUZZY_PREFIX, "")
    seq = F.concat(F.when(glued != "", F.array(glued)).otherwise(F.array().cast("array<string>")), F.slice("tokens", F.col("at") + 2, F.size("tokens")))
    rows = rows.withColumn("seq", F.when(F.col("at").isNotNull(), seq))
    body = F.when(F.col("at").isNotNull(), F.slice("seq", F.lit(2), F.size("seq"))).otherwise(F.col("tokens"))
    words = F.filter(body, lambda x: ~x.rlike(MONEY_TOKEN) & ~x.rlike(DIRTY_TOKEN))
    return rows.select("file_id", F.col("page_no").alias("page"), "top", "date", F.coalesce(F.get("seq", 0), F.lit("")).alias("ref_num"), F.array_join(words, " ").alias("particulars"), "amount", "balance", "dr_cr", "confidence")


def best_orientation(passes: DataFrame) -> DataFrame:
    """(file_id, page_no, orientation, confidence): of several passes (with ``orientation``) the most confident; conf -1 doesn't count."""
    g = passes.filter("conf >= 0").groupBy(*PAGE, "orientation").agg(F.avg("conf").alias("confidence"))
    return g.groupBy(*PAGE).agg(F.max_by(F.struct("orientation", "confidence"), F.struct("confidence", -F.col("orientation"))).alias("b")).select(*PAGE, "b.*")


def page_texts(lines: DataFrame) -> DataFrame:
    """(file_id, page_no, text): the lines of each page in order."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))
