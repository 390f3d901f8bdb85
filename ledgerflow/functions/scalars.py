"""Column functions for dates, amounts, modes, names and narrations.

Every function takes and returns Columns; nothing here runs Python on the executors.
Raw text is never cast plainly: what can't be read becomes null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Fixed values.
DATE_FORMATS = ("d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d/MMM/yyyy", "yyyy-M-d")
SHORT_YEAR_FORMATS = ("d-MMM-yy", "d/M/yy", "d-M-yy")
MODES = (
    (r"\bRTGS\b|^RTGS", "RTGS"),
    (r"\bNEFT\b", "NEFT"),
    (r"\bIMPS\b|^IMPS", "IMPS"),
    (r"\bUPI\b", "UPI"),
    (r"\bCASH\b", "CASH"),
    (r"\bCHQ\b|\bCHEQUE\b", "CHQ"),
    (r"\bDD\b", "DD"),
)
OCR_MODES = (
    (r"NEFT[A-Z]?|NEETO|NEVTO|NESTO|NRETO|NEPIO|NEET[^A-Z]", "NEFT"),
    (r"RTGS[A-Z]?|RIGS|RUGS|RYGS|ATGS", "RTGS"),
    (r"\bIMPS\b", "IMPS"),
    (r"\bUPI\b", "UPI"),
    (r"\bCASH\b", "CASH"),
    (r"\bCHQ\b|\bCHEQUE\b", "CHQ"),
)
BANKING_PREFIXES = ("NEFT/", "RTGS/", "IMPS/", "UPI/", "BY ORDER OF", "TRANSFER TO", "CREDIT BY", "DEBIT BY", "TOWARDS", "BEING")

# Letters read for digits in dates, the parts of a date in glued words, digits misread for 0 as the
# first of a day or month, and what may stand for the fourth digit of a year.
DATE_LETTERS = ("ILOGCUBS", "11000085")
ROBUST_DATE = r"(?Ud)^[^\w]*([0-9a-zA-Z]{1,2})[-/\\~=\s_.]*([0-9a-zA-Z]{1,2})[-/\\~=\s_.]*([0-9a-zA-Z]{3,4})(.*)"
ZERO_LIKE = "985632"
FOURTH_DIGITS = "89BLS"

#: Condition, year and rest of a misread date; the first that holds.
YEAR_RULES = (
    (lambda x: (x["year"] == "2019") & x["next"].isin("5", "8", "3"), lambda x: F.lit("2018"), lambda x: F.concat(F.lit("8"), x["trail"])),
    (lambda x: (F.length(x["year"]) == 4) & x["year"].rlike(r"\D"), lambda x: F.lit("2018"), lambda x: x["trail"]),
    (lambda x: (x["year"].try_cast("int") > 2026) & x["year"].startswith("207"), lambda x: F.concat(F.lit("201"), F.substring(x["year"], 4, 1)), lambda x: x["trail"]),
    (lambda x: x["year"].try_cast("int") > 2026, lambda x: F.lit("2018"), lambda x: x["trail"]),
    (lambda x: F.lit(True), lambda x: x["year"], lambda x: x["trail"]),
)


def strip(x: Column) -> Column:
    """``x`` without white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_match(x: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern occurs in ``x`` (any case), else ''."""
    cases = [F.when(x.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules]
    return F.coalesce(*cases, F.lit(""))


def parse_date(raw: Column) -> Column:
    """A date in any of the known formats, the first that fits; two-digit years from 69 on are of the 1900s."""
    x = strip(raw)
    full = [F.when(x.rlike(r"\d{4}"), F.try_to_date(x, f)) for f in DATE_FORMATS]
    short = []
    for f in SHORT_YEAR_FORMATS:
        d = F.when(x.rlike(r"[-/]\d{2}$"), F.try_to_date(x, f))
        short.append(F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
    return F.coalesce(*full, *short)


def parse_time(raw: Column) -> Column:
    """``HH:mm:ss`` of H:M:S or H:M, else null."""
    x = strip(raw)
    pattern = r"^([01]?\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d))?$"
    part = lambda k: F.lpad(F.regexp_extract(x, pattern, k), 2, "0")
    return F.when(x.rlike(pattern), F.concat_ws(":", part(1), part(2), part(3)))


def parse_amount(raw: Column) -> Column:
    """A decimal without separators and without a final Cr or Dr; null for '', '-' or other text."""
    x = F.regexp_replace(F.regexp_replace(raw, r"[,\s]", ""), r"(?i)(cr|dr)$", "")
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x).try_cast(MONEY)


def parse_balance_type(raw: Column) -> Column:
    """``Cr`` or ``Dr`` at the end, else ''."""
    return F.initcap(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)(cr|dr)\s*$", 1))


def extract_mode(narration: Column) -> Column:
    return first_match(F.coalesce(narration, F.lit("")), MODES)


def extract_mode_ocr(text: Column) -> Column:
    """As ``extract_mode``, for misread text (reference and particulars)."""
    return first_match(F.coalesce(text, F.lit("")), OCR_MODES)


def extract_counterparty(narration: Column) -> Column:
    """The name after ``NEFT-OW/ref/``, ``RTGS-OW/ref/``, ``NEFT-`` or ``RTGS`` at the start, else ''."""
    x = F.coalesce(narration, F.lit(""))
    out = r"(?i)^(?:NEFT|RTGS)-OW/[^/]+/(.+)"
    plain, joined = r"(?i)^NEFT-(.+)", r"(?i)^RTGS(.+)"
    return (
        F.when(x.rlike(out), strip(F.regexp_extract(x, out, 1)))
        .when(x.rlike(plain), strip(F.regexp_extract(x, plain, 1)))
        .when(x.rlike(joined), F.regexp_replace(strip(F.regexp_extract(x, joined, 1)), r"^[-/ ]+", ""))
        .otherwise("")
    )


def extract_counterparty_ocr(particulars: Column) -> Column:
    """Particulars without their mode; '' for charges, customers and nothing."""
    x = strip(F.regexp_replace(F.coalesce(particulars, F.lit("")), r"(?i)^(?:NEFT[O-Z]?|RTGS[O-Z]?|IMPS|UPI)[:\s\-]*", ""))
    return F.when(x.rlike(r"(?i)charges\s+for|customer|^$"), "").otherwise(x)


def working_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays in [start, end); 0 if end isn't later."""
    n = F.datediff(end, start)
    rest = n % 7
    wd = F.weekday(start)  # Monday is 0
    extra = F.greatest(F.least(wd + rest, F.lit(5)) - F.least(wd, F.lit(5)), F.lit(0)) + F.greatest(wd + rest - 7, F.lit(0))
    return F.when(n > 0, F.call_function("div", n, F.lit(7)).cast("int") * 5 + extra).otherwise(0)


def clean_narration(narration: Column) -> Column:
    """Without banking prefixes (in their order, anywhere, any case), white space collapsed."""
    x = F.coalesce(narration, F.lit(""))
    # Most narrations have no prefix, and plain searches tell that far sooner than patterns do. What is upper case in other
    # alphabets only may be found too; no replacement changes it.
    without = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), BANKING_PREFIXES, x)
    return collapse(F.when(reduce(or_, (F.upper(x).contains(p) for p in BANKING_PREFIXES)), without).otherwise(x))


def is_numeric_narration(narration: Column) -> Column:
    return F.regexp_replace(F.coalesce(narration, F.lit("")), " ", "").rlike(r"^\d+$")


def amount_or_zero(debit: Column, credit: Column) -> Column:
    """Debit unless it is null or zero, else credit likewise, else 0."""
    zero = F.lit(0).cast(MONEY)
    return F.coalesce(F.nullif(debit, zero), F.nullif(credit, zero), zero)


def normalize_for_matching(name: Column) -> Column:
    """Upper case, every run of other than A-Z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^A-Z0-9]+", " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger number of distinct tokens; 0 if either has none."""
    t1, t2 = (F.array_remove(F.array_distinct(F.split(x, " ")), "") for x in (a, b))
    most = F.greatest(F.size(t1), F.size(t2))
    return F.when((F.size(t1) > 0) & (F.size(t2) > 0), F.size(F.array_intersect(t1, t2)) / most).otherwise(0.0)


def robust_date(words: Column, most_words: int = 4) -> Column:
    """(txn_date, trail, n_words): the date that the fewest first words of a line begin with, glued together; null if none do.

    Parts of the date are read with ``DATE_LETTERS`` as digits. A day or month too large loses a first
    digit of ``ZERO_LIKE``; a year of three digits takes its fourth from the rest, and ``YEAR_RULES``
    mend the others. ``trail`` is what follows the date in the words used. Null or empty words have no date.
    """
    letters = lambda x: F.translate(F.upper(x), *DATE_LETTERS)

    def number(x: Column, most: int) -> Column:
        n = x.try_cast("int")
        return F.when((n > most) & F.substring(x, 1, 1).isin(*ZERO_LIKE), n % 10).otherwise(n)

    def split(x: Column) -> Column:
        part = [F.regexp_extract(x["text"], ROBUST_DATE, k) for k in range(1, 5)]
        rest = strip(part[3])
        return F.struct(x["n"].alias("n"), letters(part[0]).alias("day"), letters(part[1]).alias("month"), letters(part[2]).alias("year"), part[3].alias("trail"), rest.alias("rest"), F.substring(rest, 1, 1).alias("next"))

    def whole_year(x: Column) -> Column:
        short = (F.length(x["year"]) == 3) & x["year"].startswith("20")
        taken = short & x["next"].isin(*FOURTH_DIGITS)
        year = F.when(taken, F.concat(x["year"], letters(x["next"]))).when(short, F.concat(x["year"], F.lit("8"))).otherwise(x["year"])
        return x.withField("year", year).withField("trail", F.when(taken, F.regexp_replace(x["rest"], r"^.", "")).otherwise(x["trail"]))

    def mended(x: Column) -> Column:
        cases = [F.when(holds(x), F.struct(F.coalesce(year(x), F.lit("")).alias("year"), trail(x).alias("trail"))) for holds, year, trail in YEAR_RULES]
        return x.withField("mended", F.coalesce(*cases))

    def made(x: Column) -> Column:
        day = F.format_string("%04d-%02d-%02d", x["mended"]["year"].try_cast("int"), number(x["month"], 12), number(x["day"], 31)).try_cast("date")
        return F.struct(day.alias("txn_date"), x["mended"]["trail"].alias("trail"), x["n"].alias("n_words"))

    found = F.filter(F.sequence(F.lit(1), F.lit(most_words)), lambda n: n <= F.size(words))
    found = F.transform(found, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), "").alias("text")))
    # A step of its own for each value that the next one uses twice: within lambdas nothing is computed once for several uses.
    # Words without a date go first: a cast that fails costs far more than one that succeeds.
    found = F.filter(F.transform(found, split), lambda x: x["day"] != "")
    for step in (whole_year, mended, made):
        found = F.transform(found, step)
    return F.get(F.filter(found, lambda x: F.year(x["txn_date"]) >= 2000), 0)


def extract_ocr_date(line: Column, window: int = 35, first_year: int = 2015, last_year: int = 2030) -> Column:
    """A date in the first characters of a misread line: O, o, Q, D for 0, S for 5, ``~`` for ``-``."""
    digit = "[0-9OoQDS]"
    pattern = rf"({digit}{{1,2}})\s*[-~]\s*({digit}{{1,2}})\s*[-~]\s*({digit}{{2,4}})"
    head = F.substring(line, 1, window)
    d, m, y = (F.translate(F.regexp_extract(head, pattern, k), "OoQDS", "00005").try_cast("int") for k in (1, 2, 3))
    y = F.when(y < 100, y + 2000).otherwise(y)
    made = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when((y >= first_year) & (y <= last_year), made)


def extract_ocr_amounts(line: Column) -> Column:
    """Struct of balance, balance_type and txn_amount: the last amount of a line and the last but one.

    The suffixes dr, pr, or count as Dr, and cr, ck, 0r as Cr.
    """
    pattern = r"(\d{1,3}(?:[,\s]\d{2,3})*)\s*[.\-]\s*(\d{2})\s*([a-zA-Z]{0,2})"
    whole, cents, suffix = (F.regexp_extract_all(line, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))

    def value(k: int) -> Column:
        return F.concat_ws(".", F.regexp_replace(F.try_element_at(whole, F.lit(k)), r"[,\s]", ""), F.try_element_at(cents, F.lit(k))).try_cast("double")

    s = F.lower(F.try_element_at(suffix, F.lit(-1)))
    kind = F.when(s.isin("dr", "pr", "or"), "Dr").when(s.isin("cr", "ck", "0r"), "Cr").otherwise("")
    return F.struct(value(-1).alias("balance"), kind.alias("balance_type"), value(-2).alias("txn_amount"))


def fuzzy_date(token: Column) -> Column:
    """dd-mm-yyyy of a misread token that begins with a date, else ''; days are checked up to 31 only."""
    c = r"[\dOoCcQlIiSsBbgG]"
    found = F.regexp_extract(F.coalesce(token, F.lit("")), rf"^({c}{{2}}[-~]{c}{{2}}[-~]{c}{{4}})", 1)
    s = F.translate(found, "~OoCcQlIiSsBbgG", "-00000111155886")
    d, m, y = F.substring(s, 1, 2).try_cast("int"), F.substring(s, 4, 2).try_cast("int"), F.substring(s, 7, 4).try_cast("int")
    return F.when(d.between(1, 31) & m.between(1, 12) & y.between(2010, 2030), s).otherwise("")


def fix_amount_ocr(raw: Column) -> Column:
    """Text of an amount with misread signs and separators put right."""
    s = F.translate(strip(raw), "—~=€£©¢", "---6606")
    s = strip(F.regexp_replace(s, r"(?i)(cr|dr)\s*$", ""))
    s = F.regexp_replace(s, r"^(.*)[,\- ](..)$", "$1.$2")
    fee = F.regexp_replace(s, r"[\s,.]", "").isin("6116", "616", "6l6", "6I6")
    return F.when(fee, "6.16").otherwise(F.regexp_replace(s, "0{4,}", "000"))


def parse_amount_ocr(raw: Column) -> Column:
    s = F.regexp_replace(fix_amount_ocr(raw), r"(?i)[a-z\s]+$", "")
    s = F.regexp_replace(s, r"[^\d.\-]", "")
    return F.when(s.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), s).try_cast(MONEY)


def balance_type_ocr(raw: Column) -> Column:
    """CR or DR at the end, with misreadings; any other letter at the end is CR."""
    s = strip(F.coalesce(raw, F.lit("")))
    plain, near = F.upper(F.regexp_extract(s, r"(?i)(cr|dr)$", 1)), F.upper(F.regexp_extract(s, r"([a-zA-Z])R$", 1))
    return (
        F.when(plain != "", plain)
        .when(near.isin("P", "O", "B", "D"), "DR")
        .when(near == "C", "CR")
        .when(s.rlike("[a-zA-Z]$"), "CR")
        .otherwise("")
    )


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with one decimal, halves to the even digit; ``0%`` of nothing."""
    n = part * 1000
    tenths, rest = F.call_function("div", n, whole), n % whole * 2
    up = (rest > whole) | ((rest == whole) & (tenths % 2 == 1))
    tenths = tenths + F.when(up, 1).otherwise(0)
    return F.when(whole > 0, F.format_string("%d.%d%%", F.call_function("div", tenths, F.lit(10)), tenths % 10)).otherwise("0%")


def quality_flag(flag: Column, narration: Column) -> Column:
    """The parser's flag if any, else LOW_NARRATION for fewer than three characters, else ''."""
    low = F.length(strip(F.coalesce(narration, F.lit("")))) < 3
    return F.coalesce(blank_to_null(flag), F.when(low, F.lit("LOW_NARRATION")), F.lit(""))
