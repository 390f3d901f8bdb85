"""The beneficiary of a transaction, from its narration.

Layer 1 splits the narration, takes noise out of the segments and picks the best-scored name,
all with column functions. Layer 2 takes names from a table of model responses. What neither
names is queued for review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

# Fixed values.
NOISE_WORDS = (
    "IMPS", "NEFT", "RTGS", "UPI", "TRANSFER", "PAYMENT", "DEBIT", "CREDIT", "BALANCE", "CHARGES", "INTEREST", "CLEARING", "MISC", "OTHERS", "UNKNOWN", "CASH",
    "UNREGISTERED", "OUT", "IN", "EMI", "PENDING", "NULL", "MOB", "TRF", "BY", "BILL", "TRANSACTION",
)
TYPE_WORDS = (
    ("COMPANY", ("LTD", "PVT", "INDUSTRIES", "MANUFACTURING", "CORP", "CORPORATION")),
    ("BANK", ("BANK", "HDFC", "ICICI", "AXIS", "SBI", "YESBANK", "KOTAK")),
    ("GOVERNMENT", ("GOVERNMENT", "DEPT", "MINISTRY", "MUNICIPAL", "CORPORATION")),
)
BANK_CODES = {
    "HDFC": "HDFC BANK", "KOTA": "KOTAK MAHINDRA BANK", "ICIC": "ICICI BANK", "AUBA": "AU SMALL FINANCE BANK", "RBLB": "RBL BANK", "SBIC": "STATE BANK OF INDIA",
    "AXIS": "AXIS BANK", "IBKL": "IDBI BANK", "BARB": "BANK OF BARODA", "PUNB": "PUNJAB NATIONAL BANK", "CNRB": "CANARA BANK", "UTIB": "AXIS BANK",
    "YESB": "YES BANK", "ANDB": "ANDHRA BANK", "CORP": "CORPORATION BANK", "IDIB": "INDIAN BANK", "IOBA": "INDIAN OVERSEAS BANK", "ORBC": "ORIENTAL BANK OF COMMERCE",
    "UBIN": "UNION BANK OF INDIA", "VIJB": "VIJAYA BANK", "SDRB": "SIDBI", "SYNB": "SYNDICATE BANK", "ALLA": "ALLAHABAD BANK", "FDRL": "FEDERAL BANK",
    "HSBC": "HSBC BANK", "SCBL": "STANDARD CHARTERED BANK", "KKBK": "KOTAK MAHINDRA BANK", "INDB": "INDUSIND BANK", "MAHB": "BANK OF MAHARASHTRA", "UCOB": "UCO BANK",
    "CBIN": "CENTRAL BANK OF INDIA", "BOTM": "MUFG BANK", "CITI": "CITIBANK", "DBSS": "DBS BANK", "ESAF": "ESAF SMALL FINANCE BANK", "JSBP": "JANALAKSHMI COOPERATIVE BANK",
    "KARB": "KARNATAKA BANK", "KVBL": "KARUR VYSYA BANK", "LAVB": "LAXMI VILAS BANK", "NBLD": "NOIDA COMMERCIAL COOPERATIVE BANK", "PMEC": "PRIME COOPERATIVE BANK",
    "SIBL": "SOUTH INDIAN BANK", "TJSB": "TJSB SAHAKARI BANK", "TMBL": "TAMILNAD MERCANTILE BANK", "VARB": "VARACHHA COOPERATIVE BANK", "VYSA": "ING VYSYA BANK",
}
THRESHOLDS = {"HIGH": 0.85, "MEDIUM": 0.60, "LOW": 0.0}
RULE_CONFIDENCE = 0.90
BASIS = "Universal Tokenization & Subtraction"
NOISE = r"(?i)\b(?:" + "|".join(NOISE_WORDS) + r")\b"
CODES = r"(?i)\b\d{5,}\b|\b[A-Z]{4}0[A-Z0-9]{6}\b|\b\d{2}-\d{2}-\d{4}\b"


def subtract_noise(segment: Column) -> Column:
    """A segment without payment words, codes, dates, numbers and account-like tokens."""
    x = segment
    for p in (NOISE, CODES, r"[\-\.]+", r"\b[\d,\.]*\d[\d,\.]*\b", r"\b[A-Z]{1,6}\d+[A-Z0-9]*\b"):
        x = F.regexp_replace(x, p, " ")
    return s.collapse(x)


def name_facts(name: Column) -> Column:
    """What the rules for names ask of a text, found once: the text, its length, its digits and its words."""
    words = F.array_remove(F.split(F.upper(F.trim(name)), " +"), "")
    digits = F.length(name) - F.length(F.translate(name, "0123456789", ""))
    return F.struct(name.alias("name"), F.length(name).alias("size"), digits.alias("digits"), words.alias("words"))


def valid_facts(f: Column) -> Column:
    n, size, digits, words = f["name"], f["size"], f["digits"], f["words"]
    return (
        size.between(2, 100)
        & (digits < size)
        & ~((size > 8) & (digits / size > 0.40))
        & ~((size > 20) & ~F.trim(n).contains(" "))
        & ~((F.size(words) == 1) & (digits > 0))
        & ~((F.size(words) > 0) & F.forall(words, lambda w: w.isin(*NOISE_WORDS)))
        & ~((digits > 0) & n.rlike(r"\s+\d+$"))
        & n.rlike(r"\p{L}")
    )


def is_valid_name(name: Column) -> Column:
    """Whether a text may be a name: 2 to 100 characters, a letter, not mainly digits or one long token."""
    return valid_facts(name_facts(F.coalesce(name, F.lit(""))))


def name_points(name: Column) -> Column:
    up = F.upper(name)
    letters = name.rlike(r"^[A-Za-z\s]+$")
    return (
        F.length(name)
        + F.when(up.contains("BANK"), 5).otherwise(0)
        + F.when(up.contains("PVT") | up.contains("LTD") | up.contains("INDUSTRIES"), 5).otherwise(0)
        + F.when(letters & name.contains(" "), 7).when(letters, 4).otherwise(0)
    )


def best_candidate(names: Column) -> Column:
    """The first of the names with the most points, null if there are none."""
    return F.array_max(F.transform(names, lambda n, i: F.struct(name_points(n), -i, n.alias("name"))))["name"]


def classify_beneficiary(name: Column) -> Column:
    up = F.upper(name)
    cases = [F.when(up.rlike("|".join(words)), F.lit(kind)) for kind, words in TYPE_WORDS]
    return F.coalesce(*cases, F.lit("INDIVIDUAL"))


def normalize_name(name: Column) -> Column:
    """Upper case with single spaces; a routing code becomes its bank's name."""
    n = s.collapse(F.upper(name))
    codes = F.create_map(*[F.lit(x) for kv in BANK_CODES.items() for x in kv])
    bank = F.when(n.rlike(r"^[A-Z]{4}[A-Z0-9]{7,11}$"), F.try_element_at(codes, F.substring(n, 1, 4)))
    return F.coalesce(bank, n)


def raw_beneficiary(narration: Column) -> Column:
    n = s.strip(F.coalesce(narration, F.lit("")))
    facts = F.transform(F.transform(F.split(n, "/|:| - | -|  +"), subtract_noise), name_facts)
    names = F.transform(F.filter(facts, lambda f: (f["size"] > 3) & valid_facts(f)), lambda f: f["name"])
    return F.when(F.length(n) >= 2, best_candidate(names))


def extract_beneficiary(txns: DataFrame, narration: str = "narration_raw") -> DataFrame:
    """Adds ``raw_name``, ``beneficiary_name``, ``beneficiary_type``, ``confidence``, ``layer`` and ``basis``, null without a name."""
    w = txns.withColumn("raw_name", raw_beneficiary(F.col(narration)))
    named = lambda c: F.when(F.col("raw_name").isNotNull(), c)
    return w.withColumns(
        {
            "beneficiary_name": normalize_name(F.col("raw_name")),
            "beneficiary_type": named(classify_beneficiary(F.col("raw_name"))),
            "confidence": named(F.lit(RULE_CONFIDENCE)),
            "layer": named(F.lit("LAYER_1")),
            "basis": named(F.lit(BASIS)),
        }
    )


def eligible_transactions(txns: DataFrame, threshold: float = 100_000) -> DataFrame:
    """Transactions with a debit or credit of ``threshold`` or more."""
    t = F.lit(str(threshold)).cast(s.MONEY)
    return txns.filter((F.col("debit") >= t) | (F.col("credit") >= t))


def parse_llm_results(responses: DataFrame) -> DataFrame:
    """(transaction_id, beneficiary_name, beneficiary_type, confidence, basis) of responses that name one.

    A response may have text around its JSON object. HIGH, MEDIUM and any other confidence
    are 0.90, 0.70 and 0.40; the type is UNKNOWN unless given.
    """
    body = F.from_json(F.regexp_extract("response_text", r"(?s)(\{.*\})", 1), "beneficiary_name string, beneficiary_type string, confidence string, extraction_basis string")
    w = responses.withColumn("r", body)
    level = F.upper(F.coalesce("r.confidence", F.lit("LOW")))
    return w.filter("r.beneficiary_name <> ''").select(
        "transaction_id",
        normalize_name(F.col("r.beneficiary_name")).alias("beneficiary_name"),
        F.coalesce("r.beneficiary_type", F.lit("UNKNOWN")).alias("beneficiary_type"),
        F.when(level == "HIGH", 0.90).when(level == "MEDIUM", 0.70).otherwise(0.40).alias("confidence"),
        F.coalesce("r.extraction_basis", F.lit("LLM extraction")).alias("basis"),
    )


def cascade_layers(txns: DataFrame, llm: DataFrame | None = None, level: str = "HIGH") -> DataFrame:
    """Names of layer 1 where sure enough, else of layer 2, else none; adds ``status``.

    status: IDENTIFIED_LAYER1, IDENTIFIED_LAYER2 or REVIEW. ``llm`` comes from ``parse_llm_results``
    and is joined to the rows that layer 1 leaves.
    """
    least = THRESHOLDS[level]
    w = extract_beneficiary(txns)
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    done = w.filter(sure).withColumn("status", F.lit("IDENTIFIED_LAYER1"))
    rest = w.filter(~sure)
    fields = ("beneficiary_name", "beneficiary_type", "confidence", "basis")
    if llm is None:
        kept = rest.withColumn("_lf_ok", F.lit(False)).withColumns({f"_lf_{f}": F.lit(None) for f in fields})
    else:
        best = llm.filter(F.col("confidence") >= least).groupBy("transaction_id").agg(F.min(F.struct(*fields)).alias("l"))
        best = best.select(F.col("transaction_id").alias("id"), *[F.col(f"l.{f}").alias(f"_lf_{f}") for f in fields])
        kept = rest.join(best, "id", "left").withColumn("_lf_ok", F.col("_lf_beneficiary_name").isNotNull())
    ok = F.col("_lf_ok")
    kinds = dict(w.dtypes)
    kept = kept.withColumns({f: F.when(ok, F.col(f"_lf_{f}")).cast(kinds[f]) for f in fields} | {"layer": F.when(ok, F.lit("LAYER_2")), "status": F.when(ok, "IDENTIFIED_LAYER2").otherwise("REVIEW")})
    kept = kept.withColumn("raw_name", F.col("beneficiary_name"))
    return done.unionByName(kept.select(done.columns))


def review_queue(cascaded: DataFrame) -> DataFrame:
    """(id, statement_id, narration_raw, amount, txn_type) of what no layer named."""
    zero = F.lit(0).cast(s.MONEY)
    return cascaded.filter("status = 'REVIEW'").select(
        "id", "statement_id", "narration_raw", s.amount_or_zero(F.col("debit"), F.col("credit")).alias("amount"), F.when(F.coalesce("debit", zero) != 0, "DEBIT").otherwise("CREDIT").alias("txn_type")
    )


def engine_statistics(cascaded: DataFrame) -> DataFrame:
    """By statement: eligible, identified by each layer, pending, and the rate in percent."""
    n = lambda k: F.count_if(F.col("status") == k)
    out = cascaded.groupBy("statement_id").agg(F.count(F.lit(1)).alias("eligible"), n("IDENTIFIED_LAYER1").alias("layer1"), n("IDENTIFIED_LAYER2").alias("layer2"), n("REVIEW").alias("pending"))
    return out.withColumn("rate", s.percent(F.col("layer1") + F.col("layer2"), F.col("eligible")))
