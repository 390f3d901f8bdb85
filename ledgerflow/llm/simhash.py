"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that differ
in two bits at most differ in one at most within some segment, so every fingerprint
looks up the ball of radius one around each of its segments in a table of all
segments; hits are verified by their complete distance. Classes of linked
fingerprints come from star contraction, each step written to shared storage.

Copies have one fingerprint and enter once. A segment value that more than ``dense``
fingerprints share isn't expanded into pairs: two fingerprints differ in two bits at
most exactly if some point lies within one bit of both, so those fingerprints are
linked through the points of their complete balls of radius one (65 each), which
gives the same classes with links in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected_components

#: Shingles hashed at a time: bounds the memory of a long text.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text; 0 without words.

    Shingles of ``shingle`` words with repeats (fewer words: the whole sequence); a
    bit is 1 if it is set in over half of the XXH64 values.
    """
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    total = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        h = np.fromiter((digest(join(w[i : i + shingle]), seed) for i in range(k, k + m)), dtype="<u8", count=m)
        total += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def add_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``simhash`` long; the text stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t, shingle, seed) for t in b.column(text).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, "simhash"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("simhash", T.LongType())]))


def flips(col: str, bits: int) -> Column:
    """The value itself and each value with one more of its ``bits`` low bits set.

    Of two values that differ in one bit, one has a 0 there; its probe meets the other.
    """
    c = F.col(col)
    more = [F.when(c.bitwiseAND(F.lit(1 << b)) == 0, c.bitwiseOR(F.lit(1 << b))) for b in range(bits)]
    return F.array_compact(F.array(c, *more))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_pairs(prints: DataFrame, dense: int = 64, radius: int = 2) -> DataFrame:
    """Links (src, dst) between distinct fingerprints whose classes are those of distance <= 2.

    ``prints``: one column ``simhash``, distinct. Segments of at most ``dense``
    fingerprints give verified pairs, the others links through balls (see above).
    """
    low = F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("simhash", 32)
    table = prints.select("simhash", F.inline(F.array(F.struct(F.lit(0).alias("part"), low.alias("key")), F.struct(F.lit(1).alias("part"), high.alias("key")))))
    table = written(table)
    probes = table.select("part", F.col("simhash").alias("probe"), F.explode(flips("key", 32)).alias("key"))
    sizes = table.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.filter(F.col("n") <= dense).select("part", "key")
    many = written(sizes.filter(F.col("n") > dense).select("part", "key"))
    sparse = table.join(few, ["part", "key"], "left_semi")
    pairs = probes.join(sparse, ["part", "key"]).filter((F.col("probe") != F.col("simhash")) & (distance("probe", "simhash") <= radius))
    pairs = pairs.select(F.least("probe", "simhash").alias("src"), F.greatest("probe", "simhash").alias("dst"))
    # Whoever looks up a crowded segment value is linked through its complete ball.
    crowd = probes.join(many, ["part", "key"], "left_semi").select(F.col("probe").alias("simhash")).union(table.join(many, ["part", "key"], "left_semi").select("simhash")).distinct()
    s = F.col("simhash")
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    balls = crowd.select("simhash", F.explode(F.array(s, *[s.bitwiseXOR(F.lit(b).cast("long")) for b in bits])).alias("point"))
    centre = balls.groupBy("point").agg(F.min("simhash").alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("point", "src")
    through = balls.join(centre, "point").filter(F.col("src") != s).select("src", s.alias("dst"))
    return pairs.union(through).distinct()


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, seed: int = 42, dense: int = 64) -> DataFrame:
    """Adds ``simhash``, ``component_id`` (smallest id reachable) and ``representative``.

    ``representative`` is true for one row of each class: the one with the smallest
    id, and of rows with equal ids one of them. Null ids are never the smallest unless a
    class has no other (``component_id`` is null then). Texts without words have the
    fingerprint 0 and form classes like others. Fingerprints link at two differing
    bits or fewer. An empty table gives an empty one; input columns with the names of
    results are replaced.
    """
    df = df.drop("simhash", "component_id", "representative")
    marked = written(add_fingerprints(df, text, shingle, seed).withColumn("_lf_row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col(doc_id).isNull().alias("null"), F.col(doc_id).alias("id"), F.col("_lf_row").alias("row")))
    prints = written(marked.groupBy("simhash").agg(first.alias("first")))
    links = connected_components(near_pairs(prints.select("simhash"), dense))
    labelled = prints.join(links.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("_lf_label", F.coalesce("component", "simhash"))
    tops = labelled.groupBy("_lf_label").agg(F.min("first").alias("_lf_first"))
    classes = labelled.select("simhash", "_lf_label").join(tops, "_lf_label").select(F.col("simhash").alias("_lf_print"), "_lf_first")
    return (
        marked.join(classes, F.col("simhash") == F.col("_lf_print"))
        .withColumn("component_id", F.col("_lf_first.id"))
        .withColumn("representative", F.col("_lf_row") == F.col("_lf_first.row"))
        .drop("_lf_print", "_lf_first", "_lf_row")
    )
