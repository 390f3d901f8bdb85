"""Token counts by a two-tier lookup on the map side.

A first pass keeps the frequent pre-tokens of every task (lossy counting, a bounded
number each); their merged counts give the most frequent ``table_size`` overall, whose
token lengths are broadcast. The second pass adds up lengths from that table and
encodes what it misses, in batches, through a bounded cache of the worker. Pre-tokens
aren't shuffled: the only exchange holds each task's frequent ones. The table only
saves time; every length comes from the library.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How byte-level tokenizers split a text before the merges (fixed value).
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CACHED = 200_000
LONGEST = 64


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: itself if it prints, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Lengths(dict):
    """Token lengths of pre-tokens: the broadcast table, then a bounded cache of this worker."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.tokenizer = library(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table, self.room, self.sure = table, CACHED, set()

    def length(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= LONGEST:
            if self.room <= 0:
                self.clear()
                self.update(self.table)
                self.room = CACHED
            self[piece] = n
            self.room -= 1
        return n

    def unsure(self, text: str) -> bool:
        """Whether a text holds a character that ``unicodedata`` has as unassigned.

        Newer tables class some of those as letters or digits, others don't, so ``regex`` and
        the library may split them differently.
        """
        new = set(text) - self.sure
        odd = {c for c in new if unicodedata.category(c) == "Cn"}
        self.sure |= new - odd
        return bool(odd)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() and self.unsure(text) or any(s in text for s in self.special):
            return self.length(text)
        return sum(map(self.__getitem__, PIECES.findall(text)))


@lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer, which has to split and spell texts as byte-level models do."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = made["pre_tokenizer"] or {}
    if steps.get("type") != "ByteLevel" or not steps.get("use_regex", True) or steps.get("add_prefix_space") or made["normalizer"]:
        raise ValueError(f"{path} isn't a plain byte-level tokenizer")
    return Tokenizer.from_file(path)


def frequent_pieces(df: DataFrame, text: str, table_size: int, per_task: int = 32_768) -> dict[str, int]:
    """The most frequent pre-tokens of all texts and their counts, ``table_size`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(PIECES.findall(t or ""))
                if len(seen) > 16 * per_task:
                    seen = Counter(dict(seen.most_common(4 * per_task)))
        top = [(p, n) for p, n in seen.most_common(per_task) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    tops = df.select(text).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r.piece: r.n for r in tops.orderBy(F.desc("n"), "piece").limit(table_size).collect()}


def add_token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", table_size: int = 131_072, carry_text: bool = True) -> DataFrame:
    """Adds ``n_tokens`` long: the tokens of the whole text as the library gives them.

    Without begin, end or added special tokens, truncation or padding; special strings
    inside a text are handled as the library does by default. ``tokenizer_path`` names a
    byte-level BPE file of the library, present on every worker. A null or empty text has
    0 tokens; repeated rows are counted each; an empty table gives an empty one; an input
    column ``n_tokens`` is replaced.
    """
    df = df.drop("n_tokens")
    sc = df.sparkSession.sparkContext
    pieces = list(frequent_pieces(df, text, table_size))
    lengths = Lengths(tokenizer_path, {})
    table = sc.broadcast({p: lengths.length(p) for p in pieces})
    fields = [f for f in df.schema.fields if carry_text or f.name != text]
    names = [f.name for f in fields] + ["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lengths(tokenizer_path, table.value)
        for b in batches:
            n = pa.array([own.count(t) for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), n], names=names)

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
