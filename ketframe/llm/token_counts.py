"""Token counts by a map-side two-tier lookup.

First tier: a compact table of frequent pre-tokens and their numbers of tokens, broadcast. It holds
the vocabulary's own whole-word entries: a BPE vocabulary is the list of the units that were most
frequent in its training, so the table needs no pass over the corpus and is bounded by the
vocabulary file. Second tier: pre-tokens that miss it are encoded once per Python worker and kept
there. There is no shuffle at all: one pass of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.llm.bpe import Bpe, Cache
from ketframe.session import ship

_MARK = "\x00"


def frequent_lengths(tokenizer: str) -> tuple[str, bytes]:
    """The first tier of a vocabulary: its pre-tokens joined by U+0000, and a byte with each one's length.

    Entries that aren't a pre-token of their own, aren't text, or are long, are left to the second tier.
    """
    bpe = Bpe.of(tokenizer)
    pieces, lengths = [], []
    for i in range(bpe.tokenizer.get_vocab_size()):
        piece = bpe.tokenizer.decode([i], skip_special_tokens=False)
        if "�" in piece or _MARK in piece or bpe.pieces(piece) != [piece]:
            continue
        n = len(bpe.ids(piece))
        if n < 256:
            pieces.append(piece)
            lengths.append(n)
    return _MARK.join(pieces), bytes(lengths)


def token_counter(spark: SparkSession, tokenizer: str):
    """A Column function: number of tokens of a whole text (null: 0), special strings as the library's default has it."""
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(tokenizer))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe.of(tokenizer)
        kept = _kept.get(tokenizer)
        if kept is None:
            pieces, lengths = table.value
            kept = _kept[tokenizer] = _TwoTier(dict(zip(pieces.split(_MARK), lengths, strict=True)), lambda p: len(bpe.ids(p)))
        look = kept.__getitem__
        for part in parts:
            yield pd.Series([0 if t is None else sum(map(look, bpe.pieces(t))) for t in part], dtype="int64")

    return count


class _TwoTier(dict):
    """The frequent table; what misses it goes to the worker's own cache."""

    def __init__(self, frequent: dict, value):
        super().__init__(frequent)
        self.rare = Cache(value)

    def __missing__(self, piece: str) -> int:
        return self.rare[piece]


_kept: dict[str, _TwoTier] = {}


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty. Rows stay as they are: repeated rows, null ids and other columns
    pass through; columns of the three new names are replaced. An empty table gives an empty one.
    """
    count = token_counter(docs.sparkSession, tokenizer)
    body: Column = F.col(text)
    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(body), F.lit(0)).cast("long"), "n_tokens": count(body)}).withColumn("over_limit", F.col("n_tokens") > limit)
