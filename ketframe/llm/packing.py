"""Packing by shortest-pack-first over the length histogram.

Every document is tokenised once and cut into pieces of at most ``capacity`` tokens, so the rest of
the work sees a few numbers per piece. The histogram of piece lengths has at most ``capacity``
entries, whatever the corpus; the packing patterns are made from it on the driver, lengths longest
first, each into the packs with the most room. Pieces then get a rank within their length, and
the rank says which pack of which pattern, and which place in it, is theirs.

Ranks are made in two levels (a number within a hash bucket, plus the sizes of earlier buckets), so
a length that holds a large share of all pieces is spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ketframe.llm.bpe import Bpe, Cache
from ketframe.session import saved, ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns of a length histogram: (number of packs, [(length, copies), ...]).

    Lengths are placed longest first. Each goes to the pattern with the most room left; where none
    has room for it, to new packs. A length splits at most one pattern into three and opens at most
    two, so there are at most 4 patterns a length.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            most = max((r for r, p in room.items() if p), default=0)
            if most < length:
                packs, pattern, most = None, [], capacity
            else:
                packs, pattern = room[most].pop()
            each = most // length
            full, rest = divmod(left, each)
            if packs is not None and full >= packs:
                full, rest = packs, 0
            if packs is not None and (spare := packs - full - (rest > 0)):
                room[most].append((spare, pattern))
            for n, copies in ((full, each), (1 if rest else 0, rest)):
                if n:
                    room[most - copies * length].append((n, [*pattern, (length, copies)]))
            left -= full * each + rest
    return [p for r in sorted(room) for p in room[r]]


def placements(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each run of equal lengths in a pattern: which ranks of that length it takes, and where they go."""
    rows, used, sequence = [], defaultdict(int), 0
    for packs, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += packs * copies
            offset += length * copies
        sequence += packs
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "copies", "offset"), cols, strict=True))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece of each document's ids (a null text is empty), ``end_id`` behind the last."""
    ship(docs.sparkSession)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = Bpe.of(tokenizer)
        kept = _kept.get(tokenizer)
        if kept is None:
            kept = _kept[tokenizer] = Cache(lambda p: np.array(bpe.ids(p), "<u4").tobytes())
        look, last = kept.__getitem__, np.array([end_id], "<u4").tobytes()
        for part in parts:
            rows = []
            for key, body in zip(part["k"], part["t"], strict=True):
                ids = b"".join(map(look, bpe.pieces(body))) + last if body is not None else last
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    stop = min(n, start + capacity)
                    rows.append((key, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(cut, PIECES)


_kept: dict[str, Cache] = {}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    null or empty text is the one end id. Repeated rows and null ids are documents of their own.
    Equal pieces are interchangeable. Other columns of ``docs`` aren't read; an empty table gives
    an empty one. Each id lies in exactly one piece, and sequences have no gaps.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, doc_id, text)
    pieces = saved(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    # at most `capacity` rows, each a count
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = spark.sparkContext.broadcast(placements(pack_histogram(histogram, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = place.value
        size, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((p["length"] << 44) + p["first"], (size << 44) + rank, side="right") - 1
        k = rank - p["first"][at]
        return pd.DataFrame({"sequence_id": p["sequence"][at] + k // p["copies"][at], "offset": p["offset"][at] + k % p["copies"][at] * size})

    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = pieces.withColumn("number", number).join(before, ["length", "bucket"]).withColumn("seat", seat("length", F.col("before") + F.col("number") - 1))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "seat.sequence_id", "seat.offset")
