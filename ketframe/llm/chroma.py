"""Chroma audio fingerprints and their alignment.

A recording becomes frames of energy in the twelve pitch classes. Sixteen filters, sums over
rectangles of the frame image read off its integral image, look at sixteen frames at a time; each is
quantised to two bits in Gray code, which makes one packed 32-bit integer a frame. Two recordings
are aligned by the histogram of offsets at which they have equal integers, up to three of a query's bits
turned over, and held together by the share of differing bits at such offsets.

Equal fingerprints are one class before anything is compared, so copies cost nothing; offsets are
counted for queries only, in one sum that is made before it is shuffled.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.session import saved, ship

RATE, FRAME, HOP = 11_025, 4096, 1365
LOWEST, HIGHEST, CLASSES, WIDTH = 28.0, 3520.0, 12, 16
#: Steps of a filter's value in one; values lie within 4.1 of 0.
STEPS = 4096
#: Weights of five neighbouring frames in smoothing.
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
#: Frames aligned that a link needs at least, as a share of the shorter recording, and its highest share of differing bits.
OVERLAP, BIT_ERRORS = 0.5, 0.3
#: Bits of an integer that a query takes for unsure, and how many of them it turns over at once.
WEAK, TURNED = 6, 3


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, spread evenly over kinds, heights and widths."""
    return [(i % 6, (5 * i) % (CLASSES - h + 1), h, w) for i in range(16) for h in [2 + (i * 3) % 8] for w in [2 * (1 + (i * 5) % 8)]]


_chroma_of = None


def _bins() -> np.ndarray:
    """Which pitch class each frequency bin adds to, as a matrix."""
    global _chroma_of
    if _chroma_of is None:
        f = np.arange(FRAME // 2 + 1) * RATE / FRAME
        ok = (f >= LOWEST) & (f <= HIGHEST)
        note = np.zeros(f.size, int)
        note[ok] = np.rint(12 * np.log2(f[ok] / 440.0)).astype(int) % CLASSES
        _chroma_of = np.zeros((f.size, CLASSES), np.float32)
        _chroma_of[np.flatnonzero(ok), note[ok]] = 1
    return _chroma_of


def _samples(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], np.int16)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames of pitch-class energies, smoothed and of unit length; fewer samples than a frame give none."""
    n = (pcm.size - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, CLASSES), np.float32)
    x = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP][:n] * np.hamming(FRAME).astype(np.float32)
    energy = np.abs(np.fft.rfft(x, axis=1)) ** 2 @ _bins()
    if n >= _SMOOTH.size:
        energy = np.apply_along_axis(lambda c: np.convolve(c, _SMOOTH, "valid"), 0, energy)
    size = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(size > 1e-2, energy / np.maximum(size, 1e-9), 0)


def responses(frames: np.ndarray) -> np.ndarray:
    """The filters' values for every sixteen frames: log ratios of the sums of two parts of a rectangle."""
    n = frames.shape[0] - WIDTH + 1
    if n < 1:
        return np.zeros((0, 16))
    total = np.zeros((frames.shape[0] + 1, CLASSES + 1))
    total[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def box(a: int, b: int, y: int, z: int) -> np.ndarray:
        return total[t + b, z] - total[t + a, z] - total[t + b, y] + total[t + a, y]

    out = np.empty((n, 16))
    for i, (kind, y, h, w) in enumerate(filters()):
        u, v, m = w // 2, y + h, y + h // 2
        third = max(1, w // 3), max(1, h // 3)
        whole = box(0, w, y, v)
        part = [whole, box(0, w, y, m), box(0, u, y, v), box(0, u, y, m) + box(u, w, m, v), box(0, w, y + third[1], v - third[1]), box(third[0], w - third[0], y, v)][kind]
        rest = total[t + WIDTH, CLASSES] - total[t, CLASSES] - whole if kind == 0 else whole - part
        out[:, i] = np.log1p(part) - np.log1p(np.maximum(rest, 0))
    return out


def pack(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two Gray-coded bits a filter, sixteen filters to an integer."""
    level = (values[:, :, None] > cuts[None]).sum(2)
    gray = (level ^ (level >> 1)).astype(np.uint32)
    return (gray << (2 * np.arange(16, dtype=np.uint32))).sum(1, dtype=np.uint64).astype(np.uint32)


def weak_bits(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The ``WEAK`` bits of each integer that a little noise turns over first, five bits a number: those of the filters nearest to a cut."""
    away = np.abs(values[:, :, None] - cuts[None]) / np.maximum(cuts[:, 2] - cuts[:, 0], 1e-9)[None, :, None]
    cut = away.argmin(2)  # in Gray code the middle cut turns the upper bit over, the others the lower one
    bit = 2 * np.arange(16)[None] + (cut == 1)
    first = np.argsort(away.min(2), axis=1, kind="stable")[:, :WEAK]
    return (np.take_along_axis(bit, first, 1) << (5 * np.arange(WEAK))).sum(1).astype(np.int32)


def sound_of(numbers: np.ndarray) -> np.ndarray:
    """Numbers played as notes of one hop each: the decoder of a media column that the test tables lack."""
    key = np.clip(np.rint(np.asarray(numbers, float) * 48) + 18, 0, 35)
    step = np.repeat(110.0 * 2 ** (key / 12) / RATE, HOP)
    return (np.sin(2 * np.pi * np.cumsum(step)) * 12_000).astype(np.int16)


def measured(recordings: DataFrame, rec_id: str = "rec_id", pcm: str = "pcm", decode: Callable = _samples) -> DataFrame:
    """rec_id and levels: the sixteen filters' values in steps of 1 / ``STEPS``, 16-bit numbers one place of the frames after another (null for a null recording).

    ``decode`` makes 16-bit samples of a value of the media column, one recording at a time.
    """
    ship(recordings.sparkSession)

    @F.pandas_udf("binary")
    def levels_of(part: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.rint(responses(chroma(decode(x))) * STEPS).astype(np.int16).tobytes() for x in part], dtype=object)

    return recordings.select(F.col(rec_id).cast("long").alias("rec_id"), levels_of(F.col(pcm)).alias("levels"))


def _values(levels: bytes | None) -> np.ndarray:
    return np.frombuffer(levels or b"", np.int16).reshape(-1, 16) / STEPS


def cuts_of(levels: DataFrame) -> np.ndarray:
    """Quartiles of each filter over all of ``measured`` recordings: the quantiser.

    Executors count how often each value occurs; only the quartiles reach the driver. Without any
    value all are 0.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, base = np.zeros(16 << 16, np.int64), (np.arange(16) << 16) + (1 << 15)
        for part in parts:
            for x in part["levels"]:
                np.add.at(seen, (np.frombuffer(x, np.int16).reshape(-1, 16) + base).ravel(), 1)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"filter": (at >> 16).astype(np.int32), "level": (at & 0xFFFF) - (1 << 15), "n": seen[at]})

    counts = levels.filter("levels is not null").select("levels").mapInPandas(count, "filter int, level long, n long")
    out = np.zeros((16, 3))
    for r in counts.groupBy("filter").agg(F.expr("percentile(level, array(0.25, 0.5, 0.75), n)").alias("cuts")).collect():
        out[r["filter"]] = np.array(r["cuts"]) / STEPS
    return out


def prints_of(levels: DataFrame, cuts: np.ndarray) -> DataFrame:
    """rec_id, fp (array<int>, empty for a null or short recording) and weak (each integer's unsure bits) of ``measured`` recordings."""

    @F.pandas_udf("fp array<int>, weak array<int>")
    def print_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int32)
        for part in parts:
            values = [_values(x) for x in part]
            yield pd.DataFrame({"fp": [pack(v, cuts).view(np.int32) if len(v) else none for v in values], "weak": [weak_bits(v, cuts) if len(v) else none for v in values]})

    return levels.select("rec_id", print_of("levels").alias("f")).select("rec_id", "f.fp", "f.weak")


def learn_cuts(recordings: DataFrame, rec_id: str = "rec_id", pcm: str = "pcm", decode: Callable = _samples) -> np.ndarray:
    """The quantiser of all ``recordings``."""
    return cuts_of(measured(recordings, rec_id, pcm, decode))


def fingerprints(recordings: DataFrame, cuts: np.ndarray, rec_id: str = "rec_id", pcm: str = "pcm", decode: Callable = _samples) -> DataFrame:
    """rec_id, fp and weak of ``recordings``, as ``prints_of`` gives them."""
    return prints_of(measured(recordings, rec_id, pcm, decode), cuts)


def _probes() -> Column:
    """v, v with any one bit turned over, and with up to ``TURNED`` of its weak bits."""
    bit = lambda j: F.call_function("shiftleft", F.lit(1), j)
    weak = [bit(F.shiftright("weak", 5 * j).bitwiseAND(F.lit(31))) for j in range(WEAK)]
    flips = [(), *((bit(F.lit(j)),) for j in range(32)), *(some for n in range(2, TURNED + 1) for some in itertools.combinations(weak, n))]
    return F.array(*[functools.reduce(Column.bitwiseXOR, some, F.col("v")) for some in flips])


def align(prints: DataFrame, query_every: int = 20, overlap: float = OVERLAP, bit_errors: float = BIT_ERRORS) -> DataFrame:
    """For each recording (rec_id, fp, weak): class_id, n_prints, is_query, and for queries what they align with.

    class_id is the smallest id with an equal fingerprint. Recordings whose id is a multiple of
    ``query_every`` are searched among all: n_links counts the other recordings linked (copies included),
    best_id is the class of the linked one with fewest differing bits (of equals the smallest), with best_offset
    (its frame at the query's first) and best_errors. A recording without prints is linked with nothing,
    rows without id are never queries, rows that share id and print are one each.
    """
    prints = saved(prints.select("rec_id", "fp", "weak", F.xxhash64(F.lit(1), "fp").alias("h1"), F.xxhash64(F.lit(2), "fp").alias("h2")), "prints")
    is_query = F.coalesce(F.col("rec_id") % query_every == 0, F.lit(False))
    some = prints.filter(F.size("fp") > 0)
    classes = some.groupBy("h1", "h2").agg(F.min("rec_id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.max(is_query.cast("int")).alias("asked")).filter("class_id is not null")
    classes = saved(classes, "classes")
    one = some.join(classes, ["h1", "h2"]).filter("rec_id = class_id").select("class_id", "members", "asked", "fp", "weak").dropDuplicates(["class_id"])
    one = saved(one, "class_prints")
    at = one.select("class_id", "asked", F.posexplode(F.arrays_zip("fp", "weak")).alias("place", "z")).select("class_id", "asked", "place", F.col("z.fp").alias("v"), F.col("z.weak").alias("weak"))
    asked = at.filter("asked = 1").select(F.col("class_id").alias("q"), F.col("place").alias("q_place"), F.explode(_probes()).alias("v"))
    met = asked.join(at.select(F.col("class_id").alias("r"), "place", "v"), "v").filter("q <> r")
    offsets = met.groupBy("q", "r", (F.col("place") - F.col("q_place")).alias("offset")).agg(F.count(F.lit(1)).alias("equal"))
    left, right = one.select(F.col("class_id").alias("q"), F.col("fp").alias("q_fp")), one.select(F.col("class_id").alias("r"), F.col("fp").alias("r_fp"), "members")
    both = offsets.join(left, "q").join(right, "r")
    first, last = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("q_fp"), F.size("r_fp") - F.col("offset"))
    both = both.withColumns({"first": first, "n": last - first}).filter(F.col("n") >= overlap * F.least(F.size("q_fp"), F.size("r_fp")))
    pieces = F.zip_with(F.slice("q_fp", F.col("first") + 1, F.col("n")), F.slice("r_fp", F.col("first") + F.col("offset") + 1, F.col("n")), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    # bit_count takes the sign with it as 64 bits: only the low 32 of the difference count
    wrong = F.aggregate(pieces, F.lit(0), lambda t, k: t + F.when(k > 32, k - 32).otherwise(k))
    linked = both.withColumn("errors", wrong / (32.0 * F.col("n"))).filter(F.col("errors") <= bit_errors)
    best = linked.groupBy("q", "r", "members").agg(F.min(F.struct("errors", "offset")).alias("b"))
    found = best.groupBy("q").agg(F.sum("members").alias("others"), F.min(F.struct("b.errors", "r", "b.offset")).alias("b"))
    found = saved(found.select(F.col("q").alias("class_id"), "others", F.col("b.r").alias("best_id"), F.col("b.offset").alias("best_offset"), F.round("b.errors", 6).alias("best_errors")), "aligned_prints")
    rows = prints.join(classes.drop("asked"), ["h1", "h2"], "left").join(found, "class_id", "left")
    copies = F.coalesce(F.col("members") - 1, F.lit(0))
    when = lambda c: F.when(is_query, c)
    return rows.select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), F.size("fp").cast("long").alias("n_prints"), is_query.alias("is_query"), when(copies + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), when(F.col("best_id")).alias("best_id"), when(F.col("best_offset")).cast("long").alias("best_offset"), when(F.col("best_errors")).alias("best_errors"))

