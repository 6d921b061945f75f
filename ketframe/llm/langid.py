"""Language identification by interpolated Kneser-Ney character models.

One model a language, learnt from a bounded sample of labelled documents, over the letters of
lower-cased words (``^`` before a word, ``$`` after it). N-grams are 64-bit hashes in sorted arrays;
the languages share the keys and have a column each. A text gets the language under which its
cross-entropy per symbol is least; one whose cross-entropy lies beyond what held-out documents of
that language show is rejected.

A word's score doesn't depend on its neighbours, so each Python worker keeps the scores of the words
it has met, and a text costs one look-up a word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.session import ship

_letters = re.compile(r"[^\W\d_]+").findall
#: Numbers that the classes above take for letters: a half, a raised two, Roman numerals. The first plane apart, whose characters one look-up tells.
_NUMBERS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")]
_numbers, _far_numbers = (re.compile("[" + "".join(c for c in _NUMBERS if (c > "\uffff") == far) + "]+") for far in (False, True))
_far = re.compile("[\U00010000-\U0010ffff]").search


def words_of(text: str) -> list[str]:
    """Runs of letters (the Unicode class L). Numbers that aren't digits are cut out first: in one pattern they would be tried one by one at each character."""
    if not text.isascii():
        text = _numbers.sub(" ", text)
        if _far(text):
            text = _far_numbers.sub(" ", text)
    return _letters(text)


#: Symbols that any model reckons with; an unseen one gets its share of the unigram discount.
ALPHABET = 4096
_START, _END = 1, 2
#: A worker forgets its words beyond this many.
CACHE_WORDS = 250_000
#: Characters of text scored together (more if one text is longer).
SLICE = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words with ^ and $, one after another; each one's place in its word."""
    text = "".join("\x01" + w + "\x02" for w in words)
    sym = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    place = np.arange(sym.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sym, place


def _ngrams(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each symbol (meaningful where they fit the word)."""
    out, h = [], np.zeros(sym.size, np.uint64)
    for n in range(order):
        back = np.concatenate([np.zeros(n, np.uint64), sym[: sym.size - n]])
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n + 1))
        out.append(h)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted array, and which of them are true."""
    if not keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


def _kneser_ney(counts: Counter, order: int) -> tuple[list, list, float]:
    """One language: per order (hashes, probabilities) and (context hashes, back-off weights), and an unseen symbol's probability."""
    words = list(counts)
    sym, place = _symbols(words)
    weight = np.repeat(np.fromiter(counts.values(), np.float64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    grams, predicted = _ngrams(sym, order), place > 0
    raw = []  # per order: hash, suffix hash, context hash, starts a word, count
    for n in range(1, order + 1):
        ok = predicted & (place >= n - 1)
        at = np.flatnonzero(ok)
        keys, first, inverse = np.unique(grams[n - 1][at], return_index=True, return_inverse=True)
        one = at[first]
        raw.append((keys, grams[n - 2][one] if n > 1 else None, grams[n - 2][one - 1] if n > 1 else np.zeros(keys.size, np.uint64), place[one] == n - 1, np.bincount(inverse, weight[at], keys.size)))
    probs, backs, unseen = [], [], 1 / ALPHABET
    for n in range(1, order + 1):
        keys, suffix, context, starts, count = raw[n - 1]
        if n < order:  # a shorter n-gram counts once for each symbol seen before it; at a word's start nothing can stand before it
            at, hit = _find(keys, raw[n][1])
            count = np.where(starts, count, np.bincount(at[hit], minlength=keys.size))
        ones, twos = np.sum(count == 1), np.sum(count == 2)
        discount = ones / (ones + 2 * twos) if ones else 0.5
        ctx, inverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(inverse, count, ctx.size), np.bincount(inverse, minlength=ctx.size)
        off = np.minimum(discount, count)
        back = np.bincount(inverse, off, ctx.size) / np.maximum(total, 1e-300)
        if n == 1:
            unseen = float(back[0]) / ALPHABET if kinds.size else 1 / ALPHABET
            lower = 1 / ALPHABET
        else:
            lower = probs[-1][1][_find(probs[-1][0], suffix)[0]]
        probs.append((keys, (count - off) / total[inverse] + back[inverse] * lower))
        backs.append((ctx, back))
    return probs, backs, unseen


class Model:
    """Kneser-Ney models of several languages over shared sorted hash arrays."""

    def __init__(self, samples: dict[str, list[str]], order: int = 5):
        self.order, self.langs = order, sorted(samples)
        one = [_kneser_ney(Counter(w for t in samples[x] for w in words_of(t.lower())), order) for x in self.langs]
        self.unseen = np.array([m[2] for m in one])
        self.probs = [self._shared([m[0][n] for m in one], 0.0) for n in range(order)]
        self.backs = [self._shared([m[1][n] for m in one], 1.0) for n in range(order)]
        self.limit = np.full(len(one), np.inf)
        self.spread = np.zeros(len(one))
        self.heat = 0.05

    @staticmethod
    def _shared(columns: list, fill: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in columns]]))
        out = np.full((keys.size, len(columns)), fill)
        for j, (k, v) in enumerate(columns):
            out[np.searchsorted(keys, k), j] = v
        return keys, out

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row a word: its negative log-probability under each language, and its number of symbols."""
        sym, place = _symbols(words)
        grams = _ngrams(sym, self.order)
        p = np.empty((sym.size, len(self.langs)))
        keys, values = self.probs[0]
        at, hit = _find(keys, grams[0])
        p[:] = np.where(hit[:, None] & (values[at] > 0), values[at], self.unseen) if keys.size else self.unseen
        for n in range(2, self.order + 1):
            here = np.flatnonzero(place >= n - 1)
            at, hit = _find(self.backs[n - 1][0], grams[n - 2][here - 1])
            here, at = here[hit], at[hit]  # an unseen context changes nothing
            q = p[here] * self.backs[n - 1][1][at]
            keys, values = self.probs[n - 1]
            at, hit = _find(keys, grams[n - 1][here])
            p[here] = np.where(hit[:, None] & (values[at] > 0), values[at], q)
        loss = -np.log(p)
        loss[place == 0] = 0
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        out = np.add.reduceat(loss, np.cumsum(sizes) - sizes, axis=0)
        return np.column_stack([out, sizes - 1])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under each language, and its number of symbols."""
        if getattr(self, "_seen", None) is None or len(self._seen) > CACHE_WORDS:
            self._seen, self._table = {}, np.zeros((0, len(self.langs) + 1))
        seen, new, at, ends = self._seen, [], [], []
        for t in texts:
            for w in words_of(t.lower()) if t else ():
                i = seen.get(w)
                if i is None:
                    i = seen[w] = len(seen)
                    new.append(w)
                at.append(i)
            ends.append(len(at))
        for i in range(0, len(new), 50_000):
            self._table = np.concatenate([self._table, self.score_words(new[i : i + 50_000])])
        rows = np.zeros((len(at) + 1, len(self.langs) + 1))
        rows[1:] = self._table[np.array(at, np.int64)]
        np.cumsum(rows, axis=0, out=rows)
        ends = np.array(ends, np.int64)
        sums = rows[ends] - rows[np.concatenate([[0], ends[:-1]])] if ends.size else rows[:0]
        n = np.rint(sums[:, -1])
        return np.round(sums[:, :-1] / np.maximum(n, 1)[:, None], 9), n  # rounded: sums depend a little on the batch

    def calibrate(self, samples: dict[str, list[str]], trained: Model) -> None:
        """Limits and the score's sharpness, from documents that ``trained`` hasn't seen."""
        found = []
        for j, lang in enumerate(self.langs):
            h, n = trained.entropies(samples.get(lang, []))
            h, n = h[n > 0], n[n > 0]
            if len(h) < 3:
                continue
            own, mean = h[:, j], np.average(h[:, j], weights=n)
            self.spread[j] = np.sqrt(np.mean((own - mean) ** 2 * n))
            # what other languages' texts get here shows how far from home a text has to be; with one language, its letters at random
            other = [np.median(trained.entropies(t)[0][:, j]) for x, t in samples.items() if x != self.langs[j] and t]
            self.limit[j] = max(own.max(), mean + 6 * own.std(), mean + 0.8 * (min(other, default=2 * mean) - mean))
            found.append((h, j))
        heats = np.geomspace(0.005, 1, 24)
        fit = [sum(np.sum(-h[:, j] / t - np.log(np.exp((h.min(1)[:, None] - h) / t).sum(1)) + h.min(1) / t) for h, j in found) for t in heats]
        if found:
            self.heat = float(heats[int(np.argmax(fit))])

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        h, n = self.entropies(texts)
        if not self.langs:
            h = np.zeros((len(texts), 1))
        best = h.argmin(1)
        least, some = h[np.arange(len(best)), best], (n > 0) & bool(self.langs)
        score = 1 / np.exp((least[:, None] - h) / self.heat).sum(1)
        odd = ~some
        if self.langs:
            odd = odd | (least > self.limit[best] + 4 * self.spread[best] / np.sqrt(np.maximum(n, 1)))
        return pd.DataFrame({"lang": np.where(some, np.array([*self.langs, "und"], object)[np.where(some, best, -1)], "und"), "score": np.where(some, score, 0.0), "entropy": np.where(some, least, np.nan), "rejected": odd})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def learn(docs: DataFrame, per_lang: int = 240, longest: int = 20_000, order: int = 5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``per_lang`` whole documents of each label (chosen by hash, of at most ``longest`` characters).

    Documents without text, label or id, and those with crc32(id as text) mod 5 = 0, aren't learnt
    from. A quarter of the sample calibrates rejection and scores on a model of the rest; the model
    returned is then learnt from all of it.
    """
    key = F.xxhash64(F.lit(20), F.col(doc_id).cast("string"), F.col(text))
    usable = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % 5 != 0) & (F.length(text) <= longest))
    counts = {r["l"]: r["n"] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, order)
    # twice the wanted share, so that the smallest hashes are surely among them; then the rest is cut off
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * per_lang + 40) / n))])
    drawn = usable.filter(F.shiftrightunsigned(key, 2) <= (share[F.col(lang)] * float(1 << 62)).cast("long")).select(F.col(lang).alias("l"), F.col(text).alias("t"), key.alias("k")).toPandas()
    drawn = drawn.sort_values(["k", "t"]).groupby("l").head(per_lang)
    samples = {x: list(g["t"]) for x, g in drawn.groupby("l")}
    model = Model(samples, order)
    model.calibrate({x: t[::4] for x, t in samples.items()}, Model({x: [d for i, d in enumerate(t) if i % 4 or len(t) < 4] for x, t in samples.items()}, order))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1), cross_entropy and rejected.

    A null text, or one without letters, is `und`, scored 0 and rejected, as is every text if no
    language was learnt. Ties go to the first language by name. Columns of the new names are
    replaced; repeated rows and other columns pass through.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, entropy double, rejected boolean")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.tolist()
            sizes = (np.cumsum([len(t or "") for t in texts]) // SLICE).tolist()
            cuts = [0, *[i for i in range(1, len(texts)) if sizes[i] != sizes[i - 1]], len(texts)]
            yield pd.concat([sent.value.predict(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], ignore_index=True)

    out = docs.drop("lang_pred", "score", "cross_entropy", "rejected").withColumn("_found", label(F.col(text)))
    return out.select(*[c for c in out.columns if c != "_found"], F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.entropy").alias("cross_entropy"), F.col("_found.rejected").alias("rejected"))
