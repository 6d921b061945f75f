"""Removal of long repeated byte strings with suffix arrays.

Every byte covered by a string of ``span`` bytes that also starts elsewhere goes. One suffix array of a
large corpus can't be built, and comparing each shard's array with every other's would grow with the
square of the corpus, so shards are made by content:

1. Each string of ``span`` bytes holds a window of hashed ``gram``-byte grams; the smallest is its anchor.
   Equal strings have equal anchors at equal places, so whatever repeats does so around a shared anchor.
2. Anchors that occur once are done with. Occurrences whose whole context (all strings that
   have this anchor) is equal are one string with a count; a count of two settles it.
3. Different contexts of one anchor go to one shard. A shard sorts its suffixes by Larsson-Sadakane
   refinement, reads common prefixes by Kasai's recurrence, and marks starts of repeated strings. An
   anchor with many contexts is split into several parts; each is a shard, and between two of them the
   second's runs of equal strings are looked up in the first's array by binary search.
4. What a context loses holds for all its occurrences; documents take the union.

A large repeated group therefore never meets in one task, and a document's text moves twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.llm.native import row_key, small
from ketframe.llm.shingles import mix, powers
from ketframe.session import saved, ship

#: Contexts of one anchor in a part; an anchor with more is split.
PART = 400
#: Bytes of contexts that are sorted together (whole anchors, so somewhat more).
SHARD = 1_000_000
#: Bytes of text hashed together.
BATCH = 1 << 19


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over a[i : i + width] for each i; what reaches over the end is cut off."""
    out, reach = a.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        out[:-step] = pick(out[:-step], out[step:]) if step < out.size else out[:-step]
        reach += step
    return out


def anchors(texts: list[bytes], span: int, gram: int, scopes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, place, hash of the gram, hash of the context, back, ahead) of every anchor.

    The context is made of all strings of ``span`` bytes of which this is the anchor; it reaches
    from ``back`` bytes before the place to ``ahead`` bytes after it. Of equal smallest grams in a window
    all are anchors, so that nothing depends on where a text is cut. Texts of different ``scopes``
    have no hash in common.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.size or sizes.max() < span:
        return (np.zeros(0, np.int64),) * 6
    ends = np.repeat(np.cumsum(sizes), sizes)
    up, down = powers(data.size + 1)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    at = np.arange(data.size)
    grams = np.full(data.size, np.iinfo(np.uint64).max, np.uint64)
    n = data.size - gram + 1
    grams[:n] = mix((total[gram:] - total[:n]) * down[:n])
    if scopes is not None:
        grams[:n] = mix(grams[:n] ^ np.repeat(scopes.astype(np.int64).view(np.uint64), sizes)[:n])
    window = span - gram + 1
    least = _sliding(grams, window, np.minimum)
    least[at + span > ends] = 0  # no string of `span` bytes starts there
    most = _sliding(least[::-1], window, np.maximum)[::-1]
    place = np.flatnonzero((grams == most) & (at + gram <= ends) & (most > 0))
    # the strings of an anchor start side by side: a run of equal window minima
    begins = np.flatnonzero(np.diff(least, prepend=least[0] ^ np.uint64(1)) != 0)
    stops = np.append(begins[1:], least.size)
    run = np.searchsorted(stops, np.maximum(place - window + 1, 0), side="right")
    todo = np.flatnonzero(least[begins[run]] != grams[place])
    while todo.size:
        run[todo] += 1
        todo = todo[least[begins[run[todo]]] != grams[place[todo]]]
    a = np.maximum(begins[run], place - window + 1)
    b = np.minimum(stops[run] - 1, place) + span
    number = np.searchsorted(np.cumsum(sizes), place, side="right")
    first = (np.cumsum(sizes) - sizes)[number]
    a, back, ahead = np.maximum(a, first), place - np.maximum(a, first), b - place
    context = mix((total[b] - total[a]) * down[a] + mix((back * 65_536 + ahead).astype(np.uint64)))
    return number, place - first, grams[place].view(np.int64), context.view(np.int64), back, ahead


#: Bits of a place in a shard, so that two ranks and a place fit one sorted number.
_PLACE_BITS = 21


def _by(keys: np.ndarray, bits: int) -> np.ndarray:
    """Order of numbers of so many bits; sorted together with their places if both fit, which is several times faster."""
    if bits + _PLACE_BITS < 64 and keys.size < 1 << _PLACE_BITS:
        return np.sort((keys.astype(np.uint64) << np.uint64(_PLACE_BITS)) | np.arange(keys.size, dtype=np.uint64)).astype(np.int64) & ((1 << _PLACE_BITS) - 1)
    return np.argsort(keys)


def _heads(text: np.ndarray, left: np.ndarray, symbols: int, bits: int) -> np.ndarray:
    """The first symbols of each suffix in one number; those behind the string's 0 count as 0."""
    padded, first = np.concatenate([text, np.zeros(symbols - 1, np.int64)]), np.zeros(text.size, np.int64)
    for j in range(symbols):
        first = (first << bits) | padded[j : j + text.size]
    cut = np.array([sum(((1 << bits) - 1) << (bits * (symbols - 1 - j)) for j in range(d)) for d in range(symbols + 1)], np.int64)
    return first & cut[np.minimum(left, symbols)]


def _left(text: np.ndarray) -> np.ndarray:
    """Symbols from each place up to its string's 0."""
    ends = np.flatnonzero(text == 0)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(text.size)


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: suffixes in order of their first ``depth`` symbols, and each one's rank.

    ``text`` holds symbols from 1 up, and 0 behind each string; a suffix that reaches such a 0 within
    its first symbols is unlike all others. Each round doubles the sorted length and sorts only
    groups that are still equal; a group's rank is the place of its first member.
    """
    n, left = text.size, _left(text)
    used = np.zeros(int(text.max(initial=0)) + 1, np.int64)
    used[text] = 1
    used[0] = 0
    dense = np.cumsum(used) * used  # 1 up for the symbols that occur
    bits = max(1, int(dense.max(initial=0)).bit_length())
    reach = max(1, (63 - _PLACE_BITS) // bits)
    first = _heads(dense[text], left, reach, bits)
    near_end = left < reach
    order = _by(first, bits * reach)
    # of equal ends the earlier string's comes first
    at = np.flatnonzero(near_end[order])
    few = order[at]
    order[at] = few[np.lexsort((few, first[few]))]
    sorted_first, ended = first[order], near_end[order]
    same = np.zeros(n, bool)  # equal to the one before
    same[1:] = (sorted_first[1:] == sorted_first[:-1]) & ~ended[1:] & ~ended[:-1]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    open_at = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
    wide = n.bit_length()
    while reach < depth and open_at.size:
        members = order[open_at]
        # an open group's members haven't met their 0 within `reach`, so this stays inside the text
        key = (rank[members].astype(np.int64) << wide) | rank[members + reach]
        by = _by(key, 2 * wide)
        members, key = members[by], key[by]
        order[open_at] = members
        joined = np.zeros(open_at.size, bool)
        joined[1:] = key[1:] == key[:-1]
        rank[members] = np.maximum.accumulate(np.where(joined, 0, open_at))
        open_at = open_at[joined | np.concatenate([joined[1:], [False]])]
        reach *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: for each suffix, symbols in common with the one before it in ``order``, up to ``cap``.

    The recurrence (a suffix that loses its first symbol loses at most one common symbol) runs along
    all strings at once, seven symbols at a time. Suffixes shorter than ``cap`` aren't asked for and stay 0.
    """
    n, left = text.size, _left(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    seven = np.concatenate([_heads(text, left, 7, 9), np.zeros(cap + 8, np.int64)])
    now = np.zeros(starts.size, np.int64)
    for step in range(int(lengths.max(initial=0)) - cap):
        live = np.flatnonzero(lengths > step + cap)
        i = starts[live] + step
        j = before[i]
        most = np.minimum(np.minimum(left[i], left[j]), cap)  # no symbols in common behind a string's end
        have = np.where(j < 0, 0, np.maximum(now[live] - 1, 0))
        going = np.flatnonzero((j >= 0) & (have < most))
        while going.size:
            unlike = seven[i[going] + have[going]] ^ seven[j[going] + have[going]]
            top = (unlike & ~(unlike >> 1)).astype(np.float64)  # its highest bit is that of `unlike`, and it isn't rounded up
            have[going] += np.where(unlike == 0, 7, 6 - (np.frexp(top)[1] - 1) // 9)
            going = going[(unlike == 0) & (have[going] < most[going])]
        have = np.where(j < 0, 0, np.minimum(have, most))
        now[live] = have
        out[i] = have
    return out


class SuffixArray:
    """Sorted suffixes of some strings, in runs that agree in their first ``span`` bytes.

    ``codes[k] + place`` names a place of the corpus: overlapping contexts of one document hold the
    same places, which aren't repeats. Without ``places`` a code alone counts.
    """

    def __init__(self, strings: list[bytes], codes: np.ndarray, span: int, places: bool):
        self.span, self.lengths = span, np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.text[self.starts + self.lengths - 1] = 0
        self.order, _ = suffix_ranks(self.text, int(self.lengths.max(initial=1)))  # in full: Kasai's recurrence needs it
        prefix = common_prefixes(self.text, self.order, self.starts, self.lengths, span)
        self.name = np.repeat(codes - self.starts, self.lengths) + np.arange(self.text.size) if places else np.repeat(codes, self.lengths)
        self.run = np.flatnonzero(prefix[self.order] < span)
        named = self.name[self.order]
        self.low, self.high = np.minimum.reduceat(named, self.run), np.maximum.reduceat(named, self.run)

    def places_of(self, hit_runs: np.ndarray) -> list[np.ndarray]:
        """For each string, the places of suffixes in those runs."""
        hit = np.zeros(self.text.size, bool)
        hit[self.order] = np.repeat(hit_runs, np.diff(np.append(self.run, self.text.size)))
        return [np.flatnonzero(hit[s : s + n]) for s, n in zip(self.starts, self.lengths, strict=True)]

    def long_heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of suffixes with at least ``span`` bytes, in order, and where each one's first suffix starts."""
        left = np.repeat(self.starts + self.lengths - 1, self.lengths) - np.arange(self.text.size)
        head = self.order[self.run]
        long = np.flatnonzero(left[head] >= self.span)
        return long, head[long]


def repeated_starts(strings: list[bytes], codes: np.ndarray, span: int, places: bool = True) -> list[np.ndarray]:
    """For each string, the places where a string of ``span`` bytes starts that also starts under another name."""
    one = SuffixArray(strings, codes, span, places)
    return one.places_of(one.low != one.high)


def shared_starts(one: SuffixArray, two: SuffixArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same between two shards: each run of the second is looked up among the first's by binary search."""
    span = one.span
    runs, heads = one.long_heads()
    asked, starts = two.long_heads()
    low, high = np.zeros(starts.size, np.int64), np.full(starts.size, heads.size)

    def order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: strings of ``span`` bytes at a of the first text against those at b of the second."""
        out = np.zeros(a.size, np.int8)
        open_at = np.arange(a.size)
        for k in range(span):
            x, y = one.text[a[open_at] + k], two.text[b[open_at] + k]
            out[open_at] = np.sign(x - y)
            open_at = open_at[x == y]
            if not open_at.size:
                break
        return out

    live = np.flatnonzero(low < high)
    while live.size:
        mid = (low[live] + high[live]) // 2
        less = order(heads[mid], starts[live]) < 0
        low[live[less]], high[live[~less]] = mid[less] + 1, mid[~less]
        live = live[low[live] < high[live]]
    met = np.flatnonzero(low < heads.size)
    met = met[order(heads[low[met]], starts[met]) == 0]
    mine, theirs = runs[low[met]], asked[met]
    apart = np.minimum(one.low[mine], two.low[theirs]) != np.maximum(one.high[mine], two.high[theirs])
    hit_one, hit_two = np.zeros(one.run.size, bool), np.zeros(two.run.size, bool)
    hit_one[mine[apart]] = True
    hit_two[theirs[apart]] = True
    return one.places_of(hit_one), two.places_of(hit_two)


def shared_parts(bodies: list[bytes], backs: np.ndarray, groups: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """What of each context can hold a repeat at all, as start and stop; stop 0 if nothing.

    Contexts of one anchor (``groups``, at ``backs`` bytes from their start) that share a string of ``span``
    bytes share it at one distance from the anchor, and so a shorter one at a distance that is a multiple
    of the step. Only what others have the hash of goes to the suffix array.
    """
    sizes, step = np.fromiter(map(len, bodies), np.int64, len(bodies)), max(1, span // 50)
    data, starts, width = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes, span - step + 1
    up, down = powers(data.size + 1)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    first, stop = sizes.copy(), np.zeros(sizes.size, np.int64)
    group = mix(groups.astype(np.int64).view(np.uint64))
    for away in range(-(int(backs.max(initial=0)) // step) * step, int((sizes - backs).max(initial=0)) - width + 1, step):
        at = backs + away
        ok = np.flatnonzero((at >= 0) & (at + width <= sizes))
        a, at = starts[ok] + at[ok], at[ok]
        key = mix(mix((total[a + width] - total[a]) * down[a]) ^ group[ok])
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = times[which] > 1
        first[ok[hit]] = np.minimum(first[ok[hit]], at[hit] - step + 1)
        stop[ok[hit]] = np.maximum(stop[ok[hit]], at[hit] + width + step - 1)
    return np.maximum(first, 0), np.minimum(stop, sizes)


def named_grams(bodies: list[bytes], backs: np.ndarray, gram: int) -> tuple[list[bytes], int]:
    """The contexts with a name in place of the anchor's gram, equal for equal bytes; and by how much that is shorter.

    Each string that is looked for holds its context's whole gram, so two are equal only if their grams
    are, at one place. A name is a byte that UTF-8 never has and a number of as many digits as the shard needs.
    """
    names: dict[bytes, int] = {}
    numbers = [names.setdefault(x[b : b + gram], len(names)) for x, b in zip(bodies, backs.tolist(), strict=True)]
    digits = max(1, -(-max(len(names) - 1, 0).bit_length() // 6))
    # digits are bytes that texts have anyway, so that no symbol gets longer for them
    spelt = [b"\xff" + bytes(32 + (n >> 6 * k & 63) for k in range(digits)) for n in range(len(names))]
    return [x[:b] + spelt[n] + x[b + gram :] for x, b, n in zip(bodies, backs.tolist(), numbers, strict=True)], gram - digits - 1


def _spans(starts: list[np.ndarray], span: int, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-open runs covered by strings of ``span`` bytes at each string's ``starts`` (ascending), moved by its shift: the string's number, from and to."""
    sizes = np.fromiter(map(len, starts), np.int64, len(starts))
    at, own = np.concatenate([*starts, np.zeros(0, np.int64)]), np.repeat(np.arange(sizes.size), sizes)
    new = np.ones(at.size + 1, bool)  # the first of a run
    new[1:-1] = (np.diff(at) > span) | (np.diff(own) > 0)
    own, a, b = own[new[:-1]], at[new[:-1]], at[new[1:]] + span
    return own, a + shifts[own], b + shifts[own]


#: Bits of an anchor's hash that are counted to tell texts which may have something in common; equal ones of different grams only cost time.
_COUNTED = 40


def met_elsewhere(source: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Hashes (``short``) of anchors that occur in more than one row; and keys of rows that have any.

    Rows that have a string of ``span`` bytes in common with another one of their scope have such an anchor in
    it. Only these hashes are shuffled, once for each row, so a corpus that hardly repeats moves a small part of its size.
    """
    long = source.filter(F.octet_length("text") >= span).select("key_id", "key_text", "scope", "text")

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fixed = part[["key_id", "key_text", "scope"]].to_numpy()
            for a, b, texts in _batches(part["text"].tolist()):
                number, _, h, *_ = anchors(texts, span, gram, fixed[a:b, 2])
                short = h >> (64 - _COUNTED)
                order = np.lexsort((short, number))
                number, short = number[order], short[order]
                new = np.append(True, (np.diff(number) != 0) | (np.diff(short) != 0))[: number.size]
                own = fixed[a + number[new]]
                yield pd.DataFrame({"key_id": own[:, 0], "key_text": own[:, 1], "short": short[new]})

    seen = long.mapInPandas(find, "key_id long, key_text long, short long")
    shared = saved(seen.groupBy("short").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("short"), "shared_grams")
    return shared, saved(seen.join(small(shared, 8), "short", "left_semi").select("key_id", "key_text").distinct(), "rows_met")


def _batches(texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts (from, to, as bytes) of about ``BATCH`` bytes, which are hashed together."""
    held, first, size = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if held and (t is None or size > BATCH):
            yield first, i, held
            held, first, size = [], i, 0
        if t is not None:
            held.append(t.encode())
            size += len(held[-1])


def _anchored(source: DataFrame, span: int, gram: int) -> DataFrame:
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fixed = part[["key_id", "key_text", "scope"]].to_numpy()
            for first, stop, texts in _batches(part["text"].tolist()):
                number, place, h, s, back, ahead = anchors(texts, span, gram, fixed[first:stop, 2])
                own = fixed[first + number]
                yield pd.DataFrame({"key_id": own[:, 0], "key_text": own[:, 1], "scope": own[:, 2], "place": place, "h": h, "s": s, "back": back, "ahead": ahead})

    return source.mapInPandas(find, "key_id long, key_text long, scope long, place long, h long, s long, back int, ahead int")


def _contexts(texts: DataFrame) -> DataFrame:
    """Cut the wanted contexts out of their documents, a few documents at a time: contexts are several times as long as these."""
    columns = ["scope", "h", "s", "part", "parts", "key_id", "key_text", "first", "back", "body"]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, size = [], 0
            for key_id, key_text, text, wanted in zip(part["key_id"], part["key_text"], part["text"], part["wanted"], strict=True):
                body = text.encode()
                for w in wanted:
                    a = w["place"] - w["back"]
                    rows.append((w["scope"], w["h"], w["s"], w["part"], w["parts"], key_id, key_text, a, w["back"], body[a : w["place"] + w["ahead"]]))
                    size += w["back"] + w["ahead"]
                    if size > BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return texts.mapInPandas(cut, "scope long, h long, s long, part int, parts int, key_id long, key_text long, first long, back long, body binary")


def _sorted_shards(contexts: DataFrame, span: int, gram: int, places: bool) -> DataFrame:
    """h, s and what the context loses there: half-open runs relative to the anchor."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(p["body"].map(len).sum() for p in held) > SHARD:
                rows = pd.concat(held, ignore_index=True)
                last = rows.iloc[-1]
                whole = ~((rows["h"] == last["h"]) & (rows["one"] == last["one"]) & (rows["two"] == last["two"])).to_numpy()
                if whole.any():
                    yield from chunks(rows[whole])
                    held = [rows[~whole]]
        if held:
            yield from chunks(pd.concat(held, ignore_index=True))

    def chunks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.reset_index(drop=True)
        size = rows["body"].map(len).cumsum().to_numpy()
        new = np.append(True, (rows[["h", "one", "two"]].to_numpy()[1:] != rows[["h", "one", "two"]].to_numpy()[:-1]).any(1)) if len(rows) else np.zeros(0, bool)
        begins, base, scope = [0], 0, rows["scope"].to_numpy()
        for i in np.flatnonzero(new)[1:]:
            if size[i - 1] - base > SHARD or scope[i] != scope[i - 1]:
                begins.append(int(i))
                base = size[i - 1]
        for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
            if b > a:
                yield shard(rows.iloc[a:b])

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = shared_parts(rows["body"].tolist(), rows["back"].to_numpy(), rows["h"].to_numpy(), span)
        some = b > 0
        rows, a, b = rows[some], a[some], b[some]
        rows = rows.assign(body=[x[i:j] for x, i, j in zip(rows["body"], a, b, strict=True)], back=rows["back"] - a, first=rows["first"] + a)
        document = rows.groupby(["key_id", "key_text"], sort=False).ngroup().to_numpy().astype(np.int64)
        named, less = named_grams(rows["body"].tolist(), rows["back"].to_numpy(), gram)
        rows = rows.assign(body=named, code=(document << 40) + places * rows["first"].to_numpy())
        same = rows["one"] == rows["two"]
        found = []
        if same.any():
            found.append((rows[same], repeated_starts(rows.loc[same, "body"].tolist(), rows.loc[same, "code"].to_numpy(), span - less, places)))
        for _, pair in rows[~same].groupby(["h", "one", "two"], sort=False):
            sides = [pair[pair["part"] == pair[c].iloc[0]] for c in ("one", "two")]
            if all(len(s) for s in sides):
                arrays = [SuffixArray(s["body"].tolist(), s["code"].to_numpy(), span - less, places) for s in sides]
                found += zip(sides, shared_starts(*arrays), strict=True)
        out = []
        for some, starts in found:
            own, a, b = _spans(starts, span, -some["back"].to_numpy().astype(np.int64))
            out.append(pd.DataFrame({"h": some["h"].to_numpy()[own], "s": some["s"].to_numpy()[own], "a": a, "b": b}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["h", "s", "a", "b"]).astype("int64")

    # a pair of parts is a shard; with one part that is the part itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("one"), F.greatest("part", j).alias("two")))
    dealt = contexts.select("*", F.inline(pairs)).repartition("h", "one", "two").sortWithinPartitions("scope", "h", "one", "two")
    return dealt.mapInPandas(work, "h long, s long, a long, b long")


def repeated_runs(source: DataFrame, span: int, gram: int, places: bool = True, shared: DataFrame | None = None) -> DataFrame:
    """key_id, key_text and lost (runs from a to b, one for each anchor that has any) for texts with repeated strings.

    ``source`` has key_id, key_text, scope and text; only texts of one scope are compared. Without
    ``places`` a string has to start in another document, not only elsewhere; then hashes that
    ``met_elsewhere`` has ``shared`` keep other anchors from being written, and tables of what is left are
    broadcast while they are small, so that texts stay where they are.
    """
    few = (lambda df, name, row_bytes: df) if shared is None else (lambda df, name, row_bytes: small(saved(df, name), row_bytes))
    long = source.filter(F.octet_length("text") >= span)
    key = ["scope", "h", "s"]
    found = _anchored(long, span, gram)
    if shared is not None:
        found = found.withColumn("short", F.shiftright("h", 64 - _COUNTED)).join(small(shared, 8), "short", "left_semi").drop("short")
    found = saved(found, "anchors")
    # any occurrence represents its context (the columns of `first` come from one row); a hash holds its scope
    one = [F.first(c).alias(c) for c in ("scope", "key_id", "key_text", "place", "back", "ahead")]
    ends = [] if places else [F.min("key_id").alias("i0"), F.max("key_id").alias("i1"), F.min("key_text").alias("t0"), F.max("key_text").alias("t1")]
    contexts = found.groupBy("h", "s").agg(F.count(F.lit(1)).alias("times"), *one, *ends)
    apart = F.col("times") > 1 if places else F.expr("i0 <> i1 or t0 <> t1")
    contexts = saved(contexts.select(*key, "times", "key_id", "key_text", "place", "back", "ahead", apart.alias("apart")), "contexts")
    # without places, contexts of one document alone settle nothing
    alone = F.lit(True) if places else F.max("apart") | (F.min("key_id") != F.max("key_id")) | (F.min("key_text") != F.max("key_text"))
    often = contexts.groupBy("h").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds"), alone.alias("met")).filter("all > 1 and met").drop("all", "met")
    contexts = saved(contexts.join(few(often, "repeated_anchors", 16), "h"), "repeated_contexts")
    parts = F.ceil(F.col("kinds") / PART).cast("int")
    wanted = contexts.filter("kinds > 1").select("key_id", "key_text", "place", *key, "back", "ahead", F.pmod(F.xxhash64("s"), parts).cast("int").alias("part"), parts.alias("parts"))
    wanted = wanted.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("place", *key, "back", "ahead", "part", "parts")).alias("wanted"))
    one = long.join(few(wanted, "wanted", 16 + 72 * F.size("wanted")), ["key_id", "key_text"])
    lost = saved(_sorted_shards(_contexts(one), span, gram, places), "lost")
    settled = contexts.filter("apart").select("h", "s", (-F.col("back")).cast("long").alias("a"), F.col("ahead").cast("long").alias("b"))
    # written first, so that the join below is one of two tables, of which a hot context's part can be split
    # each run of a context holds its gram, so all of them together are one from the first start to the last end
    runs = saved(lost.union(settled).groupBy("h", "s").agg(F.min("a").alias("a"), F.max("b").alias("b")), "runs")
    return found.join(runs if shared is None else small(runs, 32), ["h", "s"]).groupBy("key_id", "key_text").agg(F.collect_list(F.struct((F.col("place") + F.col("a")).alias("a"), (F.col("place") + F.col("b")).alias("b"))).alias("lost"))


def lost_bytes(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of a text's bytes go."""
    return np.cumsum((np.bincount(starts, minlength=size + 1) - np.bincount(stops, minlength=size + 1))[:-1]) > 0


def remove_repeats(docs: DataFrame, span: int = 400, gram: int = 240, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row (and kept, the bytes, if asked).

    A null text is empty; nothing of a text under ``span`` bytes goes. Two rows with one id and
    one text are two documents with equal bytes, so all of a longer text goes. Matches never
    cross documents; other columns aren't read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    source = docs.select(*row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    per = repeated_runs(source.drop("doc_id").withColumn("scope", F.lit(0).cast("long")), span, gram)
    joined = source.join(per, ["key_id", "key_text"], "left")

    @F.pandas_udf("n_removed long, n_spans long, sha string, kept binary")
    def strip(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(texts, starts, stops, strict=True):
            if t is None or a is None:
                out.append((None, None, None, None))
                continue
            body = t.encode()
            gone = lost_bytes(len(body), a, b)
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
            spans = int(np.sum(np.diff(gone.astype(np.int8), prepend=0) == 1))
            out.append((len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "sha", "kept"]).astype({"n_removed": "Int64", "n_spans": "Int64"})

    # texts that lose nothing don't go to Python
    body = F.coalesce("text", F.lit(""))
    done = joined.withColumn("x", strip(F.when(F.col("lost").isNotNull(), F.col("text")), F.col("lost.a"), F.col("lost.b")))
    whole = F.when(F.col("lost").isNull(), F.sha2(body, 256))
    kept = [F.coalesce("x.kept", F.encode(body, "UTF-8")).alias("kept")] if with_text else []
    zero = F.lit(0).cast("long")
    return done.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.coalesce("x.n_removed", zero).alias("n_removed"), F.coalesce("x.n_spans", zero).alias("n_spans"), F.coalesce("x.sha", whole).alias("kept_sha256"), *kept)
