"""Operators on documents against brute force, on a small table with awkward rows and on the sf0.001 tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ketframe.llm import bpe, components, decontaminate, entries, langid, line_dedup, minhash, packing, suffix_dedup, token_counts

from .conftest import words

FOLDER = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SPAN = 400


@pytest.fixture(scope="module", params=["awkward", "sf"])
def docs(request, spark, documents):
    return documents if request.param == "awkward" else spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, library):
    rows = token_counts.count_tokens(docs, BPE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(encoded(library, r["text"]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 512)


@settings(max_examples=800, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("   \n\t'stm<|endoftext|>\x1c\x85　²½Ⅷ")))))
def test_pieces_give_the_librarys_ids(text):
    own = bpe.Bpe.of(BPE)
    assert [i for p in own.pieces(text) for i in own.ids(p)] == encoded(own.tokenizer, text)


def test_packing(docs, library):
    rows = packing.pack(docs, BPE).collect()
    want = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        want[d["doc_id"]].append([*encoded(library, d["text"]), 0])
    pieces = defaultdict(int)
    for r in rows:
        ids = [x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"]]
        cut = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for x in ids]
        assert r["ids_crc32"] in {zlib.crc32(c) for c in cut}
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {k: sum(map(len, v)) for k, v in want.items()}
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(p)) and sum(p[-1]) <= 1024
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 1024) + max(3, len(places) // 50)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=30))
def test_histogram_packing_places_each_piece_once(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed = defaultdict(int)
    for packs, pattern in patterns:
        assert packs > 0 and sum(n * c for n, c in pattern) <= 64
        for n, c in pattern:
            placed[n] += packs * c
    assert placed == counts
    assert len(patterns) <= 4 * max(1, len(counts))


def brute_components(texts: dict, percent=75):
    sets = {}
    for k, t in texts.items():
        w = words("[^\x20\x09-\x0d]+", t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = brute_components({r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()})
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_a_family_of_near_copies(spark, prose):
    """Copies with independent edits: near the original, but often too far from each other."""
    base, texts = prose(50, 150).split(), {}
    for i in range(160):
        w = list(base)
        for j in range(i % 9):
            w[(37 * (i + 1) * (j + 1)) % 150] = f"edit{i}x{j}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == want


def test_sets_around_the_size_of_a_sketch(spark, prose):
    """Sets of 30 and 31 shingles within sets of 39 to 41."""
    texts = {}
    for i in range(60):
        words = prose(900 + i, 45).split()
        texts[2 * i], texts[2 * i + 1] = " ".join(words[: 34 + i % 2]), " ".join(words[: 43 + i % 3])
    want = brute_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, links):
    root = {x: x for ab in links for x in ab if ab[0] != ab[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert len(got) == len(root)


def test_components_of_a_chain(spark):
    got = components.components(spark.range(60).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 61 and {r["component"] for r in got} == {0}


ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_contamination(text, windows):
    w, hit, items = words(ITEM, text), set(), set()
    for n, known in windows.items():
        for i in range(len(w) - n + 1):
            if found := known.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                items |= found
    names = ",".join(sorted(items))
    return len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def windows_of(items):
    out = defaultdict(lambda: defaultdict(set))
    for key, text in items:
        w = words(ITEM, text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n and key is not None else 0):
            out[n][tuple(w[i : i + n])].add(str(key))
    return out


def test_decontamination(spark, docs, documents):
    if docs is documents:
        own = [r["text"] for r in documents.filter("doc_id in (1, 4, 11)").collect()]
        items = [(1, " ".join(own[0].split()[5:30])), (2, own[1].upper()), (3, "one two"), (4, "x"), (5, None), (6, "--"), (7, " ".join(own[2].split()[20_000:20_010])), (7, "a a a a a a a a a a a a"), (8, "nothing of this is anywhere at all in any one text"), (None, "one"), (9, "é" * 500)]
    else:
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = windows_of(items)
    rows = decontaminate.contamination(docs, bench, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[2:] == brute_contamination(r["text"], known)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5))
def test_decontamination_of_repetitive_texts(spark, texts, items):
    texts, items = [(i, " ".join(t)) for i, t in enumerate(texts)], [(i, " ".join(t)) for i, t in enumerate(items)]
    rows = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: brute_contamination(t, windows_of(items)) for i, t in texts}


def line_words(line):
    return tuple(w for w in re.split(r"[^\w]+|_+", line.lower()) if w)


def brute_lines(rows, similarity=0.8):
    """doc -> places of lines that repeat an earlier one of their group, and the number of links between different lines."""
    places = defaultdict(list)
    for key, text in rows:
        for place, line in enumerate(text.split("\n") if text is not None else ()):
            if line_words(line):
                places[line_words(line)].append((key or 0, place))
    lines = list(places)
    bags, root, links = [Counter(w) for w in lines], list(range(len(lines))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        n, m = len(lines[a]), len(lines[b])
        most = int((1 - similarity) * max(n, m) + 1e-9)
        if abs(n - m) <= most and most and (bags[a] & bags[b]).total() >= max(n, m) - most and edit_distance(lines[a], lines[b]) <= most:
            root[find(a)] = find(b)
            links += 1
    groups = defaultdict(list)
    for i, w in enumerate(lines):
        groups[find(i)] += places[w]
    gone = defaultdict(set)
    for g in groups.values():
        for key, place in sorted(g)[1:]:
            gone[key].add(place)
    return gone, links


def test_lines_that_repeat_an_earlier_one_go(spark, docs):
    """Every text as brute force over the edit similarity of all pairs leaves it."""
    rows = [r for r in docs.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == docs.count()
    gone, links = brute_lines([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()])
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert links
    for r in out:
        if r["doc_id"] is None:
            continue
        if texts[r["doc_id"]] is None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
            continue
        lines = texts[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone[r["doc_id"]])
        assert (r["n_lines"], r["n_removed"]) == (len(lines), len(gone[r["doc_id"]]))
    assert set(out[0].asDict()) == {*docs.columns, "n_lines", "n_removed"}


def test_fuzzy_lines(spark, prose):
    line = prose(20, 60)
    other = line.split()
    other[30] = "instead"
    texts = [(1, prose(21, 20) + "\n" + line), (2, " ".join(other) + "\n" + prose(22, 20)), (3, "one two\none two"), (4, line.upper() + "!")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), least_words=5).collect()}
    assert out[1]["n_removed"] == 0 and out[3]["n_removed"] == 0
    assert out[4]["text"] == ""
    assert out[2]["n_removed"] == 1


def test_one_passage_in_many_lines(spark, prose):
    """Lines that share two thirds of their words, and variants of one line by the hundred."""
    passage = prose(70, 50)
    texts = [(i, f"{prose(1000 + i, 13)} {passage} {prose(2000 + i, 13)}") for i in range(150)]
    base = prose(71, 40).split()
    texts += [(200 + i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(150)]
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out if r["n_removed"]} == set(range(201, 350))


def brute_removal(texts, span=SPAN):
    """doc -> which bytes go."""
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(gone)
    return out


def test_suffix_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = defaultdict(list)
    for r, t, gone in zip(rows, texts, brute_removal(texts), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want[r["doc_id"]].append((len(t), int(gone.sum()), int(np.sum(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    got = defaultdict(list)
    for r in suffix_dedup.remove_repeats(docs).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8))
def test_suffix_dedup_of_repetitive_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df, span=12, gram=4).collect()}
    assert got == {i: int(g.sum()) for i, g in enumerate(brute_removal([t.encode() for t in texts], 12))}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_array_and_common_prefixes(strings):
    lengths = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    text[starts + lengths - 1] = 0
    order, _ = suffix_dedup.suffix_ranks(text, int(lengths.max()))
    # each string's end sorts before all symbols, earlier strings' ends first
    ends = starts + lengths - 1
    suffix = lambda i: [(1, x) if x else (0, int(np.searchsorted(ends, k))) for k, x in enumerate(text[i:], i)]
    assert order.tolist() == sorted(range(text.size), key=suffix)
    cap = 4
    prefix = suffix_dedup.common_prefixes(text, order, starts, lengths, cap)
    for a, b in itertools.pairwise(order.tolist()):
        stop = ends[np.searchsorted(ends, b)]
        if stop - b >= cap:
            n = 0
            while n < cap and text[a + n] == text[b + n] and text[b + n]:
                n += 1
            assert prefix[b] == n


def test_grams_are_sorted_by_name(prose):
    """What a shard sorts is its contexts without the grams they share, and the same strings repeat."""
    span, gram = 400, 240
    shared = prose(40, 200).encode()
    texts = [prose(41 + i, 40).encode() + shared[i : 700 + 5 * i] + prose(51 + i, 40).encode() for i in range(5)] + [b"to " * 300, b"x" + b"to " * 200]
    number, place, h, _, back, ahead = suffix_dedup.anchors(texts, span, gram)
    bodies = [texts[n][p - b : p + a] for n, p, b, a in zip(number, place, back, ahead, strict=True)]
    codes = (number << 40) + place - back
    named, less = suffix_dedup.named_grams(bodies, back, gram)
    assert 2 * sum(map(len, named)) < 1.3 * sum(map(len, bodies)) and less > 200
    for g in set(h.tolist()):
        at = np.flatnonzero(h == g)
        want = suffix_dedup.repeated_starts([bodies[i] for i in at], codes[at], span)
        got = suffix_dedup.repeated_starts([named[i] for i in at], codes[at], span - less)
        gone = [{(codes[i] + p) for i, w in zip(at, x, strict=True) for s in w for p in range(s, s + span)} for x in (want, got)]
        assert gone[0] == gone[1]


def test_each_anchor_loses_one_run(spark, prose):
    """However many parts find something of a context: what they find holds its gram."""
    shared = prose(90, 150)
    texts = [(i, i, prose(91 + i, 40) + shared[7 * i : 560 + 9 * i] + prose(111 + i, 40)) for i in range(8)]
    source = spark.createDataFrame(texts, "key_id long, key_text long, text string").withColumn("scope", F.lit(0).cast("long"))
    got = {r["key_id"]: r["lost"] for r in suffix_dedup.repeated_runs(source, SPAN, 240).collect()}
    for (i, _, text), gone in zip(texts, brute_removal([t.encode() for _, _, t in texts]), strict=True):
        runs = got.get(i, [])
        anchors = len(suffix_dedup.anchors([text.encode()], SPAN, 240)[0])
        assert len(runs) <= anchors and suffix_dedup.lost_bytes(len(text), np.array([r["a"] for r in runs], int), np.array([r["b"] for r in runs], int)).tolist() == gone.tolist()


def test_contexts_of_one_anchor_are_split_into_parts(spark, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 3)
    shared = prose(30, 120)
    texts = [prose(31 + i, 40) + shared[i : 500 + 3 * i] + prose(60 + i, 40) for i in range(14)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {i: int(g.sum()) for i, g in enumerate(brute_removal([t.encode() for t in texts]))}


def test_language_id_on_held_out_documents(spark):
    rows = entries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == labels[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.002
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_of_awkward_rows(spark, documents, prose):
    train = [(i, prose(100 + i, 60, "abcdef" if i % 2 else "uvwxyz"), "one" if i % 2 else "two") for i in range(80)]
    model = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["one", "two"]
    got = langid.identify(documents, model).collect()
    assert len(got) == documents.count()
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.langs
    odd = model.predict(["Привет мир как дела сегодня", "vwxyz uvw zyx", "fedcba abc"])
    assert odd["rejected"].tolist() == [True, False, False] and odd["lang"].tolist()[1:] == ["two", "one"]
    nothing = langid.learn(documents.limit(0))
    assert {r["lang_pred"] for r in langid.identify(documents, nothing).collect()} == {"und"}


def reference_kneser_ney(words, order, alphabet):
    """Interpolated Kneser-Ney over ^word$ by dictionaries of strings; returns log-probability of a word."""
    counts = [Counter() for _ in range(order + 1)]
    for w in words:
        t = "\x01" + w + "\x02"
        for n in range(1, order + 1):
            for i in range(max(1, n - 1), len(t)):
                counts[n][t[i - n + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):  # below the highest order: in how many ways an n-gram goes on to the left
        before = Counter(g[1:] for g in counts[n + 1])
        counts[n] = Counter({g: c if g[0] == "\x01" else before[g] for g, c in counts[n].items()})

    def probability(history, symbol):
        if history is None:
            return 1 / alphabet
        n = len(history) + 1
        lower = probability(history[1:] if history else None, symbol)
        after = {g: c for g, c in counts[n].items() if g[:-1] == history}
        if not after:
            return lower
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        total, taken = sum(after.values()), sum(min(discount, c) for c in after.values())
        c = after.get(history + symbol, 0)
        return (c - min(discount, c)) / total + taken / total * lower

    def log(word):
        t = "\x01" + word + "\x02"
        return sum(np.log(probability(t[max(0, i - order + 1) : i], t[i])) for i in range(1, len(t)))

    return log


def test_kneser_ney_against_dictionaries():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(60)] + ["abab"] * 4
    model = langid.Model({"x": [" ".join(words)]}, order=4)
    log = reference_kneser_ney(words, 4, langid.ALPHABET)
    asked = [*dict.fromkeys(words), "zz", "abz", "dddddddd", "é"]
    assert np.allclose(model.score_words(asked)[:, 0], [-log(w) for w in asked])


def test_letters_are_what_makes_words(spark):
    """Numbers that aren't decimal digits are no letters; a text without letters is undetermined."""
    docs = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, "ab Ⅷcd½ é"), (3, None), (4, "")], "doc_id long, text string")
    assert langid.words_of("ab Ⅷcd½ é_f²") == ["ab", "cd", "é", "f"]
    assert langid.words_of("ab𐄇cd𝐀 x") == ["ab", "cd𝐀", "x"]
    out = langid.identify(docs, langid.Model({"x": ["ab cd"]})).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in out} == {1: "und", 2: "x", 3: "und", 4: "und"}


@pytest.mark.parametrize("run", [lambda d: token_counts.count_tokens(d, BPE), lambda d: packing.pack(d, BPE), minhash.near_duplicates, line_dedup.dedup_lines, suffix_dedup.remove_repeats, lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text"))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_at_the_stated_similarity_meet(spark, prose):
    """Up to a fifth of the words changed, left out or added, evenly or at random, at many lengths."""
    import random

    rng, texts = random.Random(4), {}
    for i in range(60):
        line = prose(500 + i, [5, 6, 9, 10, 14, 20, 33, 60, 100, 150][i % 10]).split()
        other = list(line)
        for j in range(len(line) // 5):
            at = (5 * j + 2) % len(other) if i % 2 else rng.randrange(len(other))
            other[at : at + 1] = [["changed"], [], [other[at], "more"]][rng.randrange(3) if i % 3 else 0]
        texts[2 * i], texts[2 * i + 1] = line, other
    gone = set()
    for a, b in itertools.combinations(texts, 2):
        if edit_distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9:
            gone.add(b)
    assert len(gone) > 40
    out = line_dedup.dedup_lines(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"), least_words=1).collect()
    assert {r["doc_id"] for r in out if r["n_removed"]} == gone


def test_short_lines_repeat_too(spark, monkeypatch):
    """The query keeps one of equal lines of any length over zero; blank lines stay."""
    df = spark.createDataFrame([(1, "Share\n\nHome page"), (2, "share!\n\nhome page\nhome pages"), (3, "SHARE")], "doc_id long, text string")
    monkeypatch.setattr(entries, "_read", lambda *a: df)
    out = {r["doc_id"]: r["n_removed"] for r in entries.op5_line_dedup(spark, "").collect()}
    assert out == {1: 0, 2: 2, 3: 1}


def test_lines_with_one_passage_are_few_pairs(spark, prose, monkeypatch):
    """Beginnings of many lengths before one passage, near the limit of what is linked: as brute force, and each pair is made once at most."""
    passage, pairs = prose(80, 40), []
    texts = [(i, f"{prose(3000 + i, 1 + i % 23)} {passage}") for i in range(160)]
    cross = line_dedup.cross_pairs

    def counted(placed, keys, columns, near):
        pairs.append(placed.sparkSession.createDataFrame(cross(placed, keys, columns, near).collect(), "a long, b long"))
        both = placed.alias("x").join(placed.alias("y"), F.expr("x.list = y.list and x.node < y.node and x.g <> y.g"))
        per = both.filter(near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")) if "ls" not in columns else F.expr("x.list = array_min(array_intersect(x.ls, y.ls))"))
        assert per.count() == per.select("x.node", "y.node").distinct().count()
        return pairs[-1]

    monkeypatch.setattr(line_dedup, "cross_pairs", counted)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    gone, links = brute_lines(texts)
    assert links > 1000 and {r["doc_id"] for r in out if r["n_removed"]} == set(gone)
    assert len(pairs) == 1 and pairs[0].count() < links


def test_only_what_may_be_aligned_stays_in_a_list(spark):
    """Members of a list whose neighbourhood can't be aligned with any other's go, and no other."""
    import random

    rng, rows = random.Random(5), []
    for g in range(60):
        for node in range(rng.choice([2, 3, 4, 9, 40])):
            rows.append((g, node, rng.randrange(60), rng.randrange(60), g % 20 > 0))
    got = line_dedup._company(spark.createDataFrame(rows, "g long, node long, before int, after int, sure boolean"), 0.8)
    got = {(r["g"], r["node"]) for r in got.collect()}
    must = set()
    for x, y in itertools.permutations(rows, 2):
        if x[0] == y[0]:
            most = int(0.2 * max(x[2] + x[3], y[2] + y[3]) + 1e-9)
            if not x[4] or abs(x[2] - y[2]) + abs(x[3] - y[3]) <= most:
                must.add(x[:2])
    assert must <= got and len(got) < len(rows)


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql_twins(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    got, want = entries.queries()[name](spark, FOLDER), db.execute(entries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_lists_of_a_line(spark, prose, monkeypatch):
    """All neighbourhoods of a line of few different words, however long; of others about RATE; no lambda makes them; a line of many copies goes as before."""
    few, many = ["repeated"] * 400 + prose(900, 12).split() + ["repeated"] * 400, [f"{w}longer{i}" for i, w in enumerate(prose(901, 300).split())]
    texts = [(i, " ".join(w)) for i, w in enumerate([prose(902, 15).split(), few, many])]
    opened = spark.createDataFrame(texts, "key_id long, line string").selectExpr("key_id", "key_id as key_text", "0 as place", "line")
    listed = line_dedup._listed(opened, 0.8, 1)
    rows = listed.collect()
    assert sorted(r["key_id"] for r in rows if r["k"] is None) == [0, 1, 2]
    lists = [len({r["k"] >> 22 for r in rows if r["key_id"] == i and r["k"] is not None}) for i in range(3)]
    around = {(a, b, c) for a, b, c in zip([None, *few], few, [*few[1:], None])}
    assert lists[:2] == [15, len(around)] and 2 <= lists[2] <= 40
    assert "transform(" not in listed._jdf.queryExecution().optimizedPlan().toString()

    monkeypatch.setattr(line_dedup, "_MANY", 3)
    other = " ".join(["changed", *texts[0][1].split()[1:]])
    texts = [(i, texts[0][1]) for i in range(3, 9)] + [(9, other), (1, prose(903, 9)), (2, other + "\n" + texts[1][1]), (10, texts[1][1].replace("repeated", "Repeated", 7) + " more")]
    gone, _ = brute_lines(texts)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {i: len(gone[i]) for i, _ in texts} and len(gone[9]) == len(gone[10]) == 1
