"""Fingerprints, pages, secrets and the pipeline: held-out accuracy, brute force and planted cases."""

import hashlib
import html
import importlib
import re
from collections import Counter

import numpy as np
import pytest

from ketframe.llm import chroma, entries, html_text, secrets_scan

from .test_documents import brute_components, brute_contamination, windows_of

FOLDER = "/root/testdata/sf0.001"


# --- audio ------------------------------------------------------------------------------------------


def heard(rng, numbers, noise=300, shift=0):
    pcm = np.concatenate([np.zeros(shift, np.int16), chroma.sound_of(numbers)]).astype(float)
    return (pcm + rng.normal(size=pcm.size) * noise).astype(np.int16)


@pytest.fixture(scope="module")
def recordings(spark):
    """40 pieces; 100+ noisy copies of some, cut and delayed ones among them; exact copies; silence, short, empty and null ones."""
    rng = np.random.default_rng(2)
    pieces = [rng.normal(size=48) * 0.15 for _ in range(40)]
    rows = [(i * 20, chroma.sound_of(p).tobytes()) for i, p in enumerate(pieces)]
    rows += [(i * 20 + 1, heard(rng, p).tobytes()) for i, p in enumerate(pieces)]
    rows += [(i * 20 + 2, heard(rng, p[8:], shift=chroma.HOP * 3).tobytes()) for i, p in enumerate(pieces[:20])]
    rows += [(i * 20 + 3, chroma.sound_of(p).tobytes()) for i, p in enumerate(pieces[:5])]
    rows += [(5001, np.zeros(100_000, np.int16).tobytes()), (5002, b"\0" * 101), (5020, b""), (5040, None), (None, chroma.sound_of(pieces[0]).tobytes()), (5001, np.zeros(100_000, np.int16).tobytes())]
    return spark.createDataFrame(rows, "rec_id long, pcm binary")


def test_alignment_finds_copies(recordings):
    prints = chroma.fingerprints(recordings, chroma.learn_cuts(recordings))
    rows = {r["rec_id"]: r for r in chroma.align(prints).collect()}
    for i in range(40):
        r = rows[i * 20]
        others = 1 + (i < 20) + (i < 5) + (i == 0)  # the row without id is a copy of the first
        assert r["is_query"] and r["n_links"] == others
        if r["best_id"] is None:  # noise changed no bit: all its copies are in its own class
            assert rows[i * 20 + 1]["class_id"] == i * 20 and i >= 20
            continue
        assert r["best_id"] in (i * 20 + 1, i * 20 + 2) and r["best_errors"] < chroma.BIT_ERRORS
        assert r["best_offset"] == (0 if r["best_id"] % 20 == 1 else -5)
    assert rows[3]["class_id"] == 0 and rows[1]["n_links"] is None
    assert (rows[5020]["n_prints"], rows[5020]["n_links"], rows[5040]["n_prints"]) == (0, 0, 0)


def test_links_against_all_pairs(recordings):
    """Recall of the offset histogram against trying every offset of every pair."""
    prints = chroma.fingerprints(recordings, chroma.learn_cuts(recordings)).filter("rec_id is not null and rec_id < 900")
    table = {r["rec_id"]: np.array(r["fp"], np.int32).view(np.uint32) for r in prints.collect()}
    want = Counter()
    for q, a in table.items():
        for r, b in table.items():
            if q % 20 == 0 and r != q and len(a) and len(b):
                for offset in range(-len(a) + 1, len(b)):
                    first, n = max(0, -offset), min(len(a), len(b) - offset) - max(0, -offset)
                    if n >= chroma.OVERLAP * min(len(a), len(b)) and np.bitwise_count(a[first : first + n] ^ b[first + offset : first + offset + n]).mean() / 32 <= chroma.BIT_ERRORS:
                        want[q] += 1
                        break
    got = {r["rec_id"]: r["n_links"] for r in chroma.align(prints).collect() if r["is_query"]}
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0
    assert all(got[q] <= want[q] for q in got)


def test_integral_image_sums():
    frames = np.random.default_rng(0).random((20, 12)).astype(np.float32)
    out = chroma.responses(frames)
    assert out.shape == (5, 16)
    kind, y, h, w = chroma.filters()[0]
    part = frames[2 : 2 + w, y : y + h].sum()
    assert kind == 0 and out[2, 0] == pytest.approx(np.log1p(part) - np.log1p(frames[2:18].sum() - part), rel=1e-4)


def test_cuts_come_from_all_recordings(spark):
    """More recordings than any sample: quartiles of every value, in whole steps."""
    rng = np.random.default_rng(6)
    rows = [(i, chroma.sound_of(rng.normal(size=24) * (0.02 if i % 3 else 0.3)).tobytes()) for i in range(600)]
    values = np.concatenate([np.rint(chroma.responses(chroma.chroma(np.frombuffer(x, np.int16))) * chroma.STEPS) for _, x in rows])
    cuts = chroma.learn_cuts(spark.createDataFrame([*rows, (None, None), (7, b"")], "rec_id long, pcm binary"))
    assert np.allclose(cuts * chroma.STEPS, np.quantile(values, [0.25, 0.5, 0.75], axis=0).T, atol=1e-6)
    assert not chroma.learn_cuts(spark.createDataFrame([], "rec_id long, pcm binary")).any()


def test_no_recordings(recordings):
    assert chroma.align(chroma.fingerprints(recordings.limit(0), np.zeros((16, 3)))).count() == 0


# --- pages --------------------------------------------------------------------------------------------


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r["page_id"]: r for r in entries.op10_html_text(spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article[^>]*>(.*?)</article>", p["html"], re.S)[1]
        article = re.sub(r"<!--.*?-->", "", article, flags=re.S)
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (text, len(text))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<article><p>a<div class='comments'>c</div><p>b <b>c</b>d</article>z", ["a", "b cd"]),
        ("<main><h1>T</h1><ul><li>x<li>y</ul><form>f</form><aside>s</aside></main>", ["T", "x", "y"]),
        ("<body><nav>n</nav><header>h</header><p>one<br>two\n three</p><footer>f</footer><script>if(a<b)x</script><style>p</style>", ["one", "two three"]),
        ("<article><p class='Ad-box'>x</p><p id=cookie-bar>y</p><p>kept", ["kept"]),
        ("<article>a<!-- <p>no</p> -->b</article>", ["ab"]),
        ("<article><p title='a > b'>q</p><p hidden>h</p></article>", ["q"]),
        ("<p>1 < 2 &lt; 3", ["1 < 2 < 3"]),
        ("<article><div role=navigation>m</div><span>a</span><span>b</span></article>", ["ab"]),
    ],
)
def test_blocks(page, want):
    assert html_text.blocks(page)[1] == want


def test_host_boilerplate_of_pages_without_an_article(spark, prose):
    menu, legal = prose(70, 40), prose(71, 50)
    rows = [(i, f"https://a.example/{i}", f"<body><div>{menu}</div><div>{prose(80 + i, 60)}</div><div>{legal}</div></body>") for i in range(6)]
    rows += [(10, "https://b.example/", f"<body><div>{menu}</div><div>{prose(90, 60)}</div></body>"), (11, "https://a.example/x", None), (12, None, ""), (0, "https://a.example/0", rows[0][2]), (13, "https://c.example/", f"<article>{menu}</article>"), (None, "https://c.example/", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 6:
            assert r["text"] == prose(80 + r["page_id"], 60)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[10] == menu + " " + prose(90, 60)  # another host
    assert (by[11], by[12], by[13], by[None]) == ("", "", menu, "x")
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_host_boilerplate_inside_marked_articles(spark, prose):
    notice, wire, teaser = prose(60, 40), prose(61, 60), prose(62, 50)
    page = lambda *inside, outside="": "<body><article>" + "".join(f"<p>{t}</p>" for t in inside) + f"</article><footer><p>{outside}</p></footer></body>"
    rows = [(i, page(prose(80 + i, 60), notice, prose(180 + i, 30)), "a") for i in range(4)]  # a notice that nothing marks
    rows += [(4, page(prose(90, 60), outside=notice), "a")]
    rows += [(10 + i, page(wire, prose(100 + i, 60)), "a") for i in range(3)]  # a paragraph that articles share
    rows += [(20 + i, page(teaser, prose(110, 40)), "a") for i in range(2)] + [(22, page(prose(111, 40), outside=teaser), "a")]  # an article served twice, and its teaser elsewhere
    rows += [(30 + i, page(prose(120 + i, 60), notice), "b") for i in range(2)]  # a host without that footer
    pages = spark.createDataFrame([(i, f"https://{h}.example/{i}", t) for i, t, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == prose(80 + i, 60) + " " + prose(180 + i, 30) for i in range(4))
    assert all(got[10 + i] == wire + " " + prose(100 + i, 60) for i in range(3))
    assert got[20] == got[21] == teaser + " " + prose(110, 40)
    assert (got[4], got[22]) == (prose(90, 60), prose(111, 40))
    assert all(got[30 + i] == prose(120 + i, 60) + " " + notice for i in range(2))


# --- the registered query of recordings ------------------------------------------------------------------


def test_alignment_of_the_registered_query(spark):
    """Planted excerpts are found where they stand; what trying every offset finds beyond them are unlike recordings just under the highest bit error."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = {r["rec_id"]: r for r in entries.op1_chroma(spark, "/root/testdata/sf0.001").collect()}
    column = {"rec_id": "vec_id", "pcm": "embedding", "decode": chroma.sound_of}
    prints = {r["rec_id"]: np.array(r["fp"], np.int32).view(np.uint32) for r in chroma.fingerprints(vectors.union(entries.excerpts(vectors)), chroma.learn_cuts(vectors, **column), **column).collect()}
    assert rows.keys() == prints.keys()
    ones = np.array([bin(i).count("1") for i in range(1 << 16)])
    found = wanted = right = 0
    for q in (k for k in prints if k % 20 == 0):
        a, links = prints[q], 0
        for r, b in prints.items():
            least = chroma.OVERLAP * min(a.size, b.size)
            errors = [(ones[x & 0xFFFF] + ones[x >> 16]).mean() / 32 for o in range(-a.size, b.size) if (n := min(a.size, b.size - o) - max(0, -o)) >= least for x in [a[max(0, -o) :][:n] ^ b[max(0, o) :][:n]]]
            links += r != q and min(errors) <= chroma.BIT_ERRORS
        wanted, found = wanted + links, found + rows[q]["n_links"]
        assert rows[q]["n_links"] <= links
        right += (rows[q]["best_id"], rows[q]["best_offset"]) == (-1 - q, -8)
    assert found >= 0.9 * 25 and wanted - found <= 3
    assert right >= 24


# --- secrets ------------------------------------------------------------------------------------------


def test_forest_on_held_out_findings():
    words = Counter("the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if".split() * 5)
    scanner = secrets_scan.Scanner(words)
    held = secrets_scan.labelled_findings(list(words), 600, seed=77)
    found = scanner.scan([t for t, _, _ in held], [p for _, p, _ in held])
    right = [any(f[4] for f in x) == bool(label) for x, (_, _, label) in zip(found, held, strict=True)]
    assert np.mean(right) > 0.95


def test_planted_tokens_and_look_alikes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r["doc_id"], hashlib.sha256(m[1].encode()).hexdigest()) for r in docs.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"])}
    rows = entries.op7_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert want <= {(r["doc_id"], r["secret_sha256"]) for r in rows if r["secret"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(hashlib.sha256(texts[r["doc_id"]][r["start"] : r["stop"]].encode()).hexdigest() == r["secret_sha256"] for r in rows)
    assert len({r["doc_id"] for r in rows if r["secret"]} - {d for d, _ in want}) <= 0.001 * len(texts)


def test_secret_scan_of_awkward_rows(spark, documents):
    scanner = secrets_scan.learn(documents)
    assert secrets_scan.scan(documents, scanner, path="source").filter("secret").count() == 0
    assert secrets_scan.scan(documents.limit(0), scanner).count() == 0
    assert secrets_scan.Scanner(Counter(), findings=[]).scan(["token = 'abcdef123'"], [None])[0]


def brute_candidates(text):
    """Each kind's matches in turn, unless they lie over one that stands."""
    taken = []
    for kind, (_, pattern) in enumerate(secrets_scan.KINDS):
        for m in pattern.finditer(text):
            a, b = m.span(1)
            while kind == 3 and b > a and text[b - 1] == ".":
                b -= 1
            if b - a >= 6 and all(b <= x or y <= a for _, x, y in taken):
                taken.append((kind, a, b))
    return sorted(taken, key=lambda t: t[1])


def test_candidates_against_every_earlier_one(prose):
    texts = [f"{prose(i, 5)} token = 'a1b2c3d4e5f6a7b8c9d0e1' key: ghp_{'A1' * 18} {prose(50 + i, 3)} {'Zz9' * 12}. {prose(i, 2)}\n" for i in range(40)]
    for text in (*texts, "".join(texts), ""):
        assert secrets_scan.candidates(text) == brute_candidates(text)


def test_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, "Common words" if i % 3 else "rare" + "abcdefgh"[i % 8] + " common") for i in range(60)] + [(99, None), (100, "")], "doc_id long, text string")
    words = secrets_scan.learn(docs, dictionary=3).words
    assert words.known == {"common", "words", "rarea"} and set(secrets_scan.learn(docs).words.known) >= {"rareb", "rareh"}
    assert words.pairs["co"] > words.pairs["ra"] and secrets_scan.learn(docs.limit(0)).words.known == set()


def test_long_candidates_are_whole():
    """No upper bound on a candidate's length, nor on where its first digit stands."""
    token, late, value, body = "aB3" * 200, "abcdE" * 60 + "7", "p4$" * 150, "QUJD0" * 4000
    key = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    text = f"see {token} and {late} here\npassword = '{value}'\n{key}\n"
    assert [text[a:b] for _, a, b in secrets_scan.candidates(text)] == [token, late, value, key]
    words = secrets_scan.Words(Counter())
    long = "a" * 300 + "1" * 300
    assert secrets_scan.features(long, 3, 0, 600, "", words)[:2] == [600, 0.5]


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept: what goes is what brute force finds, clean documents stay."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 120")
    items = windows_of([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "packing":
            left = {r["doc_id"] for r in docs.collect()}
            assert {r["doc_id"] for r in out.collect()} == left
            break
        assert out.columns == columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert {k for k, t in before.items() if any(c.isalpha() for c in t)} == set(after)
        if name == "line_dedup":
            assert set(before) == set(after)
        if name == "near_dedup":
            assert {k for k, (_, c) in brute_components(before).items() if c == k} == set(after)
        if name == "decontamination":
            assert {k for k, t in before.items() if not brute_contamination(t, items)[4]} == set(after)
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_stages_on_awkward_and_empty_tables(spark, documents):
    """Nulls, empty and long texts, repeated rows and further columns go through all stages; so does a table without rows."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = documents
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        none = stage(spark, docs.limit(0), FOLDER)
        assert none.columns == out.columns and none.count() == 0
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == documents.columns
        before, after = sorted(map(repr, docs.drop("text", "n_chars").collect())), sorted(map(repr, out.drop("text", "n_chars").collect()))
        assert rows and set(after) <= set(before)
        if name == "line_dedup":
            assert before == after
        docs = spark.createDataFrame(rows, out.schema)


def test_nothing_else_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "ketframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "ketframe.llm" not in p.read_text()
