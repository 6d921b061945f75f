"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values assigned to a telling name, tokens of known shape, and long tokens with a digit.
The forest looks at the candidate's length and characters, how likely its character transitions are
among ordinary words, how much of it dictionary words cover, the path (or source) it was found in,
and the words beside it. It is trained on labelled findings.

The words of the dictionary and the transitions are counted over all documents; the labelled findings are made from a fixed seed: credentials of usual shapes in the places where they
stand, and look-alikes (hashes of commits and files, identifiers, placeholders, words, numbers). A table
of real findings can be given instead.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.session import saved, ship

_NAMES = r"(?:api|app|auth|access|aws|client|db|private|refresh|secret|session|signing|user)?[_-]?(?:key|token|secret|passw(?:or)?d|passwd|pwd|credentials?|bearer)"
#: kind -> pattern; the candidate is group 1. Earlier kinds win where two overlap.
KINDS = [
    ("private_key", re.compile(r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?)")),
    ("shaped", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[0-9A-Za-z_-]{35})")),
    ("assigned", re.compile(rf"(?i)(?<![a-z0-9]){_NAMES}[\"']?\s{{0,3}}(?:[:=]|=>|:=)\s{{0,3}}[\"']?([^\s\"'`,;<>]{{6,}}+)")),
    ("token", re.compile(r"(?<![A-Za-z0-9+/_=.-])((?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{20,}+)")),
]
_CUE = re.compile(rf"(?i){_NAMES}")
_DECOY = re.compile(r"(?i)example|sample|placeholder|changeme|dummy|your[_-]|xxxx|test|fake|<|\$\{|\{\{")
_HASHED = re.compile(r"(?i)commit|sha-?\d*|md5|checksum|digest|revision|etag|hash|uuid|guid|version|integrity")
_CODE = re.compile(r"(?i)\.(?:env|ini|cfg|conf|ya?ml|json|toml|properties|py|js|ts|go|rb|java|sh|tf|pem|key)\b")
_TESTED = re.compile(r"(?i)test|spec|mock|fixture|sample|example|docs?/")
BESIDE = 40
FEATURES = ["length", "digits", "upper", "lower", "other", "entropy", "hex", "changes", "transitions", "coverage", "cue_before", "hash_before", "decoy", "quoted", "assigned", "code_path", "test_path", "kind"]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates in a text, in order, none inside another."""
    taken: list[tuple[int, int, int]] = []  # (start, end, kind), ascending and apart
    for kind, (_, pattern) in enumerate(KINDS):
        for m in pattern.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".=" and kind == 3 and not text[b - 1 : b] == "=":
                b -= 1
            i = bisect.bisect_right(taken, (a, a, len(KINDS)))
            if b - a >= 6 and not (i and taken[i - 1][1] > a) and not (i < len(taken) and taken[i][0] < b):
                taken.insert(i, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


class Words:
    """Dictionary and character transitions of ordinary words, ``pairs`` being counts of two neighbouring characters (by default those in ``words``)."""

    def __init__(self, words: Counter, size: int = 20_000, pairs: Counter | None = None):
        self.known = {w for w, _ in words.most_common(size) if len(w) >= 3}
        firsts = Counter()
        if pairs is None:
            pairs = Counter()
            for w, n in words.items():
                for a, b in zip("^" + w, w + "$", strict=True):
                    pairs[a + b] += n
        for p, n in pairs.items():
            firsts[p[0]] += n
        self.pairs = {p: math.log((n + 0.5) / (firsts[p[0]] + 32)) for p, n in pairs.items() if n > 1}
        self.unseen = math.log(0.5 / 1000)

    def transitions(self, s: str) -> float:
        s = s.lower()
        return sum(self.pairs.get(a + b, self.unseen) for a, b in zip(s, s[1:], strict=False)) / max(1, len(s) - 1)

    def coverage(self, s: str) -> float:
        """Share of the characters in dictionary words, taken longest first from the left."""
        s, at, hit = s.lower(), 0, 0
        while at < len(s):
            n = next((n for n in range(min(16, len(s) - at), 2, -1) if s[at : at + n] in self.known), 0)
            hit += n
            at += n or 1
        return hit / max(1, len(s))


def features(text: str, kind: int, a: int, b: int, path: str, words: Words) -> list[float]:
    part = text[a:b]
    before, beside = text[max(0, a - BESIDE) : a], text[max(0, a - BESIDE) : a] + " " + text[b : b + BESIDE]
    n = len(part)
    counts = Counter(part)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    share = lambda ok: sum(map(ok, part)) / n
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in part]
    return [float(n), share(str.isdigit), share(str.isupper), share(str.islower), 1 - share(str.isalnum), entropy, float(all(c in "0123456789abcdefABCDEF" for c in part)), sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), words.transitions(part), words.coverage(part), float(bool(_CUE.search(before))), float(bool(_HASHED.search(before))), float(bool(_DECOY.search(part))) + float(bool(_DECOY.search(beside))), float(before[-1:] in ("'", '"', "`")), float(bool(re.search(r"[:=]\s*[\"'`]?$", before))), float(bool(_CODE.search(path))), float(bool(_TESTED.search(path))), float(kind)]


class Forest:
    """Random forest over numbers: Gini splits on random features and cut points, bootstrapped trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 9, least: int = 3, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[i], y[i], depth, least, rng) for i in (rng.integers(0, len(y), len(y)) for _ in range(trees))]

    def _grow(self, x, y, depth, least, rng):
        nodes: list[list[float]] = []  # feature (-1: leaf), cut, left, right, share

        def split(rows: np.ndarray, left: int) -> int:
            me = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0, 0, 0, share])
            if not left or len(rows) < 2 * least or share in (0.0, 1.0):
                return me
            best = (share * (1 - share) - 1e-9, None)
            for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))) + 1, replace=False):
                v = x[rows, f]
                for cut in np.unique(rng.choice(v, min(12, len(v)), replace=False)):
                    low = v <= cut
                    n = int(low.sum())
                    if least <= n <= len(v) - least:
                        p, q = y[rows][low].mean(), y[rows][~low].mean()
                        gini = (n * p * (1 - p) + (len(v) - n) * q * (1 - q)) / len(v)
                        if gini < best[0]:
                            best = (gini, (f, cut, low))
            if best[1]:
                f, cut, low = best[1]
                a, b = split(rows[low], left - 1), split(rows[~low], left - 1)
                nodes[me][:4] = [f, cut, a, b]
            return me

        split(np.arange(len(y)), depth)
        return np.array(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the trees' votes for a secret."""
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(low, t[at, 2], t[at, 3]), at).astype(int)
            total += t[at, 4]
        return total / len(self.trees)


def labelled_findings(vocabulary: Sequence[str], n: int = 4000, seed: int = 5) -> list[tuple[str, str, int]]:
    """(text with one finding, path, label) from a fixed seed; half are secrets."""
    rng = random.Random(seed)
    vocabulary = list(vocabulary) or ["alpha", "beta", "gamma", "delta"]
    chars = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    lower_hex = "0123456789abcdef"
    word = lambda: rng.choice(vocabulary)
    prose = lambda k: " ".join(word() for _ in range(k))
    name = lambda: rng.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "client_secret", "access_token", "AUTH_TOKEN", "db_password", "TOKEN", "SECRET_KEY", "private_key"])
    sign = lambda: rng.choice([" = ", "=", ": ", ":", " := "])
    quote = lambda: rng.choice(['"', '"', "'", ""])
    alnum = string.ascii_letters + string.digits

    def secret() -> str:
        return rng.choice([
            lambda: chars(lower_hex, rng.choice([32, 40, 40, 48, 64])),
            lambda: chars(lower_hex, 40).upper(),
            lambda: chars(alnum, rng.randint(20, 48)),
            lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode(),
            lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16),
            lambda: "ghp_" + chars(alnum, 36),
            lambda: "sk_live_" + chars(alnum, 24),
            lambda: chars(alnum + "!#%&*+-?@", rng.randint(10, 18)),
        ])()

    def shaped() -> str:
        return rng.choice(["AKIA" + chars(string.ascii_uppercase + string.digits, 16), "ghp_" + chars(alnum, 36), "xoxb-" + chars(string.digits, 12) + "-" + chars(alnum, 24), "sk_live_" + chars(alnum, 24)])

    def decoy() -> str:
        q = quote()
        return rng.choice([
            lambda: f"commit {chars(lower_hex, 40)}",
            lambda: f"sha256: {chars(lower_hex, 64)}",
            lambda: f"md5 checksum {chars(lower_hex, 32)}",
            lambda: f"uuid {uuid.UUID(bytes=rng.randbytes(16))}",
            lambda: f"{word()}_{word()}_{word()}_{rng.randint(1, 99)}_{word()}",
            lambda: f"{word()}/{word()}/{word()}{rng.randint(1, 2030)}/{word()}.{rng.choice(['html', 'png', 'txt'])}",
            lambda: f"{name()}{sign()}{q}{rng.choice(['your_api_key_here', 'changeme123', 'xxxxxxxxxxxxxxxx', 'EXAMPLE_TOKEN_1234567890', '${SECRET_TOKEN}', '<token-goes-here>', 'placeholder'])}{q}",
            lambda: f"{name()}{sign()}{q}{word()}{rng.choice(['', '_' + word(), '.' + word()])}{q}",
            lambda: f"{name()}{sign()}{word()}({word()}, {rng.randint(1, 9)})",
            lambda: f"{chars(string.digits, rng.randint(20, 30))}",
            lambda: f"{word()}-{word()}-{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{word()}",
            lambda: f"{word().capitalize()}{word().capitalize()}{rng.randint(1, 9)}{word().capitalize()}{word().capitalize()}{word().capitalize()}",
        ])()

    out = []
    for i in range(n):
        label = i % 2
        path = rng.choice(["src/app.py", "config/settings.yml", ".env", "README.md", "docs/guide.md", "tests/test_auth.py", "src0", "web", ""])
        q = quote()
        core = (f"{name()}{sign()}{q}{secret()}{q}" if rng.random() < 0.8 else shaped()) if label else decoy()
        out.append((f"{prose(rng.randint(0, 8))} {core}{rng.choice([' ', ', ', '. ', chr(10), '### ', '!! '])}{prose(rng.randint(0, 8))}", path, label))
    return out


class Scanner:
    """Dictionary and forest; small enough to be sent to every worker."""

    def __init__(self, words: Counter, findings: Sequence[tuple[str, str, int]] | None = None, threshold: float = 0.5, pairs: Counter | None = None):
        self.words, self.threshold = Words(words, pairs=pairs), threshold
        common = [w for w, _ in words.most_common(2000)]
        rows, labels = [], []
        for text, path, label in findings if findings is not None else labelled_findings(common):
            for kind, a, b in candidates(text):
                rows.append(features(text, kind, a, b, path, self.words))
                labels.append(label)
        self.forest = Forest(np.array(rows, float), np.array(labels, float)) if rows else None

    def scan(self, texts: Sequence[str | None], paths: Sequence[str | None]) -> list[list[tuple]]:
        rows, where = [], []
        for i, (text, path) in enumerate(zip(texts, paths, strict=True)):
            for kind, a, b in candidates(text) if text else ():
                rows.append(features(text, kind, a, b, path or "", self.words))
                where.append((i, kind, a, b))
        scores = self.forest.score(np.array(rows, float).reshape(-1, len(FEATURES))) if self.forest else np.ones(len(rows))
        out: list[list[tuple]] = [[] for _ in texts]
        for (i, kind, a, b), score in zip(where, scores, strict=True):
            out[i].append((a, b, KINDS[kind][0], round(float(score), 6), bool(score >= self.threshold), hashlib.sha256(texts[i][a:b].encode()).hexdigest()))
        return out


def learn(docs: DataFrame, dictionary: int = 20_000, transitions: int = 100_000, findings: Sequence[tuple[str, str, int]] | None = None, text: str = "text") -> Scanner:
    """The ``dictionary`` most frequent words and the ``transitions`` most frequent character pairs of all documents, and the forest.

    Words are counted before anything is dealt, so a word in every document is one row a task; ties
    go to the first by character order. Null texts have no words; without words the dictionary is empty.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}]+")).alias("w")).filter(F.length("w") >= 2)
    counts = saved(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "word_counts")
    edged = F.concat(F.lit("^"), "w", F.lit("$"))
    pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(edged, i, F.lit(2)))).alias("p")).groupBy("p").agg(F.sum("n").alias("n"))
    most = lambda df, key, n: Counter({r[key]: r["n"] for r in df.orderBy(F.desc("n"), key).limit(n).collect()})
    return Scanner(most(counts, "w", dictionary), findings, pairs=most(pairs, "p", transitions))


def scan(docs: DataFrame, scanner: Scanner, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each candidate in the whole texts: doc_id, start, stop (characters), kind, score, secret and secret_sha256.

    ``secret`` is false for those that the forest takes for false positives. The candidate itself isn't
    returned, only its hash. A null or empty text has none; repeated rows give their findings
    each; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(scanner)

    @F.pandas_udf("array<struct<start:long,stop:long,kind:string,score:double,secret:boolean,secret_sha256:string>>")
    def find(texts: pd.Series, paths: pd.Series) -> pd.Series:
        names = ("start", "stop", "kind", "score", "secret", "secret_sha256")
        return pd.Series([[dict(zip(names, f, strict=True)) for f in found] for found in sent.value.scan(texts.tolist(), paths.tolist())])

    where = F.col(path).cast("string") if path else F.lit("")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(find(F.col(text).cast("string"), where)).alias("f")).select("doc_id", "f.*")
