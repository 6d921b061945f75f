import hashlib
import re

import pytest

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="session")
def prose():
    """Deterministic words that depend on a seed."""

    def make(seed: int, n: int, letters: str = "abcdefghijklmnop") -> str:
        out, state = [], hashlib.sha256(str(seed).encode()).digest()
        while len(out) < n:
            state = hashlib.sha256(state).digest()
            out += ["".join(letters[b % len(letters)] for b in state[i : i + 2 + state[i] % 6]) for i in range(0, 24, 4)]
        return " ".join(out[:n])

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Rows with nulls, empty and very long texts, copies, near copies, ties, repeated rows and clashing extra columns."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: prose(2, 90), 5: None, 6: "", 7: "   \n\t ", 8: "one two", 9: "one two", 10: "ONE  two",
        11: prose(3, 30_000), 12: prose(4, 200) + "\n" + base, 13: "1234 %%% 5678", 14: "\n".join([prose(5, 12)] * 5), 15: "é" * 500 + " " + prose(6, 40), 16: prose(7, 3).upper() + " <|endoftext|> x",
        17: "a " * 900, 18: prose(8, 100) + " 　\u0085  \x1c\x1d x y  \n\n  z",
    }
    rows = [(k, v, "en", "s", 1, "k", 7, "g") for k, v in texts.items()] + [(4, texts[4], "en", "s", 1, "k", 7, "g"), (None, prose(9, 50), None, None, None, "k", 7, "g"), (None, None, None, None, None, "k", 7, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key_id string, n long, bits string")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)


def words(pattern: str, text: str | None) -> list[str]:
    return re.findall(pattern, (text or "").translate(LOW))
