"""Byte-level BPE through per-worker caches of pre-tokens.

A byte-level BPE encodes each pre-token on its own, so a text's ids are its pre-tokens' ids in
order. Pre-tokens repeat; each worker keeps what it has encoded, and only new ones reach the
tokenizer library.
"""

from __future__ import annotations

import json
import os
import re

import regex

#: Pre-token pattern of byte-level BPE vocabularies (fixed value; \p{White_Space} is what the
#: tokenizer library's \s means, Python's \s would also take U+001C to U+001F).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for texts whose characters all lie below U+0250, with the classes spelt out (fixed
#: values) for the faster engine; only one alternative can match at any character but white space.
_LETTER, _DIGIT, _WHITE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_LATIN = re.compile(f" ?[{_LETTER}]+| ?[{_DIGIT}]+|'(?:[stmd]|re|ve|ll)| ?[^{_WHITE}{_LETTER}{_DIGIT}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_BEYOND = re.compile("[^\x00-\u024f]")

#: Byte-level vocabularies write bytes that aren't printable Latin-1 characters as U+0100 and on, in order (fixed values).
_UNPRINTABLE = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTES = {b: 0x100 + i for i, b in enumerate(_UNPRINTABLE)}

#: A worker forgets its cached pre-tokens beyond this many and starts anew: memory stays bounded.
CACHE_ENTRIES = 400_000
#: Pre-tokens longer than this aren't kept.
CACHE_LENGTH = 64


class Bpe:
    """One vocabulary file with its caches, living as long as the Python worker."""

    _open: dict[str, Bpe] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.any_find, self.latin_find, self.beyond = regex.compile(PATTERN).findall, _LATIN.findall, _BEYOND.search
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        made = json.loads(self.tokenizer.to_str())
        #: With nothing around the model but the byte-level pattern, its pre-tokens go to the model as they are.
        self.bare = made["normalizer"] is None and made["post_processor"] is None and (made["pre_tokenizer"] or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        self.tokenize = self.tokenizer.model.tokenize
        #: Special strings are cut out before the pattern splits the rest, as the library does.
        self.special = {a["content"]: a["id"] for a in added}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @classmethod
    def of(cls, path: str) -> Bpe:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def find(self, text: str) -> list[str]:
        return self.any_find(text) if self.beyond(text) else self.latin_find(text)

    def ids(self, piece: str) -> list[int]:
        """Ids of a pre-token or a special string."""
        if self.bare and piece not in self.special:
            return [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(_BYTES))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a whole text, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.find(part)
        return out


class Cache(dict):
    """piece -> value(piece), kept within bounds."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, piece: str):
        v = self.value(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = v
        return v
