"""Token ids of the byte-level BPE vocabulary, through a pre-token cache.

``tokenizers`` splits a text into pre-tokens and merges inside each; equal
pre-tokens always give equal ids. ``Encoder`` splits with Python's ``re`` and
asks ``tokenizers`` only for pre-tokens it has not seen. The pattern's classes
are spelled out below U+0250 (and tested against the library code point by code
point). In a text with other code points each of these is replaced, for the
split only, by a stand-in of its class below U+0250; the class is asked of the
library's own pre-tokenizer when a code point is first seen. A pre-token's ids
are those of the library's own merge model. Only a text holding an added token's
string, or a code point that the library puts in no class, is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct

import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"

# The byte-level pattern's classes below U+0250.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = " \\t\\n\\x0b\\x0c\\r\x85\xa0"
PRETOKEN = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile("[^\x00-ɏ]")


# Stand-ins for other code points: a letter, a number, a space, anything else.
_STAND_INS = ("\u024f", "\xb2", "\xa0", "\xa1")


class ClassTable(dict):
    """Code point to stand-in, asked of a pre-tokenizer when first seen: a code
    point is of the class with whose stand-in it makes one pre-token. One of no
    class maps to U+0000."""

    def __init__(self, pre_tokenizer):
        super().__init__({c: c for c in range(0x250)})
        self._split = pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        # twice the stand-in, as a single space in front belongs to what follows
        one = [s for s in _STAND_INS if len(self._split(s + s + c)) == 1 and len(self._split(c + s + s)) == 1]
        self[code] = one[0] if len(one) == 1 else "\0"
        return self[code]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable Latin-1 byte stands for itself, the
    others, in order, for the code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class TwoGenerationCache(dict):
    """A dictionary that computes what it lacks and keeps at most twice
    ``limit`` entries: when full, its entries become the old generation and
    the previous old generation goes."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids as the library gives them, without begin, end or added tokens."""

    def __init__(self, path: str, cache_entries: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._classes = ClassTable(self._tokenizer.pre_tokenizer)
        self.size = self._tokenizer.get_vocab_size()
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._packed = TwoGenerationCache(lambda p: _pack(self.pretoken(p)), cache_entries)
        #: Token counts of pre-tokens, computed when first asked for.
        self.lengths = TwoGenerationCache(lambda p: len(self.pretoken(p)), cache_entries)

    def whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def pretoken(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self._model.tokenize(text.encode().decode("latin-1").translate(_LETTERS))]

    def pretokens(self, text: str) -> list[str] | None:
        """The pre-tokens whose concatenation the text is; None if it must be
        encoded whole."""
        if any(a in text for a in self._added):
            return None
        if not _OTHER.search(text):
            return PRETOKEN.findall(text)
        shape = text.translate(self._classes)
        if shape.count("\0") != text.count("\0"):
            return None
        return [text[m.start():m.end()] for m in PRETOKEN.finditer(shape)]

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pretokens = self.pretokens(text)
        if pretokens is None:
            return _pack(self.whole(text))
        return b"".join(map(self._packed.__getitem__, pretokens))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
