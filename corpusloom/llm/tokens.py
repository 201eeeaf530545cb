"""Token ids of whole texts, by a public vocabulary file of the ``tokenizers`` library.

The vocabulary splits a text into words before it merges bytes, and white space
never joins two words, so ids of a text are the ids of its white-space separated
chunks, one after another. Each worker remembers the ids of chunks and words it
has met (``REMEMBERED`` of each at most; then it starts afresh): a frequent word
is merged once, not once per occurrence. Texts outside Latin-1, and those that
hold a special token's string or an odd control character, are encoded chunk by
chunk by the library itself. Results equal ``Tokenizer.encode(text,
add_special_tokens=False).ids``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

REMEMBERED = 600_000
LONGEST = 48  # characters of a chunk that is remembered

_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"  # of lower-case Latin-1
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]|<\\|")
_PLAIN_SPACE = re.compile("[ \t\n\r]+")


def default_vocabulary() -> str:
    """Where this machine keeps the public 49k word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Remembered(dict):
    """A dictionary that computes what it lacks and forgets all when it is full."""

    def __init__(self, make) -> None:
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


def _visible_bytes() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for
    themselves, the other bytes for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Encoder:
    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        model, visible = tokenizer.model, _visible_bytes()

        def merged(word: str) -> bytes:
            units = "".join([visible[b] for b in word.encode("utf-8")])
            return np.array([t.id for t in model.tokenize(units)], "<u4").tobytes()

        words = _Remembered(merged)
        self._chunks = _Remembered(lambda chunk: b"".join(map(words.__getitem__, _WORD.findall(chunk))))
        self._other = _Remembered(
            lambda chunk: np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        )

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = not _SEPARATORS.search(text)
        if plain:
            return b"".join(map(self._chunks.__getitem__, text.lower().split()))
        return b"".join(map(self._other.__getitem__, filter(None, _PLAIN_SPACE.split(text))))


@lru_cache(2)
def encoder(vocabulary: str | None = None) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(vocabulary or default_vocabulary())
