"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980).

``stem_array`` runs as an Arrow function. Each batch is dictionary-encoded
first, so Python sees every distinct word of a part of it once, however often the
corpus repeats it; a bounded cache carries words over to later ones. A batch holds
ten thousand documents: it is stemmed in parts, and freed memory goes back to the
system after each batch, so a worker's memory depends on neither vocabulary nor corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.memory import release

PART = 1 << 17   # words stemmed together
CACHED = 1 << 18  # words whose stems a worker remembers

# --- fixed values: Porter's suffix rules, (suffix, replacement) --------------
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT_END = re.compile("[^aeiouy][aeiouy][^aeiouywxY]$")
_BY_LENGTH_2 = sorted(STEP_2, key=lambda r: -len(r[0]))
_BY_LENGTH_3 = sorted(STEP_3, key=lambda r: -len(r[0]))
_BY_LENGTH_4 = sorted(STEP_4, key=lambda s: -len(s))


def mark_consonant_y(word: str) -> str:
    """Write a y that acts as a consonant as Y."""
    word = re.sub("^y", "Y", word)
    return re.sub("([aeiouy])y", r"\1Y", word)


def _regions(word: str) -> tuple[int, int]:
    """Where the parts of measure > 0 and > 1 begin."""
    first = _REGION.match(word)
    if first is None:
        return len(word), len(word)
    second = _REGION.match(word, first.end())
    return first.end(), second.end() if second else len(word)


def _swap(word: str, rules, r1: int) -> str:
    for suffix, replacement in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + replacement if len(stem) >= r1 else word
    return word


def _past_and_gerund(word: str, r1: int) -> str:
    if word.endswith("eed"):
        return word[:-1] if len(word) - 3 >= r1 else word
    for suffix in ("ing", "ed"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if not _VOWEL.search(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(DOUBLES):
                return stem[:-1]
            if len(stem) == r1 and _SHORT_END.search(stem):
                return stem + "e"
            return stem
    return word


def _strip_residual(word: str, r2: int) -> str:
    for suffix in _BY_LENGTH_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if len(stem) < r2:
                return word
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem
    return word


def porter(word: str) -> str:
    w = mark_consonant_y(word)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    w = _past_and_gerund(w, r1)
    if w[-1:] in ("y", "Y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _BY_LENGTH_2, r1)
    w = _swap(w, _BY_LENGTH_3, r1)
    w = _strip_residual(w, r2)
    if w.endswith("e"):
        n = len(w) - 1
        if n >= r2 or (n >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_cached_porter = lru_cache(maxsize=CACHED)(porter)


def _stem_strings(words: pa.Array) -> pa.Array:
    parts = [_stem_part(words.slice(at, PART)) for at in range(0, len(words), PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _stem_part(words: pa.Array) -> pa.Array:
    encoded = words.dictionary_encode()
    stems = pa.array(
        [None if w is None else _cached_porter(w) for w in encoded.dictionary.to_pylist()],
        pa.string(),
    )
    return stems.take(encoded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_array(words: pa.Array) -> pa.Array:
    """Stem every word of an array column; NULL elements stay NULL."""
    lists = words.cast(pa.list_(pa.string()))
    flat = _stem_strings(lists.flatten())
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    mask = lists.is_null() if lists.null_count else None
    release()
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=mask)


@F.arrow_udf(T.StringType())
def stem_word(words: pa.Array) -> pa.Array:
    """Stem a string column."""
    return _stem_strings(words.cast(pa.string()))
