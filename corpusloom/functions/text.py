"""Tokens, term filters and n-grams as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let
from corpusloom.stopwords import WORDS

# Unicode word boundaries: letters may be joined by . ' or a typographic
# apostrophe, digits also by , and ; ("don't", "3.14", but "fig.2" is two
# words). Quantifiers are possessive: no backtracking and no recursion on very
# long runs without spaces.
TOKEN = (
    r"_*+(?:(?:"
    r"[a-z\p{L}\p{M}]++(?:[.'’][a-z\p{L}\p{M}]++)*+"
    r"|[0-9\p{Nd}]++(?:[.,;'’][0-9\p{Nd}]++)*+"
    r")_*+)++"
)
# same language for engines without possessive marks
TOKEN_PORTABLE = TOKEN.replace("++", "+").replace("*+", "*")

# What a lenient string-to-number conversion accepts in a lower-case token.
NUMBER = r"^(?:inf(?:inity)?|0x[0-9a-f]+|[0-9]+(?:\.[0-9]*)?(?:e[0-9]+)?)$"
DIGIT = "[0-9]"


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-case word tokens in text order, ``array<string>``."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def not_numeric(word: Column) -> Column:
    return ~word.rlike(NUMBER)


def min_len(word: Column, n: int = 3) -> Column:
    return F.length(word) >= n


def no_digit(word: Column) -> Column:
    return ~word.rlike(DIGIT)


def remove_words(word: Column, words: Iterable[str]) -> Column:
    """True for words outside the list. Catalyst turns long lists into a hash
    set, so the test costs one lookup and needs no join."""
    words = sorted(set(words))
    return ~word.isin(words) if words else F.lit(True)


@lru_cache
def stop_words(*languages: str) -> tuple[str, ...]:
    """The stop-word lists of the given languages, merged."""
    merged = {w for lang in languages or ("english",) for w in WORDS[lang]}
    return tuple(sorted(merged))


def mask_words(tokens: str, lexicon: Iterable[str], drop_words: Iterable[str],
               min_length: int = 3) -> Column:
    """Replace dropped tokens of a named array column by NULL and keep every
    token at its position, so that n-grams still mean neighbours in the raw text.

    All word filters in one test, cheapest first. A number either holds a digit
    or is spelled inf(inity). Stemming takes letters off the end only, so digits
    and too short words can be dropped before it.

    Written as one SQL expression: a lexicon of a thousand literals is parsed in
    one go instead of crossing from Python word by word.
    """
    unwanted = sorted(set(lexicon) | set(drop_words) | {"inf", "infinity"})
    listed = ", ".join(_sql_literal(w) for w in unwanted)
    return F.expr(
        f"transform({tokens}, w -> case when length(w) >= {min_length} "
        f"and not w in ({listed}) and not rlike(w, '{DIGIT}') then w end)"
    )


def _sql_literal(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mask_stems(stems: Column, min_length: int = 3) -> Column:
    """Drop stems that came out too short."""
    return F.transform(stems, lambda s: F.when(min_len(s, min_length), s))


def ngrams(words: str, n: int) -> str:
    """SQL for an array of n-grams, words joined by a space (tokens hold none).
    A NULL (dropped) position or the end of the text makes the whole n-gram NULL
    and is left out."""
    later = "".join(f", ' ', get(ws, i + {j})" for j in range(1, n))
    return let(words, "ws", f"array_compact(transform(ws, (w, i) -> concat(w{later})))")


def ngram_term(gram: Column, n: int) -> Column:
    """Glue the parts of an n-gram with ``_`` (for display and the term list)."""
    return F.concat_ws("_", *[gram[f"w{j}"] for j in range(1, n + 1)])
