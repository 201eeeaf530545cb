"""Term statistics.

A document is one row, so everything that counts *within* a document (term and
n-gram frequencies, length, collocation scores) is worked out inside that row:
no shuffle and no join. Only statistics *across* documents are aggregated.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import BIGRAM_T, PUBLISHER_WORDS, TRIGRAM_T
from corpusloom.functions.arrays import count_items, let, place_in, search_steps, sum_of
from corpusloom.functions.stemming import stem_array, stem_word
from corpusloom.functions.text import (
    mask_stems, mask_words, ngram_term, ngrams, not_numeric, remove_words, tokenize,
)
from corpusloom.operators.rows import evaluated_once, unnest


# --- words --------------------------------------------------------------------

def with_words(docs: DataFrame, lexicon: Iterable[str], *, stem: bool = True,
               drop_words: Iterable[str] = PUBLISHER_WORDS, min_length: int = 3,
               name: str = "words") -> DataFrame:
    """Replace ``text`` by the filtered (and stemmed) words, position by
    position, NULL where a token was dropped."""
    words = mask_words("_tokens", lexicon, drop_words, min_length)
    if stem:
        words = mask_stems(stem_array(words), min_length)
    return (
        docs.withColumn("_tokens", tokenize(F.col("text")))
        .withColumn(name, words).drop("text", "_tokens")
    )


def word_rows(docs: DataFrame) -> DataFrame:
    """Long form of ``words``: doc_id, pos (from 1), word."""
    return docs.select("doc_id", F.posexplode_outer("words").alias("pos", "word")).filter(
        F.col("word").isNotNull()
    ).withColumn("pos", F.col("pos") + 1)


def stem_vocab(docs: DataFrame, lexicon: Iterable[str], *,
               drop_words: Iterable[str] = PUBLISHER_WORDS) -> DataFrame:
    """Every distinct word that reaches the stemmer, with its stem."""
    word = F.col("word")
    distinct_in_doc = F.array_distinct(tokenize(F.col("text")))
    reaching = unnest(docs, distinct_in_doc, "word").filter(
        remove_words(word, {*lexicon, *drop_words}) & not_numeric(word)
    )
    return reaching.distinct().select("word", stem_word("word").alias("stem"))


# --- per-document statistics ----------------------------------------------------

def min_count_for_bigram(threshold: float) -> int:
    """A bigram is no more frequent than its words, so p1, p2 >= p and
    t^2 <= n (1 - p) < n: no bigram below threshold^2 can pass."""
    return floor(threshold * threshold) + 1 if threshold > 0 else 1


def min_count_for_trigram(threshold: float) -> int:
    """Likewise t^2 <= n (1 - p) (1 + p)^2 <= 32 n / 27."""
    return floor(27 * threshold * threshold / 32) + 1 if threshold > 0 else 1


def collocation_t(n_gram: str, n_words: list[str], length: str) -> str:
    """SQL for Student's t of an n-gram against its words occurring independently."""
    size = f"cast({length} as double)"
    p = f"({n_gram} / {size})"
    chance = " * ".join(f"({n} / {size})" for n in n_words)
    return f"try_divide({p} - {chance}, sqrt({p} * (1 - {p}) / {size}))"


def _collocations(n: int, threshold: float) -> Column:
    """Tested n-grams of a row that holds words, unigrams and length.

    N-grams that are frequent enough for the test are few, so only they look
    their words up, by binary search in the sorted list of repeated words. A word
    that occurs once is not in it, and an n-gram with such a word is dropped.
    """
    at_least = min_count_for_bigram if n == 2 else min_count_for_trigram
    parts = ", ".join(f"split_part(c.item, ' ', {j})" for j in range(1, n + 1))
    found = ", ".join(
        "'n{0}', get(doc.ns, {1})".format(j, place_in("doc.items", f"g.w[{j - 1}]", "doc.steps")) for j in range(1, n + 1)
    )
    t = collocation_t("g.n", [f"g.n{j}" for j in range(1, n + 1)], "doc.length")
    fields = ", ".join(f"'w{j}', g.w[{j - 1}]" for j in range(1, n + 1))
    looked_up = f"""transform(transform(doc.candidates, c -> named_struct('n', c.n, 'w', array({parts}))),
        g -> named_struct('n', g.n, 'w', g.w, {found}))"""
    scored = f"transform({looked_up}, g -> named_struct({fields}, 'n', g.n, 't', {t}))"
    document = f"""named_struct('candidates', {count_items(ngrams("words", n), at_least(threshold))}, 'length', length,
        'items', transform(unigrams, u -> u.item), 'ns', transform(unigrams, u -> u.n), 'steps', {search_steps("unigrams")})"""
    return F.expr(let(document, "doc", f"filter({scored}, g -> g.t > {float(threshold)!r}D)"))


def doc_terms(docs: DataFrame, *, bigram_t: float = BIGRAM_T,
              trigram_t: float = TRIGRAM_T) -> DataFrame:
    """Replace ``words`` by the document's statistics, one narrow stage:

    - ``unigrams`` array<struct<item, n>>: words occurring more than once
    - ``length``: their total count
    - ``bigrams``, ``trigrams`` array<struct<w1, .., n, t>>: collocations

    Documents in which no word occurs twice have none of these and drop out.
    """
    others = [c for c in docs.columns if c != "words"]
    counted = evaluated_once(
        docs,
        {"words": F.col("words"), "unigrams": F.expr(count_items("array_compact(words)", 2))},
        F.size("unigrams") > 0, *others,
    )
    return counted.withColumn("length", F.expr(sum_of("unigrams", "n"))).withColumns({
        "bigrams": _collocations(2, bigram_t),
        "trigrams": _collocations(3, trigram_t),
    }).drop("words")


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    """Frequency of every n-gram in every document (before any test)."""
    grams = unnest(docs, F.expr(count_items(ngrams("words", n))), "g", "doc_id")
    words = [F.split_part("g.item", F.lit(" "), F.lit(j)).alias(f"w{j}") for j in range(1, n + 1)]
    return grams.select("doc_id", *words, "g.n")


def term_counts(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """Frequency of every word in every document."""
    counts = unnest(docs, F.expr(count_items("array_compact(words)", min_count)), "u", "doc_id")
    return counts.select("doc_id", F.col("u.item").alias("term"), "u.n")


def unigrams(terms: DataFrame) -> DataFrame:
    """Long form of ``doc_terms().unigrams``."""
    return unnest(terms, "unigrams", "u", "doc_id").select(
        "doc_id", F.col("u.item").alias("term"), "u.n"
    )


def collocations(terms: DataFrame, n: int) -> DataFrame:
    """Long form of the document collocations of n words, with their t."""
    column = "bigrams" if n == 2 else "trigrams"
    return unnest(terms, column, "g", "doc_id").select("doc_id", "g.*")


def doc_length(terms: DataFrame) -> DataFrame:
    """Length of documents that have any repeated word."""
    return terms.select("doc_id", "length")


# --- statistics across documents ------------------------------------------------

def doc_freq(counts: DataFrame) -> DataFrame:
    """Number of documents per term (one row per document and term comes in)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def common_terms(counts: DataFrame, max_df: int) -> DataFrame:
    return doc_freq(counts).filter(F.col("df") > max_df)


def rare_terms(counts: DataFrame, min_df: int) -> DataFrame:
    return doc_freq(counts).filter(F.col("df") < min_df)


def vocab_df(counts: DataFrame, min_df: int, max_df: int) -> DataFrame:
    """Terms kept by both bounds. Dropping common terms leaves the document
    frequency of other terms as it was, so the two removals are one range."""
    return doc_freq(counts).filter(F.col("df").between(min_df, max_df))


def prune_vocab(counts: DataFrame, min_df: int, max_df: int) -> DataFrame:
    """Rows of kept terms. No broadcast hint: the vocabulary may be large, so
    the choice is left to AQE, which knows its size when it matters and splits
    the partition of a very common (hence dropped) term."""
    kept = vocab_df(counts, min_df, max_df).select("term")
    return counts.join(kept, "term", "left_semi").select("doc_id", "term", "n")


def all_terms(terms: DataFrame, min_df: int, max_df: int) -> DataFrame:
    """Pruned words plus all collocations: doc_id, term, n."""
    def glued(column: str, size: int) -> Column:
        return F.transform(
            column, lambda g: F.struct(ngram_term(g, size).alias("term"), g["n"].alias("n"))
        )

    both = F.concat(glued("bigrams", 2), glued("trigrams", 3))
    grams = unnest(terms, both, "g", "doc_id").select("doc_id", "g.*")
    return prune_vocab(unigrams(terms), min_df, max_df).unionByName(grams)


def corpus_totals(terms: DataFrame) -> DataFrame:
    """Distinct terms and total count, by term first so that both fall out of
    one pre-aggregated shuffle."""
    per_term = terms.groupBy("term").agg(F.sum("n").alias("n"))
    return per_term.agg(
        F.count("*").alias("n_terms"), F.sum("n").alias("total_n")
    )
