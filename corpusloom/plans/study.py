"""From a paper table to terms and topics, the usual order of operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpusloom.constants import BIGRAM_T, DF_BOUNDS, PUBLISHER_WORDS, TRIGRAM_T
from corpusloom.operators import corpus, dtm, models, terms
from corpusloom.operators.em_fit import TopicFit
from corpusloom.session import cut_lineage


def documents(papers: DataFrame, *keep: str, clean: bool = True) -> DataFrame:
    """doc_id, (kept columns), text of the papers that have an abstract."""
    usable = corpus.with_abstract(papers)
    if clean:
        usable = corpus.clean_abstract(usable)
    return corpus.with_text(usable).select("doc_id", *keep, "text")


def document_terms(papers: DataFrame, lexicon: Iterable[str], *keep: str, stem: bool = True,
                   clean: bool = True, drop_words: Iterable[str] = PUBLISHER_WORDS,
                   bigram_t: float = BIGRAM_T, trigram_t: float = TRIGRAM_T) -> DataFrame:
    """Per-document term statistics; one stage from scan to result."""
    words = terms.with_words(
        documents(papers, *keep, clean=clean), lexicon, stem=stem, drop_words=drop_words
    )
    return terms.doc_terms(words, bigram_t=bigram_t, trigram_t=trigram_t)


@dataclass
class TopicStudy:
    """A fitted model and the tables every later question starts from."""

    model: TopicFit
    k: int
    index: DataFrame     # term, term_id
    beta: DataFrame      # term, weights
    mixtures: DataFrame  # doc_id, weights, kept paper columns


def fit_topics(papers: DataFrame, lexicon: Iterable[str], k: int, seed: int, *keep: str,
               bounds: tuple[int, int] = DF_BOUNDS["full"], stem: bool = True,
               drop_words: Iterable[str] = PUBLISHER_WORDS, max_iter: int = 20) -> TopicStudy:
    """Corpus to topics. Text is processed once: its terms are checkpointed
    before the vocabulary, the matrix and the fit read them repeatedly."""
    per_doc = cut_lineage(document_terms(papers, lexicon, stem=stem, drop_words=drop_words))
    kept = cut_lineage(terms.all_terms(per_doc, *bounds))
    index = cut_lineage(dtm.term_index(kept))
    matrix = cut_lineage(dtm.to_dtm(kept, index))
    model = models.fit_lda(matrix, k, seed, max_iter)
    counts, _ = models.stored_counts(model)
    mixtures = models.doc_topics(counts, k, matrix)
    if keep:
        mixtures = corpus.with_info(mixtures, papers, keep)
    return TopicStudy(model, k, index, models.topic_terms(counts, k, index), mixtures)
