"""Every operator as a query over whole tables: name -> (spark, sf) -> DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schema
from corpusloom.functions.labels import label_array
from corpusloom.functions.mixtures import topic_short_name
from corpusloom.functions.text import min_len, no_digit, not_numeric, remove_words, tokenize
from corpusloom.constants import DF_BOUNDS, PUBLISHER_WORDS, PUBLISHER_WORDS_COMBINED
from corpusloom.operators import (
    corpus, distances, dtm, membership, models, near_titles, ranking, streamed_fits, terms, trends,
)
from corpusloom.operators.rows import unnest
from corpusloom.plans import study
from corpusloom.session import cut_lineage, new_folder
from corpusloom.sources import files
from verification import tables as t

MIN_DF, MAX_DF = 8, 100
K = 13
SWEEP = tuple(range(2, 31))  # topic counts scored on assignments
FITTED = SWEEP  # topic counts fitted one by one


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- corpus -------------------------------------------------------------------

def papers_with_abstract(spark, sf):
    return corpus.with_abstract(t.papers(spark, sf)).select("doc_id", "title", "year", "labels")


def cleaned_abstracts(spark, sf):
    # the tables hold no publisher notices, so some are appended first
    notice = (
        F.when(F.col("doc_id") % 4 == 0, " (C) 2010 Elsevier")
        .when(F.col("doc_id") % 4 == 1, " Crown Copyright 2009\nAll rights")
        .when(F.col("doc_id") % 4 == 2, " © 2011 from Authors").otherwise(" from Authors (c) 7")
    )
    papers = t.papers(spark, sf).withColumn("abstract", F.concat("abstract", notice))
    return corpus.clean_abstract(papers).select("doc_id", "abstract")


def cleaned_missing_abstracts(spark, sf):
    """The notice for papers without an abstract, written where it is missing."""
    abstract = F.when(F.col("abstract") == "", "[No abstract available]").otherwise(F.col("abstract"))
    papers = t.papers(spark, sf).withColumn("abstract", abstract)
    return corpus.with_abstract(corpus.clean_abstract(papers)).select("doc_id", F.md5("abstract").alias("abstract_md5"))


# --- files --------------------------------------------------------------------

def _with_lines_above(df, *lines):
    """String rows with further rows before the first of every task, so that
    each written file starts with them."""
    columns = df.columns

    def put(batches):
        wanted = pa.schema([pa.field(c, pa.string()) for c in columns])
        above = [[line[i] if i < len(line) else None for line in lines] for i in range(len(columns))]
        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in above], schema=wanted)
            yield pa.RecordBatch.from_arrays(batch.columns, schema=wanted)

    return df.mapInArrow(put, df.schema)


def reviewed_papers_csv(spark, sf):
    """Written as CSV files with a banner, with commas, above the header, and read back."""
    path = new_folder(spark, "reviewed")
    papers = t.papers(spark, sf).select(
        "labels", F.col("doc_id").cast("string").alias("source_id"), "title", "abstract",
        F.col("year").cast("string").alias("publication_year"),
    )
    lines = _with_lines_above(papers, ["Reviewed papers, final list", "a", "b"],
                              ["Labels", "Id", "Title", "Abstract", "Publication Year"])
    lines.write.option("quoteAll", True).option("escape", '"').csv(path)
    back = files.read_papers_csv(spark, path)
    return back.select(F.col("source_id").cast("bigint").alias("doc_id"), "title", "year", "labels",
                       F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"))


def recent_papers_csv(spark, sf):
    """Files whose columns stand in different order and number, stacked by name."""
    path = new_folder(spark, "recent")
    papers = t.papers(spark, sf).withColumn("extra", F.lit("x, y"))
    orders = (["year", "doc_id", "abstract", "title"], ["title", "extra", "abstract", "doc_id", "year"])
    for i, columns in enumerate(orders):
        part = papers.filter(F.col("doc_id") % 2 == i).select(*columns)
        part.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("append").csv(path)
    wanted = T.StructType([T.StructField("doc_id", T.LongType()), *schema.RECENT_PAPERS])
    back = files.read_papers_glob(spark, path, "*.csv", wanted)
    return back.select("doc_id", "title", "year", F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"))


def top_words_csv(spark, sf):
    """Topic word lists exported as CSV and read back."""
    path = new_folder(spark, "top-words")
    files.write_table(top_words(spark, sf), path, "csv")
    words = T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("top_topic_words", T.StringType())])
    return files.read_csv(spark, path, words)


def modelling_text(spark, sf):
    text = study.documents(t.papers(spark, sf))
    return text.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                       F.md5("text").alias("text_md5"))


def complete_papers(spark, sf):
    papers = t.papers(spark, sf).withColumn("abstract", F.nullif("abstract", F.lit("")))
    return corpus.complete_cases(papers).select("doc_id", "title", "year")


def document_numbers(spark, sf):
    papers = corpus.with_abstract(t.papers(spark, sf)).select("doc_id", "year")
    return corpus.with_doc_id(papers, "doc_id", "document")


def _sources(spark, sf):
    """English papers as the reviewed list, the others as the recent one, and
    titles wanted of the latter: those of labelled good quality, plus benchmark
    texts, which are titles of nothing."""
    papers = cut_lineage(t.papers(spark, sf))  # read several times
    columns = ["doc_id", "title", "abstract", "year"]
    reviewed = papers.filter(F.col("lang") == "en").select(columns)
    recent = papers.filter(F.col("lang") != "en").select(columns)
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    wanted = recent.join(good, "doc_id", "left_semi").select("title")
    missing = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("title"))
    return reviewed, recent, wanted.unionByName(missing).distinct()


def matched_titles(spark, sf):
    _, recent, wanted = _sources(spark, sf)
    return corpus.match_titles(wanted, recent).select("title", "doc_id", "year")


def merged_sources(spark, sf):
    return corpus.merge_sources(*_sources(spark, sf)).select(
        "source_ord", "doc_id", "title", "year"
    )


def distinct_titles(spark, sf):
    papers = t.papers(spark, sf).withColumn("source_ord", F.lit(1))
    return corpus.distinct_by_title(papers).select("doc_id", "title", "year")


# --- text and terms -----------------------------------------------------------

def _vocabulary(spark, sf, corpus_name):
    return terms.vocab_df(terms.unigrams(t.document_terms(spark, sf)), *DF_BOUNDS[corpus_name])


def unigram_vocab_reviewed(spark, sf):
    return _vocabulary(spark, sf, "reviewed")


def unigram_vocab_combined(spark, sf):
    return _vocabulary(spark, sf, "combined")


def unigram_vocab_full(spark, sf):
    return _vocabulary(spark, sf, "full")


def combined_token_counts(spark, sf):
    """Words left by the combined corpus's list of publisher words."""
    kept = terms.with_words(study.documents(t.papers(spark, sf)), t.lexicon(), stem=False,
                            drop_words=PUBLISHER_WORDS_COMBINED)
    return terms.word_rows(kept).groupBy("word").agg(F.count("*").alias("n"))


def token_counts(spark, sf):
    tokens = unnest(study.documents(t.papers(spark, sf)), tokenize(F.col("text")), "word")
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def filtered_token_counts(spark, sf):
    """Token filters one by one on rows instead of inside the document."""
    word = F.col("word")
    lexicon = t.lexicon()
    tokens = unnest(study.documents(t.papers(spark, sf)), tokenize(F.col("text")), "word")
    return tokens.filter(
        remove_words(word, lexicon) & not_numeric(word) & remove_words(word, PUBLISHER_WORDS)
        & min_len(word) & no_digit(word)
    ).groupBy("word").agg(F.count("*").alias("n"))


def word_positions(spark, sf):
    return terms.word_rows(t.words(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


def term_frequencies(spark, sf):
    return terms.term_counts(t.words(spark, sf))


def repeated_terms(spark, sf):
    return terms.unigrams(t.document_terms(spark, sf))


def bigram_counts(spark, sf):
    return terms.ngram_counts(t.words(spark, sf), 2)


def trigram_counts(spark, sf):
    return terms.ngram_counts(t.words(spark, sf), 3)


def common_terms(spark, sf):
    return terms.common_terms(terms.unigrams(t.document_terms(spark, sf)), MAX_DF)


def rare_terms(spark, sf):
    return terms.rare_terms(terms.unigrams(t.document_terms(spark, sf)), MIN_DF)


def unigram_vocab(spark, sf):
    return terms.vocab_df(terms.unigrams(t.document_terms(spark, sf)), MIN_DF, MAX_DF)


def pruned_terms(spark, sf):
    return terms.prune_vocab(terms.unigrams(t.stored_terms(spark, sf)), MIN_DF, MAX_DF)


def doc_length(spark, sf):
    return terms.doc_length(t.document_terms(spark, sf))


def bigram_collocations(spark, sf):
    return rounded(terms.collocations(t.document_terms(spark, sf), 2), "t")


def trigram_collocations(spark, sf):
    return rounded(terms.collocations(t.document_terms(spark, sf), 3), "t")


def all_terms(spark, sf):
    # read three times (words, their frequencies, collocations): written once
    return terms.all_terms(cut_lineage(t.document_terms(spark, sf)), MIN_DF, MAX_DF)


def corpus_totals(spark, sf):
    return terms.corpus_totals(all_terms(spark, sf))


def dtm_summary(spark, sf):
    return rounded(dtm.dtm_summary(all_terms(spark, sf)), "sparsity").withColumn(
        "longest_term", F.col("longest_term").cast("bigint")
    )


def top_total_terms(spark, sf):
    return dtm.top_total_terms(all_terms(spark, sf), 10)


def stemmed_words(spark, sf):
    return terms.stem_vocab(study.documents(t.papers(spark, sf)), t.lexicon())


def stemmed_vocab(spark, sf):
    return terms.vocab_df(terms.unigrams(t.document_terms(spark, sf, stem=True)), MIN_DF, MAX_DF)


def stemmed_bigrams(spark, sf):
    return rounded(terms.collocations(t.document_terms(spark, sf, stem=True), 2), "t")


# --- topics -------------------------------------------------------------------

def doc_topics(spark, sf):
    return rounded(models.long_gamma(t.mixtures(spark, sf, K)), "gamma")


def topic_terms(spark, sf):
    return rounded(models.long_beta(t.beta(spark, sf, K)), "beta")


def _top_terms(spark, sf, n=20):
    return ranking.top_terms(models.long_beta(t.beta(spark, sf, K)), n)


def top_terms(spark, sf):
    return rounded(ranking.ordered(_top_terms(spark, sf), "beta", "term"), "beta")


def top_100_terms(spark, sf):
    return rounded(_top_terms(spark, sf, 100), "beta")


def top_words(spark, sf):
    return ranking.top_words(_top_terms(spark, sf))


def term_ranks(spark, sf):
    return ranking.term_rank(_top_terms(spark, sf)).select("topic", "term", "term_rank")


def shared_top_terms(spark, sf):
    """Terms in the top lists of more than one topic."""
    return ranking.shared_top_terms(top_terms(spark, sf), 2)


def top_docs(spark, sf):
    mixtures = cut_lineage(t.mixtures(spark, sf, K, "title", "year"))
    gamma = models.long_gamma(mixtures, "title", "year")
    return rounded(ranking.top_docs(gamma, 20), "gamma")


def top_docs_csv(spark, sf):
    """Top documents with their text written as CSV and read back: quotes, line
    breaks and empty abstracts come through."""
    mixtures = cut_lineage(t.mixtures(spark, sf, K, "title", "abstract"))
    gamma = models.long_gamma(mixtures, "title", "abstract")
    path = new_folder(spark, "top-docs")
    files.write_table(rounded(ranking.top_docs(gamma, 20), "gamma"), path, "csv")
    columns = T.StructType.fromDDL("topic int, doc_id long, title string, abstract string, gamma double")
    return files.read_csv(spark, path, columns)


def top_100_terms_csv(spark, sf):
    path = new_folder(spark, "top-terms")
    files.write_table(top_100_terms(spark, sf), path, "csv")
    return files.read_csv(spark, path, T.StructType.fromDDL("topic int, term string, beta double"))


def near_equal_titles(spark, sf):
    return rounded(near_titles.near_titles(t.papers(spark, sf)), "similarity")


def top_docs_joined(spark, sf):
    """Paper columns fetched by a join, for models fitted elsewhere."""
    top = ranking.top_docs(models.long_gamma(cut_lineage(t.mixtures(spark, sf, K))), 10)
    return rounded(corpus.with_info(top, t.papers(spark, sf), ["year", "labels"]), "gamma")


def gamma_wide(spark, sf):
    wide = models.gamma_wide(t.mixtures(spark, sf, K, "year"), K, "year")
    return rounded(wide, *[schema.wide_name(i) for i in range(1, K + 1)])


def gamma_pivoted(spark, sf):
    wide = models.pivot_gamma(models.long_gamma(t.mixtures(spark, sf, K)), K)
    return rounded(wide, *[schema.wide_name(i) for i in range(1, K + 1)])


def dominant_topic(spark, sf):
    return membership.dominant_topic(t.mixtures(spark, sf, K))


def dominant_topic_long(spark, sf):
    return membership.dominant_topic_long(models.long_gamma(t.mixtures(spark, sf, K)), K)


def dominant_topic_exported(spark, sf):
    """The wide table written, read back and ranked, as two jobs share it."""
    path = new_folder(spark, "gamma-wide")
    files.write_table(models.gamma_wide(t.mixtures(spark, sf, K, "year"), K, "year"), path)
    extra = schema.RECENT_PAPERS["year"]
    wide = files.read_papers(spark, path, columns=schema.gamma_wide(K, [extra]))
    return membership.dominant_topic_wide(wide, K, "year")


def topic_size(spark, sf):
    sizes = membership.topic_size(membership.dominant_topic(t.mixtures(spark, sf, K)))
    return membership.topic_size_named(sizes, t.topic_names(spark, K))


def topic_short_names(spark, sf):
    sizes = membership.topic_size(membership.dominant_topic(t.mixtures(spark, sf, K)))
    named = membership.with_topic_name(sizes, t.topic_names(spark, K), "dom_topic")
    return named.select("dom_topic", topic_short_name(F.col("topic_name")).alias("name"), "n")


def topic_generality(spark, sf):
    return rounded(membership.topic_generality(t.mixtures(spark, sf, K)),
                   "selected_weight", "unselected_weight")


# --- labels -------------------------------------------------------------------

def _dominant_labelled(spark, sf, k):
    return membership.dominant_topic(t.mixtures(spark, sf, k, "labels"), "labels")


def concordance(spark, sf):
    named = membership.with_topic_name(
        _dominant_labelled(spark, sf, 4), t.expert_names(spark), "dom_topic"
    )
    return rounded(membership.concordance(named), "prop")


def label_topic_crosstab(spark, sf):
    return membership.label_topic_crosstab(_dominant_labelled(spark, sf, 10))


def fish_docs_topics(spark, sf):
    """Topics of documents that mention "Fish" in a label."""
    papers = t.papers(spark, sf)
    fish = membership.docs_with_label(papers, "Fish")
    return membership.docs_in(membership.dominant_topic(t.mixtures(spark, sf, 10)), fish)


def label_combos(spark, sf):
    return membership.label_combo_counts(t.papers(spark, sf))


def label_share(spark, sf):
    return rounded(membership.label_share(t.papers(spark, sf)), "retained", "all")


def _share(papers):
    total = papers.agg(F.count("*")).scalar()
    rows = papers.select(F.explode(F.array_distinct(label_array(F.col("labels")))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", (F.col("n") / total).alias("share")
    )


def label_share_joined(spark, sf):
    papers = t.papers(spark, sf)
    joined = membership.share_joined(_share(corpus.with_abstract(papers)), _share(papers))
    return rounded(joined, "retained", "all")


def label_share_long(spark, sf):
    return rounded(membership.share_long(membership.label_share(t.papers(spark, sf))), "prop")


# --- time ---------------------------------------------------------------------

def pubs_per_year(spark, sf):
    return trends.pubs_per_year(corpus.up_to_year(t.papers(spark, sf)))


def _dominant_dated(spark, sf):
    dom = membership.dominant_topic(t.mixtures(spark, sf, K, "year"), "year")
    return corpus.up_to_year(dom)


def pubs_per_year_topic(spark, sf):
    return trends.pubs_per_year_topic(_dominant_dated(spark, sf))


def _per_period(scheme):
    def query(spark, sf):
        return trends.pubs_per_period(pubs_per_year(spark, sf), scheme)
    return query


def pubs_per_period_topic(spark, sf):
    return trends.pubs_per_period_topic(_dominant_dated(spark, sf), "b")


def _popularity(spark, sf, k=K):
    return trends.popularity_by_year(corpus.up_to_year(t.mixtures(spark, sf, k, "year")), k)


def popularity_by_year(spark, sf):
    return rounded(_popularity(spark, sf), "total_gamma")


def popularity_by_year_joined(spark, sf):
    """Years fetched by a join, for models fitted elsewhere."""
    dated = corpus.with_info(t.mixtures(spark, sf, K), t.papers(spark, sf), ["year"])
    return rounded(trends.popularity_by_year(dated, K), "total_gamma")


def popularity_share(spark, sf):
    return rounded(trends.popularity_share(_popularity(spark, sf)), "prop")


def _by_period(scheme, k=K):
    def query(spark, sf):
        return rounded(trends.popularity_by_period(_popularity(spark, sf, k), scheme), "prop")
    return query


def pubs_per_period_topic_c(spark, sf):
    return trends.pubs_per_period_topic(_dominant_dated(spark, sf), "c")


def _trend_of(spark, sf, scheme):
    by_period = trends.popularity_by_period(_popularity(spark, sf), scheme)
    return rounded(trends.topic_trend(by_period), "avg_prop_change", "se")


def topic_trend_c(spark, sf):
    return _trend_of(spark, sf, "c")


def topic_trend_d(spark, sf):
    return _trend_of(spark, sf, "d")


def topic_trend(spark, sf):
    by_period = trends.popularity_by_period(_popularity(spark, sf), "b")
    trend = membership.with_topic_name(trends.topic_trend(by_period), t.topic_names(spark, K))
    return rounded(trend, "avg_prop_change", "se").orderBy("avg_prop_change", "topic")


def popularity_with_trend(spark, sf):
    by_period = trends.popularity_by_period(_popularity(spark, sf), "b")
    rows = trends.with_trend(by_period, trends.topic_trend(by_period))
    return rounded(rows, "prop", "avg_prop_change")


# --- distances ----------------------------------------------------------------

def topic_dissimilarity(spark, sf):
    return rounded(distances.topic_dissimilarity(t.beta(spark, sf, K)), "dist")


def topic_doc_dissimilarity(spark, sf):
    return rounded(distances.topic_doc_dissimilarity(t.mixtures(spark, sf, K)), "dist")


def distance_range(spark, sf):
    dist = distances.topic_doc_dissimilarity(t.mixtures(spark, sf, K))
    return rounded(distances.dist_range(dist), "min_dist", "max_dist")


def scaled_dissimilarity(spark, sf):
    return rounded(distances.minmax(distances.topic_dissimilarity(t.beta(spark, sf, K))), "dist")


def _gap(spark, sf, scaled):
    per_doc = t.stored_terms(spark, sf)
    by_terms = distances.topic_dissimilarity(t.beta(spark, sf, K, per_doc))
    by_docs = distances.topic_doc_dissimilarity(t.mixtures(spark, sf, K, per_doc=per_doc))
    return rounded(distances.research_gap(by_terms, by_docs, scaled), "gap")


def research_gap(spark, sf):
    return _gap(spark, sf, True)


def research_gap_raw(spark, sf):
    return _gap(spark, sf, False)


def _scores(spark, sf):
    rows = terms.unigrams(t.document_terms(spark, sf))
    keyed = rows.select("term", t.topic_key(F.col("term")).alias("key"), "n")
    return models.posterior_divergence(keyed, SWEEP)


def topic_divergence(spark, sf):
    return rounded(models.topic_divergence(t.beta(spark, sf, K), K), "score")


def ranked_topic_counts(spark, sf):
    return rounded(models.rank_topic_counts(_scores(spark, sf)), "score", "scaled")


# --- model fits (rows only: other engines have no LDA) ------------------------

def _matrix(spark, sf):
    per_doc = cut_lineage(t.document_terms(spark, sf, stem=True))
    kept = cut_lineage(terms.all_terms(per_doc, MIN_DF, MAX_DF))
    index = cut_lineage(dtm.term_index(kept))
    return index, cut_lineage(dtm.to_dtm(kept, index))


def document_term_matrix(spark, sf):
    kept = cut_lineage(all_terms(spark, sf))
    matrix = dtm.to_dtm(kept, dtm.term_index(kept))
    return matrix.select("doc_id", F.unwrap_udt("features").alias("v")).select(
        "doc_id",
        F.size("v.indices").cast("bigint").alias("n_terms"),
        F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total_n"),
        F.col("v.size").cast("bigint").alias("n_columns"),
    )


def lda_topics(spark, sf):
    return ranking.top_terms(models.long_beta(lda_study(spark, sf).beta), 20)


def lda_study(spark, sf, k=K, seed=13):
    """A whole study: stemmed terms, matrix, fit, its own gamma and beta."""
    return study.fit_topics(t.papers(spark, sf), t.lexicon(), k, seed, bounds=(MIN_DF, MAX_DF))


def lda_topic_terms(spark, sf):
    return models.long_beta(lda_study(spark, sf).beta)


def lda_doc_topics(spark, sf):
    return models.long_gamma(lda_study(spark, sf, 4, 1).mixtures)


def _dated_study(spark, sf):
    fitted = lda_study(spark, sf)
    dated = corpus.with_info(fitted.mixtures, t.papers(spark, sf), ["year"])
    return fitted, cut_lineage(dated)


def lda_topic_trend(spark, sf):
    """From raw documents to hot and cold topics of a fit."""
    fitted, dated = _dated_study(spark, sf)
    by_year = trends.popularity_by_year(corpus.up_to_year(dated), fitted.k)
    return trends.topic_trend(trends.popularity_by_period(by_year, "b"))


def lda_research_gap(spark, sf):
    """From raw documents to the gaps between a fit's topics."""
    fitted, dated = _dated_study(spark, sf)
    return distances.research_gap(
        distances.topic_dissimilarity(fitted.beta), distances.topic_doc_dissimilarity(dated)
    )


def topic_count_sweep(spark, sf):
    index, matrix = _matrix(spark, sf)
    return models.rank_topic_counts(models.topic_count_sweep(matrix, index, FITTED, seed=1))


def _streamed_fit(spark, sf, k=K, seed=13):
    """A mini-batch fit: stored matrix, index, topic counts of terms."""
    index, matrix = _matrix(spark, sf)
    (_, counts, _), = streamed_fits.fit_tables(matrix, index.count(), [k], seed, max_iter=5, batches=4)
    return matrix, index, counts


def lda_online_topics(spark, sf):
    _, index, counts = _streamed_fit(spark, sf)
    return ranking.top_terms(models.long_beta(models.topic_terms(counts, K, index)), 20)


def lda_online_doc_topics(spark, sf):
    matrix, _, counts = _streamed_fit(spark, sf)
    return models.long_gamma(streamed_fits.doc_topics(matrix, counts, K))


QUERIES = {
    f.__name__: f for f in (
        papers_with_abstract, cleaned_abstracts, modelling_text, complete_papers,
        document_numbers, matched_titles, merged_sources, distinct_titles,
        token_counts, filtered_token_counts, word_positions, term_frequencies,
        repeated_terms, bigram_counts, trigram_counts, common_terms, rare_terms,
        unigram_vocab, pruned_terms, doc_length, bigram_collocations,
        trigram_collocations, all_terms, corpus_totals, dtm_summary, top_total_terms,
        stemmed_words, stemmed_vocab, stemmed_bigrams,
        doc_topics, topic_terms, top_terms, top_100_terms, top_words, term_ranks,
        shared_top_terms, top_docs, top_docs_joined, gamma_wide, gamma_pivoted,
        dominant_topic, dominant_topic_long, dominant_topic_exported, topic_size,
        topic_short_names, topic_generality,
        concordance, label_topic_crosstab, fish_docs_topics, label_combos, label_share,
        label_share_joined, label_share_long,
        pubs_per_year, pubs_per_year_topic, pubs_per_period_topic, popularity_by_year,
        popularity_by_year_joined, popularity_share, topic_trend, popularity_with_trend,
        topic_dissimilarity, topic_doc_dissimilarity, distance_range,
        scaled_dissimilarity, research_gap, research_gap_raw, topic_divergence,
        ranked_topic_counts, document_term_matrix, lda_topics, lda_doc_topics,
        topic_count_sweep, top_docs_csv, top_100_terms_csv, near_equal_titles, lda_online_topics, lda_online_doc_topics, lda_topic_terms, lda_topic_trend, lda_research_gap,
        reviewed_papers_csv, recent_papers_csv, top_words_csv, pubs_per_period_topic_c, topic_trend_c, topic_trend_d,
        cleaned_missing_abstracts, unigram_vocab_reviewed, unigram_vocab_combined, unigram_vocab_full,
        combined_token_counts,
    )
}
for _scheme in "abcd":
    QUERIES[f"pubs_per_period_{_scheme}"] = _per_period(_scheme)
    QUERIES[f"popularity_by_period_{_scheme}"] = _by_period(_scheme)
