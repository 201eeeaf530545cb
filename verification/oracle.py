"""DuckDB SQL for the registered queries.

Written from the definitions, with joins and groupings, not from the Spark
plans: n-grams by ``lead``, collocations by joins on document and word, stems by
a chain of regular expressions.
"""

from __future__ import annotations

from corpusloom.constants import (
    ALPHA_TOTAL, BIGRAM_T, CLEAN_RULES, DELTA, DF_BOUNDS, EXPERT_LABELS, OPENING_PERIOD_D,
    PERIOD_SCHEMES, PUBLISHER_WORDS, PUBLISHER_WORDS_COMBINED, TRIGRAM_T,
)
from corpusloom.functions.stemming import DOUBLES, STEP_2, STEP_3, STEP_4
from corpusloom.functions.text import NUMBER, TOKEN_PORTABLE, stop_words
from corpusloom.schema import wide_name
from verification.queries import K, MAX_DF, MIN_DF, SWEEP
from verification.tables import LANGUAGES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# --- corpus -------------------------------------------------------------------

_LABELS = ", ".join(
    f"case when ((doc_id % 15 + 1) & {1 << i}) > 0 then {lit(name)} end"
    for i, name in enumerate(EXPERT_LABELS)
)
PAPERS = f"""papers as (
  select doc_id, lang, split_part(text, chr(10), 1) as title,
         substring(text, length(split_part(text, chr(10), 1)) + 2) as abstract,
         cast(1966 + doc_id % 57 as int) as year,
         concat_ws(', ', {_LABELS}) as labels
  from documents)"""


def cleaned(column: str) -> str:
    for _, rule in CLEAN_RULES:
        column = f"regexp_replace({column}, {lit(rule)}, '', 'g')"
    return column


DOCS = f"""docs as (
  select doc_id, title, year, labels,
         concat_ws(' ', title, {cleaned('abstract')}) as text
  from papers where coalesce(abstract, '') <> '')"""

TOKENS = f"""tokens as materialized (
  select doc_id, unnest(tk) as word, generate_subscripts(tk, 1) as pos
  from (select doc_id, regexp_extract_all(lower(text), {lit(TOKEN_PORTABLE)}) as tk from docs))"""

_UNWANTED = ", ".join(lit(w) for w in sorted(set(stop_words(*LANGUAGES)) | set(PUBLISHER_WORDS)))
_KEEP = f"word not in ({_UNWANTED}) and not regexp_matches(word, {lit(NUMBER)})"
_KEEP_STEM = "length(word) >= 3 and not regexp_matches(word, '[0-9]')"


# --- stems --------------------------------------------------------------------

def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _swap_case(rules, region: str) -> str:
    whens = []
    for suffix, replacement in sorted(rules, key=lambda r: -len(r[0])):
        n = len(suffix)
        whens.append(
            f"when w like '%{suffix}' then case when length(w) - {n} >= {region} "
            f"then {_cut('w', n)} || '{replacement}' else w end"
        )
    return "case " + " ".join(whens) + " else w end"


def _step_4() -> str:
    whens = []
    for suffix in sorted(STEP_4, key=lambda s: -len(s)):
        n = len(suffix)
        test = f"length(w) - {n} >= r2"
        if suffix == "ion":
            test += " and (w like '%sion' or w like '%tion')"
        whens.append(f"when w like '%{suffix}' then case when {test} then {_cut('w', n)} else w end")
    return "case " + " ".join(whens) + " else w end"


_SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"
_UNIT = "[^aeiouy]*[aeiouy]+[^aeiouy]"
STEMS = f"""stem_0 as (
  select word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') as w
  from (select distinct word from tokens where {_KEEP})),
stem_r as (
  select word, w,
    case when regexp_matches(w, '^{_UNIT}') then length(regexp_extract(w, '^{_UNIT}'))
         else length(w) end as r1,
    case when regexp_matches(w, '^(?:{_UNIT}){{2}}') then length(regexp_extract(w, '^(?:{_UNIT}){{2}}'))
         else length(w) end as r2
  from stem_0),
stem_1a as (select word, r1, r2,
    case when w like '%sses' or w like '%ies' then {_cut('w', 2)}
         when w like '%s' and w not like '%ss' then {_cut('w', 1)} else w end as w
  from stem_r),
stem_1b as (select word, r1, r2, w,
    case when w like '%eed' then null
         when w like '%ing' then case when regexp_matches({_cut('w', 3)}, '[aeiouy]') then {_cut('w', 3)} end
         when w like '%ed' then case when regexp_matches({_cut('w', 2)}, '[aeiouy]') then {_cut('w', 2)} end
    end as b
  from stem_1a),
stem_1 as (select word, r1, r2,
    case when w like '%eed' then case when length(w) - 3 >= r1 then {_cut('w', 1)} else w end
         when b is null then w
         when regexp_matches(b, '(at|bl|iz)$') then b || 'e'
         when regexp_matches(b, '({"|".join(DOUBLES)})$') then {_cut('b', 1)}
         when length(b) = r1 and regexp_matches(b, '{_SHORT}') then b || 'e'
         else b end as w
  from stem_1b),
stem_1c as (select word, r1, r2,
    case when regexp_matches(w, '[aeiouy].*[yY]$') then {_cut('w', 1)} || 'i' else w end as w
  from stem_1),
stem_2 as (select word, r1, r2, {_swap_case(STEP_2, 'r1')} as w from stem_1c),
stem_3 as (select word, r1, r2, {_swap_case(STEP_3, 'r1')} as w from stem_2),
stem_4 as (select word, r1, r2, {_step_4()} as w from stem_3),
stem_5a as (select word, r1, r2,
    case when w like '%e' and (length(w) - 1 >= r2 or (length(w) - 1 >= r1
           and not regexp_matches({_cut('w', 1)}, '{_SHORT}'))) then {_cut('w', 1)} else w end as w
  from stem_4),
stems as (select word,
    replace(case when w like '%ll' and length(w) - 1 >= r2 then {_cut('w', 1)} else w end, 'Y', 'y') as stem
  from stem_5a)"""

# --- terms --------------------------------------------------------------------

WORDS = f"""words as materialized (
  select doc_id, pos, case when {_KEEP} and {_KEEP_STEM} then word end as word from tokens)"""
STEMMED = f"""words as materialized (
  select doc_id, pos, case when {_KEEP_STEM} then word end as word
  from (select t.doc_id, t.pos, s.stem as word from tokens t left join stems s on t.word = s.word))"""
COUNTS = "counts as (select doc_id, word as term, count(*) as n from words where word is not null group by all)"
REPEATED = "repeated as materialized (select * from counts where n > 1)"
LENGTHS = "lengths as materialized (select doc_id, cast(sum(n) as bigint) as length from repeated group by all)"
DF = "df as (select term, count(*) as df from repeated group by all)"
VOCAB = f"vocab as (select * from df where df >= {MIN_DF} and df <= {MAX_DF})"
PRUNED = "pruned as (select r.* from repeated r semi join vocab v on r.term = v.term)"
NEXT = """neighbours as (
  select doc_id, word as w1, lead(word, 1) over p as w2, lead(word, 2) over p as w3
  from words window p as (partition by doc_id order by pos))"""
BIGRAMS = """bigrams as materialized (
  select doc_id, w1, w2, count(*) as n from neighbours
  where w1 is not null and w2 is not null group by all)"""
TRIGRAMS = """trigrams as materialized (
  select doc_id, w1, w2, w3, count(*) as n from neighbours
  where w1 is not null and w2 is not null and w3 is not null group by all)"""


def scored(n: int, threshold: float) -> str:
    """Collocations of n words: one join per word on (document, word), one on
    the document, then the t test. Joins are materialized one by one; planned
    together they are reordered into pairs of words within a document."""
    name, source = {2: ("two", "bigrams"), 3: ("three", "trigrams")}[n]
    steps, last = [], source
    for j in range(1, n + 1):
        step = f"{name}_{j}"
        steps.append(f"""{step} as materialized (
  select g.*, r.n as n{j} from {last} g join repeated r on g.doc_id = r.doc_id and g.w{j} = r.term)""")
        last = step
    words = ", ".join(f"w{j}" for j in range(1, n + 1))
    chance = " * ".join(f"(n{j} / cast(length as double))" for j in range(1, n + 1))
    steps.append(f"""{name} as materialized (select * from (
  select *, (p - q) / sqrt(p * (1 - p) / l) as t from (
    select g.doc_id, {words}, g.n, cast(length as double) as l,
           g.n / cast(length as double) as p, {chance} as q
    from {last} g join lengths on g.doc_id = lengths.doc_id)) where t > {threshold})""")
    return ",\n".join(steps)


TWO, THREE = scored(2, BIGRAM_T), scored(3, TRIGRAM_T)
ALL = """all_terms as (
  select doc_id, term, n from pruned
  union all select doc_id, w1 || '_' || w2, n from two
  union all select doc_id, w1 || '_' || w2 || '_' || w3, n from three)"""
CELLS = "cells as (select doc_id, term, cast(sum(n) as bigint) as n from all_terms group by all)"

BASE = (PAPERS, DOCS, TOKENS)
PLAIN = BASE + (WORDS, COUNTS)
COUNTED = PLAIN + (REPEATED, LENGTHS)
PRUNE = COUNTED + (DF, VOCAB, PRUNED)
GRAMS = COUNTED + (NEXT, BIGRAMS, TRIGRAMS, TWO, THREE)
EVERYTHING = GRAMS + (DF, VOCAB, PRUNED, ALL)
STEM_BASE = BASE + (STEMS, STEMMED, COUNTS, REPEATED, LENGTHS)

# --- topics -------------------------------------------------------------------


def assigned(k: int, s: str = "") -> tuple[str, ...]:
    """gamma and beta of the deterministic assignment, names suffixed by s."""
    alpha = ALPHA_TOTAL / k
    return (
        f"assigned{s} as (select doc_id, term, cast((length(term) + 7 * ascii(term) + doc_id) % {k} + 1 as int) as topic, n from repeated)",
        f"topics{s} as (select cast(range as int) as topic from range(1, {k + 1}))",
        f"""gamma{s} as (
  select d.doc_id, t.topic, (coalesce(x.n, 0) + cast({alpha!r} as double)) / (d.length + {k} * cast({alpha!r} as double)) as gamma
  from lengths d cross join topics{s} t
  left join (select doc_id, topic, sum(n)::bigint as n from assigned{s} group by all) x
    on x.doc_id = d.doc_id and x.topic = t.topic)""",
        f"""beta{s} as (
  select w.term, t.topic,
         (cast(coalesce(x.n, 0) as double) + cast({DELTA} as double))
         / (cast(coalesce(y.n, 0) as double) + cast({DELTA} as double) * w.terms) as beta
  from (select distinct term, count(*) over () as terms from (select distinct term from assigned{s})) w
  cross join topics{s} t
  left join (select term, topic, sum(n)::bigint as n from assigned{s} group by all) x
    on x.term = w.term and x.topic = t.topic
  left join (select topic, sum(n)::bigint as n from assigned{s} group by all) y on y.topic = t.topic)""",
    )


def dominant(s: str = "") -> str:
    return f"""dom{s} as (
  select doc_id, cast(min(topic) as int) as dom_topic from (
    select doc_id, topic, gamma, max(gamma) over (partition by doc_id) as top from gamma{s})
  where gamma = top group by doc_id)"""


TOPICS = COUNTED + assigned(K)
TOP_TERMS = """top as (select topic, term, beta from (
  select *, rank() over (partition by topic order by beta desc) as r from beta) where r <= {n})"""
NAMES = f"names as (select cast(range as int) as topic, range || '. Topic ' || range as topic_name from range(1, {K + 1}))"
DATED = "dated as (select d.*, p.year from dom d join papers p using (doc_id) where p.year <= 2021)"
POPULARITY = """popularity as (
  select p.year, g.topic, sum(g.gamma) as total_gamma, count(*) as n_doc
  from gamma g join papers p using (doc_id) where p.year <= 2021 group by all)"""
TIME = TOPICS + (dominant(), DATED, POPULARITY)


def period(scheme: str) -> str:
    if scheme == "d":
        last, label = OPENING_PERIOD_D
        return f"case when year <= {last} then '{label}' else cast(year as varchar) end"
    return "case " + " ".join(f"when year <= {y} then '{p}'" for y, p in PERIOD_SCHEMES[scheme]) + " end"


def period_ord(scheme: str) -> str:
    if scheme == "d":
        return f"cast(greatest(year - {OPENING_PERIOD_D[0]}, 0) as int)"
    return "cast(case " + " ".join(
        f"when year <= {y} then {i}" for i, (y, _) in enumerate(PERIOD_SCHEMES[scheme])
    ) + " end as int)"


def by_period(scheme: str) -> str:
    return f"""by_period as (
  select * from (
    select {period(scheme)} as period, {period_ord(scheme)} as period_ord, topic,
           sum(total_gamma) / sum(n_doc) as prop
    from popularity group by all) where period is not null)"""


TREND = """trend as (
  select topic, avg(step) * 100 as avg_prop_change, stddev_samp(prop) / sqrt(count(*)) as se
  from (select *, prop - lag(prop) over (partition by topic order by period_ord) as step from by_period)
  group by topic)"""
CLASS = "case when avg_prop_change > 0.1 then 'Hot' when avg_prop_change < -0.1 then 'Cold' else 'Neutral' end as trend"


def distance(name: str, source: str, key: str, value: str) -> str:
    return f"""{name} as (
  select a.topic as topic_a, b.topic as topic_b,
         sum(abs(a.{value} - b.{value})) / sum(a.{value} + b.{value}) as dist
  from {source} a join {source} b on a.{key} = b.{key} and a.topic < b.topic group by all)"""


TERM_DIST = distance("term_dist", "beta", "term", "beta")
DOC_DIST = distance("doc_dist", "gamma", "doc_id", "gamma")


def scaled(name: str) -> str:
    return (f"(select topic_a, topic_b, (dist - min(dist) over ()) / "
            f"(max(dist) over () - min(dist) over ()) as dist from {name})")


def divergence(k: int, s: str = "") -> str:
    return f"""select {k} as k, sum(0.5 * (a.beta - b.beta) * ln(a.beta / b.beta)) / {float(k * (k - 1))} as score
  from beta{s} a join beta{s} b on a.term = b.term and a.topic < b.topic"""


# --- sources ------------------------------------------------------------------

SOURCES = PAPERS + """,
recent as (select doc_id, title, abstract, year from papers where lang <> 'en'),
wanted as (
  select title from recent where doc_id in (select doc_id from labels where quality = 1)
  union select text from benchmark),
matched as (
  select w.title, r.doc_id, r.abstract, r.year
  from (select distinct title from wanted) w left join
       (select *, row_number() over (partition by title order by doc_id) as rn from recent) r
    on r.title = w.title and r.rn = 1)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    papers = with_(PAPERS)
    sql["papers_with_abstract"] = papers + \
        "select doc_id, title, year, labels from papers where coalesce(abstract, '') <> ''"
    noticed = """abstract || case doc_id % 4 when 0 then ' (C) 2010 Elsevier'
      when 1 then ' Crown Copyright 2009' || chr(10) || 'All rights'
      when 2 then ' © 2011 from Authors' else ' from Authors (c) 7' end"""
    sql["cleaned_abstracts"] = papers + f"select doc_id, {cleaned('(' + noticed + ')')} as abstract from papers"
    sql["modelling_text"] = with_(PAPERS, DOCS) + \
        "select doc_id, length(text) as n_chars, md5(text) as text_md5 from docs"
    missing = cleaned("case when abstract = '' then '[No abstract available]' else abstract end")
    sql["cleaned_missing_abstracts"] = papers + \
        f"select doc_id, md5(a) as abstract_md5 from (select doc_id, {missing} as a from papers) where a <> ''"
    sql["reviewed_papers_csv"] = papers + \
        "select doc_id, title, year, labels, md5(abstract) as abstract_md5 from papers"
    sql["recent_papers_csv"] = papers + "select doc_id, title, year, md5(abstract) as abstract_md5 from papers"
    sql["complete_papers"] = papers + "select doc_id, title, year from papers where nullif(abstract, '') is not null"
    sql["document_numbers"] = papers + """select doc_id, year, row_number() over (order by doc_id) as document
      from papers where coalesce(abstract, '') <> ''"""
    sources = with_(SOURCES)
    sql["matched_titles"] = sources + "select title, doc_id, year from matched"
    sql["merged_sources"] = sources + """select source_ord, doc_id, title, year from (
      select *, row_number() over (partition by title order by source_ord, doc_id) as rn from (
        select cast(1 as int) as source_ord, doc_id, title, year from papers
        where lang = 'en' and coalesce(abstract, '') <> ''
        union all select cast(2 as int), doc_id, title, year from matched where doc_id is not null
      )) where rn = 1"""
    sql["distinct_titles"] = papers + """select doc_id, title, year from (
      select *, row_number() over (partition by title order by doc_id) as rn from papers) where rn = 1"""

    sql["near_equal_titles"] = papers + f"""select title_a, title_b, round(similarity, 6) as similarity from (
      with words as (
        select distinct title, list_sort(list_distinct(regexp_extract_all(lower(title), {lit(TOKEN_PORTABLE)}))) as w
        from papers where title is not null),
      classes as (select w, min(title) as title from words where len(w) > 0 group by w)
      select least(a.title, b.title) as title_a, greatest(a.title, b.title) as title_b,
             len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) as similarity
      from classes a join classes b on a.title < b.title
      where len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8
      union all
      select c.title, x.title, 1.0 from words x join classes c on c.w = x.w where c.title <> x.title)"""

    sql["token_counts"] = with_(*BASE) + "select word, count(*) as n from tokens group by all"
    sql["filtered_token_counts"] = with_(*BASE) + \
        f"select word, count(*) as n from tokens where {_KEEP} and {_KEEP_STEM} group by all"
    sql["word_positions"] = with_(*BASE, WORDS) + "select doc_id, pos, word from words where word is not null"
    sql["term_frequencies"] = with_(*PLAIN) + "select doc_id, term, n from counts"
    sql["repeated_terms"] = with_(*COUNTED) + "select doc_id, term, n from repeated"
    sql["bigram_counts"] = with_(*BASE, WORDS, NEXT, BIGRAMS) + "select * from bigrams"
    sql["trigram_counts"] = with_(*BASE, WORDS, NEXT, TRIGRAMS) + "select * from trigrams"
    sql["common_terms"] = with_(*COUNTED, DF) + f"select * from df where df > {MAX_DF}"
    # rare terms as first defined: after the common ones have been removed
    sql["rare_terms"] = with_(*COUNTED, DF) + f"""select term, count(*) as df
      from repeated r anti join (select term from df where df > {MAX_DF}) c on r.term = c.term
      group by term having count(*) < {MIN_DF}"""
    sql["unigram_vocab"] = with_(*PRUNE) + "select term, df from vocab"
    for corpus, (low, high) in DF_BOUNDS.items():
        sql[f"unigram_vocab_{corpus}"] = with_(*COUNTED, DF) + \
            f"select term, df from df where df >= {low} and df <= {high}"
    unwanted = ", ".join(lit(w) for w in sorted(set(stop_words(*LANGUAGES)) | set(PUBLISHER_WORDS_COMBINED)))
    sql["combined_token_counts"] = with_(*BASE) + f"""select word, count(*) as n from tokens
      where word not in ({unwanted}) and not regexp_matches(word, {lit(NUMBER)}) and {_KEEP_STEM} group by all"""
    sql["pruned_terms"] = with_(*COUNTED, DF) + f"""select r.doc_id, r.term, r.n from repeated r
      anti join (select term from df where df > {MAX_DF}) c on r.term = c.term
      anti join (select term from df where df < {MIN_DF}) d on r.term = d.term"""
    sql["doc_length"] = with_(*COUNTED) + "select doc_id, length from lengths"
    sql["bigram_collocations"] = with_(*GRAMS) + "select doc_id, w1, w2, n, round(t, 6) as t from two"
    sql["trigram_collocations"] = with_(*GRAMS) + "select doc_id, w1, w2, w3, n, round(t, 6) as t from three"
    sql["all_terms"] = with_(*EVERYTHING) + "select * from all_terms"
    sql["corpus_totals"] = with_(*EVERYTHING) + \
        "select count(distinct term) as n_terms, cast(sum(n) as bigint) as total_n from all_terms"
    sql["dtm_summary"] = with_(*EVERYTHING, CELLS) + """select count(distinct doc_id) as n_docs,
      count(distinct term) as n_terms, count(*) as nnz, cast(sum(n) as bigint) as total_n,
      max(length(term)) as longest_term,
      round(1 - count(*) / (cast(count(distinct doc_id) as double) * count(distinct term)), 6) as sparsity
      from cells"""
    sql["top_total_terms"] = with_(*EVERYTHING) + """select term, cast(sum(n) as bigint) as n
      from all_terms group by term order by n desc, term limit 10"""
    sql["document_term_matrix"] = with_(*EVERYTHING, CELLS) + """select doc_id, count(*) as n_terms,
      cast(sum(n) as bigint) as total_n, (select count(distinct term) from cells) as n_columns
      from cells group by doc_id"""
    sql["stemmed_words"] = with_(*BASE, STEMS) + "select word, stem from stems"
    sql["stemmed_vocab"] = with_(*STEM_BASE, DF, VOCAB) + "select term, df from vocab"
    sql["stemmed_bigrams"] = with_(*STEM_BASE, NEXT, BIGRAMS, TWO) + \
        "select doc_id, w1, w2, n, round(t, 6) as t from two"

    topics = with_(*TOPICS)
    sql["doc_topics"] = topics + "select doc_id, topic, round(gamma, 6) as gamma from gamma"
    sql["topic_terms"] = topics + "select term, topic, round(beta, 6) as beta from beta"
    top20, top100 = TOP_TERMS.format(n=20), TOP_TERMS.format(n=100)
    sql["top_terms"] = with_(*TOPICS, top20) + "select topic, term, round(beta, 6) as beta from top"
    sql["top_100_terms"] = with_(*TOPICS, top100) + "select topic, term, round(beta, 6) as beta from top"
    sql["top_words"] = with_(*TOPICS, top20) + """select topic,
      string_agg(term, ', ' order by beta desc, term) as top_topic_words from top group by topic"""
    sql["term_ranks"] = with_(*TOPICS, top20) + """select topic, term,
      cast(row_number() over (partition by topic order by beta, term desc) as int) as term_rank from top"""
    sql["shared_top_terms"] = with_(*TOPICS, top20) + \
        "select term, count(*) as n from top group by term having count(*) >= 2"
    sql["top_words_csv"] = sql["top_words"]
    top_docs = """ranked as (select *, rank() over (partition by topic order by gamma desc) as r from gamma)"""
    sql["top_docs"] = with_(*TOPICS, top_docs) + """select r.doc_id, p.title, p.year, r.topic,
      round(r.gamma, 6) as gamma from ranked r join papers p using (doc_id) where r <= 20"""
    sql["top_docs_csv"] = with_(*TOPICS, top_docs) + """select r.doc_id, p.title, p.abstract, r.topic,
      round(r.gamma, 6) as gamma from ranked r join papers p using (doc_id) where r <= 20"""
    sql["top_100_terms_csv"] = sql["top_100_terms"]
    sql["top_docs_joined"] = with_(*TOPICS, top_docs) + """select r.doc_id, r.topic,
      round(r.gamma, 6) as gamma, p.year, p.labels
      from ranked r left join papers p using (doc_id) where r <= 10"""
    wide = ", ".join(
        f"round(max(case when topic = {i} then gamma end), 6) as {wide_name(i)}" for i in range(1, K + 1)
    )
    sql["gamma_wide"] = topics + f"select g.doc_id, p.year, {wide} from gamma g join papers p using (doc_id) group by 1, 2"
    sql["gamma_pivoted"] = topics + f"select doc_id, {wide} from gamma group by 1"
    dom = with_(*TOPICS, dominant())
    sql["dominant_topic"] = dom + "select doc_id, dom_topic from dom"
    sql["dominant_topic_long"] = sql["dominant_topic"]
    sql["dominant_topic_exported"] = dom + "select doc_id, p.year, dom_topic from dom join papers p using (doc_id)"
    named = with_(*TOPICS, dominant(), NAMES,
                  "sizes as (select dom_topic, count(*) as n from dom group by all)")
    sql["topic_size"] = named + """select topic, topic_name, coalesce(n, 0) as n
      from names left join sizes on topic = dom_topic"""
    sql["topic_short_names"] = named + """select dom_topic, split_part(topic_name, '. ', 2) as name, n
      from sizes left join names on topic = dom_topic"""
    sql["topic_generality"] = topics + """select topic,
      round(avg(case when gamma >= top then gamma end), 6) as selected_weight,
      round(avg(case when gamma < top then gamma end), 6) as unselected_weight
      from (select *, max(gamma) over (partition by doc_id) as top from gamma) group by topic"""

    experts = "experts as (select * from (values " + ", ".join(
        f"({i}, {lit(n)})" for i, n in enumerate(EXPERT_LABELS, start=1)) + ") e(topic, topic_name))"
    sql["concordance"] = with_(*COUNTED, *assigned(4), dominant(), experts) + """select topic_name,
      count(*) as n, cast(sum(hit) as bigint) as consist, round(sum(hit) / count(*), 6) as prop from (
        select e.topic_name, case when list_contains(string_split(p.labels, ', '), e.topic_name)
          then 1 else 0 end as hit
        from dom d join papers p using (doc_id) left join experts e on e.topic = d.dom_topic)
      group by topic_name"""
    ten = with_(*COUNTED, *assigned(10), dominant())
    sql["label_topic_crosstab"] = ten + """select label, dom_topic, count(*) as freq from (
      select unnest(string_split(p.labels, ', ')) as label, d.dom_topic
      from dom d join papers p using (doc_id)) where label <> '' group by all"""
    sql["fish_docs_topics"] = ten + """select doc_id, dom_topic from dom
      where doc_id in (select doc_id from papers where regexp_matches(labels, 'Fish'))"""
    sql["label_combos"] = papers + """select labels, count(*) as n_all,
      nullif(count(case when coalesce(abstract, '') <> '' then 1 end), 0) as n_retained
      from papers group by labels"""
    shares = """shares as (
      select label, count(distinct case when kept then doc_id end) as n_retained,
             count(distinct doc_id) as n_all
      from (select doc_id, coalesce(abstract, '') <> '' as kept,
                   unnest(string_split(labels, ', ')) as label from papers)
      where label <> '' group by label),
    totals as (select count(*) as every, count(case when coalesce(abstract, '') <> '' then 1 end) as kept from papers)"""
    sql["label_share"] = with_(PAPERS, shares) + """select label, n_retained, n_all,
      round(n_retained / kept, 6) as retained, round(n_all / every, 6) as "all" from shares, totals"""
    sql["label_share_joined"] = with_(PAPERS, shares) + """select label,
      round(n_retained / kept, 6) as retained, round(n_all / every, 6) as "all"
      from shares, totals where n_retained > 0"""
    sql["label_share_long"] = with_(PAPERS, shares) + """
      select label, 'retained' as "group", round(n_retained / kept, 6) as prop from shares, totals
      union all select label, 'all', round(n_all / every, 6) from shares, totals"""

    sql["pubs_per_year"] = papers + "select year, count(*) as n from papers where year <= 2021 group by year"
    time = with_(*TIME)
    sql["pubs_per_year_topic"] = time + "select year, dom_topic, count(*) as n from dated group by all"
    sql["pubs_per_period_topic"] = time + f"""select {period('b')} as period, {period_ord('b')} as period_ord,
      dom_topic, count(*) as n from dated group by all"""
    sql["popularity_by_year"] = time + \
        "select year, topic, round(total_gamma, 6) as total_gamma, n_doc from popularity"
    sql["popularity_by_year_joined"] = topics + """select p.year, g.topic,
      round(sum(g.gamma), 6) as total_gamma, count(*) as n_doc
      from gamma g left join papers p using (doc_id) group by p.year, g.topic"""
    sql["popularity_share"] = time + "select year, topic, round(total_gamma / n_doc, 6) as prop from popularity"
    for scheme in "abcd":
        sql[f"pubs_per_period_{scheme}"] = papers + f"""select * from (
          select {period(scheme)} as period, {period_ord(scheme)} as period_ord, count(*) as n
          from papers where year <= 2021 group by all) where period is not null"""
        sql[f"popularity_by_period_{scheme}"] = with_(*TIME, by_period(scheme)) + \
            "select period, period_ord, topic, round(prop, 6) as prop from by_period"
    trend = with_(*TIME, by_period("b"), TREND, NAMES)
    sql["topic_trend"] = trend + f"""select topic, topic_name, round(avg_prop_change, 6) as avg_prop_change,
      round(se, 6) as se, {CLASS} from trend left join names using (topic)"""
    for scheme in "cd":
        sql[f"topic_trend_{scheme}"] = with_(*TIME, by_period(scheme), TREND) + f"""select topic,
          round(avg_prop_change, 6) as avg_prop_change, round(se, 6) as se, {CLASS} from trend"""
    sql["pubs_per_period_topic_c"] = time + f"""select * from (select {period('c')} as period,
      {period_ord('c')} as period_ord, dom_topic, count(*) as n from dated group by all) where period is not null"""
    sql["popularity_with_trend"] = trend + f"""select b.topic, b.period, b.period_ord,
      round(b.prop, 6) as prop, round(avg_prop_change, 6) as avg_prop_change, {CLASS}
      from by_period b left join trend t on b.topic = t.topic"""

    by_terms, by_docs = with_(*TOPICS, TERM_DIST), with_(*TOPICS, DOC_DIST)
    both = with_(*TOPICS, TERM_DIST, DOC_DIST)
    sql["topic_dissimilarity"] = by_terms + "select topic_a, topic_b, round(dist, 6) as dist from term_dist"
    sql["topic_doc_dissimilarity"] = by_docs + "select topic_a, topic_b, round(dist, 6) as dist from doc_dist"
    sql["distance_range"] = by_docs + \
        "select round(min(dist), 6) as min_dist, round(max(dist), 6) as max_dist from doc_dist"
    sql["scaled_dissimilarity"] = by_terms + \
        f"select topic_a, topic_b, round(dist, 6) as dist from {scaled('term_dist')}"
    gap = "select a.topic_a, a.topic_b, round(a.dist * b.dist, 6) as gap from {} a join {} b " \
          "on a.topic_a = b.topic_a and a.topic_b = b.topic_b"
    sql["research_gap"] = both + gap.format(scaled("term_dist"), scaled("doc_dist"))
    sql["research_gap_raw"] = both + gap.format("term_dist", "doc_dist")
    sql["topic_divergence"] = topics + f"select round(score, 6) as score from ({divergence(K)})"
    sweep = [assigned(k, f"_{k}") for k in SWEEP]
    scores = " union all ".join(divergence(k, f"_{k}") for k in SWEEP)
    sql["ranked_topic_counts"] = with_(*COUNTED, *[c for s in sweep for c in s], f"scores as ({scores})") + """
      select cast(k as int) as k, round(score, 6) as score,
        round((score - min(score) over ()) / (max(score) over () - min(score) over ()), 6) as scaled,
        k = first_value(k) over (order by score desc, k) as is_best from scores"""
    return sql
