"""Registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import (
    branch_and_bound, html_cut, minhash, mixing, one_bit_codes, packing, quality, repair, secrets, simhash, token_counts,
    trie, urls,
)


def op1_one_bit_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    return one_bit_codes.nearest(base, base.filter(F.col("vec_id") % 50 == 0), k=5)


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf}/documents.parquet"))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"))


def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge_quality(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    )


def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf}/documents.parquet"))


def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_cut.extract(spark.read.parquet(f"{sf}/pages.parquet"))


def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(spark.read.parquet(f"{sf}/documents.parquet"))


def op10_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    return branch_and_bound.highest(base, base.filter(F.col("vec_id") % 50 == 0), k=5)


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet")))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.conversation_keys(spark.read.parquet(f"{sf}/conversations.parquet"))))


def op13_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint)),
    lambda a, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::bigint[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)),
    4294967295::bigint), 4294967295::bigint)"""


def _edit(way: str, cost: str, edit: str, line: str = "''") -> str:
    """A way (cost, audit, lines) gone on with; a missing way stays missing."""
    return f"case when {way} is not null then {{'c': {way}.c + {cost}, 'a': {way}.a || '{edit}', 't': {way}.t || {line}}} end"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w is not null))"


def _repair_sql() -> str:
    """A plain dynamic programme over rows and states: at the start (s0), after
    system (s1), user (s2), assistant (s3); inserts follow every row."""
    def keep(way: str, initial: str) -> str:
        return f"case when fault not in (1, 2) and left(role, 1) = '{initial}' then " + _edit(
            way, "late", "K", "chr(10) || role || ':' || text") + " end"

    def rerole(way: str, role: str) -> str:
        return "case when fault not in (1, 2) then " + _edit(way, "late + 3", "R", f"chr(10) || '{role}:' || text") + " end"

    moved = ", ".join([
        _edit("s0", "4", "D") + " as m0",
        _least(_edit("s1", "4", "D"), keep("s0", "s")) + " as m1",
        _least(_edit("s2", "4", "D"), *[f(w, x) for w in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user"))]) + " as m2",
        _least(_edit("s3", "4", "D"), keep("s2", "a"), rerole("s2", "assistant")) + " as m3",
    ])
    user, assistant = ("chr(10) || 'user:'", "chr(10) || 'assistant:'")
    two = _least("m2", *[_edit(m, "3", "I", user) for m in ("m0", "m1", "m3")])
    return f"""with recursive rows as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from rows where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again
  from damaged),
faulty as (
  select conv_id, turn, role, text, place,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when again then 2
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') then 3 else 0 end as fault,
         left(lag(role) over (partition by conv_id order by place), 1) || left(role, 1) not in ('su', 'ua', 'au') as illegal
  from placed),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
         count(*) filter (fault = 3) as truncated, count(*) filter (illegal) as illegal, count(*) as n
  from faulty group by conv_id),
ways as (
  select conv_id, 0::bigint as place, s0, s1, {_edit("s0", "3", "I", user)} as s2,
         {_edit("s0", "6", "II", user + " || " + assistant)} as s3
  from (select distinct conv_id, {{'c': 0::bigint, 'a': '', 't': ''}} as s0,
               null::struct(c bigint, a varchar, t varchar) as s1 from conversations)
  union all
  select conv_id, place, m0 as s0, m1 as s1, m2 as s2, {_least("m3", _edit("m2", "3", "I", assistant))} as s3
  from (select conv_id, place, m0, m1, {two} as m2, m3
        from (select conv_id, place, {moved}
              from (select w.conv_id, f.place, s0, s1, s2, s3, role, text, fault,
                           case when fault = 3 then 3 else 0 end as late
                    from ways w join faulty f on f.conv_id is not distinct from w.conv_id and f.place = w.place + 1)))),
best as (
  select w.conv_id, {_least("s0", "s3")} as w, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank,
         coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal
  from ways w left join counted c on c.conv_id is not distinct from w.conv_id
  where w.place = coalesce(c.n, 0))
select conv_id, gaps, blank, duplicate, truncated, illegal, w.c as cost, w.a as audit,
       sha256(substr(w.t, 2)) as repaired_sha256 from best"""


_TRIE_SQL = f"""with own as (
  select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                       order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns,
         {_crc32("conv_id::varchar")} % 9 as h
  from conversations where conv_id is not null group by conv_id),
rebuilt as (
  select o.conv_id, list_concat(list_slice(f.turns, 1, o.h), list_slice(o.turns, o.h + 1, len(o.turns))) as turns
  from own o left join own f on f.conv_id = o.conv_id - o.conv_id % 5),
prefixes as (
  select conv_id, turns, d, list_slice(turns, 1, d) as prefix
  from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
nodes as (
  select prefix, d, min(conv_id) as conv_id, count(*) as n_convs,
         string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = d) as ends
  from prefixes group by prefix, d),
children as (
  select list_slice(prefix, 1, d - 1) as prefix, count(*) as n_children from nodes where d > 0 group by 1),
whole as (
  select n.*, coalesce(c.n_children, 0) as n_children,
         case when n.d = 0 then 0 else (n_convs - 1) * strlen(n.prefix[n.d].t) end as saved
  from nodes n left join children c on c.prefix = n.prefix),
sums as (
  select prefix, count(*) filter (n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
  from (select list_slice(prefix, 1, unnest(range(0, d + 1))) as prefix, n_children, saved from whole) group by prefix)
select w.conv_id, w.d as depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(w.ends, '')) as ends_sha256
from whole w join sums s on s.prefix = w.prefix
left join whole p on w.d > 0 and p.d = w.d - 1 and p.prefix = list_slice(w.prefix, 1, w.d - 1)"""

_VALID = """v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)"""

_TOP = """
select query_id, cast(rank as int) as rank, vec_id, score from (
  select query_id, vec_id, score,
         row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 5"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit_neighbours": op1_one_bit_neighbours,
    "op2_mix_sources": op2_mix_sources,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_one_bit_neighbours": f"""with {_VALID},
pairs as (
  select q.vec_id as query_id, c.vec_id,
         list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 50 = 0 and list_dot_product(q.e, q.e) > 0 and list_dot_product(c.e, c.e) > 0){_TOP}""",
    "op10_exact_top_k": f"""with {_VALID},
w as (select vec_id, list_transform(e, lambda x: floor(256 * x)) as e from v),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from w q join w c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 50 = 0){_TOP}""",
    "op11_conversation_repair": _repair_sql(),
    "op12_prefix_trie": _TRIE_SQL,
}
