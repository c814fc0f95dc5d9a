"""The thirteen numbered queries and the pipeline, as ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benchlens.llm import decontamination, gif_media, html_template, license_scan, merge_dropout, near_dedup, periodic_runs, quality, quality_rules, sharding, token_rollup, warc, whitening
from benchlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_texts(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.roll_up(table(spark, sf_dir, "documents"))


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trip(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_warc": op3_warc,
    "op4_near_dedup": op4_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_gif": op7_gif,
    "op8_token_rollup": op8_token_rollup,
    "op9_html_template": op9_html_template,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
with item_words as (select item_id, {_WORDS} as w from benchmark),
windows as (select distinct item_id, array_to_string(w[i : i + 9], ' ') as k, least(len(w), 10) as l from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
doc_words as (select doc_id, {_WORDS} as w from documents),
places as (select doc_id, p, l, array_to_string(w[p : p + l - 1], ' ') as k from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as p from doc_words, (select distinct l from windows))),
found as (select doc_id, p, l, item_id from places join windows using (k, l)),
hits as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(p, p + l)) as q from found) group by 1),
items as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as names from (select distinct doc_id, cast(item_id as varchar) as i from found) group by 1)
select doc_id, len(w) as n_words, coalesce(hits.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
from doc_words left join hits using (doc_id) left join items using (doc_id)
"""

_OP3 = """
select page_id, n as payload_bytes, h as payload_digest, case when n >= 100 and page_id > least_id then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id > least_id then least_id end as refers_to
from (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as h, min(page_id) over (partition by sha256(coalesce(html, ''))) as least_id from pages)
"""

_OP4 = f"""
with recursive doc_words as (select doc_id, text, {_WORDS} as w from documents),
shingles as (select doc_id, s, count(*) as c from (select doc_id, array_to_string(w[i : i + 4], ' ') as s from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from doc_words where len(w) > 0)) group by 1, 2),
sizes as (select doc_id, sum(c) as n from shingles group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, sum(least(a.c, b.c)) as both_n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where both_n >= 0.8 * (p.n + q.n - both_n) union all select a.doc_id, b.doc_id from doc_words a join doc_words b on a.text = b.text and a.doc_id < b.doc_id where len(a.w) = 0),
ends as (select x, y from links union all select y, x from links),
reach(doc_id, z) as (select doc_id, doc_id from doc_words union select doc_id, y from reach join ends on z = x)
select doc_id, min(z) as class_id from reach group by 1
"""

_MEASURE = {m: (sql.replace(" div ", " // "), *rest) for m, (sql, *rest) in quality_rules.MEASURES.items()}
_LEVEL = """(select {keys}measure, max(total) as total, min(bucket) filter (4 * upto >= total) as low, min(bucket) filter (4 * upto >= 3 * total) as high from
  (select *, sum(n) over (partition by {keys}measure) as total, sum(n) over (partition by {keys}measure order by bucket) as upto from (select {keys}measure, bucket, sum(n) as n from sketch group by all)) group by all)"""
_BOUND = {m: f"q.measure = '{m}' and (v > high + {quality_rules.FENCE} * greatest(high - low, {least})" + (f" or v < low - {quality_rules.FENCE} * greatest(high - low, {least}))" if both else ")") for m, (_, both, least) in _MEASURE.items()}

_OP13 = rf"""
with texts as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as w from documents),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from texts) where regexp_matches(line, '[^ 	-]') group by 1),
windows as (select doc_id, i, array_to_string(w[i : i + {quality_rules.WINDOW - 1}], ' ') as k from (select *, unnest(range(1, len(w) - {quality_rules.WINDOW - 2})) as i from texts)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from windows) where c > 1),
repeats as (select doc_id, count(*) as n_repeat_words from (select distinct doc_id, unnest(range(i, i + {quality_rules.WINDOW})) as q from again) group by 1),
counts as (select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as n_marks
  from texts left join lines using (doc_id) left join repeats using (doc_id)),
flagged as (select *, n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words as base_failed from counts),
measured as ({" union all ".join(f"select doc_id, lang, source, '{m}' as measure, {sql} as v from flagged where not base_failed" for m, (sql, *_) in _MEASURE.items())}),
sketch as (select lang, source, measure, case when v < 128 then v else (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) end as bucket, count(*) as n from measured group by all),
chosen as (select g.lang, g.source, g.measure, coalesce(a.low, b.low, c.low) as low, coalesce(a.high, b.high, c.high) as high from (select distinct lang, source, measure from sketch) g
  left join {_LEVEL.format(keys="lang, source, ")} a on a.lang is not distinct from g.lang and a.source is not distinct from g.source and a.measure = g.measure and a.total >= {quality_rules.LEAST_DOCUMENTS}
  left join {_LEVEL.format(keys="lang, ")} b on b.lang is not distinct from g.lang and b.measure = g.measure and b.total >= {quality_rules.LEAST_DOCUMENTS}
  left join {_LEVEL.format(keys="")} c on c.measure = g.measure),
verdicts as (select doc_id, {", ".join(f"bool_or({x}) as {m}" for m, x in _BOUND.items())} from measured m join chosen q on q.lang is not distinct from m.lang and q.source is not distinct from m.source and q.measure = m.measure group by 1),
named as (select doc_id, concat_ws(',', {", ".join(f"case when {m} then '{m}' end" for m in _MEASURE)}) as failed from verdicts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(failed, '') = '' as kept, coalesce(failed, '') as failed, n_lines, n_capitals, n_marks
from flagged left join named using (doc_id)
"""

#: DuckDB SQL of those queries that SQL can express.  Compressed sizes, permutations by hash, fitted
#: models, code streams, tokenizers and page templates are tested against brute force, round trips or
#: held-out accuracy instead.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": _OP1, "op3_warc": _OP3, "op4_near_dedup": _OP4, "op13_quality_rules": _OP13}
