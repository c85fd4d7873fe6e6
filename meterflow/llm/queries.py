"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meterflow.llm import bpe, decontaminate, fingerprints, html, jaccard, langid, licenses, packing, quality, runs, substring, toxicity, whitening
from meterflow.llm.base import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find_runs(table(spark, sf_dir, "documents"), runs.repeating))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_substring_dedup, op3_html_extraction, op4_bpe, op5_ngram_jaccard, op6_licenses, op7_language, op8_fingerprints, op9_packing, op10_quality, op11_whitening, op12_runs, op13_decontamination, pipeline]
    return {f.__name__: f for f in found}


_SUBSTRING = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 48)) as p, w from d where len(w) >= 50),
h as (select doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) as h from win),
first as (select h, min(doc_id) as low from h group by h),
hit as (select distinct doc_id, unnest(range(p, p + 50)) as q from h join first using (h) where low < doc_id),
gone as (select doc_id, list(q) as qs from hit group by doc_id),
kept as (select doc_id, len(w) as n, case when qs is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(qs, x[2])), lambda x: x[1]) end as k from d left join gone using (doc_id))
select doc_id, n::bigint as n_words, (n - len(k))::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept"""


_JACCARD = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from d),
size as (select doc_id, count(*) as n from g group by 1),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y, c = a.n and c = b.n as same from pair join size a on a.doc_id = x join size b on b.doc_id = y where c >= 0.8 * (a.n + b.n - c) - 1e-9),
near as (select x, y, same from link union all select y, x, same from link),
reach as (select x as doc_id, y as other from near union select r.doc_id, b.y from reach r join near b on r.other = b.x)
select d.doc_id, least(d.doc_id, coalesce((select min(y) from near where x = d.doc_id and same), d.doc_id)) as class_id, (select count(*) from near where x = d.doc_id) as n_links, least(d.doc_id, coalesce((select min(other) from reach r where r.doc_id = d.doc_id), d.doc_id)) as group_id from d"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": _JACCARD, "op2_substring_dedup": _SUBSTRING, "op6_licenses": licenses.oracle(), "op13_decontamination": decontaminate.oracle()}
