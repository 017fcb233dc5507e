"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflume.llm import alignment, ann, decontaminate, html_text, language_id, lexical_search, ngram_join, packing, retrieval_packing, sharding, substring_dedup, token_counts, token_files
from tarifflume.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(table(spark, sf_dir, "embeddings"))
    return ann.nearest(index, F.col("vec_id") % 50 == 0)


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=13, keep_text=False)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path, with_ids=False)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(table(spark, sf_dir, "documents"))


ORACLE["op10_decontamination"] = r"""
with cut as (
    select 'd' as kind, doc_id as id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F\x{80}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{2000}-\x{203F}]+'), lambda x: x <> '') as w from documents where doc_id is not null
    union all
    select 'i', item_id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F\x{80}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{2000}-\x{203F}]+'), lambda x: x <> '') from benchmark where item_id is not null),
shingle as (
    select distinct kind, id, s from (
        select kind, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as s from cut)),
size as (select id, count(*) as n from shingle where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, any_value(z.n) as n_item_shingles, count(*) as n_shared, count(*) / any_value(z.n) as containment
from shingle d join shingle i on d.kind = 'd' and i.kind = 'i' and d.s = i.s join size z on z.id = i.id
group by d.id, i.id having count(*) / any_value(z.n) >= 0.8
"""

ORACLE["op6_substring_dedup"] = r"""
with cut as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (
    select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from cut where len(w) >= 13)),
low as (select g, min(doc_id) as f from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from win join low using (g) where f < doc_id),
lists as (select doc_id, list(j) as js from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(len(js), 0) as n_removed,
    sha256(array_to_string(case when js is null then w else list_filter(w, lambda x, i: not list_contains(js, i)) end, ' ')) as kept_sha256
from cut left join lists using (doc_id)
"""

ORACLE["op2_ngram_join"] = r"""
with recursive cut as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
    select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from cut),
shingle as (select doc_id, len(s) as n, unnest(s) as g from sets),
link as (
    select a.doc_id as a, b.doc_id as b from shingle a join shingle b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select doc_id, len(s) as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id,
    (select count(*) from link where a = doc_id) as n_links
from sets
"""

ORACLE["op11_lexical_search"] = r"""
with cut as (
    select kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from (select 'd' as kind, doc_id as id, text from documents where text is not null union all select 'i', item_id, text from benchmark where text is not null)),
docs as (select id, len(w) as n from cut where kind = 'd' and len(w) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from docs),
posting as (select kind, id, term, count(*) as tf from (select kind, id, unnest(w) as term from cut) group by all),
weight as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as weight from posting, total where kind = 'd' group by term),
scored as (
    select i.id as item_id, d.id as doc_id, sum(i.tf * weight * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
    from posting i join posting d on i.kind = 'i' and d.kind = 'd' and i.term = d.term join weight on weight.term = d.term join docs on docs.id = d.id, total
    group by i.id, d.id)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
where rank <= 20
"""
