"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.llm import byte_bpe, hard_negatives, html_extract, jaccard_join, language_id, mixing, simhash, substring_dedup, token_counts, url_filters, vector_search, whitening
from dexspark.llm.common import ship_code, table

#: Vocabulary of the BPE query and of the last stage of the pipeline.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Piece list of the token counts.
PIECES = "piece_bpe_32k.model"
#: Rules of the url query.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Mixing: values of the tree's levels and their weights, part of all tokens, epochs, seed.
DOMAINS, LANGUAGES = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 1}
SHARE, EPOCHS, SEED = 0.6, 3, 17
LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"


def mixing_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, tokens): the domain is the source's number modulo 4, tokens are words."""
    number = F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999"))
    domain = F.concat(F.lit("d"), F.coalesce(number.cast("int") % 4, F.lit(0)))
    return docs.select("doc_id", domain.alias("domain"), "lang", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("tokens"))


def mixing_weights(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        level: spark.createDataFrame([(k, float(w)) for k, w in values.items()], f"{level} string, weight double")
        for level, values in (("domain", DOMAINS), ("lang", LANGUAGES))
    }


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES.items()), "rule string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing_rows(table(spark, sf_dir, "documents"))
    return mixing.mix(rows, LEVELS, mixing_weights(spark), SHARE, EPOCHS, SEED)


def bpe_digests(docs: DataFrame) -> DataFrame:
    ids = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k_products(table(spark, sf_dir, "embeddings"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.beside_edited(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _filled(level: str, parents: str, weight: str, above: str) -> str:
    """One level of the budget tree: children sorted by capacity over weight, then the open level."""
    part = f"partition by {parents}" if parents else ""
    match = " and ".join(f"n.{c} is not distinct from a.{c}" for c in parents.split(", ")) if parents else "true"
    keys = f"{parents}, {level}" if parents else level
    return f"""
{level}_n as (select {keys}, sum(cap) as cap, cast({weight} as double) as w from leaves group by {keys}),
{level}_f as (
  select n.*, a.budget,
    (a.budget - coalesce(sum(n.cap) over (o rows between unbounded preceding and 1 preceding), 0)) /
      nullif(sum(n.w) over (o rows between current row and unbounded following), 0) as lv
  from {level}_n n join {above} a on {match}
  window o as ({part.replace('by ', 'by n.').replace(', ', ', n.')} order by n.cap / n.w, n.{level})),
{level}_o as (select *, max(case when not cap <= w * lv then lv end) over ({part}) as open from {level}_f),
{level}_b as (select {keys}, cast(greatest(least(case when cap <= w * lv or open is null then cap else floor(w * open) end, cap), 0) as bigint) as budget from {level}_o)"""


def _case(level: str, values: dict[str, int]) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " else 1 end"


MIXING_SQL = f"""
with docs as (
  select doc_id, concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as integer) % 4, 0)) as domain, lang, source,
    cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as tokens
  from documents),
used as (select * from docs where tokens > 0),
leaves as (select domain, lang, source, cast(sum(tokens) as bigint) as t, cast(sum(tokens) * {EPOCHS} as bigint) as cap from used group by domain, lang, source),
total as (select cast(floor(sum(t) * cast({SHARE} as double)) as bigint) as budget from leaves),
{_filled("domain", "", _case("domain", DOMAINS), "total").strip()},
{_filled("lang", "domain", _case("lang", LANGUAGES), "domain_b").strip()},
{_filled("source", "domain, lang", "1", "lang_b").strip()},
plan as (
  select l.*, b.budget // l.t as whole, b.budget % l.t as rest from leaves l
  join source_b b on l.domain = b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
rows_ as (
  select d.*, p.whole, p.rest,
    coalesce(sum(d.tokens) over (partition by p.domain, p.lang, p.source
      order by substring(md5(concat_ws(':', '{SEED}', p.whole, d.doc_id)), 1, 12), d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from used d join plan p on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source)
select doc_id, domain, lang, source, tokens, cast(whole as integer) as whole_epochs,
  cast(greatest(least(rest - before, tokens), 0) as bigint) as last_tokens
from rows_ where whole > 0 or before < rest
"""


OPERATORS = [
    op1_html_extract,
    op2_token_counts,
    op3_url_filters,
    op4_source_mixing,
    op5_byte_bpe,
    op6_language_id,
    op7_exact_top_k,
    op8_jaccard_join,
    op9_nearest_neighbours,
    op10_substring_dedup,
    op11_hard_negatives,
    op12_simhash,
    op13_whitening,
]


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


#: The longest rule whose host is the url's or a domain above it and whose path starts the url's.
URL_SQL = f"""
with rules(rule, verdict) as (values {", ".join(f"('{r}', '{v}')" for r, v in RULES.items())}),
parts as (select rule, verdict, split_part(rule, '/', 1) as rhost, substring(rule, length(split_part(rule, '/', 1)) + 1) as rpath from rules),
rest as (select page_id, case when contains(url, '://') then substring(url, position('://' in url) + 3) else '' end as r from pages),
urls as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
fits as (
  select u.page_id, p.rule, p.verdict, row_number() over (partition by u.page_id order by length(p.rule) desc, p.rule desc) as n
  from urls u join parts p on (u.host = p.rhost or ends_with(u.host, '.' || p.rhost)) and starts_with(u.path, p.rpath))
select u.page_id, coalesce(u.host, '') as host, coalesce(u.path, '') as path, f.rule, coalesce(f.verdict, 'allow') as verdict
from urls u left join fits f on u.page_id = f.page_id and f.n = 1
"""

#: Integer products of every query with every other vector.
PRODUCT_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as c
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

#: Every anchor with every row, then every positive with every row of another label.
NEGATIVE_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, d.vec_id, a.label = d.label as same, cast(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * d.c[i])) as bigint) as score
  from v a join v d on a.vec_id <> d.vec_id where a.vec_id % 50 = 0),
positives as (select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
found as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as integer) as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from found where rank <= 3
"""


def queries() -> dict:
    own = {f.__name__: f for f in OPERATORS}
    return {name: _shipped(f) for name, f in (own | {"pipeline": pipeline}).items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": URL_SQL, "op4_source_mixing": MIXING_SQL, "op7_exact_top_k": PRODUCT_SQL, "op11_hard_negatives": NEGATIVE_SQL}
