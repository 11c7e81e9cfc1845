"""Mixing against a plain loop and DuckDB, searches against all pairs, and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from dexspark.llm import byte_bpe, language_id, mixing, registry, vector_search
from tests.llm.test_dedup import by_pairs, removed
from tests.conftest import SMALL

LEAVES = "p string, q string, tokens long"


def fill(children, budget):
    """Water level over (name, weight, capacity)."""
    out, left = dict.fromkeys((c[0] for c in children), 0), budget
    live = [c for c in children if c[1] > 0]
    while live and left > 1e-9:
        weight = sum(w for _, w, _ in live)
        full = [c for c in live if out[c[0]] + left * c[1] / weight >= c[2] - 1e-9]
        if not full:
            for name, w, _ in live:
                out[name] += left * w / weight
            return out
        for name, w, cap in full:
            left -= cap - out[name]
            out[name] = cap
        live = [c for c in live if c not in full]
        # the others start again from what is left
        out.update({c[0]: 0 for c in live})
        left = budget - sum(out.values())
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9, 1.5, 9.0])
def test_budgets_equal_a_plain_loop(spark, share):
    rows = [("a", "x", 100), ("a", "y", 50), ("b", "x", 10), ("b", "z", 5), (None, "x", 70), ("c", None, 30)]
    weights = {"p": {"a": 3.0, "b": 5.0, "c": 0.0}, "q": {"x": 2.0}}
    tables = {k: spark.createDataFrame(list(v.items()), f"{k} string, weight double") for k, v in weights.items()}
    got = {(r.p, r.q): r.budget for r in mixing.budgets(spark.createDataFrame(rows, LEAVES), ["p", "q"], tables, F.sum("tokens") * F.lit(share), 2).collect()}
    tops = {p: 2 * sum(t for a, _, t in rows if a == p) for p, _, _ in rows}
    high = fill([(p, weights["p"].get(p, 1.0), cap) for p, cap in tops.items()], int(share * sum(r[2] for r in rows)))
    for p in tops:
        low = fill([(q, weights["q"].get(q, 1.0), 2 * t) for a, q, t in rows if a == p], int(high[p]))
        for q, budget in low.items():
            assert abs(got[p, q] - budget) <= 2, (p, q, got[p, q], budget)


def test_shortage_goes_to_siblings_first(spark):
    rows = spark.createDataFrame([("a", "small", 5), ("a", "big", 1000), ("b", "x", 1000)], LEAVES)
    got = {r.q: r.budget for r in mixing.budgets(rows, ["p", "q"], {}, F.lit(400).cast("long"), 1).collect()}
    assert got == {"small": 5, "big": 195, "x": 200}


def test_mix_of_hard_inputs(spark):
    rows = [(1, None, "a", 10), (2, "d", None, 5), (2, "d", None, 5), (3, "d", "a", None), (4, "d", "a", -3), (None, "d", "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, tokens long").selectExpr("*", "'s' as source", "1 as _t", "2 as _bucket", "3 as whole_epochs")
    out = mixing.mix(docs, ["domain", "lang"], {}, 10.0, 2).collect()
    assert sorted((r.tokens, r.whole_epochs, r.last_tokens) for r in out) == [(5, 2, 0), (5, 2, 0), (8, 2, 0), (10, 2, 0)]
    assert mixing.mix(docs.limit(0), ["domain", "lang"], {}, 0.5).count() == 0


def test_budget_is_spent_to_the_token(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("d").alias("domain"), (1 + F.col("id") % 7).alias("tokens"))
    total = docs.agg(F.sum("tokens")).first()[0]
    for share in (0.31, 1.77):
        out = mixing.mix(docs, ["domain"], {}, share, 3, 5)
        assert out.agg(F.sum(F.col("whole_epochs") * F.col("tokens") + F.col("last_tokens"))).first()[0] == int(share * total)
        assert out.filter("last_tokens > 0 and last_tokens < tokens").count() <= 1


def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_with_sql(spark, name):
    got = registry.queries()[name](spark, SMALL)
    found = duck().execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def vectors(spark, seed, n=600, dims=16):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, dims)), 2)
    x[5] = x[100]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(700, None), (800, []), (900, [1.0] * (dims - 1) + [None]), (1000, [float("nan")] * dims), (1100, [float("inf")] + [0.0] * (dims - 1)), (1200, [1.0]), (1300, [0.0] * dims)]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as shard", "3 as score"), x


@pytest.mark.parametrize("shard", [50, 10_000])
def test_products_equal_all_pairs(spark, shard):
    docs, x = vectors(spark, 1)
    y = np.vstack([np.floor(1024 * x).astype(int), np.zeros((1, x.shape[1]), dtype=int)])
    names = np.array([*range(len(x)), 1300])
    got = vector_search.top_k_products(docs, shard=shard, queries=3).collect()
    for q in [*range(0, 600, 100), 1300]:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        s = y @ y[names == q][0]
        best = [k for k in np.lexsort((names, -s)) if names[k] != q][:10]
        assert [(v, t) for _, v, t in own] == [(names[k], s[k]) for k in best]
    assert {r.query_id for r in got} == {*range(0, 600, 100), 1300}


@pytest.mark.parametrize("shard", [50, 10_000])
def test_neighbours_are_nearly_all_found(spark, shard):
    docs, x = vectors(spark, 2)
    got = vector_search.nearest(docs, shard=shard, queries=3).collect()
    hits = 0
    for q in range(0, 600, 100):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(600), far)) if k != q][:10]
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        assert all(abs(far[v] - s) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(best))
    assert hits >= 54


def test_vectors_that_are_repeated_or_share_an_id(spark):
    rows = [(100, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [0.5, 0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [0.25, 0.0]), (9, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 3.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = 1024 * 1024
    got = sorted(map(tuple, vector_search.top_k_products(docs, k=2).collect()))
    first, second = [(7, one * 3 // 2), (100, one * 3 // 4)], [(7, one), (100, one * 3 // 4)]
    assert got == sorted([(100, n, *r) for own in (first, second) for n, r in enumerate(own, 1)] + [(200, 1, 9, int(15.5 * one))])
    near = sorted(map(tuple, vector_search.nearest(docs, k=2).collect()))
    assert [(q, n, v) for q, n, v, _ in near] == [(100, 1, 7), (100, 1, 100), (100, 2, 8), (100, 2, 100), (200, 1, 9)]
    with pytest.raises(Exception, match="too large"):
        vector_search.top_k_products(spark.createDataFrame([(100, [1e17]), (1, [1e17])], docs.schema)).collect()


@pytest.mark.parametrize("dims", [1, 7, 64, 130])
def test_bits_give_the_product_of_a_code(dims):
    rng = np.random.default_rng(dims)
    x, q = rng.standard_normal((50, dims)), rng.standard_normal(dims)
    bits, _, _ = vector_search.encode(x, np.zeros(dims), lambda v: v)
    unit = q / np.linalg.norm(q)
    got, off = vector_search.code_products(vector_search.words(bits), dims, unit)
    want = np.where(x > 0, 1, -1) @ unit / np.sqrt(dims)
    assert np.abs(got - want).max() <= off + 1e-9 and off < 0.05


@pytest.mark.parametrize("dims", [1, 3, 64, 512, 700, 1536])
def test_rotation_keeps_lengths_and_spreads_them(dims):
    x = np.random.default_rng(dims).standard_normal((20, dims))
    x[0] = 0
    x[0, 0] = 1  # all of it in one component
    y = vector_search.turned(x)
    assert y.shape[1] == max(512, 1 << (dims - 1).bit_length()) and np.allclose(y @ y.T, x @ x.T)
    assert np.abs(y[0]).max() < 6 / np.sqrt(y.shape[1])


def test_neighbours_of_long_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 1536)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vector_search.nearest(rows).collect()
    far = {q: np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)) for q in range(0, 1200, 100)}
    best = {(q, int(k)) for q, d in far.items() for k in [k for k in np.argsort(d, kind="stable") if k != q][:10]}
    assert len(best & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(best)


def test_scores_beyond_doubles_lose_no_document():
    """Sums far above 2^53, where shares of them as quotients would be off by more than one."""
    rng = np.random.default_rng(12)
    docs = rng.integers(-(2**27), 2**27, size=(500, 40))
    postings, ids = vector_search.Postings(docs), np.arange(500)
    for k in range(20):
        query = rng.integers(-(2**27), 2**27, size=40)
        at, score = postings.top(ids, query, -1, 5)
        every = docs @ query
        assert at.tolist() == np.lexsort((ids, -every))[:5].tolist() and score.tolist() == every[at].tolist()


def test_max_score_equals_all_products_and_skips_some():
    rng = np.random.default_rng(4)
    docs = (1024 * rng.standard_normal((3000, 24)) * np.geomspace(1, 0.05, 24)).astype(np.int64)
    postings, ids = vector_search.Postings(docs), np.arange(3000) * 2
    for k in range(40):
        query = docs[k] if k % 2 else -docs[k]
        at, score = postings.top(ids, query, k, 10)
        every = docs @ query
        want = [d for d in np.lexsort((ids, -every)) if d != k][:10]
        assert at.tolist() == want and score.tolist() == every[want].tolist()
    for weight in (3, 1, -1, -2, -7):
        for least in (-500, -1, 0, 1, 99, 100, 101):
            assert sorted(postings.reaching(1, weight, least).tolist()) == np.flatnonzero(weight * docs[:, 1] >= least).tolist()
    large = vector_search.Postings(docs << 14)
    at, score = large.top(ids, docs[0] << 14, 0, 10)
    every = (docs << 14) @ (docs[0] << 14)
    assert score.tolist() == [every[k] for k in at] == sorted((int(x) for x in np.delete(every, 0)), reverse=True)[:10]


def test_few_or_no_vectors(spark):
    docs, _ = vectors(spark, 3)
    three = docs.filter("vec_id < 3")
    assert vector_search.nearest(three).count() == vector_search.top_k_products(three).count() == 2
    assert vector_search.nearest(docs.limit(0)).count() == vector_search.top_k_products(docs.limit(0)).count() == 0


def test_pipeline_equals_plain_steps(spark):
    """Every stage's documents against plain Python or SQL over the documents before it."""
    import hashlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = {r.doc_id: r for r in docs.collect()}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).persist()
        got[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(got[name])
        if name != "byte_bpe":
            assert docs.dtypes == spark.read.parquet(f"{SMALL}/documents.parquet").dtypes
    learned = spark.read.parquet(f"{SMALL}/documents.parquet").filter(~language_id.held_out())
    model, limits = language_id.train_bounded(learned)
    kept = {}
    for doc, row in at.items():
        text = (row.text or "").encode()
        bits = model.code_lengths(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0]
        bound = limits.get(model.languages[int(bits.argmin())], language_id.PLAIN) + language_id.SHORT / max(1, len(text)) ** 0.5
        if any(c.isalpha() for c in row.text or "") and bits.min() / max(1, len(text)) <= bound:
            kept[doc] = row
    assert got["language_id"] == kept
    classes = by_pairs([(d, r.text) for d, r in kept.items()])
    kept = {d: r for d, r in kept.items() if classes[d][0] == d}
    assert got["jaccard_join"] == kept
    passages = removed([(d, r.text) for d, r in kept.items()])
    kept = {d: (passages[d][2], len(passages[d][2])) if passages[d][1] else (r.text, r.n_chars) for d, r in kept.items() if not 0 < passages[d][0] == passages[d][1]}
    assert {d: (r.text, r.n_chars) for d, r in got["substring_dedup"].items()} == kept
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in got["substring_dedup"].values()]))
    drawn = {r[0] for r in con.execute(registry.MIXING_SQL.replace(f"* {registry.EPOCHS} as", "* 1 as")).fetchall()}
    assert set(got["source_mixing"]) == drawn and all(got["substring_dedup"][d] == r for d, r in got["source_mixing"].items())
    ranks = byte_bpe.load_ranks(public_tokenizers.path(registry.RANKS))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc, row in got["byte_bpe"].items():
        text = got["source_mixing"][doc].text
        ids = library.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert corpus_pipeline.run(spark, SMALL).count() == len(drawn) > 0


def test_language_stage_rejects_unlearned_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bad = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心",
        "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
        "bm90IGEgbGFuZ3VhZ2UgYXQgYWxsLCBqdXN0IGVuY29kZWQgdGV4dA",
        "xqzj kkvw pqrz",
        "12 34",
    ]
    good = ["A.", "De.", "The", "Die", "By be in the and of."]
    planted = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(bad + good)], "doc_id long, text string")
    some = docs.unionByName(planted, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, some, SMALL).select("doc_id").collect()}
    assert {k for k in kept if k >= 10**9} == {10**9 + k for k in range(len(bad), len(bad + good))}
    every = {r.doc_id for r in docs.filter("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert len(every - kept) <= 0.02 * len(every)


def test_stages_of_hard_documents(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s1", 0), (3, "hello the world", "en", None, 15), (3, "hello the world", "en", None, 15), (None, "hello the world", None, "srcx", None)]
    clash = ["_row", "_text", "k0", "x5", "text_key", "lang_pred", "fits", "n_words", "kept_text", "spans", "copy", "_copy", "_drawn", "name", "a.b"]
    for table in (rows, []):
        at = spark.createDataFrame(table, schema)
        for n, name in enumerate(clash):
            at = at.withColumn(name, F.lit(n))
        names = at.columns
        for stage, function in corpus_pipeline.STAGES:
            at = function(spark, at, SMALL)
            assert stage == "byte_bpe" or at.columns == names
        assert at.count() <= len(table)
    twice = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows[2:] + [(4, "hello the world", "en", "s", 15)], schema), SMALL)
    assert sorted(map(repr, (r.doc_id for r in twice.collect()))) == ["3", "None"]
