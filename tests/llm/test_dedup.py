"""Near duplicates and repeated passages against brute force, and hard inputs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from dexspark.llm import jaccard_join as j
from dexspark.llm import substring_dedup as s
from dexspark.llm.graph import connected_components

DOCS = "doc_id long, text string"
HARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (None, "a b c d e f"), (7, "x " * 30_000), (8, "wörter über alles " * 5)]


def texts(seed, n=120):
    """Unrelated texts, exact and near copies, passages shared by many, one group of a third."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["und", "the", "é"]
    passage = " ".join(rng.choices(words, k=40))
    hot = rng.choices(words, k=60)
    out = []
    for k in range(n):
        kind = k % 6
        if kind < 2:  # near copies of one text
            near = hot.copy()
            near[rng.randrange(60)] = f"n{k}"
            out.append((k, " ".join(near)))
        elif kind == 2 and out:
            out.append((k, rng.choice(out)[1]))
        else:
            own = rng.choices(words, k=rng.randrange(0, 80))
            at = rng.randrange(len(own) + 1)
            middle = [passage] if kind == 3 else []
            out.append((k, rng.choice([" ", "\n", "  "]).join(own[:at] + middle + own[at:])))
    rng.shuffle(out)
    return out


def removed(rows, window=13):
    """By the definition, word by word."""
    first = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for doc in sorted(split):
        words = split[doc]
        for at in range(len(words) - window + 1):
            first.setdefault(tuple(words[at : at + window]), doc)
    out = {}
    for doc, words in split.items():
        keep = [True] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < doc:
                keep[at : at + window] = [False] * window
        out[doc] = (len(words), len(words) - sum(keep), b" ".join(w for w, k in zip(words, keep) if k).decode())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_the_definition(spark, seed):
    rows = texts(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in s.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == removed(rows)


def test_repeats_of_hard_inputs(spark):
    docs = spark.createDataFrame(HARD, DOCS).selectExpr("*", "'x' as n_words", "1 as spans", "2 as _spans", "3 as block")
    got = s.remove_repeats(docs, keep=["doc_id", "spans", "n_words"]).collect()
    assert len(got) == len(HARD)
    found = {r.doc_id: (r.n_words, r.n_removed) for r in got}
    assert found[1] == found[2] == found[3] == (0, 0) and found[None] == (6, 0) and found[7] == (30_000, 0)
    assert s.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_a_window_across_an_edge_of_a_passage(spark):
    """Only whole windows that repeat are taken, down to a single one."""
    base = [f"a{k}" for k in range(30)]
    rows = [(1, " ".join(base)), (2, " ".join(["z"] * 3 + base[5:18] + ["y"] * 3)), (3, " ".join(base[:12]))]
    got = {r.doc_id: r.n_removed for r in s.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 0, 2: 13, 3: 0}


def by_pairs(rows, threshold=0.8, gram=5):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        n = min(gram, max(1, len(words)))
        sets[doc] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    links, root = Counter(), {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (top(d), links[d]) for d in sets}


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_equal_all_pairs(spark, seed):
    rows = texts(seed)
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == by_pairs(rows)


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 7)
    rows = texts(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == by_pairs(rows)


def test_near_duplicates_of_hard_inputs(spark):
    docs = spark.createDataFrame(HARD + [(4, "one two")], DOCS).selectExpr("*", "'a' as rep", "1 as sig", "2 as copy_key", "3 as size")
    got = j.near_duplicates(docs).collect()
    assert len(got) == len(HARD) + 1
    found = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert found[4] == found[5] == (4, 2) and found[1] == (1, 0) and found[3] == (3, 0)
    assert j.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_share_an_id_have_the_links_of_their_texts(spark):
    words = [f"w{k}" for k in range(60)]
    a, near = " ".join(words), " ".join([*words[:59], "x"])
    other, close = " ".join(words[::-1]), " ".join(["y", *words[:0:-1]][:60])
    rows = [(5, a), (5, a), (7, near), (5, other), (9, close)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in j.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    links = by_pairs(list(enumerate(t for _, t in rows)))
    assert got == sorted((d, 5, links[k][1]) for k, (d, _) in enumerate(rows))


def test_overlaps_by_matrix_and_by_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(12)]
    i, k = np.triu_indices(12, 1)
    plain = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, k)]
    assert j.overlaps(sets, i, k).tolist() == plain
    assert j.overlaps(sets, i[:5], k[:5]).tolist() == plain[:5]


def test_pruning_keeps_pairs_at_the_threshold():
    needed = j.least_matches(0.8, 1e-6)
    assert needed == sorted(needed) and needed[-1] < 0.8 * j.VALUES
    sigs = np.zeros((2, j.VALUES), dtype=np.uint16)
    sigs[1, ::5] = 1  # four of five values agree
    assert len(j.survivors(sigs, np.array([0]), np.array([1]), needed)) == 1
    sigs[1] = 1
    assert len(j.survivors(sigs, np.array([0]), np.array([1]), needed)) == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (3, a), (4, " ".join(["x"] * 14)), (4, f"{b} z")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in s.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 30, 0), (2, 30, 0), (2, 30, 0), (2, 30, 30), (3, 30, 30), (3, 30, 30), (4, 14, 0), (4, 31, 30)]


def test_joining_rows_before_they_are_dealt_changes_nothing(spark, monkeypatch):
    """The steps by hand, with units and automata of a few rows and pieces over many batches."""
    import pyarrow as pa

    monkeypatch.setattr(s, "UNIT", 40)
    monkeypatch.setattr(s, "SHARD", 5)
    rows = [r for r in texts(6) if r[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows[k : k + 5]], pa.int64()), pa.array([t for _, t in rows[k : k + 5]])], ["doc_id", "text"]) for k in range(0, len(rows), 5)]
    dealt = pa.Table.from_batches(s._anchor_rows(13, 5)(batches)).sort_by("h")
    found = pa.Table.from_batches(s._recurring(dealt.to_batches(max_chunksize=7)))
    held = {}
    for doc, text in rows:
        for h in set(s.signed(s.window_minima(s.word_hashes(text.encode().split()), 13, 5)).tolist()):
            held.setdefault(h, set()).add(doc)
    assert set(zip(found["doc_id"].to_pylist(), found["h"].to_pylist())) == {(d, h) for h, docs in held.items() if len(docs) > 1 for d in docs}
    phrases = [(1, b"a b c d", 0b11), (2, b"b c d e", 0b11), (0, b"c d e", 0b1)]
    automata = list(s.automata(iter(phrases), 3))
    assert sorted(source for codes, machine in automata for _, source in machine.iter("".join(map(codes.__getitem__, b"x a b c d e".split())))) == [0, 1, 1]


def test_empty_tables_and_very_long_texts(spark):
    long_ = " ".join(f"w{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long_), (2, long_ + " end"), (3, "x " * 50_000), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in j.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in s.remove_repeats(docs).collect()}
    assert kept == {1: (60_000, 0), 2: (60_001, 60_000), 3: (50_000, 0), 4: (1, 0)}
    assert j.near_duplicates(docs.limit(0)).count() == s.remove_repeats(docs.limit(0)).count() == 0
