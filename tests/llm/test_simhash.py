"""Fingerprints against a plain loop with another hash library, neighbours by id, and the radius search against all pairs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dexspark.llm import registry, simhash
from tests.conftest import SMALL


def hashed(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def plain(text: str) -> int:
    """The fingerprint by a loop over terms."""
    words = [hashed(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    runs = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    votes = np.zeros(64, dtype=np.int64)
    for run, weight in Counter(runs).items():
        low = 42
        for word in run:
            low = hashed(word.to_bytes(8, "little"), low)
        votes += weight * np.array([1 if low >> k & 1 else -1 for k in range(64)])
    return sum(1 << k for k in range(64) if votes[k] > 0)


def expected(docs):
    """Rows by doc_id from (doc_id, text), ids distinct."""
    docs = sorted(docs, key=lambda d: -d[0])
    prints = [plain(t) for _, t in docs]
    out = {}
    for n, (doc, text) in enumerate(docs):
        other = docs[(n + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        mine = plain(edited)
        near = [1 - (prints[n] ^ x).bit_count() / 64 for x in (mine, prints[(n + 1) % len(docs)])]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[n]:016x}", f"{mine:016x}", *near)
    return out


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query_equals_a_plain_loop(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    got = registry.queries()["op12_simhash"](spark, SMALL).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == expected(map(tuple, rows))
    assert len(got) == len(rows)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for r in got:
        near = sum((prints[r.doc_id] ^ x).bit_count() <= simhash.RADIUS for x in prints.values()) - 1
        assert r.n_near == (near if r.doc_id % 50 == 0 else None)


def test_hard_texts(spark):
    texts = {1: "", 2: "one", 3: " \t one\n", 4: "a b c d", 5: "a b c d e", 6: "a b c d e f", 7: "\U0001f600é" * 7, 8: "x y " * 40_000, 9: "   ", 10: " ", 11: "a b c d e"}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as print", "4 as part", "5 as `a.b`")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in simhash.beside_edited(docs).collect()}
    assert got == expected(texts.items())
    assert got[1][2] == "0" * 16 and got[2][2] == got[3][2] and got[5][2] == got[11][2]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(5, "e e"), (5, "e e"), (5, "other"), (None, None), (None, ""), (None, "n n"), (1, None), (0, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.beside_edited(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("0", 4), ("1", 0), ("5", 3), ("5", 5), ("None", 0), ("None", 3)]
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 0].edited_sha256 == hashlib.sha256(b"").hexdigest()
    # the document before the ones without an id is 0; what follows it starts with whichever text's hash is less
    assert by[0, 4].edited_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in ("ze", "zen ")}
    first = [t for t in ("e e", "other") if hashlib.sha256((t[: len(t) - len(t) // 2] + "")[:9].encode()).hexdigest() == by[5, len(t)].edited_sha256]
    assert len(first) == 1  # one of the two is followed by the other, the other by the empty text of 1
    one = simhash.beside_edited(spark.createDataFrame([(3, "ab cd")], docs.schema)).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"ab ab").hexdigest(), 1.0)]
    assert simhash.beside_edited(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius, blocks", [(0, 1), (1, 2), (3, 4), (3, 8), (2, 4), (6, 8)])
def test_radius_search_equals_all_pairs(spark, radius, blocks):
    rng = np.random.default_rng(radius * 10 + blocks)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63, size=20)]
    for _ in range(150):  # chains of near prints, and some equal ones
        base = prints[int(rng.integers(len(prints)))] & (2**64 - 1)
        for bit in rng.integers(64, size=int(rng.integers(0, 6))).tolist():
            base ^= 1 << bit
        prints.append(base - (1 << 64) if base >> 63 else base)
    held = spark.createDataFrame([(x,) for x in [*prints, None]], "print long").selectExpr("*", "7 as near", "8 as a")
    asked = held.limit(60)
    got = [tuple(r) for r in simhash.within(asked, held, radius, blocks).collect()]
    differ = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a in prints[:60] for b in prints}
    assert sorted(got) == sorted((*pair, bits) for pair, bits in differ.items() if bits <= radius)
    if radius:
        with pytest.raises(ValueError, match="blocks"):
            simhash.within(asked, held, radius, radius)


def test_main_path_is_native(spark):
    plan = registry.queries()["op12_simhash"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
