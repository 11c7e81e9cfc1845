"""All pairs of documents whose word n-gram sets have a Jaccard similarity of a threshold or more.

Method: Bayesian candidate pruning. Texts with the same gram set collapse to one class first.
Bands of MinHash values propose pairs; their values are compared a few at a time and a pair
is dropped as soon as the posterior probability that its similarity reaches the threshold
falls below a tolerance. The pairs left give components. Inside a component the same test
picks pairs, and only texts of pairs that pass are read into sets and verified exactly: so a
pair is verified once however many bands it shares, and texts are not sent once per band.

No row per pair is ever made: crowded buckets and components are cut into blocks of a fixed
number of texts, every pair of blocks is one group, and a group returns sums per text and a
spanning forest of its links. The expected loss at the threshold is below 1e-6 for the bands
and below the tolerance for each comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.llm.common import as_bytes, gram_hashes, materialise, slices, small_batches, word_hashes
from dexspark.llm.graph import connected_components

#: Words of a gram, similarity, MinHash values, values of a band, values compared at a time, tolerance.
GRAM, THRESHOLD, VALUES, BAND, STEP, TOLERANCE = 5, 0.8, 128, 4, 16, 1e-6
#: Texts of a block: a group never holds more than two blocks.
BLOCK = 256
#: Odd multipliers of the MinHash functions.
FACTORS = np.random.default_rng(20260101).integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Stands for the set of a text that no pair needs.
NO_GRAMS = np.empty(0, dtype=np.uint64)


def gram_set(text: bytes | None, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct gram hashes; a text of fewer words is one gram, an empty one has none."""
    hashes = word_hashes((text or b"").split())
    return np.unique(gram_hashes(hashes, min(gram, max(1, len(hashes)))))


def min_hashes(grams: np.ndarray) -> np.ndarray:
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * FACTORS).min(axis=0), out=out)
    return out.astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Matches needed after each step so that P(similarity >= threshold) reaches the tolerance.

    With a uniform prior, m matches of n values give a Beta(m+1, n-m+1) posterior, whose upper
    tail equals the chance that a Binomial(n+1, threshold) is at most m.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[int]) -> np.ndarray:
    """Positions of the pairs (i, j) that no step drops."""
    left = np.arange(len(i))
    matches = np.zeros(len(i), dtype=np.int32)
    for k, least in enumerate(needed):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[left] += (sigs[i[left], part] == sigs[j[left], part]).sum(axis=1)
        left = left[matches[left] >= least]
    return left


def pairs_of(block: np.ndarray, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside a block, or between the two blocks of a crossing group."""
    if crossing:
        first, second = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
        return np.repeat(first, len(second)), np.tile(second, len(first))
    return np.triu_indices(len(block), 1)


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that join every component of the pairs, fewer than there are nodes."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and last == key[:, 0].tolist():
            if not len(cuts):
                held.append(batch)
                continue
            held.append(batch.slice(0, cuts[0]))
            yield pa.Table.from_batches(held)
            start, cuts = cuts[0], cuts[1:]
        else:
            if held:
                yield pa.Table.from_batches(held)
            start = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([batch.slice(start, cut - start)])
            start = cut
        held, last = [batch.slice(start)], key[:, -1].tolist()
    if held:
        yield pa.Table.from_batches(held)


def signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, VALUES)


def _signature_rows(gram: int):
    def rows(batches):
        for batch in slices(batches):
            keys, sigs = [], []
            for text in as_bytes(batch.column("text")):
                grams = gram_set(text, gram)
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sigs.append(min_hashes(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "copy_key", "sig"])

    return rows


def _candidates(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)

    def compare(batches):
        i, j, sigs, ids, rows, pairs = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            sig, doc = np.concatenate(sigs), np.concatenate(ids)
            a, b = np.concatenate(i), np.concatenate(j)
            kept = survivors(sig, a, b, needed)
            edges = forest(zip(doc[a[kept]].tolist(), doc[b[kept]].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([max(e) for e in edges], pa.int64()), pa.array([min(e) for e in edges], pa.int64())], ["a", "b"])

        for t in groups(batches, ["key", "lo", "hi"]):
            a, b = pairs_of(t["own"].to_numpy(), t["lo"][0] != t["hi"][0])
            sigs.append(signatures(t["sig"]))
            ids.append(t["rep"].to_numpy())
            i.append(a + rows)
            j.append(b + rows)
            rows, pairs = rows + t.num_rows, pairs + len(a)
            if pairs > 50_000 or rows > 8192:
                yield flush()
                i, j, sigs, ids, rows, pairs = [], [], [], [], 0, 0
        if rows:
            yield flush()

    return compare


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[gram] > 1
    number = np.cumsum(times > 1) - 1
    gram, owner = number[gram[shared]], owner[shared]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):
        lo, hi = np.searchsorted(gram, [at, at + 4096])
        held = np.zeros((len(sets), 4096), dtype=np.float32)
        held[owner[lo:hi], gram[lo:hi] - at] = 1
        out += held @ held.T
    return out[i, j].astype(np.int64)


def _verify(threshold: float, tolerance: float, gram: int):
    needed = least_matches(threshold, tolerance)

    def check(batches):
        for t in groups(batches, ["key", "lo", "hi"]):
            once = np.sort(np.unique(t["name"].to_numpy(), return_index=True)[1])  # rows can be repeated
            t = t if len(once) == t.num_rows else t.take(once)
            name, rep, copies = (t[c].to_numpy() for c in ("name", "rep", "copies"))
            i, j = pairs_of(t["own"].to_numpy(), t["lo"][0] != t["hi"][0])
            kept = survivors(signatures(t["sig"]), i, j, needed)
            if not len(kept):
                continue
            i, j = i[kept], j[kept]
            needs = set(np.concatenate([i, j]).tolist())
            sets = [gram_set(x, gram) if k in needs else NO_GRAMS for k, x in enumerate(as_bytes(t["text"]))]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            both = overlaps(sets, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            links = np.bincount(i, copies[j], t.num_rows) + np.bincount(j, copies[i], t.num_rows)
            own = np.flatnonzero(links)
            edges = forest(zip(rep[i].tolist(), rep[j].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*name[own].tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array([*links[own].astype(np.int64).tolist(), *[0] * len(edges)], pa.int64()),
                    pa.array([*[None] * len(own), *[a for a, _ in edges]], pa.int64()),
                    pa.array([*[None] * len(own), *[b for _, b in edges]], pa.int64()),
                ],
                ["name", "links", "a", "b"],
            )

    return check


def in_block_pairs(rows: DataFrame, key: str, size: str, rep: str) -> DataFrame:
    """Deal the rows of each key to every pair of its blocks that they take part in.

    Adds key, own (the row's block), lo and hi (the pair of blocks); size is a key's row count.
    """
    count = F.ceil(F.col(size) / F.lit(float(BLOCK))).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(rep), count).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), count - 1)))
    out = dealt.select(
        F.col(key).alias("key"), "own", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), *[c for c in rows.columns if c not in (key, size)]
    )
    return out.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, tolerance: float = TOLERANCE, classed: Callable = connected_components) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links) for every row of docs (doc_id long, text string).

    n_links counts the other rows whose gram set has at least the threshold similarity,
    class_id is the least doc_id that such links reach, copy_id the least doc_id with the same
    gram set. Words are separated by ASCII white space and taken unchanged. A text of fewer
    words than a gram is one gram; null and blank texts have no links and are their own class.
    Repeated rows count as copies of each other. Rows that share a doc_id but not the text have
    the links of their own texts and fall into one class. Rows with a null doc_id share the
    class of their copies and count as a link of none. Texts of any length count with all their grams. Of
    equal candidates the least doc_id names a class. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs)
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = materialise(own.mapInArrow(_signature_rows(gram), "doc_id long, text_key long, copy_key binary, sig binary"))
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    held = rows.filter("copy_key is not null and doc_id is not null").groupBy("copy_key").agg(first, F.count("*").alias("copies"), F.max("sig").alias("sig"))
    # name tells gram sets apart where an id stands for several
    reps = materialise(held.select("copy_key", F.xxhash64("copy_key").alias("name"), F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "copies", "sig"))

    width = 2 * BAND
    band = F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    bands = reps.select("name", F.explode(band).alias("bucket"))
    crowded = materialise(bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    members = bands.join(crowded, "bucket").join(reps.select("name", "rep", "sig"), "name")
    edges = in_block_pairs(members, "bucket", "size", "name").mapInArrow(_candidates(threshold, tolerance), "a long, b long")
    parts = materialise(classed(edges))

    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    chosen = parts.join(sizes, "component").join(reps.select("name", "rep", "text_key", "copies", "sig"), F.col("node") == F.col("rep")).withColumnRenamed("text_key", "_key")
    texts = own.join(chosen, (F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("_key")))
    held = texts.select("component", "size", "name", "rep", "copies", "sig", "text")
    found = materialise(in_block_pairs(held, "component", "size", "name").mapInArrow(_verify(threshold, tolerance, gram), "name long, links long, a long, b long"))
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    classes = classed(found.filter("b is not null").select("a", "b"))
    known = (
        reps.select("copy_key", "name", "rep", "copies")
        .join(links, "name", "left")
        .join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("copy_key", F.col("rep").alias("copy_id"), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    known = materialise(known)  # a plain side of the join below, of which a gram set of very many copies can be split
    return rows.select("doc_id", "copy_key").join(known, "copy_key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
