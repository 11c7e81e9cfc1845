"""Searches of a set of query vectors against all vectors, in blocks of both.

``top_k_products`` is exact: MaxScore over impact postings of the dimensions. A vector is a
document and a dimension a term; a term gives a document q*v, less the least such product of
the shard, so that every part is 0 or more. Terms are ordered by the most they can give. Those
at the end that together cannot lift a document to the threshold are not essential. A document
that reaches the threshold has in some essential term at least that term's share of what the
others leave to reach it, so each essential posting is traversed from its greatest impact down
to that share, and only documents met there are scored: by the essential terms first, then those that
can still compete by all others at once. The threshold is the k-th
best score met; it rises over stretches of the postings. Shards are merged at the end.

``nearest`` is approximate: randomly rotated one-bit codes. Every vector is coded once: less
the centre and with zeros behind it up to BITS dimensions, or more, it is rotated by rounds of random signs and
Hadamard transforms and kept as its sign bits, its
length and the product of the code with its direction. So a vector of BITS components has one bit a
component, a shorter one more, as the error goes with the number of bits. Only codes are dealt to the query blocks. A query's components are cut to
LEVELS bits, and the bits of a code under each of them are counted, which gives the inner
product and so an estimate of the distance with an error bound. Vectors whose lower bound lies
within the k-th smallest upper bound are fetched and measured.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dexspark.llm.common import blocks_for, materialise, slices, small_batches

#: Vectors of a shard, queries of a block.
SHARD, QUERIES = 8192, 1024
#: Vectors that the centre is the mean of, bits of a code at least, width of the error bound in standard deviations, bits of a
#: query's component, seed and rounds of the rotation.
SAMPLE, BITS, WIDTH, LEVELS, SEED, ROUNDS = 4096, 512, 1.5, 8, 20260101, 3
#: Parts in which postings are traversed, between which the threshold rises.
STRETCHES = 2
#: Bound of a score, so that sums fit a long.
MOST = 2.0**62

KEYS = ["dims", "shard", "block"]


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, dims, v): vectors as doubles, without those that are null or hold null or non-finite components.

    row is a hash of the vector, which tells rows that share an id apart.
    """
    small_batches(vectors)
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0").filter(fine)
    return own.select("vec_id", F.xxhash64("v").alias("row"), F.size("v").alias("dims"), "v")


def in_blocks(candidates: DataFrame, asked: DataFrame, shard: int, queries: int):
    """Candidates and queries, dealt to every pair of a shard and a query block of equal dims."""
    shards, blocks = blocks_for(candidates.count(), shard), blocks_for(asked.count(), queries)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    rows = candidates.withColumns({"shard": own, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = asked.withColumns({"block": block, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    return rows.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS))


def once(table: pa.Table) -> pa.Table:
    """Rows by vec_id, without repeated ones."""
    ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
    order = np.lexsort((rows, ids))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(rows[order]) != 0)
    return table.take(order[new])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


class Postings:
    """Documents of a shard by term, in the order of their component."""

    def __init__(self, docs: np.ndarray):
        self.docs = docs
        self.lists = np.ascontiguousarray(np.argsort(docs, axis=0, kind="stable").T)
        self.impacts = np.ascontiguousarray(np.sort(docs, axis=0).T)
        self.exact = docs.astype(np.float64)

    def reaching(self, term: int, weight: int, least: int) -> np.ndarray:
        """Documents of a posting whose part weight * component is ``least`` or more; weight is not 0."""
        if weight > 0:
            return self.lists[term, np.searchsorted(self.impacts[term], -(-least // weight)) :]
        return self.lists[term, : np.searchsorted(self.impacts[term], least // weight, side="right")]

    def products(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Products of documents with a query; in floating point where all sums are exact there."""
        rows = self.exact[found]
        if float(np.abs(weights).sum()) * float(np.abs(self.impacts[:, [0, -1]]).max()) < 2.0**53:
            return (rows @ weights.astype(np.float64)).astype(np.int64)
        return self.docs[found] @ weights

    def top(self, ids: np.ndarray, query: np.ndarray, skip: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the k best documents for one query; the one at skip takes no part, ties go to the smaller id."""
        n, dims = self.docs.shape
        ends = query * self.impacts[:, -1], query * self.impacts[:, 0]
        least, most = np.minimum(*ends), np.maximum(*ends)
        terms = np.argsort(least - most, kind="stable")
        bound = (most - least)[terms]
        terms, bound = terms[bound > 0], bound[bound > 0]
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])  # what the terms from a place on can add
        base = int(least.sum())
        open_ = np.ones(n, dtype=bool)
        if skip >= 0:
            open_[skip] = False
        best, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def score(postings: list[np.ndarray], essential: int) -> None:
            """Score the documents met: by the essential terms, then by the others those that can still compete."""
            nonlocal best, scores
            met = np.zeros(n, dtype=bool)
            for posting in postings:
                met[posting] = True
            found = np.flatnonzero(met & open_)
            open_[found] = False
            first = np.zeros(dims, dtype=np.int64)
            first[terms[:essential]] = query[terms[:essential]]
            partial = self.products(found, first)
            if essential < len(terms) or len(terms) < dims:
                if len(scores) >= k:
                    live = partial + int(np.delete(least, terms[:essential]).sum()) + rest[essential] >= scores[k - 1]
                    found, partial = found[live], partial[live]
                partial = partial + self.products(found, query - first)
            best, scores = np.concatenate([best, found]), np.concatenate([scores, partial])
            order = np.lexsort((ids[best], -scores))[:k]
            best, scores = best[order], scores[order]

        score([self.lists[t, -4 * k :] if query[t] > 0 else self.lists[t, : 4 * k] for t in terms[:8]], len(terms))
        for stretch in range(STRETCHES, -1, -1):
            # the terms from here on cannot lift a document above what it must have
            known = len(scores) >= k and base < scores[k - 1]
            essential = max(1, int(np.argmax(base + rest < scores[k - 1]))) if known else 0
            if not known:
                score([np.arange(n)], len(terms))  # no threshold, or one that every document passes
                break
            # a share of each posting; first only what is far above it, to raise the threshold
            part, all_ = int(scores[k - 1] - base - rest[essential]) * (2 * STRETCHES + stretch), int(rest[0] - rest[essential]) * 2 * STRETCHES
            if part <= all_:
                score([self.reaching(t, int(query[t]), int(least[t]) + max(1, part * room // all_)) for t, room in zip(terms[:essential].tolist(), bound[:essential].tolist())], essential)
        return best, scores


def _products(k: int):
    def search(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [], [], [], []
        if rows.num_rows and asked.num_rows:
            rows, asked = once(rows), once(asked)
            docs, queries = np.floor(1024 * matrix(rows["v"])), np.floor(1024 * matrix(asked["v"]))
            if docs.shape[1] * np.abs(docs).max() * np.abs(queries).max() >= MOST:
                raise OverflowError("components are too large for scores that fit a long")
            ids, names = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            postings = Postings(docs.astype(np.int64))
            for query, name, vector in zip(asked["vec_id"].to_pylist(), asked["row"].to_pylist(), queries.astype(np.int64), strict=True):
                lo, hi = np.searchsorted(ids, [query, query + 1])
                own = lo + np.flatnonzero(names[lo:hi] == name)
                at, score = postings.top(ids, vector, int(own[0]) if len(own) else -1, k)
                for column, values in zip(out, ([query] * len(at), [name] * len(at), ids[at].tolist(), score.tolist())):
                    column.extend(values)
        return pa.table([pa.array(x, pa.int64()) for x in out], ["query_id", "query_row", "vec_id", "score"])

    return search


def ranked(found: DataFrame, k: int, best: F.Column) -> DataFrame:
    order = Window.partitionBy("query_id", "query_row").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_products(vectors: DataFrame, k: int = 10, every: int = 100, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the greatest integer product of each query.

    Components x become floor(1024 * x). Queries are the vectors whose id is divisible by
    ``every``; their own row takes no part. Ties go to the smaller vec_id. Vectors that are null,
    empty, or hold null or non-finite components take no part. A product needs equal numbers of
    components: a query is compared with all vectors of its own number. Repeated rows are one
    vector; rows that share an id but not the vector are vectors and queries of their own, each
    with its own ranks. Components so large that a score could pass 2^62 raise an OverflowError.
    """
    fine = clean(vectors)
    pairs = in_blocks(fine, fine.filter(F.col("vec_id") % every == 0), shard, queries)
    return ranked(pairs.applyInArrow(_products(k), "query_id long, query_row long, vec_id long, score long"), k, F.desc("score"))


@cache
def signs(size: int) -> np.ndarray:
    """The random signs of each round, the same in every task."""
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(ROUNDS, size))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Rows with zeros behind them up to a power of two, rotated at random; their lengths stay."""
    size = 1 << max(BITS, vectors.shape[1], 1).bit_length() - 1
    size = size if size >= vectors.shape[1] else 2 * size
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    for flips in signs(size):
        out *= flips
        half = 1
        while half < size:
            pairs = out.reshape(len(out), -1, 2, half)
            low, high = pairs[:, :, 0].copy(), pairs[:, :, 1]
            pairs[:, :, 0] += high
            np.subtract(low, high, out=pairs[:, :, 1])
            half *= 2
        out /= np.sqrt(size)
    return out


def encode(vectors: np.ndarray, centre: np.ndarray, turn=turned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and products of code and direction."""
    apart = vectors - centre
    length = np.linalg.norm(apart, axis=1)
    unit = turn(apart / np.where(length > 0, length, 1)[:, None])
    product = np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])
    return np.packbits(unit > 0, axis=1), length, np.where(product > 0, product, 1)


def _code_rows(centres: dict[int, np.ndarray]):
    def rows(batches):
        for batch in slices(batches, 256):
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == size))
                bits, length, product = encode(matrix(pa.chunked_array([part.column("v")])), centres.get(size, np.zeros(size)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "row", "dims")), pa.array(map(bytes, bits), pa.binary()), pa.array(length), pa.array(product)], ["vec_id", "row", "dims", "bits", "length", "product"])

    return rows


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes as 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view(np.uint64)


def code_products(codes: np.ndarray, dims: int, unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Products of all codes, as unit vectors, with a query's direction, from counted bits; and the most they are off.

    The query's components become whole numbers of LEVELS bits. The bits of a code under each
    of these bits are counted: a set bit adds the component, an unset one takes it off.
    """
    low = float(unit.min())
    step = max(float(unit.max()) - low, 1e-300) / (2**LEVELS - 1)
    whole = np.rint((unit - low) / step).astype(np.int64)
    off = float(np.linalg.norm(unit - (low + step * whole)))
    planes = words(np.packbits((whole[None, :] >> np.arange(LEVELS)[:, None]) & 1, axis=1))
    total = np.zeros(len(codes))
    for j in range(LEVELS):
        total += 2.0**j * np.bitwise_count(codes & planes[j]).sum(axis=1)
    ones = np.bitwise_count(codes).sum(axis=1)
    return (2 * (low * ones + step * total) - unit_sum(low, step, whole)) / np.sqrt(dims), off


def unit_sum(low: float, step: float, whole: np.ndarray) -> float:
    return low * len(whole) + step * float(whole.sum())


def _neighbours(k: int, centres: dict[int, np.ndarray], width: float):
    def search(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [], [], [], [], [], []
        if rows.num_rows and asked.num_rows:
            rows, asked = once(rows), once(asked)
            dims = key[0].as_py()
            centre = centres.get(dims, np.zeros(dims))
            ids, names = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            length, product = rows["length"].to_numpy(), rows["product"].to_numpy()
            codes = words(np.frombuffer(b"".join(rows["bits"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1))
            size = 8 * len(rows["bits"][0].as_py())
            wide = width * np.sqrt(np.maximum(0, 1 - product**2) / max(1, size - 1))
            for query, name, vector in zip(asked["vec_id"].to_pylist(), asked["row"].to_pylist(), matrix(asked["v"]), strict=True):
                far = float(np.linalg.norm(vector - centre))
                found, off = code_products(codes, size, turned(((vector - centre) / (far or 1))[None, :])[0])
                scale = 2 * far * length / product
                middle, error = length**2 + far**2 - scale * found, scale * (wide + off)
                low, high = middle - error, middle + error
                fit = (ids != query) | (names != name)
                up = high[fit]
                limit = np.partition(up, k - 1)[k - 1] if len(up) > k else np.inf
                at = np.flatnonzero(fit & (low <= limit))
                for column, values in zip(out, ([query] * len(at), [name] * len(at), ids[at], names[at], low[at], high[at])):
                    column.extend(values)
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], ["query_id", "query_row", "vec_id", "row", "low", "high"])

    return search


def _measured(batches):
    for batch in slices(batches, 4096):
        names = ["query_id", "query_row", "vec_id", "row"]
        sizes = pc.list_value_length(batch.column("v")).to_numpy()
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            apart = matrix(pa.chunked_array([part.column("v")])) - matrix(pa.chunked_array([part.column("q")]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.sqrt((apart**2).sum(axis=1)))], [*names, "score"])


def centres_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean of a sample of SAMPLE vectors by their number of components."""
    sample = vectors.select("dims", "v", F.xxhash64("vec_id", "row").alias("h")).orderBy("h").limit(SAMPLE)
    means = sample.select("dims", F.posexplode("v")).groupBy("dims", "pos").agg(F.avg("col").alias("mean")).collect()  # from SAMPLE vectors
    out: dict[int, np.ndarray] = {}
    for r in means:
        out.setdefault(r["dims"], np.zeros(r["dims"]))[r["pos"]] = r["mean"]
    return out


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, shard: int = SHARD, queries: int = QUERIES, width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest vectors of each query, by Euclidean distance.

    Queries are the vectors whose id is divisible by ``every``; their own row takes no part. The
    score is the exact distance, ties go to the smaller vec_id. All vectors are indexed; only the
    centre comes from a sample of SAMPLE vectors. Null, empty and zero vectors and those with
    null or non-finite components take no part. A distance needs equal numbers of components: a
    query is compared with all vectors of its own number. Repeated rows are one vector; rows
    that share an id but not the vector are vectors and queries of their own, each with its own
    ranks.
    """
    fine = clean(vectors).filter(F.exists("v", lambda x: x != 0))
    centres = centres_of(fine)
    codes = materialise(fine.mapInArrow(_code_rows(centres), "vec_id long, row long, dims int, bits binary, length double, product double"))
    asked = fine.filter(F.col("vec_id") % every == 0)
    pairs = in_blocks(codes, asked, shard, queries)
    bounds = materialise(pairs.applyInArrow(_neighbours(k, centres, width), "query_id long, query_row long, vec_id long, row long, low double, high double"))
    query = ["query_id", "query_row"]
    order = Window.partitionBy(*query).orderBy("high")
    limits = bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).groupBy(*query).agg(F.max("high").alias("limit"))
    chosen = bounds.join(limits, query).filter("low <= limit").select(*query, "vec_id", "row")
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"))
    near = chosen.join(fine.select("vec_id", "row", "v"), ["vec_id", "row"]).join(own, query)
    measured = near.select(*query, "vec_id", "row", "v", "q").mapInArrow(_measured, "query_id long, query_row long, vec_id long, row long, score double")
    return ranked(measured.dropDuplicates([*query, "vec_id", "row"]), k, F.asc("score"))
