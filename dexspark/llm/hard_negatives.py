"""Hard negatives of anchors: rows of another label that score high, but less than a positive does.

Method: segment summaries. A vector is cut into segments, and each keeps its mean m and standard
deviation s. Over a segment of length l the product of two vectors is l * m * m' up to
l * s * s', so the sums of both over all segments bound a score from below and above. Segments
are refined by level: a row whose bounds leave what is asked for goes, those that stay are bounded by shorter segments, and what the
last level leaves is scored exactly. Before a level is tried, the rows whose bounds say they are best are
scored, which raises what the others must reach.

Vectors are summed up once. Anchors meet all rows in blocks of both: first for the positives, rows of
their label, then with the positives' scores for the negatives; shards are merged by a rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dexspark.llm.common import blocks_for, materialise, slices, small_batches
from dexspark.llm.vector_search import matrix

#: Components become floor(SCALE * x).
SCALE = 256
#: Lengths of the segments, each a multiple of the next.
LENGTHS = (8, 2)
#: Rows of a shard, anchors of a block, rows scored to raise a bound.
SHARD, ANCHORS, FIRST = 8192, 4096, 64
#: Positives of an anchor, negatives of a positive, and the percent of a positive's score between which theirs lie.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Bound of a score, so that a hundred times it fits a long.
MOST = 2.0**56
#: Sums of bounds may be off by this share of the greatest of them.
SLACK = 1e-9

ROW = "vec_id long, row long, label string, dims int, x array<long>, sums array<double>"
KEYS = ["dims", "shard", "block"]


def summary_sizes(dims: int) -> list[int]:
    """How many segments a vector has at each level."""
    return [-(-dims // LENGTHS[0]) * (LENGTHS[0] // length) for length in LENGTHS]


def summaries(x: np.ndarray) -> np.ndarray:
    """By level the means of all segments and then their deviations, each times the root of the length; zeros are put behind the last."""
    wide = np.zeros((len(x), -(-x.shape[1] // LENGTHS[0]) * LENGTHS[0]))
    wide[:, : x.shape[1]] = x
    out = []
    for length in LENGTHS:
        cut = wide.reshape(len(x), -1, length)
        root = np.sqrt(length)
        out += [cut.mean(axis=2) * root, cut.std(axis=2) * root]
    return np.concatenate(out, axis=1)


def _summed(batches):
    for batch in slices(batches, 4096):
        dims = batch.column("dims").to_numpy()
        for size in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == size))
            whole = np.floor(SCALE * matrix(pa.chunked_array([part.column("v")])))
            if size * np.abs(whole).max() ** 2 >= MOST:
                raise OverflowError("components are too large for scores that fit a long")
            sums = summaries(whole)
            lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel())) for m in (whole.astype(np.int64), sums)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "row", "label", "dims")), *lists], ["vec_id", "row", "label", "dims", "x", "sums"])


def clean(vectors: DataFrame) -> DataFrame:
    """Rows that take part, with whole components and their summaries; each of repeated rows once.

    row is a hash of vector and label, which tells rows that share an id apart.
    """
    small_batches(vectors)
    v = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    own = own.filter("vec_id is not null and label is not null and v is not null and size(v) > 0").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    own = own.select("vec_id", F.xxhash64("v", "label").alias("row"), "label", F.size("v").alias("dims"), "v")
    return materialise(own.dropDuplicates(["vec_id", "row"]).mapInArrow(_summed, ROW))


class Shard:
    """Rows of a shard in the order of label, vec_id and row, with their summaries."""

    def __init__(self, rows: pa.Table):
        labels = np.array(rows["label"].to_pylist(), dtype=object)
        names, codes = np.unique(labels, return_inverse=True)
        order = np.lexsort((rows["row"].to_numpy(), rows["vec_id"].to_numpy(), codes))
        rows, codes = rows.take(order), codes[order]
        self.ids, self.names = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        self.x = matrix(rows["x"])
        ends = np.searchsorted(codes, np.arange(len(names) + 1))
        self.places = {name: (ends[k], ends[k + 1]) for k, name in enumerate(names.tolist())}
        self.levels = by_level(matrix(rows["sums"]), self.x.shape[1])

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact products; whole numbers whose sums a double may not hold are multiplied as longs."""
        if np.abs(self.x[at]).max(initial=0) * np.abs(x).sum() < 2.0**53:
            return (self.x[at] @ x).astype(np.int64)
        return self.x[at].astype(np.int64) @ x.astype(np.int64)

    def best(self, at: np.ndarray, x: np.ndarray, levels: list, bands: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each band of scores (low, high) the k best rows among ``at`` within it: positions and scores, ties by position's id."""
        done, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def chosen(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
            fit = (scores >= low) & (scores <= high)
            found, own = done[fit], scores[fit]
            order = np.lexsort((self.names[found], self.ids[found], -own))[:k]
            return found[order], own[order]

        def least() -> float:
            """What a row must reach to be among the best of some band."""
            reach = [(own[k - 1] if len(own) == k else low) for low, high in bands for own in [chosen(low, high)[1]]]
            return min(reach)

        low, high = min(b[0] for b in bands), max(b[1] for b in bands)
        for (means, spreads), (own_means, own_spreads) in zip(self.levels, levels):
            middle, width = means[at] @ own_means, spreads[at] @ own_spreads
            width = width + SLACK * (np.abs(middle) + width) + SLACK
            keep = (middle + width >= low) & (middle - width <= high)
            at, middle = at[keep], middle[keep]
            if len(at) > FIRST:
                under = np.flatnonzero(middle <= high)
                first = under[np.argpartition(-middle[under], FIRST)[:FIRST]] if len(under) > FIRST else under
                done, scores = np.concatenate([done, at[first]]), np.concatenate([scores, self.scores(at[first], x)])
                at = np.delete(at, first)
                low = least()
        done, scores = np.concatenate([done, at]), np.concatenate([scores, self.scores(at, x)])
        return [chosen(*band) for band in bands]


def by_level(sums: np.ndarray, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, start = [], 0
    for size in summary_sizes(dims):
        out.append((sums[:, start : start + size], sums[:, start + size : start + 2 * size]))
        start += 2 * size
    return out


def _positives(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
    out = [], [], [], [], []
    if rows.num_rows and asked.num_rows:
        shard, x = Shard(rows), matrix(asked["x"])
        levels = by_level(matrix(asked["sums"]), x.shape[1])
        for n, (anchor, name, label) in enumerate(zip(asked["vec_id"].to_pylist(), asked["row"].to_pylist(), asked["label"].to_pylist(), strict=True)):
            at = np.arange(*shard.places.get(label, (0, 0)))
            at = at[(shard.ids[at] != anchor) | (shard.names[at] != name)]
            own = [(m[n], s[n]) for m, s in levels]
            for found, scores in shard.best(at, x[n], own, [(-np.inf, np.inf)], POSITIVES):
                for column, values in zip(out, ([anchor] * len(found), [name] * len(found), shard.ids[found], shard.names[found], scores)):
                    column.extend(values)
    return pa.table([pa.array(c, pa.int64()) for c in out], ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score"])


def _negatives(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
    out = [], [], [], [], []
    if rows.num_rows and asked.num_rows:
        shard, x = Shard(rows), matrix(asked["x"])
        levels = by_level(matrix(asked["sums"]), x.shape[1])
        every = np.arange(len(shard.ids))
        for n, (anchor, name, label, positives) in enumerate(zip(asked["vec_id"].to_pylist(), asked["row"].to_pylist(), asked["label"].to_pylist(), asked["scores"].to_pylist(), strict=True)):
            start, end = shard.places.get(label, (0, 0))
            at = np.concatenate([every[:start], every[end:]])
            own = [(m[n], s[n]) for m, s in levels]
            bands = [(-(-LOW * s // 100), HIGH * s // 100) for s in positives]
            for score, (found, scores) in zip(positives, shard.best(at, x[n], own, bands, NEGATIVES)):
                for column, values in zip(out, ([anchor] * len(found), [name] * len(found), [score] * len(found), shard.ids[found], scores)):
                    column.extend(values)
    return pa.table([pa.array(c, pa.int64()) for c in out], ["anchor_id", "anchor_row", "positive_score", "negative_id", "negative_score"])


def meeting(rows: DataFrame, asked: DataFrame, shard: int, anchors: int):
    """Rows and anchors dealt to every pair of a shard and a block of equal dims."""
    shards, blocks = blocks_for(rows.count(), shard), blocks_for(asked.count(), anchors)
    own = F.pmod(F.xxhash64("vec_id", "row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.lit(blocks)).cast("int")
    dealt = rows.withColumns({"shard": own, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    own_names = asked.toDF(*asked.columns)  # apart from the rows' columns, which they come from
    met = own_names.withColumns({"block": block, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    return dealt.groupBy(*KEYS).cogroup(met.groupBy(*KEYS))


def mine(vectors: DataFrame, every: int = 50, shard: int = SHARD, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by ``every``. A score is the product of two
    rows' whole components, floor(256 * x); higher ones come first, ties by the smaller vec_id.
    An anchor's positives are the first 5 other rows of its label, or all. For each of them the first 3, or all, of
    the rows of other labels whose score is from 50 to 95 percent of the positive's are returned;
    below a positive score there are none.

    Rows with a null vec_id, label or vector, an empty vector, or null or non-finite components take no
    part. Rows meet those of equal numbers of components. Repeated rows are one row; rows that share an id
    but not vector and label are rows, and anchors, of their own (of equal scores and ids in the order of a hash). Components so large that a
    score could pass 2^56 raise an OverflowError. An empty table gives no rows. Other columns are not looked at.
    """
    rows = clean(vectors)
    asked = rows.filter(F.col("vec_id") % every == 0)
    anchor = ["anchor_id", "anchor_row"]
    kinds = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long"
    found = meeting(rows, asked, shard, anchors).applyInArrow(_positives, kinds)
    order = Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    positives = materialise(found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= POSITIVES).drop("_n"))
    scores = positives.groupBy(*anchor).agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    scored = asked.join(scores, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))).drop(*anchor)
    kinds = "anchor_id long, anchor_row long, positive_score long, negative_id long, negative_score long"
    negatives = meeting(rows, scored, shard, anchors).applyInArrow(_negatives, kinds)
    order = Window.partitionBy(*anchor, "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    best = negatives.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return positives.join(best, [*anchor, "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
