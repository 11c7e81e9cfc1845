"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ORDER. The code length of a byte is
-log2 of its share in the longest context that has seen it, plus the escape cost of every
longer context that has not (escape method C: distinct successors against all successors);
below order 0 every byte costs 8 bits. Statistics are frozen after training, so the code
length of a text is a sum over its bytes and the shortest code names the language.

Training counts the byte grams of every labelled text in Spark. The trees are then flattened: every gram seen in any
language gets its cost in all languages, so a text is scored by table lookups. A byte's cost depends on grams that share
the byte before it, and a language's costs on its own counts, so a model of more than CELLS costs is cut by that byte and
by language into packs; each pack is fitted and broadcast alone and adds its bits in a pass of its own over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dexspark.llm.common import as_bytes, beside_text, materialise, slices, small_batches

#: Longest context in bytes, bytes scored at a time, bytes counted at a time.
ORDER, CHUNK, COUNTED = 3, 1 << 17, 1 << 19
#: Costs (grams times languages) and languages of a pack, steps of a bit by which costs are counted.
CELLS, LANGUAGES, STEPS = 1 << 22, 64, 1024
#: For a sample only: longest text in bytes, bits of a hash that make a range.
LONGEST, PARTS = 1 << 18, 12
#: Spreads (99 % quantile less median) above the median that a text may cost a byte; what one byte alone may cost more,
#: divided by the root of the length for longer texts; the bound of a language of fewer than LEAST calibration texts, and the
#: most: bytes written plainly.
SPREADS, SHORT, LEAST, PLAIN = 3, 8, 8, 8.0
#: Label of texts that are null or have no letter.
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Table:
    """Open-addressed map from a gram code to a row of costs; row 0 is none."""

    slots: np.ndarray
    codes: np.ndarray
    costs: np.ndarray

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where it is absent. Codes are above 0."""
        mask = np.int64(len(self.slots) - 1)
        shift = np.uint64(64 - int(mask).bit_length())
        at = ((codes.astype(np.uint64) * MIX) >> shift).astype(np.int64)
        out = self.slots[at]
        held = self.codes[out]
        open_ = np.flatnonzero(held != codes)
        while len(open_):
            empty = held[open_] == 0
            out[open_[empty]] = -1
            open_ = open_[~empty]
            at[open_] = (at[open_] + 1) & mask
            out[open_] = self.slots[at[open_]]
            held[open_] = self.codes[out[open_]]
            open_ = open_[held[open_] != codes[open_]]
        return out


def build(codes: np.ndarray, costs: np.ndarray) -> Table:
    size = 1 << max(4, int(1.5 * len(codes)).bit_length())
    slots = np.zeros(size, dtype=np.int32)
    at = ((codes.astype(np.uint64) * MIX) >> np.uint64(64 - int(size - 1).bit_length())).astype(np.int64)
    left = np.arange(len(codes), dtype=np.int32)
    while len(left):
        free = left[slots[at[left]] == 0]
        slots[at[free]] = free + 1  # of several for one slot the last stays
        left = left[slots[at[left]] != left + 1]
        at[left] = (at[left] + 1) & (size - 1)
    return Table(slots, np.concatenate([[0], codes]), np.concatenate([np.zeros((1, costs.shape[1])), costs]).astype(np.float32))


@dataclass
class Pack:
    """Costs in the languages numbered ``of`` of bytes that follow one of the bytes first to last; grams[k] and escapes[k] of contexts of k bytes.

    A gram's code is 1 then its bytes. A text's own first byte counts as following byte 0.
    """

    of: list[int]
    first: int
    last: int
    grams: list[Table]
    escapes: list[Table]

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of every text in every language of the pack; text t is data[bounds[t]:bounds[t+1]].

        Bytes are scored CHUNK at a time, so one long text needs no more memory than many short ones.
        """
        out = np.zeros((len(bounds) - 1, len(self.of)))
        first, high = 0, len(self.grams) - 1
        for at in range(0, len(data), CHUNK):
            end = min(len(data), at + CHUNK)
            first = int(np.searchsorted(bounds, at, side="right")) - 1
            text = np.searchsorted(bounds, np.arange(at, end), side="right") - 1 - first
            low = max(0, at - high)
            cost = self._costs(data[low:end].astype(np.int64), np.arange(at, end) - bounds[first + text], at - low)
            for k in range(len(self.of)):
                sums = np.bincount(text, cost[:, k])
                out[first : first + len(sums), k] += sums
        return out

    def _costs(self, wide: np.ndarray, place: np.ndarray, skip: int) -> np.ndarray:
        """Bits of each byte behind the first ``skip``; place is a byte's distance from its text's start."""
        cost = np.zeros((len(place), len(self.of)), dtype=np.float32)
        left = np.arange(len(place))
        if (self.first, self.last) != (0, 255):
            before = np.where(place > 0, wide[np.maximum(0, skip + left - 1)], 0)
            left = left[(before >= self.first) & (before <= self.last)]
        for order in range(len(self.grams) - 1, -1, -1):
            enough = place[left] >= order
            use = left[enough]
            code = np.ones(len(use), dtype=np.int64)
            for k in range(order, 0, -1):
                code = (code << 8) | wide[skip + use - k]
            slot = self.grams[order].find((code << 8) | wide[skip + use])
            seen = slot >= 0
            cost[use[seen]] += self.grams[order].costs[slot[seen]]
            missed, code = use[~seen], code[~seen]
            slot = self.escapes[order].find(code)
            known = slot >= 0
            cost[missed[known]] += self.escapes[order].costs[slot[known]]
            left = np.concatenate([left[~enough], missed])
        cost[left] += 8
        return cost


@dataclass
class Model:
    """languages; the counts of all grams; languages, first and last byte before of each pack."""

    languages: list[str]
    counts: DataFrame
    packs: list[tuple[list[int], int, int]]
    order: int
    _held: tuple[int, Pack] | None = None

    def pack(self, n: int) -> Pack:
        """Fits pack n; the driver holds the last one only."""
        if self._held is None or self._held[0] != n:
            self._held = None
            self._held = n, _fit(self.counts, self.languages, *self.packs[n], self.order)
        return self._held[1]

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        for n, (of, *_) in enumerate(self.packs):
            out[:, of] += self.pack(n).code_lengths(data, bounds)
        return out


def _gather(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(code, return_inverse=True)
    return value, np.bincount(at, times, minlength=len(value)).astype(np.int64)


def _count(texts: list[bytes], order: int):
    """(order, codes, times) of the grams of all orders, COUNTED bytes at a time.

    Only the longest grams are counted byte by byte: a shorter one ends a longer one or starts a text.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for at in range(0, len(data), COUNTED):
        end = min(len(data), at + COUNTED)
        low = max(0, at - order)
        wide = data[low:end].astype(np.int64)
        where = np.arange(at, end)
        place = where - starts[np.searchsorted(starts, where, side="right") - 1]
        code, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for k in range(order, -1, -1):
            ends = np.flatnonzero(place >= order if k == order else place == k) + (at - low)
            own = np.ones(len(ends), dtype=np.int64)
            for back in range(k, -1, -1):
                own = (own << 8) | wide[ends - back]
            top = np.int64(1) << (8 * (k + 1))
            if k == order:
                code, times = np.unique(own, return_counts=True)
            else:
                code, times = _gather(np.concatenate([(code & (top - 1)) | top, own]), np.concatenate([times, np.ones(len(own), dtype=np.int64)]))
            yield k, code, times


def _gram_rows(order: int):
    def rows(batches):
        for batch in batches:
            held: dict[tuple[str, bool], list[bytes]] = {}
            for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                held.setdefault((lang, half), []).append(text)
            for (lang, half), texts in held.items():
                for k, code, times in _count(texts, order):
                    n = len(code)
                    columns = [pa.array([lang] * n, pa.string()), pa.array([half] * n, pa.bool_()), pa.array(np.full(n, k, dtype=np.int32)), pa.array(code), pa.array(times)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "half", "order", "code", "times"])

    return rows


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """(lang, doc_id, text) of at most ``sample`` documents per language, the least by a hash of doc_id.

    Hashes are counted in ranges first, which tells in which range a language's last document
    lies; only ids of that range are ranked, so no task sees a whole language. That last rank then
    filters the texts where they are read. Rows without text, language or doc_id and texts of more
    than LONGEST bytes are not learned from. Repeated rows count each in the ranking; of rows that
    share doc_id and language the first text in byte order is learned.
    """
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    fine = labelled.filter("lang is not null and doc_id is not null and text is not null").filter(F.octet_length("text") <= LONGEST).select("lang", "doc_id", "text", spread.alias("h"))
    part, rank = F.shiftright("h", 64 - PARTS), F.struct("h", "doc_id")
    counts = fine.groupBy("lang", part.alias("part")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumns({"before": before, "wanted": F.least(F.sum("n").over(whole), F.lit(sample))})
    cut = materialise(cut.filter("before < wanted and before + n >= wanted").select("lang", "part", (F.col("wanted") - F.col("before")).alias("place")))
    near = fine.select("lang", part.alias("part"), rank.alias("last")).join(F.broadcast(cut), ["lang", "part"])  # a row per language
    last = materialise(near.withColumn("_n", F.row_number().over(whole.orderBy("last"))).filter("_n = place").select("lang", "last"))
    chosen = fine.join(F.broadcast(last), "lang").filter(rank <= F.col("last"))  # a row per language
    return chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def train(labelled: DataFrame, order: int = ORDER, sample: int | None = None) -> Model:
    """Fit the trees to every row with text, language and doc_id, repeated rows each; or to ``sample`` documents per language."""
    few = sampled(labelled, sample) if sample else labelled
    return _model(_counted(few, F.lit(True), order), order)


def _half() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")) % 2 == 0


def _learned(labelled: DataFrame) -> DataFrame:
    return labelled.filter("lang is not null and doc_id is not null and text is not null")


def _counted(labelled: DataFrame, half: F.Column, order: int) -> DataFrame:
    """lang, half, order, code and times of every gram."""
    small_batches(labelled)
    rows = _learned(labelled).select(F.col("lang").cast("string").alias("lang"), half.alias("half"), F.col("text").cast("string").alias("text"))
    grams = rows.mapInArrow(_gram_rows(order), "lang string, half boolean, order int, code long, times long")
    return materialise(grams.groupBy("lang", "half", "order", "code").agg(F.sum("times").alias("times")))


def _before() -> F.Column:
    """The byte before the last one of a gram."""
    return F.shiftright("code", 8).bitwiseAND(255).cast("int")


def _model(counts: DataFrame, order: int) -> Model:
    """Cuts the model into packs by the grams that follow each byte; the driver sees those 256 numbers per LANGUAGES languages."""
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    group = F.lit(0)
    if len(languages) > LANGUAGES:
        numbers = {name: n // LANGUAGES for n, name in enumerate(languages)}
        names = counts.sparkSession.createDataFrame(list(numbers.items()), "lang string, _group int")
        counted, group = counts.join(F.broadcast(names), "lang"), F.col("_group")
    else:
        counted = counts
    distinct = counted.filter("order > 0").select(group.alias("g"), _before().alias("b"), "order", "code").distinct()
    sizes = {(r.g, r.b): r["count"] for r in distinct.groupBy("g", "b").count().collect()}
    packs = []
    for g in range(0, len(languages), LANGUAGES):
        of, first, cells = list(range(g, min(g + LANGUAGES, len(languages)))), 0, 0
        for byte in range(256):
            more = sizes.get((g // LANGUAGES, byte), 0) * len(of)
            if cells and cells + more > CELLS:
                packs.append((of, first, byte - 1))
                first, cells = byte, 0
            cells += more
        packs.append((of, first, 255))
    return Model(languages, counts, packs, order)


def _fit(counts: DataFrame, languages: list[str], of: list[int], first: int, last: int, order: int) -> Pack:
    few = counts if len(of) == len(languages) else counts.filter(F.col("lang").isin([languages[k] for k in of]))
    if (first, last) != (0, 255):
        few = few.filter((F.col("order") == 0) | _before().between(first, last))
    got = few.groupBy("lang", "order", "code").agg(F.sum("times").alias("times")).toArrow()
    lang = got["lang"].combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    number = {languages[k]: n for n, k in enumerate(of)}
    which = np.array([number[name] for name in lang.dictionary.to_pylist()], dtype=np.int64)[lang.indices.to_numpy(zero_copy_only=False)]
    level, code, times = got["order"].to_numpy(), got["code"].to_numpy(), got["times"].to_numpy()
    return Pack(of, first, last, *_flatten(len(of), [(which[level == k], code[level == k], times[level == k]) for k in range(order + 1)]))


def _flatten(n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[Table], list[Table]]:
    """Costs of every gram in each of n languages, from the shortest context up."""
    grams: list[Table] = []
    escapes: list[Table] = []
    below = np.zeros(0, dtype=np.int64), np.zeros((0, n))
    for which, code, times in levels:
        known = np.unique(code)
        count = np.zeros((len(known), n))
        count[np.searchsorted(known, code), which] = times
        context, at = np.unique(known >> 8, return_inverse=True)
        total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(total, at, count)
        np.add.at(kinds, at, count > 0)
        seen = total > 0
        escape = np.where(seen, np.log2(np.where(seen, (total + kinds) / np.maximum(kinds, 1), 1)), 0)
        bits = int(known.max()).bit_length() - 1 if len(known) else 8
        shorter = (known & ((1 << (bits - 8)) - 1)) | (1 << (bits - 8)) if bits > 8 else known  # drops the first byte
        lower = np.full((len(known), n), 8.0)
        if bits > 8:
            lower = below[1][np.searchsorted(below[0], shorter)]
        share = np.where(count > 0, np.log2(np.maximum(total + kinds, 1)[at] / np.maximum(count, 1)), escape[at] + lower)
        grams.append(build(known, share))
        escapes.append(build(context, escape))
        below = known, share
    return grams, escapes


def train_bounded(labelled: DataFrame, order: int = ORDER) -> tuple[Model, dict[str, float]]:
    """The model, and the bits a byte of each language up to which a long text counts as one of it.

    A model of one half of the documents scores the whole other half, so that no text has been learned.
    """
    counts = _counted(labelled, _half(), order)
    half = _model(counts.filter("half"), order)
    other = _learned(labelled).filter(~_half() & (F.col("text") != "")).select(F.col("text").cast("string").alias("text"))
    bounds = {}
    if half.languages:
        scored, shared = _all_but_last(other, half, [])
        costs = scored.mapInArrow(_costs_of(shared, half.languages), "lang string, cost double")
        for lang, (n, middle, far) in quantiles(costs, (0.5, 0.99)).items():
            if n >= LEAST:
                bounds[lang] = min(PLAIN, middle + SPREADS * (far - middle))
        shared.unpersist()
    return _model(counts, order), bounds


def quantiles(costs: DataFrame, shares: tuple[float, ...]) -> dict[str, tuple[float, ...]]:
    """Rows and exact quantiles of cost for every lang, between two costs in proportion.

    Costs are counted by steps of a bit first, which tells in which step a wanted rank lies; only the
    distinct costs of that step are ranked, each with its count, so no task sees a whole language.
    """
    values = materialise(costs.groupBy("lang", "cost").agg(F.count("*").alias("n"))).withColumn("step", F.floor(F.col("cost") * STEPS))
    whole = Window.partitionBy("lang").orderBy("step")
    steps = values.groupBy("lang", "step").agg(F.sum("n").alias("n"))
    steps = steps.withColumns({"before": F.sum("n").over(whole) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("lang"))})
    places = [F.lit(q) * (F.col("total") - 1) for q in shares]
    ranks = steps.select("*", F.posexplode(F.array(*[f(p) for p in places for f in (F.floor, F.ceil)])).alias("at", "rank"))
    wanted = materialise(ranks.filter("before <= rank and rank < before + n").select("lang", "step", "at", "rank", "before", "total"))
    near = values.join(F.broadcast(wanted), ["lang", "step"])  # a row per language and share, twice
    ranked = near.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("lang", "at").orderBy("cost")))
    found: dict[str, dict[int, float]] = {}
    totals = {}
    for r in ranked.filter("upto - n <= rank and rank < upto").select("lang", "at", "cost", "total").collect():
        found.setdefault(r.lang, {})[r["at"]] = r.cost
        totals[r.lang] = r.total
    out = {}
    for lang, at in found.items():
        spots = [q * (totals[lang] - 1) for q in shares]
        out[lang] = totals[lang], *(at[2 * k] + (at[2 * k + 1] - at[2 * k]) * (p - int(p)) for k, p in enumerate(spots))
    return out


def _bits(pack: Pack, batch: pa.RecordBatch, n: int) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Texts of a batch, their sizes, and their bits in n languages of this pack and of those before."""
    texts = as_bytes(batch.column("text"))
    size = np.array([len(t or b"") for t in texts], dtype=np.int64)
    held = batch.schema.get_field_index("bits")
    bits = np.zeros((len(texts), n)) if held < 0 else batch.column(held).flatten().to_numpy(zero_copy_only=False).reshape(len(texts), n).copy()
    bits[:, pack.of] += pack.code_lengths(np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]))
    return texts, size, bits


def _all_but_last(own: DataFrame, model: Model, kept: list[str]):
    """own, with bits of all packs but the last if there are several, and the last one as a broadcast."""
    context, n = own.sparkSession.sparkContext, len(model.languages)

    def adding(shared):
        def rows(batches):
            for batch in slices(batches, 64):
                bits = _bits(shared.value, batch, n)[2]
                column = pa.ListArray.from_arrays(np.arange(0, bits.size + 1, n, dtype=np.int32), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], [*names, "bits"])

        return rows

    names = [*(c for c in kept if c != "text"), "text"]
    schema = T.StructType([own.schema[c] for c in names] + [T.StructField("bits", T.ArrayType(T.DoubleType()))])
    for k in range(len(model.packs) - 1):
        shared = context.broadcast(model.pack(k))
        own = materialise(own.mapInArrow(adding(shared), schema))
        shared.unpersist()
    return own, context.broadcast(model.pack(len(model.packs) - 1))


def _best(languages: list[str], bits: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The best language of each text, its bits a byte, and its posterior."""
    sure = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
    return [languages[k] for k in bits.argmin(axis=1)], bits.min(axis=1) / np.maximum(size, 1), sure


def _costs_of(shared, languages: list[str]):
    def rows(batches):
        for batch in slices(batches, 64):
            _, size, bits = _bits(shared.value, batch, len(languages))
            best, per_byte, _ = _best(languages, bits, size)
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), pa.array(per_byte, pa.float64())], ["lang", "cost"])

    return rows


def _predict(shared, languages: list[str], kept: list[str], limits: dict[str, float] | None):
    def rows(batches):
        for batch in slices(batches, 64):
            lang, score, fits = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [False] * batch.num_rows
            if languages and batch.num_rows:
                texts, size, bits = _bits(shared.value, batch, len(languages))
                best, per_byte, sure = _best(languages, bits, size)
                for at, text in enumerate(texts):
                    if text and LETTER.search(text.decode()):
                        lang[at], score[at] = best[at], float(sure[at])
                        fits[at] = limits is not None and bool(per_byte[at] <= limits.get(best[at], PLAIN) + SHORT / np.sqrt(len(text)))
            found = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())} | ({} if limits is None else {"fits": pa.array(fits, pa.bool_())})
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found.values()], [*kept, *found])

    return rows


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id if not given), lang_pred and score for every row of docs.

    score is the posterior probability of the language under equal priors. A text that is null
    or holds no letter, and every text under a model without languages, is ``und`` with score 0.
    Ties go to the first language in alphabetical order. Whole texts are scored, long ones in
    chunks. Repeated rows are judged each, and an empty table gives no rows. Kept columns named lang_pred or score are replaced;
    other names do not matter. With the bounds of train_bounded as ``limits`` the column
    fits tells whether the text costs no more than its language's bound, which widens for short
    texts: score alone is near 1 for any text, as it compares only the learned languages.
    """
    small_batches(docs)
    new = ["lang_pred", "score", *(["fits"] if limits is not None else [])]
    kept = [c for c in keep or ["doc_id"] if c not in new]
    own, names = beside_text(docs, kept)
    schema = T.StructType([own.schema[n] for n in names] + [T.StructField(n, kind) for n, kind in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    shared = None
    if model.languages:
        own, shared = _all_but_last(own, model, names)
    return own.mapInArrow(_predict(shared, model.languages, names, limits), schema).toDF(*kept, *new)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
