"""Removal of word runs that an earlier document already holds.

Method: repeated-phrase automata. (1) Each document gives the minimum 5-word hash of each
13-word window; equal windows give equal minima, so a shared window is never missed. Minima
of two documents mark candidate windows, which are cut out of the texts as pieces. (2) Spark
confirms by their hash which windows of the pieces recur, and the first document of each.
(3) Every block of documents gets just the confirmed windows of its own pieces, as they stand
in those first documents, compiles Aho-Corasick automata from them and streams its pieces
through. A match in a document with a larger id marks its words.

Exact copies of an earlier document are told by their text's hash and lose all their words
without a search. Rows with an equal key (a minimum, a window) are joined inside each task
before they are dealt, so that a key of a third of all rows is a few rows per task; of those
joined, whatever is decided already goes on spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dexspark.llm import common
from dexspark.llm.common import as_bytes, beside_text, gram_hashes, hashed_words, materialise, signed, slices, small_batches, word_hashes

#: Words of a window, of the hashed grams in it, and documents of a block.
WINDOW, GRAM, BLOCK = 13, 5, 256
#: Windows of a piece: one bit of a long for each.
PIECE = 64
#: Rows that a task joins before it deals them, windows of one automaton.
UNIT, SHARD = 1 << 20, 50_000
#: Symbols of a word and their base: automata are slow at nodes with many children.
DIGITS, BASE = 3, 128
#: State of a row between tasks: one document so far, several, or decided and only passed on.
OPEN, SHARED, PASSED = range(3)

PIECES = "block int, doc_id long, key long, start int, piece long, words binary"
SPANS = "doc_id long, key long, spans array<struct<lo:int,hi:int>>"


def window_minima(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window the least hash of the grams inside it."""
    grams = gram_hashes(hashes, gram)
    count = len(hashes) - window + 1
    if count < 1:
        return np.empty(0, dtype=np.uint64)
    out = grams[:count].copy()
    for k in range(1, window - gram + 1):
        np.minimum(out, grams[k : k + count], out=out)
    return out


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def units(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of many small parts joined to UNIT rows or more."""
    held, count = [], 0
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count >= UNIT:
            yield [np.concatenate(c) for c in zip(*held)]
            held, count = [], 0
    if count:
        yield [np.concatenate(c) for c in zip(*held)]


def _anchor_rows(window: int, gram: int):
    """(dest, h, doc_id, state): the minima of documents; of an equal one in a unit only the first is left to compare."""

    def parts(batches):
        for batch in slices(batches):
            hashes, owner = hashed_words(as_bytes(batch.column(1)))
            least = window_minima(hashes, window, gram)
            inside = owner[: len(least)] == owner[len(hashes) - len(least) :]
            least, owner = signed(least[inside]), owner[: len(least)][inside]
            new = starts_of(least, owner)
            yield [least[new], batch.column(0).to_numpy()[owner[new]]]

    def rows(batches):
        for h, doc in units(parts(batches)):
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = starts_of(h, doc)
            h, doc = h[new], doc[new]
            first = starts_of(h)
            many = np.diff(np.append(np.flatnonzero(first), len(h)))
            state = np.where(first, np.where(np.repeat(many, many) > 1, SHARED, OPEN), PASSED)
            dest = np.where(first, h, doc)
            yield pa.RecordBatch.from_arrays([pa.array(dest), pa.array(h), pa.array(doc), pa.array(state.astype(np.int8))], ["dest", "h", "doc_id", "state"])

    return rows


def _recurring(batches):
    """(doc_id, h) of minima that two documents hold, from rows sorted by h."""

    def told(h, doc, state):
        first = np.flatnonzero(starts_of(h))
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        held = (low < high) | (np.maximum.reduceat(state, first) == SHARED)
        chosen = np.repeat(held, np.diff(np.append(first, len(h))))
        return doc[chosen], h[chosen]

    rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)]
    for batch in batches:
        h, doc, state = (batch.column(c).to_numpy() for c in ("h", "doc_id", "state"))
        passed = state == PASSED
        out = [doc[passed]], [h[passed]]
        h, doc, state = rest = [np.concatenate(c) for c in zip(rest, (h[~passed], doc[~passed], state[~passed]))]
        if len(h):
            end = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if end:
                for held, found in zip(out, told(h[:end], doc[:end], state[:end])):
                    held.append(found)
            rest = [c[end:] for c in rest]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "h"])
    if len(rest[0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in told(*rest)], ["doc_id", "h"])


def _packed(batches):
    """Texts go through the shuffle compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        names = batch.schema.names
        columns = [batch.column(c) if c != "text" else pa.array([None if t is None else pack(t) for t in as_bytes(batch.column(c))], pa.binary()) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names)


def _pieces_of(window: int, gram: int):
    """Cut the runs of candidate windows out of the documents of a block; a hit without h names a copy."""

    def cut(key, docs: pa.Table, hits: pa.Table) -> pa.Table:
        named = hits.filter(hits["h"].is_null())
        copies = set(zip(named["doc_id"].to_pylist(), named["key"].to_pylist()))
        hits = hits.filter(hits["h"].is_valid())
        order = np.argsort(at := hits["doc_id"].to_numpy(), kind="stable")
        at, anchors = at[order], hits["h"].to_numpy()[order]
        block, number = key[0].as_py(), dict[int, int]()
        out = {name: [] for name in ("doc_id", "key", "start", "piece", "words")}
        for doc, name, text in zip(*(docs[c].to_pylist() for c in ("doc_id", "key", "text")), strict=True) if len(at) else ():
            lo, hi = np.searchsorted(at, [doc, doc + 1])
            if lo == hi or (doc, name) in copies:
                continue
            words = zstandard.decompress(text).split()
            held = np.isin(signed(window_minima(word_hashes(words), window, gram)), anchors[lo:hi])
            edges = np.flatnonzero(np.diff(np.concatenate(([0], held.view(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for start in range(a, b, PIECE):
                    place = number[doc] = number.get(doc, -1) + 1  # rows that share an id share the numbers
                    for column, value in zip(out.values(), (doc, name, start, (block << 32) + place * PIECE, b" ".join(words[start : min(b, start + PIECE) + window - 1]))):
                        column.append(value)
        kinds = {"start": pa.int32(), "words": pa.binary()}
        columns = [pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]
        return pa.table([pa.array([block] * len(columns[0]), pa.int32()), *columns], ["block", *out])

    return cut


def _window_rows(window: int):
    """(dest, w, doc_id, at, source, source_at): windows of pieces by their place; w is left to compare once per unit.

    The block of a place is its upper half. A window that a smaller document of the unit holds
    needs no further comparison: it is passed on with that document as its source.
    """

    def parts(batches):
        for batch in batches:
            hashes, owner = hashed_words(as_bytes(batch.column(2)))
            w = signed(gram_hashes(hashes, window))
            inside = owner[: len(w)] == owner[len(hashes) - len(w) :]
            owner, at = owner[: len(w)][inside], np.flatnonzero(inside)
            first = np.flatnonzero(starts_of(owner)) if len(owner) else np.empty(0, dtype=np.int64)
            offset = at - np.repeat(at[first], np.diff(np.append(first, len(at))))
            yield [w[inside], batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner] + offset]

    def rows(batches):
        for w, doc, at in units(parts(batches)):
            order = np.lexsort((at, doc, w))
            w, doc, at = w[order], doc[order], at[order]
            first = np.flatnonzero(starts_of(w))
            times = np.diff(np.append(first, len(w)))
            source, source_at = np.repeat(doc[first], times), np.repeat(at[first], times)
            later = np.flatnonzero(doc > source)
            later = later[np.lexsort((at[later] >> 32, w[later]))]
            later = later[starts_of(w[later], at[later] >> 32)]
            none = np.full(len(first), -1)
            dest = np.concatenate([w[first], at[later]])
            columns = [np.concatenate([c[first], c[later]]) for c in (w, doc, at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (dest, *columns, np.concatenate([doc[first], source[later]]), np.concatenate([none, source_at[later]]))], ["dest", "w", "doc_id", "at", "source", "source_at"]
            )

    return rows


def _requests(batches):
    """(block, source, source_at): where the windows that a block needs stand first, from rows sorted by w and doc_id."""
    held = (None, 0, 0)  # the last window met, its first document and place
    for batch in batches:
        w, doc, at, source, place = (batch.column(c).to_numpy() for c in ("w", "doc_id", "at", "source", "source_at"))
        compared = place < 0
        passed = ~compared
        out = [at[passed] >> 32], [source[passed]], [place[passed]]
        w, doc, at = w[compared], doc[compared], at[compared]
        if len(w):
            new = starts_of(w)
            new[0] = held[0] is None or w[0] != held[0]
            group = np.cumsum(new)
            first = np.flatnonzero(new)
            least, where = (np.concatenate(([h], c[first])) for h, c in zip(held[1:], (doc, at)))
            later = doc > least[group]
            for column, found in zip(out, (at[later] >> 32, least[group[later]], where[group[later]])):
                column.append(found)
            held = w[-1], least[-1], where[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["block", "source", "source_at"])


class Codes(dict):
    """A string of DIGITS symbols for every word; a word that no phrase has gets a symbol of no phrase."""

    def add(self, word: bytes) -> str:
        code = self.get(word)
        if code is None:
            n = len(self)
            high, middle, low = n // BASE**2, n // BASE % BASE, n % BASE
            code = self[word] = chr(2 + BASE + low) + chr(2 + middle) + chr(2 + 2 * BASE + high)  # the first symbol is never one of the others
        return code

    def __missing__(self, word: bytes) -> str:
        return "\x01" * DIGITS


def automata(phrases: Iterator[tuple[int, bytes, int]], window: int) -> Iterator[tuple[Codes, ahocorasick.Automaton]]:
    """Automata of at most SHARD windows each, from (source, words, mask of its windows)."""
    codes, first = Codes(), dict[str, int]()
    for source, words, mask in phrases:
        text = "".join(map(codes.add, words.split()))
        mask &= (1 << PIECE) - 1
        while mask:
            low = mask & -mask
            mask ^= low
            at = DIGITS * (low.bit_length() - 1)
            phrase = text[at : at + DIGITS * window]
            if source < first.get(phrase, source + 1):
                first[phrase] = source
        if len(first) >= SHARD:
            yield codes, compiled(first)
            codes, first = Codes(), {}
    if first:
        yield codes, compiled(first)


def compiled(first: dict[str, int]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for phrase, source in first.items():
        out.add_word(phrase, source)
    out.make_automaton()
    return out


def _spans_of(window: int):
    """Stream the pieces of a block through the automata of its phrases."""

    def locate(key, pieces: pa.Table, phrases: pa.Table) -> pa.Table:
        marks: dict[tuple[int, int], list[int]] = {}
        for codes, automaton in automata(zip(phrases["source"].to_pylist(), as_bytes(phrases["words"]), phrases["mask"].to_pylist(), strict=True), window):
            for doc, name, start, words in zip(*(pieces[c].to_pylist() for c in ("doc_id", "key", "start", "words")), strict=True):
                text = "".join(map(codes.__getitem__, words.split()))
                found = [start + (end + 1) // DIGITS - window for end, source in automaton.iter(text) if source < doc]
                if found:
                    marks.setdefault((doc, name), []).extend(found)
        spans = []
        for found in marks.values():
            at = np.unique(found)
            new = np.flatnonzero(np.diff(at, prepend=at[0] - window - 1) > window)
            spans.append([{"lo": a, "hi": b + window} for a, b in zip(at[new].tolist(), at[np.append(new[1:] - 1, len(at) - 1)].tolist())])
        docs, names = ([k[n] for k in marks] for n in (0, 1))
        return pa.table([pa.array(docs, pa.int64()), pa.array(names, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["doc_id", "key", "spans"])

    return locate


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of the rows of docs (doc_id, key, text) whose text a document with a smaller id has too."""
    ids = docs.select("doc_id", "key", F.xxhash64(F.lit(1), "text").alias("other"))
    groups = ids.groupBy("key", "other").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    held = materialise(groups.filter("most > least").select("key", "other", "least"))
    return ids.join(held, ["key", "other"]).filter("doc_id > least").select("doc_id", "key").distinct()


def repeated_spans(docs: DataFrame, copies: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, spans): word ranges [lo, hi) covered by windows that start in an earlier document.

    docs has doc_id, key and text without nulls; copies, which are left out, are rows of later_copies.
    Documents without such a range have no row.
    """
    blocks = common.blocks_for(docs.count(), BLOCK)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    anchors = docs.select("doc_id", "text").mapInArrow(_anchor_rows(window, gram), "dest long, h long, doc_id long, state byte")
    hits = anchors.repartition("dest").sortWithinPartitions("h").mapInArrow(_recurring, "doc_id long, h long")
    hits = hits.select("doc_id", "h", F.lit(None).cast("long").alias("key")).union(copies.select("doc_id", F.lit(None).cast("long"), "key")).withColumn("block", block)
    packed = docs.mapInArrow(_packed, "doc_id long, key long, text binary").withColumn("block", block)
    pieces = materialise(packed.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_pieces_of(window, gram), PIECES))
    windows = pieces.select("doc_id", "piece", "words").mapInArrow(_window_rows(window), "dest long, w long, doc_id long, at long, source long, source_at long")
    asked = windows.repartition("dest").sortWithinPartitions("w", "doc_id").mapInArrow(_requests, "block long, source long, source_at long")
    bit = F.col("source_at").bitwiseAND(F.lit(PIECE - 1))
    masks = asked.groupBy("block", "source", (F.col("source_at") - bit).alias("piece")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(source_at & {PIECE - 1} as int))")).alias("mask"))
    phrases = masks.withColumnRenamed("block", "_block").join(pieces.select(F.col("doc_id").alias("source"), "piece", "words"), ["source", "piece"]).select(F.col("_block").cast("int").alias("block"), "source", "mask", "words")
    return pieces.select("block", "doc_id", "key", "start", "words").groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(_spans_of(window), SPANS)


#: Columns that remove_repeats adds.
NEW = ["n_words", "n_removed", "kept_text"]


def _kept(columns: list[str], window: int):
    def rows(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            texts = [None if t is None else unpack(t) for t in batch.column("text").to_pylist()]
            for text, spans, copy in zip(texts, batch.column("spans").to_pylist(), batch.column("copy").to_pylist(), strict=True):
                words = (text or b"").split()
                keep = np.ones(len(words), dtype=bool)
                if copy and len(words) >= window:
                    keep[:] = False
                for span in spans or ():
                    keep[span["lo"] : span["hi"]] = False
                n_words.append(len(words))
                n_removed.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in columns], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*columns, *NEW],
            )

    return rows


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id if not given), n_words, n_removed and kept_text for every row.

    A word is removed if a window of ``window`` words that covers it also starts in a document
    with a smaller doc_id, judged on the input. kept_text joins the words left by one space.
    Null and empty texts and those shorter than a window lose nothing; an empty kept_text stands
    for no words. Rows with a null doc_id keep all words. Every row is judged by its own text: of
    rows that share a doc_id none is earlier than the other, be their texts equal or not, and each
    gets its own words removed. Windows are told apart by 64-bit hashes before the automata
    confirm them word by word. Texts of any length are taken whole, in pieces. Kept columns named like the new
    ones are replaced; other names and columns do not matter. An empty table gives no rows.
    """
    small_batches(docs)
    kept = [c for c in keep or ["doc_id"] if c not in NEW]
    beside, names = beside_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), [*kept, "doc_id"])
    own = beside.withColumnRenamed(names.pop(), "doc_id").withColumn("key", F.xxhash64("text"))
    own = own.select(*[c for c in own.columns if c != "text"], "text")
    judged = own.select("doc_id", "key", "text").filter("doc_id is not null and text is not null")
    copies = materialise(later_copies(judged))
    spans = repeated_spans(judged, copies, window, gram).select("doc_id", "key", "spans", F.lit(False).alias("copy"))
    marks = spans.union(copies.select("doc_id", "key", F.lit(None).cast(spans.schema["spans"].dataType), F.lit(True))).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    packed = own.mapInArrow(_packed, T.StructType([*own.schema.fields[:-1], T.StructField("text", T.BinaryType())]))
    joined = packed.join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(*[n for n in names if n != "text"], "text", "spans", "copy")
    schema = T.StructType([own.schema[n] for n in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_kept(names, window), schema).toDF(*kept, *NEW)
