"""Byte-level BPE encoding and decoding.

Method: the merges are a left-to-right transducer over bytes. Two neighbouring tokens stay
apart exactly if no merge across their border comes before those that make them, and BPE of a
text is the one sequence whose neighbours all stay apart. So the last token of every prefix is
the one vocabulary entry ending there that fits the last token before it. What later bytes can
do depends only on the live starts, the places from which a token can still begin, and on the
last token before each; that is a state. States and arcs are determinised when an input first
needs them. A token is emitted once every live start lies behind it, so the lookahead is at
most the longest token.

Decoding joins the bytes of the ids in chunks through an incremental UTF-8 decoder, a state
machine that holds back an unfinished character.
"""

from __future__ import annotations

import base64
import codecs
import math
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.llm.common import no_cycles, slices, small_batches

#: Stored states and stored words before a store starts anew, longest stored word, bytes between emissions.
STATES, WORDS, STORED, EMIT = 300_000, 250_000, 48, 4096
#: Blanks that do not start a match, and the places before those that do.
BLANKS, CUT = re.compile(r" (?:\s|\Z)"), re.compile(r" (?=\S)")
#: Marks that are a match of their own after a letter and at the end of a word.
ENDS = frozenset(",.;:!?")
# Code points that the tiktoken library has as unassigned, where the regex module has letters or numbers.
UNASSIGNED = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
OTHER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in UNASSIGNED.split()) + "]")
#: Stands for one of them where matches are sought: a code point that both have as unassigned.
STAND_IN = "\u0378"
#: Keys of a state besides its bytes.
LAST, TEXT, LIVE = -1, -2, -3
#: Ids that are decoded at a time.
CHUNK = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Lazily determinised transducer of a rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        #: Texts that a longer token starts with.
        self.starts = {token[:k] for token in ranks for k in range(1, len(token))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        #: Ids of words met lately, and of those met before them: two generations keep the frequent ones.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        most = max(ranks.values()) + 1 if ranks else 0
        self.lengths = np.zeros(most, dtype=np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(k, b"") for k in range(most)), dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        """Forget all states but the empty prefix, state 0.

        A state is the dictionary of its arcs by byte. Under LAST it has its last token, under
        TEXT the text since its first live start, under LIVE for every live start its distance
        from the end with the last token before it, -1 if there is none.
        """
        self.fits.clear()
        self.start: dict = {LAST: -1, TEXT: b"", LIVE: ((0, -1),)}
        self.number: dict[tuple, dict] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            text = self.tokens[token]
            best, found = None, None
            if len(text) > 1:
                # the merge that makes a token is the last of the ones inside it: merge by rank, but stop before it
                left = [self.ranks[text[k : k + 1]] for k in range(len(text))]
                while len(left) > 2:
                    pairs = [self.ranks.get(self.tokens[a] + self.tokens[b], token) for a, b in zip(left, left[1:])]
                    best = min(pairs)
                    if best >= token:
                        break
                    at = pairs.index(best)
                    left[at : at + 2] = [best]
                found = (left[0], left[1]) if len(left) == 2 else None
            self.halves[token] = found
        return self.halves[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before those that make a and b."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._fit(a, b)
        return known

    def edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one end (0 left, 1 right) of a token while it is merged, each with the rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            known, at = [(self.tokens[token], math.inf)], token
            while (halves := self.parts(at)) is not None:
                known.append((self.tokens[halves[side]], at))
                at = halves[side]
            self.edges[side][token] = known
        return known

    def _fit(self, a: int, b: int) -> bool:
        """Merges go by rank, equal ones from the left: one across the border needs both its sides before they are taken up."""
        get = self.ranks.get
        for left, until in self.edge(a, 1):
            for right, least in self.edge(b, 0):
                rank = get(left + right)
                if rank is not None and rank < until and rank <= least:
                    return False
        return True

    def step(self, state: dict, byte: int) -> dict:
        """Add the arc of a state for the next byte, and the state it leads to if that is new."""
        text, live, token = state[TEXT] + bytes((byte,)), [], None
        for far, before in state[LIVE]:  # the farthest first
            part = text[len(text) - 1 - far :]
            if token is None:
                whole = self.ranks.get(part)
                if whole is not None and (before < 0 or self.fit(before, whole)) and (len(part) == 1 or self.parts(whole)):
                    token = whole
            if part in self.starts:
                live.append((far + 1, before))
        if token is None:
            raise ValueError(f"no token ends with byte {byte}")
        live.append((0, token))
        key = (text[len(text) - live[0][0] :], tuple(live))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = {LAST: token, TEXT: key[0], LIVE: key[1]}
        state[byte] = to
        return to

    def walk(self, data: bytes) -> Iterator[int]:
        """Tokens of a piece, each as soon as no later byte can change it."""
        lasts, done, state, size = [], 0, self.start, self.size
        for end, byte in enumerate(data, 1):
            state = state.get(byte) or self.step(state, byte)
            lasts.append(state[LAST])
            if end % EMIT and end < len(data):
                continue
            # what lies before the splits of all live starts is final
            open_ = {end - far for far, _ in state[LIVE]} if end < len(data) else {end}
            while len(open_) > 1:
                top = max(open_)
                open_.remove(top)
                open_.add(top - size[lasts[top - done - 1]])
            keep = at = open_.pop()
            final = []
            while at > done:
                token = lasts[at - done - 1]
                final.append(token)
                at -= size[token]
            yield from reversed(final)
            lasts, done = lasts[keep - done :], keep

    def piece(self, text: str) -> bytes:
        """Packed ids of one piece, little-endian unsigned 32 bits each."""
        if len(self.number) > STATES:
            self.clear()
        data = text.encode()
        if len(data) > EMIT:
            return np.fromiter(self.walk(data), dtype="<u4").tobytes()
        state, path = self.start, []
        add = path.append
        try:
            for byte in data:
                state = state[byte]
                add(state)
        except KeyError:
            for byte in data[len(path) :]:
                state = state.get(byte) or self.step(state, byte)
                add(state)
        ids, at, size = [], len(data), self.size
        while at:
            token = path[at - 1][LAST]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return pack(f"<{len(ids)}I", *ids)

    def matches(self, text: str) -> list[str]:
        """Matches of the pattern, with the library's classes of code points."""
        if OTHER.search(text) is None:
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(OTHER.sub(STAND_IN, text))]

    def word(self, text: str, blank: str = " ") -> bytes:
        """Packed ids of a blank and a word, a stretch that no match of the pattern crosses."""
        out = self.older.get(text) if blank else None
        if out is not None:
            pass
        elif text.isalpha():
            out = self.piece(blank + text)
        elif blank and text[-1:] in ENDS and text[:-1].isalpha():
            out = (self.words.get(text[:-1]) or self.word(text[:-1])) + self.piece(text[-1])
        else:
            out = b"".join(map(self.piece, self.matches(blank + text)))
        if blank and len(text) <= STORED:
            if len(self.words) > WORDS:
                self.words, self.older = {}, self.words
            self.words[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, every match of the pattern on its own.

        A blank before a visible character always starts a match, so texts are cut there first
        and what stands between the cuts is encoded once while it is stored.
        """
        head, *rest = CUT.split(text) if BLANKS.search(text) else text.split(" ")
        found = list(map(self.words.get, rest))
        if None in found:
            found = [self.words.get(w) or self.word(w) if x is None else x for x, w in zip(found, rest)]
        return self.word(head, "") + b"".join(found)

    def decode(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids that arrive in chunks; bytes that are not UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for chunk in chunks:
            ids = np.frombuffer(chunk, dtype="<u4")
            size = self.lengths[ids]
            shift = self.offsets[ids] - np.cumsum(size) + size
            yield machine.decode(self.bytes[np.arange(size.sum()) + np.repeat(shift, size)].tobytes())
        yield machine.decode(b"", final=True)


#: One transducer per Python worker and vocabulary: its states serve all tasks that follow.
_LOADED: dict[tuple[str, str], Transducer] = {}


def _transducer(path: str, pattern: str) -> Transducer:
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = Transducer(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def _rows(path: str, pattern: str, decoded: bool):
    def rows(batches):
        machine = _transducer(path, pattern)
        for batch in slices(batches, 128):
            with no_cycles():
                ids = [machine.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(["".join(machine.decode(x[at : at + 4 * CHUNK] for at in range(0, len(x), 4 * CHUNK))) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return rows


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of docs (doc_id, text); ids are packed little-endian uint32.

    path names a rank file that every executor can read (lines of base64 token and rank).
    decoded adds the text that the ids decode to. A null text encodes as an empty one. Special
    tokens are ordinary text. Repeated rows are encoded each, and texts whole however long.
    Other columns of docs are ignored.
    """
    small_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_rows(path, pattern, decoded), "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) for rows of (doc_id, ids); null ids decode to an empty text."""

    def rows(batches):
        machine = _transducer(path, pattern)
        for batch in slices(batches, 128):
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            texts = ["".join(machine.decode(x[at : at + 4 * CHUNK] for at in range(0, len(x), 4 * CHUNK))) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, decoded string")
