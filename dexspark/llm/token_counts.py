"""Token counts under a unigram vocabulary by dynamic programming over a shared trie.

Method: the distinct pre-tokens of the documents go into a trie. The best log score of a
prefix depends on the prefix alone, so the forward step of the unigram model runs once per
trie node, and the node where a pre-token ends stores its count of tokens. Documents then add
up the counts of their pre-tokens.

Each Python worker keeps one trie over all its tasks and starts it anew at NODES nodes, so
its memory is bounded and nothing is shuffled. Pre-tokens of more than 64 characters take the
same steps beside the trie, which they would only fill. The vocabulary is a public piece list in order
of frequency; the log probability of the piece of rank r follows Zipf's law, -ln(r + 1) less
the log of the harmonic sum. Characters without a piece are spelled in byte pieces.
"""

from __future__ import annotations

import math

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.llm.common import no_cycles, slices, small_batches

#: Mark of a pre-token's start, nodes and words that a worker stores.
START, NODES, WORDS = "▁", 500_000, 300_000


def load_scores(path: str) -> tuple[dict[str, float], float]:
    """(log score of each piece, log score of a byte piece) of a piece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain) + 1)))
    scores = {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}
    return scores, -math.log(len(plain) + 1) - total


class Trie:
    """Trie of pre-tokens with the forward scores of the unigram model.

    A node is the dictionary of its children by character; under BEST it has the best log score
    of its prefix with the tokens it takes, counted down from 0, so that the greater pair is the
    better one. ``ends`` holds the pieces from their last character back, so that a new node
    meets only pieces that end at it.
    """

    BEST = 0

    def __init__(self, scores: dict[str, float], byte: float):
        self.byte, self.longest = byte, max(map(len, scores), default=1)
        self.ends: dict = {}
        for piece, score in scores.items():
            node = self.ends
            for letter in reversed(piece):
                node = node.setdefault(letter, {})
            node[self.BEST] = score
        #: Tokens of pre-tokens met lately, and of those met before them: two generations keep the frequent ones.
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.root: dict = {self.BEST: (0.0, 0)}
        self.nodes = 0

    def best(self, text: str, end: int, below: list[tuple[float, int]]) -> tuple[float, int]:
        """Score of the first ``end`` characters from those of all shorter prefixes, the nearest last."""
        letter, (score, tokens) = text[end - 1], below[-1]
        size = 1 if letter < "\x80" else len(letter.encode())
        out, node = (score + size * self.byte, tokens - size), self.ends
        for back in range(1, len(below) + 1):
            node = node.get(text[end - back])
            if node is None:
                break
            if self.BEST in node:
                score, tokens = below[-back]
                if (here := (score + node[self.BEST], tokens - 1)) > out:
                    out = here
        return out

    def count(self, word: str) -> int:
        """Tokens of a pre-token, from its terminal node."""
        found = self.older.get(word)
        if found is None:
            found = self.long_count(word) if len(word) > 64 else self.walk(word)
        if len(word) <= 64:
            if len(self.counts) > WORDS:
                self.counts, self.older = {}, self.counts
            self.counts[word] = found
        return found

    def walk(self, word: str) -> int:
        if self.nodes > NODES:
            self.clear()
        text, node, held = START + word, self.root, [self.root[self.BEST]]
        for end, letter in enumerate(text, 1):
            below = node.get(letter)
            if below is None:
                below = node[letter] = {self.BEST: self.best(text, end, held)}
                self.nodes += 1
            node = below
            held.append(node[self.BEST])
        return -held[-1][1]

    def long_count(self, word: str) -> int:
        """The same steps for a pre-token too long to store, over a window of scores."""
        text, held = START + word, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            held.append(self.best(text, end, held))
            if len(held) > self.longest:
                del held[0]
        return -held[-1][1]

    def total(self, text: str) -> int:
        words = text.split()
        found = list(map(self.counts.get, words))
        if None in found:
            found = [self.counts.get(w) or self.count(w) if n is None else n for n, w in zip(found, words)]
        return sum(found)


#: One trie per Python worker and vocabulary.
_LOADED: dict[str, Trie] = {}


def _rows(path: str):
    def rows(batches):
        if path not in _LOADED:
            _LOADED.clear()
            _LOADED[path] = Trie(*load_scores(path))
        trie = _LOADED[path]
        for batch in slices(batches):
            with no_cycles():
                counts = [trie.total(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs (doc_id, text).

    Pre-tokens are separated by Unicode white space. Of equal scores the one with fewer tokens
    counts. Null and blank texts have 0 tokens; an empty table gives an empty one. Repeated rows
    are counted each. A text is read whole however long it is. path names a piece model that
    every executor can read. Other columns are ignored.
    """
    small_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_rows(path), "doc_id long, n_tokens long")
