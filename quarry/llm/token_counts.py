"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenising of a word takes the longest vocabulary piece
that starts the rest of the word, again and again.  The automaton does it in
one pass over the characters: a trie over the pieces, and for every node a
failure link to the node reached after the greedy pieces of the node's
string are popped, with the *number* of pieces popped on the way.  Counting
follows edges and adds up the popped numbers; no piece is ever built.

The vocabulary is a sentencepiece model file (path is a parameter): a piece
that starts with the word mark can only start a word, others continue one.
A character outside the vocabulary counts one token per UTF-8 byte (the
model's byte pieces).  Words are runs of non-space characters.

Edge cases: a null or empty text has 0 words and 0 tokens; a text of any
length is counted whole; rows are independent, so ties, repeated rows and
other columns do not matter.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import find_words, prepare_python

WORD_MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
# Words whose count a worker remembers.
CACHE_WORDS = 400_000


def load_pieces(path: str) -> list[str]:
    """Text pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Automaton:
    """Node 0 is the root; ``fail[v]`` and ``pops[v]`` are set for all others."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[bool] = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                v = self.next[v].setdefault(c, len(self.next))
                if v == len(self.next):
                    self.next.append({})
                    ends.append(False)
            ends[v] = ends[v] or v > 0
        self.fail = [0] * len(self.next)
        self.pops = [0] * len(self.next)
        todo = deque((0, c, v) for c, v in self.next[0].items())
        while todo:                                   # breadth first: a parent's link is known before its children's
            u, c, v = todo.popleft()
            if ends[v]:
                self.pops[v] = 1                      # the node's whole string is one piece
            elif u == 0:
                self.pops[v] = len(c.encode("utf-8", "surrogatepass"))
            else:
                self.fail[v], popped = self.step(self.fail[u], c)
                self.pops[v] = self.pops[u] + popped
            todo.extend((v, d, w) for d, w in self.next[v].items())

    def step(self, v: int, c: str) -> tuple[int, int]:
        """Node after reading ``c`` at ``v``, and the pieces popped."""
        popped = 0
        while True:
            w = self.next[v].get(c)
            if w is not None:
                return w, popped
            if v == 0:
                return 0, popped + len(c.encode("utf-8", "surrogatepass"))
            popped += self.pops[v]
            v = self.fail[v]

    def count(self, text: str) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        v = n = 0
        for c in text:
            w = nxt[v].get(c)
            if w is None:
                v, popped = self.step(v, c)
                n += popped
            else:
                v = w
        while v:
            n += pops[v]
            v = fail[v]
        return n


class WordCounts(dict):
    """Word -> number of pieces; filled on demand, emptied when full."""

    def __init__(self, automaton: Automaton, limit: int = CACHE_WORDS):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[word] = self.automaton.count(WORD_MARK + word)
        return n


_COUNTS: dict[str, WordCounts] = {}           # per worker process and vocabulary


def _counts(path: str) -> WordCounts:
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(Automaton(load_pieces(path)))
    return _COUNTS[path]


def token_count(text: Column, path: str) -> Column:
    """struct<n_words, n_tokens> of a text."""

    @F.arrow_udf("n_words bigint, n_tokens bigint")
    def count(texts: pa.Array) -> pa.Array:
        of = _counts(path).__getitem__
        words, tokens = [], []
        for t in texts.to_pylist():
            w = find_words(t or "")
            words.append(len(w))
            tokens.append(sum(map(of, w)))
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["n_words", "n_tokens"])

    return count(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    prepare_python(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), token_count(F.col(text), path).alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
