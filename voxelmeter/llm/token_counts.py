"""Greedy word-piece counts by a linear longest-match automaton: a vocabulary trie with failure links and popped counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 400_000
START = "▁"


class LongestMatch:
    """Number of pieces that greedy longest match cuts a word into, in time linear in the word.

    ``pieces`` that begin with the word mark begin a word, others go on inside one. Where none fits, the mark alone is a
    piece at a word's start, and inside a word the next character counts as its UTF-8 bytes (byte fallback).

    Node v of the trie spells s(v). When no edge leads on from v, the longest pieces at the front of s(v) are popped:
    ``popped[v]`` is their precomputed number, and ``fail[v]`` the node that spells the rest. No piece is ever built.
    """

    WORD, INNER = 0, 1  # the two roots: behind the mark, and inside a word

    def __init__(self, pieces: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        is_piece = [False, False]
        for p in pieces:
            at, text = (self.WORD, p[1:]) if p.startswith(START) else (self.INNER, p)
            for ch in text:
                if ch not in self.edges[at]:
                    self.edges[at][ch] = len(self.edges)
                    self.edges.append({})
                    is_piece.append(False)
                at = self.edges[at][ch]
            is_piece[at] = is_piece[at] or at > 1
        self.fail, self.popped = [self.INNER] * len(self.edges), [0] * len(self.edges)
        self.popped[self.WORD] = 1  # the mark alone
        queue = deque((v, root, ch) for root in (0, 1) for ch, v in self.edges[root].items())
        while queue:
            v, parent, ch = queue.popleft()
            if is_piece[v]:
                self.popped[v] = 1
            elif parent == self.INNER:
                self.popped[v] = len(ch.encode("utf-8", "surrogatepass"))
            else:
                self.fail[v], self.popped[v] = self._step(self.fail[parent], self.popped[parent], ch)
            queue.extend((w, v, c) for c, w in self.edges[v].items())

    def _step(self, at: int, total: int, ch: str) -> tuple[int, int]:
        while ch not in self.edges[at]:
            if at == self.INNER:
                return at, total + len(ch.encode("utf-8", "surrogatepass"))
            total += self.popped[at]
            at = self.fail[at]
        return self.edges[at][ch], total

    def count(self, word: str) -> int:
        """Pieces of one word without white space; 0 for an empty one."""
        at, total = self.WORD, 0
        for ch in word:
            at, total = self._step(at, total, ch)
        while at > self.INNER:
            total += self.popped[at]
            at = self.fail[at]
        return total


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word_tokens) for each row; words are cut at ASCII white space.

    A null or empty text has 0 of all. Rows that repeat a doc_id, or have none, are counted each for itself. Counts of
    words are kept by each task up to a bound, so that the automaton runs once for each distinct word of a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = LongestMatch(sentencepiece_vocabulary(vocabulary_path)), {}
        for batch in batches:
            n_words, n_tokens, longest = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                counts = []
                for w in words:
                    c = known.get(w)
                    if c is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        c = known[w] = automaton.count(w.decode())
                    counts.append(c)
                n_words.append(len(words))
                n_tokens.append(sum(counts))
                longest.append(max(counts, default=0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, longest))],
                                             ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")
