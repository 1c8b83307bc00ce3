"""Ranked lexical search: a document FP-tree, searched depth first by branch and bound for every item."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.llm.arrays import ALNUM, LOWER, byte_chunks, hash_text_words, word_bounds, word_hashes
from voxelmeter.llm.io import checkpointed, release

TOP = 50
MAX_ITEM_BYTES = 16 << 20
TREE_POSTINGS = 1 << 20
LEAF_DOCS = 64
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_NO_ID = (1 << 63) - 1


@dataclass
class Items:
    """Items of one slice, their terms as places in ``hashes`` (sorted), flat, with the first of each item and one more."""

    names: list
    hashes: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    first: np.ndarray


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, words): the distinct terms of each item, of all its rows together."""
    folded = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = items.where("item_id is not null and text is not null").select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))).alias("word"))
    return one.groupBy("item_id").agg(F.sort_array(F.collect_set("word")).alias("words"))


def _slices(items: DataFrame, max_bytes: int) -> Iterator[Items]:
    """The items in slices by hash of their id, each of about ``max_bytes`` of words, as one task and one broadcast may hold them."""
    terms = checkpointed(_item_terms(items))
    size = terms.agg(F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words")), F.lit(0))).first()[0]
    n = max(1, -(-size // max_bytes))
    for k in range(n):
        rows = sorted(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect(), key=lambda r: r["item_id"])
        if rows:
            words = sorted({w for r in rows for w in r["words"]})
            raw = [w.encode() for w in words]
            hashes = hash_text_words(raw)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = dict(zip(words, place.tolist(), strict=True))
            yield Items([r["item_id"] for r in rows], hashes[order], np.array([len(w) for w in raw], np.int64)[order],
                        np.array([at[w] for r in rows for w in r["words"]], np.int64), np.cumsum([0] + [len(r["words"]) for r in rows]))
    release(terms)


def restricted(documents: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tf) per row: the number of its terms, and those that items hold, with their occurrences."""
    hashes, lengths = items.hashes, items.lengths
    bits = np.zeros(1 << 20, bool)
    bits[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column("text")):
                data = LOWER[data]
                starts, ends, first = word_bounds(data, offsets, ALNUM)
                found = word_hashes(data, starts, ends)
                maybe = np.flatnonzero(bits[(found >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(hashes, found[maybe]), len(hashes) - 1)
                same = (hashes[place] == found[maybe]) & (lengths[place] == (ends - starts)[maybe])
                row = np.searchsorted(first, maybe[same], "right") - 1
                key, tf = np.unique(row * len(hashes) + place[same], return_counts=True)
                cut = np.searchsorted(key // len(hashes), np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array((key % len(hashes)).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tf"])
    return documents.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Tree:
    """An FP-tree: documents in order of their term vectors, most frequent terms first, so that those who share a path adjoin.

    A node is a stretch [lo, hi) of documents with its children, the largest tf of each term below it, and the least m.
    Paths without a fork are one node, and small neighbours below one node share a leaf.
    """

    def __init__(self, ptr: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, leaf_docs: int):
        sizes = np.diff(ptr)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.lexsort((rank, doc))
        raw = rank[inner].astype(">u4").tobytes()
        ends = (4 * ptr).tolist()
        paths = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.m, self.ids = m[order], ids[order]
        sizes = sizes[order]
        self.ptr = np.append(0, np.cumsum(sizes))
        take = inner[np.repeat(ptr[order] - self.ptr[:-1], sizes) + np.arange(self.ptr[-1])]
        self.rank, self.tf, self.sizes = rank[take], tf[take], sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.nodes: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow(leaf_docs)
        self._bounds()

    def _node(self, lo: int, hi: int) -> int:
        self.nodes.append((lo, hi))
        self.children.append([])
        return len(self.nodes) - 1

    def _grow(self, leaf_docs: int) -> None:
        todo = [(self._node(0, len(self.sizes)), 0)]
        while todo:
            node, depth = todo.pop()
            lo, hi = self.nodes[node]
            if hi - lo <= leaf_docs:
                continue
            one, two = (self.rank[self.ptr[i] + depth:self.ptr[i + 1]] for i in (lo, hi - 1))
            common = min(len(one), len(two))
            unequal = np.flatnonzero(one[:common] != two[:common])
            depth += int(unequal[0]) if len(unequal) else common
            if len(one) == len(two) and not len(unequal):
                continue  # equal vectors, however many
            has = self.sizes[lo:hi] > depth
            term = np.full(hi - lo, -1)
            term[has] = self.rank[self.ptr[lo:hi][has] + depth]
            edges = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), hi - lo)
            at = 0
            while at < len(edges) - 1:
                to = max(int(np.searchsorted(edges, edges[at] + leaf_docs, "right")) - 1, at + 1)
                child = self._node(lo + int(edges[at]), lo + int(edges[to]))
                self.children[node].append(child)
                if to == at + 1 and term[edges[at]] >= 0:
                    todo.append((child, depth + 1))
                at = to

    def _bounds(self) -> None:
        self.terms, self.most, self.least = [None] * len(self.nodes), [None] * len(self.nodes), [0] * len(self.nodes)
        for v in range(len(self.nodes) - 1, -1, -1):  # children follow their parents
            lo, hi = self.nodes[v]
            if self.children[v]:
                term = np.concatenate([self.terms[c] for c in self.children[v]])
                tf = np.concatenate([self.most[c] for c in self.children[v]])
            else:
                term, tf = self.rank[self.ptr[lo]:self.ptr[hi]], self.tf[self.ptr[lo]:self.ptr[hi]]
            order = np.argsort(term, kind="stable")
            term, tf = term[order], tf[order]
            at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            self.terms[v], self.most[v] = term[at], np.maximum.reduceat(tf, at) if len(at) else tf
            self.least[v] = int(self.m[lo:hi].min())


def _worth(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Search:
    """The best ``top`` documents of each item so far: scores and ids, best first."""

    def __init__(self, weights: np.ndarray, terms: np.ndarray, first: np.ndarray, top: int):
        self.weights, self.terms, self.first, self.top = weights, terms, first, top
        self.score, self.ids = np.zeros((len(first) - 1, top), np.int64), np.full((len(first) - 1, top), _NO_ID)
        self.visited = self.scored = 0

    def _flat(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.first[alive + 1] - self.first[alive]
        front = np.cumsum(size) - size
        return self.terms[np.repeat(self.first[alive] - front, size) + np.arange(size.sum())], front

    def over(self, tree: Tree) -> None:
        """Depth first: an item leaves a subtree whose bound, of its tf maxima and least m, is under the item's last place."""
        worth = np.zeros(len(self.weights) + 1, np.int64)
        column = np.zeros(len(self.weights), np.int64)
        todo = [(0, np.flatnonzero(np.diff(self.first) > 0))]
        while todo:
            node, alive = todo.pop()
            self.visited += 1
            terms = tree.terms[node]
            worth[terms] = self.weights[terms] * _worth(tree.most[node], tree.least[node])
            flat, front = self._flat(alive)
            bound = np.add.reduceat(worth[flat], front) if len(alive) else front
            worth[terms] = 0
            alive = alive[bound >= np.maximum(self.score[alive, -1], 1)]
            if not len(alive):
                continue
            if tree.children[node]:
                todo += [(c, alive) for c in reversed(tree.children[node])]
                continue
            lo, hi = tree.nodes[node]
            flat, front = self._flat(alive)
            column[terms] = np.arange(1, len(terms) + 1)
            where = column[flat]
            for a in range(lo, hi, LEAF_DOCS):
                b = min(hi, a + LEAF_DOCS)
                own = slice(tree.ptr[a], tree.ptr[b])
                dense = np.zeros((b - a, len(terms) + 1), np.int64)
                dense[tree.doc[own] - a, column[tree.rank[own]]] = self.weights[tree.rank[own]] * _worth(tree.tf[own], tree.m[tree.doc[own]])
                self.scored += len(alive) * (b - a)
                self._keep(alive, np.add.reduceat(dense[:, where], front, axis=1), tree.ids[a:b])
            column[terms] = 0

    def _keep(self, alive: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= np.maximum(self.score[alive, -1], 1)
        for j in np.flatnonzero(fit.any(axis=0)).tolist():
            item, rows = alive[j], np.flatnonzero(fit[:, j])
            score, who = np.concatenate([self.score[item], scores[rows, j]]), np.concatenate([self.ids[item], ids[rows]])
            best = np.lexsort((who, -score))[:self.top]
            self.score[item], self.ids[item] = score[best], who[best]


def _ranked(vectors: DataFrame, items: Items, kind: str, top: int, tree_postings: int, leaf_docs: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each item in each task."""
    totals = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 1
    df = np.zeros(len(items.hashes), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more than the slice's terms
        df[r["term"]] = r["count"]
    order = np.lexsort((items.hashes, -df))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[order].tolist()], np.int64)
    terms, first, names = rank[items.terms], items.first, items.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, postings = Search(weights, terms, first, top), [], 0

        def grown() -> None:
            sizes, term, tf, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            search.over(Tree(np.append(0, np.cumsum(sizes)), rank[term], tf, m, ids, leaf_docs))
            held.clear()
        for batch in batches:
            lists = batch.column("terms")
            held.append((np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64), batch.column("tf").flatten().to_numpy().astype(np.int64),
                         batch.column("n").to_numpy(), batch.column("doc_id").fill_null(_NO_ID).to_numpy()))
            postings += len(held[-1][1])
            if postings >= tree_postings:
                grown()
                postings = 0
        if held:
            grown()
        item, place = np.nonzero(search.score > 0)
        ids = search.ids[item, place]
        for lo in range(0, len(item), 10_000):
            part = slice(lo, lo + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in item[part]]), pa.array(ids[part], mask=ids[part] == _NO_ID), pa.array(search.score[item[part], place[part]])],
                                             ["item_id", "doc_id", "score"])
    return vectors.where(F.size("terms") > 0).mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, max_item_bytes: int = MAX_ITEM_BYTES, tree_postings: int = TREE_POSTINGS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with score above 0, equal scores by doc_id.

    Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that
    have a term, L terms in all, n in a document and df holders, a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document has
    m = 50 + (50 n N) div L, and its score is the sum of w ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.

    One pass over the texts keeps each document's vector of the terms that items hold; N, L and df are counted from all vectors.
    Each task then grows FP-trees of about ``tree_postings`` vector entries at a time and searches them for all items, with the places
    won so far as thresholds, and gives its best ``top`` an item. Items beyond ``max_item_bytes`` of words are cut into slices, which are
    searched one after the other, so neither a broadcast nor a task grows with them.

    A null or empty text has no term: such an item has no row, such a document isn't counted. Rows that repeat an item_id are one item, its
    terms together; an item without id is left out. Every document row is ranked for itself, whether or not its doc_id repeats;
    rows without doc_id count and rank like others, behind those of equal score. Words are told by a 64-bit hash and their length. A
    text may be as long as a row may; its vector has no more entries than items have terms.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind, found = items.schema["item_id"].dataType.simpleString(), None
    for own in _slices(items, max_item_bytes):
        vectors = checkpointed(restricted(rows, own))
        best = checkpointed(_ranked(vectors, own, kind, top, tree_postings, leaf_docs))
        release(vectors)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
