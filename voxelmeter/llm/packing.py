"""Hierarchical multi-length packing: documents go to context-size tiers, long windows are filled up from shorter tiers."""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.llm.arrays import ALNUM, LOWER, NOT_SPACE, byte_chunks, thrifty, word_bounds, word_hashes
from voxelmeter.llm.io import checkpointed

TIERS = (2048, 1024, 512, 256, 128)
END_ID = 1
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 19
CACHE_WORDS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_length long"
_NAMES = [*(c.strip().split(" ")[0] for c in PIECES.split(",")), "part", "place"]


_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ASCII_ALNUM = ALNUM & (np.arange(256) < 0x80)


class WordTokenizer:
    """Ids of whole texts from the ids of their units, which the tokenizer never joins.

    A unit is a stretch without ASCII white space, or, where it ends in marks behind a Latin letter or digit, its body
    and its marks. Case of ASCII and Latin-1 letters is folded first, as the tokenizer does. Units are known by their 64-bit hash and length;
    known ones are forgotten when there are more than CACHE_WORDS, so memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # The same merges without the patterns: for units of lower-case Latin letters alone, which the patterns leave whole.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Slot 0 is the end id."""
        self.known: dict[int, int] = {}
        self.flat, self.at, self.size = np.array([END_ID], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encode(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units, and their numbers by unit."""
        if plain:
            texts = [" ".join(words[i:i + 100]) for i in range(0, len(words), 100)]
            ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False))])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 4000):
            part = words[lo:lo + 4000]
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(encoded.ids, np.uint32))
            sizes.append(np.diff(np.searchsorted(np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded)), starts)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, hashes: list[int], words: list[bytes], plain: int) -> None:
        """Keeps the ids of new units, the first ``plain`` of which are lower-case Latin letters alone."""
        ids1, size1 = self._encode([w.decode() for w in words[:plain]], True)
        ids2, size2 = self._encode([w.decode() for w in words[plain:]], False)
        self.known.update(zip(hashes, range(len(self.size), len(self.size) + len(hashes)), strict=True))
        self.flat, self.size = np.concatenate([self.flat, ids1, ids2]), np.concatenate([self.size, size1, size2])
        self.at = np.cumsum(self.size) - self.size

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        data = LOWER[data]
        behind = np.zeros(len(data), bool)  # the second byte of a letter from U+00C0 to U+00FF
        behind[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        data[behind & (data < 0x9F)] += 0x20
        latin = behind | (data >= 0x61) & (data <= 0x7A)
        latin[:-1] |= behind[1:]
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~latin, out=odd[1:])
        starts, ends, _ = word_bounds(data, offsets, NOT_SPACE)
        if len(starts):
            body = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))[ends - 1] + 1
            last = data[np.maximum(body, 1) - 1]
            cut = (body > starts) & (body < ends) & (_ASCII_ALNUM[last] | behind[np.maximum(body, 1) - 1])
            more = np.flatnonzero(cut)
            starts, ends = np.insert(starts, more + 1, body[more]), np.insert(ends, more, body[more])
        hashes, back = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self._forget()
        keys = hashes.tolist()
        slots = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        if (fresh := np.flatnonzero(slots < 0)).size:
            example = np.zeros(len(hashes), np.int64)
            example[back] = np.arange(len(back))
            mixed = odd[starts[example[fresh]]] != odd[ends[example[fresh]]]
            fresh = np.concatenate([fresh[~mixed], fresh[mixed]])
            raw = data.tobytes()
            words = [raw[starts[i]:ends[i]] for i in example[fresh]]
            slots[fresh] = len(self.size) + np.arange(len(fresh))
            self._learn(hashes[fresh].tolist(), words, len(fresh) - int(mixed.sum()))
        # One slot for the end id behind each text's units.
        slot = np.insert(slots[back], np.searchsorted(starts, offsets[1:]), 0)
        sizes = self.size[slot]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[slot] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
        return np.split(ids, ends[np.flatnonzero(slot == 0)][:-1])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, so that its known units serve the next task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Fills sequences with pieces of documents. A piece is (length, row of the document, start)."""

    def __init__(self, tiers: tuple[int, ...], first_id: int):
        self.tiers, self.next = tuple(sorted(tiers)), first_id
        self.in_tier = dict.fromkeys(self.tiers, 0)
        self.todo: list[tuple[int, int, int]] = []

    def route(self, row: int, length: int) -> list[tuple]:
        """Whole windows of the longest tier at once; the rest waits in the shortest tier that holds it."""
        top, out = self.tiers[-1], []
        for start in range(0, length - top + 1, top):
            out += self._sequence([(top, row, start)])
        if length % top:
            self.todo.append((length % top, row, length - length % top))
        return out

    def _sequence(self, pieces: list[tuple[int, int, int]]) -> list[tuple]:
        total = sum(p[0] for p in pieces)
        tier = self.tiers[bisect.bisect_left(self.tiers, total)]
        out, at = [], 0
        for length, row, start in pieces:
            out.append((row, start, length, self.next, at, tier, total, self.in_tier[tier]))
            at += length
        self.next, self.in_tier[tier] = self.next + 1, self.in_tier[tier] + 1
        return out

    def pack(self) -> list[tuple]:
        """Tier after tier, the longest first: a window of the tier's size for each of its pieces, its gap filled from shorter tiers.

        The gap takes the longest piece that fits it whole, again and again; where none does, the shortest piece left is cut. What
        cannot fill its window waits for more.
        """
        out = []
        self.todo.sort()
        while self.todo:
            pieces = [self.todo.pop()]
            room = self.tiers[bisect.bisect_left(self.tiers, pieces[0][0])] - pieces[0][0]
            while room and self.todo:
                at = bisect.bisect_right(self.todo, (room, 1 << 62)) - 1
                if at >= 0:
                    pieces.append(self.todo.pop(at))
                else:
                    length, row, start = self.todo.pop(0)
                    pieces.append((room, row, start))
                    bisect.insort(self.todo, (length - room, row, start + room))
                room -= pieces[-1][0]
            if room:
                self.todo = sorted(pieces)
                break
            out += self._sequence(pieces)
        return out

    def close(self) -> list[tuple]:
        """What is left as full sequences of shorter tiers; the end, under the shortest tier, is one sequence to be padded."""
        out, left = [], self.todo
        self.todo = []
        for tier in reversed(self.tiers):
            while sum(p[0] for p in left) >= tier:
                own, room = [], tier
                while room:
                    length, row, start = left.pop()
                    own.append((min(room, length), row, start))
                    if length > room:
                        left.append((length - room, row, start + room))
                    room -= own[-1][0]
                out += self._sequence(own)
        return out + (self._sequence(left) if left else [])


_OUT_ROWS = 2000


def _packed(documents: DataFrame, tokenizer_path: str, tiers: tuple[int, ...], pool_tokens: int) -> DataFrame:
    """The pieces with ``part``, the partition that packed them, and ``place``, the number of their sequence within part and tier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer, packer = word_tokenizer(tokenizer_path), Packer(tiers, part << 40)
        held: dict[int, tuple] = {}  # documents with a piece that waits: id and tokens
        fresh, tokens, row = [], 0, 0

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows), _OUT_ROWS):
                cols = list(zip(*rows[lo:lo + _OUT_ROWS], strict=True))
                own = [held[r] for r in cols[0]]
                crc = [zlib.crc32(ids[start:start + length].tobytes()) for (_, ids), start, length in zip(own, cols[1], cols[2], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in own], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([len(ids) for _, ids in own], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32()),
                     pa.array(cols[6], pa.int64()), pa.array([part] * len(own), pa.int32()), pa.array(cols[7], pa.int64())], _NAMES)
            for r in held.keys() - {p[1] for p in packer.todo}:
                del held[r]

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in byte_chunks(batch.column("text")):
                for name, ids in zip(names[lo:hi], tokenizer.chunk(data, offsets), strict=True):
                    held[row] = (name, ids.copy())
                    fresh += packer.route(row, len(ids))
                    tokens, row = tokens + len(ids), row + 1
                if tokens >= pool_tokens:
                    yield from out(fresh + packer.pack())
                    fresh, tokens = [], 0
        yield from out(fresh + packer.pack() + packer.close())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(thrifty(run), f"{PIECES}, part int, place long")


def pack(documents: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    Whole windows of the longest tier are sequences of their own. What is left of a document goes to the shortest tier that holds it, and each tier is
    packed into sequences of its own size: one of its pieces, and the gap behind it filled from shorter tiers. ``tier`` is that size, ``sequence_length``
    the tokens in the sequence. They are equal but for at most one sequence of each partition, the end of its last pool.

    ``step_group`` numbers groups of sequences of one tier over all partitions, from the partitions' totals. The groups of a tier differ by one
    sequence at most, and there are as many as make them nearest to ``step_tokens`` tokens, so steps of all tiers weigh alike; a tier with
    fewer tokens than that is one lighter group.

    Every row of ``documents`` is a document of its own, whether or not its doc_id repeats or is null; a null or empty
    text is one end id. A text may be as long as a row may. Each partition packs its own rows, a pool of about ``pool_tokens`` at a time, so no text is
    shuffled, memory doesn't grow with the input, and a lost task gives the same sequences again.
    """
    pieces = checkpointed(_packed(documents, tokenizer_path, tiers, pool_tokens))
    counts = pieces.groupBy("part", "tier").agg((F.max("place") + 1).alias("own"))
    before = W.partitionBy("tier").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # A row for each partition and tier; Spark broadcasts them only while they are small.
    offsets = counts.select("part", "tier", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("front"), F.sum("own").over(W.partitionBy("tier")).alias("all"))
    groups = F.greatest(F.round(F.col("all") * F.col("tier") / step_tokens).cast("long"), F.lit(1))
    joined = pieces.join(offsets, ["part", "tier"])
    return joined.select(*_NAMES[:-2], F.floor((F.col("front") + F.col("place")) * groups / F.col("all")).cast("int").alias("step_group"))
