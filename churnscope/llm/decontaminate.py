"""Benchmark decontamination with a distributed positional inverted index of the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, compared by 64-bit hashes.

``build_index`` stores the postings of the training tokens as Parquet in the shared checkpoint folder: one row
per shard (about 4 MB of consecutive documents) with its documents, their word counts, the sorted terms and the
positions of every term. Shards are independent, so neither building nor searching shuffles anything and a
frequent word is only a longer list inside each shard. Searching a shard takes, for every phrase, the postings of
its rarest word there, shifts them by the word's offset, and intersects them with the lists of the other words
from rare to frequent. ``phrase_matches`` gives exact occurrences, ``proximity_matches`` ordered occurrences with
at most ``slop`` words between, ``contamination`` the per-document digest.

The benchmark is a stated query set: it is matched against all shards in blocks of at most ``BLOCK_WORDS`` words
(a longer single item is a block of its own), so what is broadcast has a fixed size; hits of several blocks are
gathered in a column of the shard rows.

Edge cases: null or empty text has no words (n_words 0, not contaminated); one result row per input row, repeated
rows included; null doc_ids stay null; items without words match nothing; items with a null item_id are left out;
rows of one item_id are one item; an empty benchmark gives zero hits; an empty table an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from . import kernels as K

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 2_000_000

INDEX_SCHEMA = ("doc_id array<long>, n_words array<long>, terms binary, counts binary, positions binary")
HIT = np.dtype([("start", "<i4"), ("length", "<i4"), ("item", "<i8")])


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words): the word hashes of every item that has an id and a word."""
    def task(batches):
        for batch in batches:
            ids, words = [], []
            for lo, hi in K.row_slices(batch.column(1)):
                w = K.Words(batch.column(1).slice(lo, hi - lo), K.ALNUM_WORD)
                h = w.hashes()
                for r in range(hi - lo):
                    if w.first[r + 1] > w.first[r]:
                        ids.append(batch.column(0)[lo + r].as_py())
                        words.append(h[w.first[r]:w.first[r + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())],
                                             names=["item_id", "words"])
    rows = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    return rows.mapInArrow(task, "item_id long, words binary")


def item_blocks(words: DataFrame, block_words: int = BLOCK_WORDS):
    """Lists of (item_id, hash array), each of about ``block_words`` words."""
    total = words.agg(F.sum(F.length("words"))).first()[0] or 0
    n = -(-int(total) // (8 * block_words)) or 1
    for b in range(n):
        part = words.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == b) if n > 1 else words
        yield [(r.item_id, np.frombuffer(bytes(r.words), np.uint64)) for r in part.collect()]


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Positional index of ``docs`` (doc_id, text), stored in the checkpoint folder.

    ``vocabulary`` (sorted word hashes, bounded by the caller) restricts the lists to words of the test set;
    None keeps every word.
    """
    known = None
    if vocabulary is not None:
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        known = docs.sparkSession.sparkContext.broadcast((vocabulary, sieve))

    def task(batches):
        K.tidy()
        for batch in batches:
            for lo, hi in K.row_slices(batch.column(1), shard_bytes):
                w = K.Words(batch.column(1).slice(lo, hi - lo), K.ALNUM_WORD)
                h = w.hashes()
                pos = np.arange(len(h), dtype=np.int32)
                if known is not None:
                    vocab, sieve = known.value
                    pos = np.flatnonzero(sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)])
                    h = h[pos]
                    at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
                    hit = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
                    h, pos = h[hit], pos[hit].astype(np.int32)
                order = np.argsort(h, kind="stable")
                terms, counts = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                     pa.array([np.diff(w.first)], pa.list_(pa.int64())), pa.array([terms.tobytes()], pa.binary()),
                     pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([pos[order].tobytes()], pa.binary())],
                    names=["doc_id", "n_words", "terms", "counts", "positions"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, INDEX_SCHEMA)
    return materialize(rows, name="positional-index")


class Shard:
    """One index row: term lists and the document bounds."""

    def __init__(self, n_words, terms, counts, positions):
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        self.key = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.positions
        self.bounds = np.concatenate([[0], np.cumsum(n_words)])

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Row of every hash in the term table, -1 where the shard lacks it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def from_rarest(self, phrases: np.ndarray):
        """Rows of ``phrases`` (hash matrix) found term by term, and their words' order from rare to frequent."""
        ids = self.term_ids(phrases)
        rows = np.flatnonzero((ids >= 0).all(axis=1))
        ids = ids[rows]
        return rows, ids, np.argsort(self.counts[ids], axis=1, kind="stable") if len(rows) else ids

    def phrases(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase row, start position) of every exact occurrence inside one document."""
        rows, ids, order = self.from_rarest(phrases)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = np.arange(len(rows))
        rare = ids[line, order[:, 0]]
        n = self.counts[rare]
        which = np.repeat(line, n)
        start = self.positions[K.csr_indices(self.first[rare], n)] - order[which, 0]
        for k in range(1, phrases.shape[1]):
            off = order[which, k]
            wanted = (ids[which, off] << 32) | (start + off)
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            ok = (self.key[at] == wanted) & (start >= 0)
            which, start = which[ok], start[ok]
        ok = (start >= 0) & (self.doc_of(start) == self.doc_of(start + phrases.shape[1] - 1))
        return rows[which[ok]], start[ok]

    def near(self, phrases: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase row, start, end) of ordered occurrences with at most ``slop`` foreign words, per rarest word."""
        rows, ids, order = self.from_rarest(phrases)
        none = np.zeros(0, np.int64)
        if not len(rows):
            return none, none, none
        rare = ids[np.arange(len(rows)), order[:, 0]]
        n = self.counts[rare]
        which = np.repeat(np.arange(len(rows)), n)
        anchor = self.positions[K.csr_indices(self.first[rare], n)]
        offset = order[which, 0]
        left, right, ok = anchor.copy(), anchor.copy(), np.ones(len(anchor), bool)
        size = phrases.shape[1]
        for step in range(1, size):
            for side in (-1, 1):
                at = offset + side * step
                live = np.flatnonzero(ok & (at >= 0) & (at < size))
                term = ids[which[live], at[live]]
                here = (right if side > 0 else left)[live]
                if side > 0:
                    i = np.searchsorted(self.key, (term << 32) | here, side="right")
                else:
                    i = np.searchsorted(self.key, (term << 32) | here, side="left") - 1
                good = (i >= 0) & (i < len(self.key))
                found = self.key[np.clip(i, 0, len(self.key) - 1)]
                good &= (found >> 32) == term
                (right if side > 0 else left)[live] = found & 0xFFFFFFFF
                ok[live[~good]] = False
        ok &= right - left + 1 <= size + slop
        ok[ok] = self.doc_of(left[ok]) == self.doc_of(right[ok])
        out = np.unique(np.stack([rows[which[ok]], left[ok], right[ok] + 1]), axis=1) if ok.any() else np.zeros((3, 0), int)
        return out[0], out[1], out[2]


def phrase_tables(items, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(item ids, hash matrix) per phrase length: windows of ``window`` words, short items whole."""
    by_length: dict[int, tuple[list, list]] = {}
    for item, words in items:
        size = min(window, len(words))
        m = np.lib.stride_tricks.sliding_window_view(words, size)
        ids, parts = by_length.setdefault(size, ([], []))
        ids.append(np.full(len(m), item, np.int64))
        parts.append(m)
    return [(np.concatenate(i), np.concatenate(p)) for _, (i, p) in sorted(by_length.items())]


def _shard_rows(batch: pa.RecordBatch):
    for r in range(batch.num_rows):
        n_words = batch.column(1)[r].values.to_numpy()
        yield r, Shard(n_words, *(batch.column(c)[r].as_py() for c in (2, 3, 4)))


def with_hits(index: DataFrame, items, window: int = WINDOW) -> DataFrame:
    """Index rows with the exact occurrences of one block of items added to column ``hits``."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def task(batches):
        tables = phrase_tables(shared.value, window)
        for batch in batches:
            out = []
            for r, shard in _shard_rows(batch):
                parts = [np.frombuffer(batch.column(5)[r].as_py(), HIT)]
                for ids, phrases in tables:
                    row, start = shard.phrases(phrases)
                    hit = np.zeros(len(row), HIT)
                    hit["start"], hit["length"], hit["item"] = start, phrases.shape[1], ids[row]
                    parts.append(hit)
                out.append(np.concatenate(parts).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())],
                                             names=[*INDEX_NAMES, "hits"])

    rows = index if "hits" in index.columns else index.withColumn("hits", F.lit(b""))
    return rows.select(*INDEX_NAMES, "hits").mapInArrow(task, INDEX_SCHEMA + ", hits binary")


INDEX_NAMES = ["doc_id", "n_words", "terms", "counts", "positions"]


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, length): every exact occurrence of an item window; positions count words."""
    rows = index
    for block in item_blocks(item_words(items)):
        rows = with_hits(rows, block, window)

    def task(batches):
        for batch in batches:
            for r, shard in _shard_rows(batch):
                hit = np.frombuffer(batch.column(5)[r].as_py(), HIT)
                doc = shard.doc_of(hit["start"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[r].values.take(pa.array(doc)), pa.array(hit["item"]),
                     pa.array(hit["start"] - shard.bounds[doc]), pa.array(hit["length"].astype(np.int64))],
                    names=["doc_id", "item_id", "start", "length"])

    return rows.mapInArrow(task, "doc_id long, item_id long, start long, length long")


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, end): item windows whose words occur in order with at most ``slop`` words between."""
    out = None
    for block in item_blocks(item_words(items)):
        shared = index.sparkSession.sparkContext.broadcast(block)

        def task(batches, shared=shared):
            tables = phrase_tables(shared.value, window)
            for batch in batches:
                for r, shard in _shard_rows(batch):
                    for ids, phrases in tables:
                        row, start, end = shard.near(phrases, slop)
                        doc = shard.doc_of(start)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0)[r].values.take(pa.array(doc)), pa.array(ids[row]),
                             pa.array(start - shard.bounds[doc]), pa.array(end - shard.bounds[doc])],
                            names=["doc_id", "item_id", "start", "end"])

        part = index.select(*INDEX_NAMES).mapInArrow(task, "doc_id long, item_id long, start long, end long")
        out = part if out is None else out.union(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per input row.

    A document word is hit when it lies in an occurrence of an item window; a document is contaminated when a
    twentieth of its words or more is hit.
    """
    words = materialize(item_words(benchmark), name="item-words")
    blocks = item_blocks(words, block_words)
    first = next(blocks)
    second = next(blocks, None)
    vocabulary = np.unique(np.concatenate([w for _, w in first])) if first and second is None else None
    if not first:
        vocabulary = np.zeros(0, np.uint64)
    rows = with_hits(build_index(docs, vocabulary), first, window)
    while second is not None:
        rows = with_hits(rows, second, window)
        second = next(blocks, None)

    def task(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                n_words = batch.column(1)[r].values.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(n_words)])
                hit = np.frombuffer(batch.column(2)[r].as_py(), HIT)
                step = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(step, hit["start"], 1)
                np.add.at(step, hit["start"] + hit["length"], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
                n_hit = covered[bounds[1:]] - covered[bounds[:-1]]
                doc = np.searchsorted(bounds, hit["start"], side="right") - 1
                found = np.unique(np.stack([doc, hit["item"]]), axis=1) if len(hit) else np.zeros((2, 0), int)
                first_item = np.searchsorted(found[0], np.arange(len(n_words) + 1))
                digest, n_items = [], np.diff(first_item)
                empty = hashlib.sha256(b"").hexdigest()
                for d in range(len(n_words)):
                    ids = sorted(map(str, found[1][first_item[d]:first_item[d + 1]].tolist()))
                    digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else empty)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[r].values, pa.array(n_words), pa.array(n_hit), pa.array(n_items.astype(np.int64)),
                     pa.array(digest, pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.select("doc_id", "n_words", "hits").mapInArrow(
        task, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
