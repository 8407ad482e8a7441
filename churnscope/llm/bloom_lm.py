"""Language-model scoring from a log-frequency Bloom filter.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token per text; n-grams are known by hashes.

Counting. Texts are hashed slice by slice; each slice adds up its own n-grams and sends one row per segment (hash range)
with the distinct hashes and counts, so a frequent word is one entry per slice. A segment task merges these lists:
exact unigram counts, and for bigrams seen at least ``MIN_COUNT`` times the quantised count
``1 + floor(log(c) / log(QUANT))``. The number of segments follows the size of the texts, so a segment stays small.

Filter. An n-gram of level q is entered q times, as (n-gram, 1) .. (n-gram, q). A segment belongs to one region of the
filter (many segments share one when there are more than the filter has regions). The filter has ``FILTER_BITS`` bits at
least and grows with the counted entries (``filter_bits``), so at most half of its bits are set; no level is left out.

Scoring. A count is read by probing levels 1, 2, ... until a probe fails. The probability of a token is the bigram
estimate smoothed by the unigram estimate, ``(c(v w) + KAPPA * p(w)) / (c(v) + KAPPA)`` with
``p(w) = (c(w) + 1) / (N + V + 1)``; the score is the sum of the log10 probabilities of a text. A filter of up to
``BROADCAST_BITS`` bits is broadcast. A larger one stays on the executors: the texts are written once in compressed blocks,
every block asks for the levels of its distinct words and pairs, and each group of ``GROUP_REGIONS`` regions fills its part
of the filter, probes all that is asked of it at once and answers the blocks. Both ways give equal scores.

Base score. ``sum log10((c + 1) / (N + V + 1))`` needs exact counts. With a broadcast filter, words with at least
N / HEAVY_WORDS occurrences (no more than HEAVY_WORDS exist, whatever the corpus) are broadcast; occurrences of all other
words meet their exact counts in their segment, and the partial sums return to the block of their document. Without, the
answer for a word holds its exact count.

Growth. Rows between blocks (or slices) and segments number their product, which grows with the square of the input. All of
a task's rows are therefore built, probed and added up in whole arrays: a row costs its transport, not a Python call.

Edge cases: null and empty text are one end token; repeated rows are scored (and counted) as often as they occur; a
null doc_id belongs to the training part; an empty table gives an empty result; with no training document N = V = 0 and
all counts are 0; texts of any length are processed whole; other columns are ignored.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from . import kernels as K

FILTER_BITS = 1 << 28
BROADCAST_BITS = 1 << 28
LEAST_REGION = 1 << 12
PROBES = 4
QUANT = 1.5
MIN_COUNT = 2
KAPPA = 1000.0
HEAVY_WORDS = 1 << 18
SLICE_BYTES = 4 << 20
SEGMENT_BYTES = 4 << 20
GROUP_REGIONS = 4       # regions whose n-grams are asked for together, if that leaves LEAST_GROUPS groups
LEAST_GROUPS = 64
PROBE_KEYS = 1 << 20    # n-grams probed at a time
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

END = np.uint64(0xE5D0E5D0E5D0E5D1)    # hash of the end token
BEGIN = np.uint64(0xB0B0B0B0B0B0B0B1)  # context of the first token
MAX_LEVEL = 100

BLOCK_SCHEMA = ("kind int, block long, seg int, doc_id array<long>, held array<boolean>, n_tokens array<long>, "
                "known array<long>, log_sum array<double>, score array<double>, hash binary, doc binary")
TEXT_SCHEMA = "block long, doc_id array<long>, held array<boolean>, length array<long>, text binary"
SEGMENT_SCHEMA = ("seg int, tokens long, words long, uni_hash binary, uni_count binary, bi_hash binary, "
                  "bi_level binary, uni_levels array<long>, bi_levels array<long>")


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(QUANT) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """Count stood for by each level: the geometric middle of its range; 0 for level 0."""
    q = np.arange(MAX_LEVEL + 1, dtype=np.float64)
    lowest = np.ceil(QUANT ** (q - 1) - 1e-9)
    highest = np.maximum(lowest, np.ceil(QUANT**q - 1e-9) - 1)
    out = np.sqrt(lowest * highest)
    out[0] = 0
    return out


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix64(before * K.SHINGLE_KEYS[10] + word * K.SHINGLE_KEYS[11])


class Tokens:
    """Token hashes of a slice of rows with end tokens: ``h``, ``before`` (context), ``first`` (n + 1 offsets)."""

    def __init__(self, column: pa.Array):
        w = K.Words(column, K.SPACE_WORD)
        n = len(w.first) - 1
        at = w.first + np.arange(n + 1)
        self.first = at
        self.h = np.full(at[-1], END, np.uint64)
        inner = np.ones(at[-1], bool)
        inner[at[1:] - 1] = False
        self.h[inner] = w.hashes()
        self.before = np.empty_like(self.h)
        self.before[1:] = self.h[:-1]
        self.before[at[:-1]] = BEGIN

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _split(seg: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(seg, np.arange(n + 1))


def _distinct(h: np.ndarray, counted: bool = False):
    """Sorted distinct hashes (and how often each occurs): by sorting, several times as fast as ``np.unique`` alone."""
    h = np.sort(h)
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return (h[start], np.diff(start, append=len(h))) if counted else h[start]


def _parts(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of ``values`` cut at the places ``cut``: one binary cell from each place to the next."""
    at = (np.asarray(cut, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binary cells of a column in one array, and the places where a cell begins, the end included."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    cells = column.cast(pa.large_binary()).combine_chunks()
    at = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset:cells.offset + len(cells) + 1]
    values = np.frombuffer(cells.buffers()[2], np.uint8)[at[0]:at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)
    return values, (at - at[0]) // np.dtype(kind).itemsize


@contextmanager
def shuffles_removed(spark):
    """Shuffle files of the queries that run inside go when their query ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def count_rows(docs: DataFrame, segments: int) -> DataFrame:
    """Per slice and segment: distinct unigram hashes with counts, bigram hashes (32 bits) with counts."""
    def task(batches):
        K.tidy()
        for batch in batches:
            for lo, hi in K.row_slices(batch.column(0), SLICE_BYTES):
                t = Tokens(batch.column(0).slice(lo, hi - lo))
                uni, n_uni = _distinct(t.h, True)
                bi, n_bi = _distinct(pair_hash(t.before, t.h), True)
                u, b = _split(segment_of(uni, segments), segments), _split(segment_of(bi, segments), segments)
                low = (bi & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                times = -(-n_bi // 255)  # counts are bytes: larger ones are entered in parts
                end = np.concatenate([[0], np.cumsum(times)])
                small = np.full(end[-1], 255, np.uint8)
                small[end[1:] - 1] = n_bi - 255 * (times - 1)
                low, b = np.repeat(low, times), end[b]
                seg = np.flatnonzero(np.diff(u) + np.diff(b))
                u, b = np.append(u[seg], u[-1]), np.append(b[seg], b[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg, pa.int32()), _parts(uni, u), _parts(n_uni.astype(np.int32), u), _parts(low, b),
                     _parts(small, b)], names=["seg", "uni_hash", "uni_count", "bi_hash", "bi_count"])
    return docs.select("text").mapInArrow(
        task, "seg int, uni_hash binary, uni_count binary, bi_hash binary, bi_count binary")


def _summed(hashes: list, counts: list, htype, ctype):
    h = np.frombuffer(b"".join(hashes), htype)
    c = np.frombuffer(b"".join(counts), ctype).astype(np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[start], np.add.reduceat(c, start) if len(h) else c


def _level_histogram(levels: np.ndarray) -> list:
    return np.bincount(levels, minlength=MAX_LEVEL + 1).tolist()


def segment_counts(docs: DataFrame, segments: int) -> DataFrame:
    """One row per segment: exact unigram counts and quantised bigram counts of the training texts."""
    def merge(table: pa.Table) -> pa.Table:
        get = lambda name: table[name].to_pylist()
        uni, n_uni = _summed(get("uni_hash"), get("uni_count"), np.uint64, np.int32)
        bi, n_bi = _summed(get("bi_hash"), get("bi_count"), np.uint32, np.uint8)
        keep = n_bi >= MIN_COUNT
        level = level_of(n_bi[keep])
        return pa.table({
            "seg": pa.array([table["seg"][0].as_py()], pa.int32()), "tokens": [int(n_uni.sum())], "words": [len(uni)],
            "uni_hash": pa.array([uni.tobytes()], pa.binary()), "uni_count": pa.array([n_uni.tobytes()], pa.binary()),
            "bi_hash": pa.array([bi[keep].tobytes()], pa.binary()),
            "bi_level": pa.array([level.astype(np.uint8).tobytes()], pa.binary()),
            "uni_levels": [_level_histogram(level_of(n_uni))], "bi_levels": [_level_histogram(level)]})
    rows = count_rows(docs, segments).groupBy("seg").applyInArrow(merge, SEGMENT_SCHEMA)
    with shuffles_removed(docs.sparkSession):  # more than the input
        return materialize(rows, name="lm-segments")


def lowest_level(uni_levels: np.ndarray, bi_levels: np.ndarray, bits: int) -> int:
    """Least bigram level whose entries, with all unigrams, fill no more than half of the filter's bits.

    Not used by ``train``, whose filter holds every level.
    """
    room = bits * math.log(2) / PROBES
    q = np.arange(MAX_LEVEL + 1)
    need = float((uni_levels * q).sum())
    tail = np.cumsum((bi_levels * q)[::-1])[::-1]
    fits = np.flatnonzero(need + tail <= room)
    return int(fits[0]) if len(fits) else MAX_LEVEL + 1


def filter_bits(uni_levels: np.ndarray, bi_levels: np.ndarray, bits: int) -> int:
    """``bits``, or as many as all entries need to fill no more than half of them."""
    entries = int(((uni_levels + bi_levels) * np.arange(MAX_LEVEL + 1)).sum())
    return max(bits, math.ceil(entries * PROBES / math.log(2)) + 1)


def region_count(segments: int, bits: int) -> int:
    """Regions of the filter: one per segment, but none smaller than ``LEAST_REGION`` bits."""
    return max(1, min(segments, bits // LEAST_REGION))


def _mixed(key: np.ndarray, level) -> np.ndarray:
    return K.mix64(key + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))


def _steps(g: np.ndarray) -> np.ndarray:
    return (K.mix64(g + np.uint64(0x5851F42D)) | np.uint64(1)) >> np.uint64(20)


def filter_places(at: np.ndarray, key: np.ndarray, level, region: int):
    """The filter positions of (n-gram, level) in region ``at``: PROBES arrays. ``key`` tells the n-grams apart."""
    g = _mixed(key, level)
    step = _steps(g)
    base = at * region
    g = g >> np.uint64(20)
    for i in range(PROBES):
        yield base + ((g + step * np.uint64(i)) % np.uint64(region)).astype(np.int64)


def _uni_key(h):
    return h | np.uint64(1 << 63)


def _bi_key(h, seg):
    return (h & np.uint64(0xFFFFFFFF)) | (seg.astype(np.uint64) << np.uint64(32))


def region_bits(regions: int, bits: int) -> int:
    return max(64, bits // regions // 8 * 8)


def region_of(segments: int, regions: int):
    return F.expr(f"cast(cast(seg as long) * {regions} div {segments} as int)").alias("region")


def filled(rows: list, segments: int, regions: int, size: int, first: int, n: int) -> np.ndarray:
    """The bits of ``n`` regions from region ``first`` on, filled from their segments (``rows``)."""
    on = np.zeros(n * size, bool)
    for row in rows:
        seg = np.array([row["seg"]])
        at = seg * regions // segments - first
        uni = np.frombuffer(row["uni_hash"], np.uint64)
        bi = np.frombuffer(row["bi_hash"], np.uint32).astype(np.uint64)
        bi_level = np.frombuffer(row["bi_level"], np.uint8).astype(np.int64)
        uni_level = level_of(np.frombuffer(row["uni_count"], np.int64))
        for key, level in ((_uni_key(uni), uni_level), (_bi_key(bi, seg), bi_level)):
            for q in range(1, int(level.max(initial=0)) + 1):
                for place in filter_places(at, key[level >= q], q, size):
                    on[place] = True
    return np.packbits(on, bitorder="little")


def filter_regions(counted: DataFrame, segments: int, regions: int, size: int) -> DataFrame:
    """(region, bits): every region of the filter, filled from its segments."""
    def fill(table: pa.Table) -> pa.Table:
        bits = filled(table.to_pylist(), segments, regions, size, table["region"][0].as_py(), 1)
        return pa.table({"region": table["region"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = counted.select(region_of(segments, regions), "seg", "uni_hash", "uni_count", "bi_hash", "bi_level")
    return rows.groupBy("region").applyInArrow(fill, "region int, bits binary")


def probed_levels(bits: np.ndarray, at: np.ndarray, key: np.ndarray, region: int) -> np.ndarray:
    """Level of every n-gram (region ``at``, ``key``): the last one before a probe of ``bits`` fails."""
    level = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    q = 1
    while len(live) and q <= MAX_LEVEL:
        g = _mixed(key[live], q)
        base, start, step = at[live] * region, g >> np.uint64(20), None
        for i in range(PROBES):  # of ``filter_places``, only for n-grams that no probe has failed yet
            place = base + ((start + step * np.uint64(i) if i else start) % np.uint64(region)).astype(np.int64)
            on = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            live, base, start = live[on], base[on], start[on]
            step = step[on] if i else _steps(g[on])
        level[live] = q
        q += 1
    return level


class Model:
    """The broadcast part: totals, the exact counts of the heavy words and the filter (None if it is too large)."""

    def __init__(self, bits, segments, regions, region, tokens, words, heavy_hash, heavy_count):
        self.bits, self.segments, self.regions, self.region = bits, segments, regions, region
        self.tokens, self.words = tokens, words
        self.heavy_hash, self.heavy_count = heavy_hash, heavy_count
        self.counts = level_counts()

    def levels(self, h: np.ndarray, bigram: bool) -> np.ndarray:
        """Quantised counts by repeated membership probes: the last level before a probe fails."""
        seg = segment_of(h, self.segments)
        key = _bi_key(h, seg) if bigram else _uni_key(h)
        seg = seg * self.regions // self.segments
        return probed_levels(self.bits, seg, key, self.region)

    def token_log10(self, t: Tokens) -> np.ndarray:
        """log10 probability of every token of a slice, by the broadcast filter."""
        words, at = np.unique(t.h, return_inverse=True)
        pairs, pair = np.unique(pair_hash(t.before, t.h), return_inverse=True)  # in the order of the filter's regions
        return self.log10_of(self.levels(words, False)[at], self.levels(pairs, True)[pair], t.first[:-1])

    def log10_of(self, word: np.ndarray, pair: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of every token from the levels of its word and pair; texts begin at ``starts``."""
        count, pair = self.counts[word], self.counts[pair]
        unigram = (count + 1) / (self.tokens + self.words + 1)
        before = np.empty(len(count))
        before[1:] = count[:-1]
        before[starts] = self.texts
        return np.log10((np.minimum(pair, before) + KAPPA * unigram) / (before + KAPPA))


def train(docs: DataFrame, bits: int = FILTER_BITS, heavy_words: int = HEAVY_WORDS,
          broadcast_bits: int = BROADCAST_BITS):
    """(model, segment table) learned from the texts of ``docs``; the filter has ``bits`` bits at least."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    segments = max(8, -(-int(size[1] or 0) // SEGMENT_BYTES))
    counted = segment_counts(docs, segments)
    total = counted.agg(F.sum("tokens"), F.sum("words"), *[
        F.array(*[F.sum(F.get(c, F.lit(q))) for q in range(MAX_LEVEL + 1)]) for c in ("uni_levels", "bi_levels")]).first()
    tokens, words = int(total[0] or 0), int(total[1] or 0)
    levels = [np.array([x or 0 for x in total[k]], np.int64) for k in (2, 3)]
    bits = filter_bits(*levels, bits)
    regions = region_count(segments, bits)
    region = region_bits(regions, bits)
    joined = None
    if bits <= broadcast_bits:
        joined = np.zeros(regions * region // 8, np.uint8)
        for r in filter_regions(counted, segments, regions, region).collect():  # broadcast_bits in all
            joined[r.region * region // 8:(r.region + 1) * region // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    floor = max(1, -(-tokens // heavy_words))

    def heavy(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, c = np.frombuffer(row["uni_hash"], np.uint64), np.frombuffer(row["uni_count"], np.int64)
                keep = c >= floor
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()),
                                                  pa.array([c[keep].tobytes()], pa.binary())], names=["h", "c"])

    rows = counted.select("uni_hash", "uni_count").mapInArrow(heavy, "h binary, c binary").collect()
    h = np.frombuffer(b"".join(bytes(r.h) for r in rows), np.uint64)
    c = np.frombuffer(b"".join(bytes(r.c) for r in rows), np.int64)
    order = np.argsort(h)
    model = Model(joined, segments, regions, region, tokens, words, h[order], c[order])
    model.texts = int(size[0])
    return spark.sparkContext.broadcast(vars(model)), counted


def score_blocks(docs: DataFrame, shared, held) -> DataFrame:
    """Kind 0: one row per block (slice) with its documents; kind 1: per segment the occurrences of light words."""
    def task(batches):
        K.tidy()
        m = K.rebuilt(Model, shared)
        block = TaskContext.get().partitionId() << 32
        logs = np.log10((m.heavy_count + 1) / (m.tokens + m.words + 1))
        for batch in batches:
            for lo, hi in K.row_slices(batch.column(1), SLICE_BYTES):
                t = Tokens(batch.column(1).slice(lo, hi - lo))
                n = hi - lo
                row = t.rows()
                score = np.bincount(row, m.token_log10(t), minlength=n)
                at = np.minimum(np.searchsorted(m.heavy_hash, t.h), max(len(m.heavy_hash) - 1, 0))
                hit = m.heavy_hash[at] == t.h if len(m.heavy_hash) else np.zeros(len(t.h), bool)
                log_sum = np.bincount(row[hit], logs[at[hit]] if hit.any() else None, minlength=n).astype(np.float64)
                known = np.bincount(row[hit], minlength=n)
                light, light_doc = t.h[~hit], row[~hit].astype(np.uint32)
                order = np.argsort(light, kind="stable")
                light, light_doc = light[order], light_doc[order]
                cut = _split(segment_of(light, m.segments), m.segments)
                segs = np.flatnonzero(np.diff(cut))
                cut = np.append([0], np.append(cut[segs], cut[-1]))  # the first cell, of kind 0, is empty
                k = len(segs)
                lists = [batch.column(0).slice(lo, n).to_pylist(), batch.column(2).slice(lo, n).to_pylist(),
                         np.diff(t.first), known, log_sum, score]
                kinds = ["int64", "bool_", "int64", "int64", "float64", "float64"]
                arrays = [pa.array(np.arange(k + 1) > 0).cast(pa.int32()), pa.array(np.full(k + 1, block)),
                          pa.array(np.append([-1], segs), pa.int32())]
                arrays += [pa.array([x, *[None] * k], pa.list_(getattr(pa, kind)()))
                           for x, kind in zip(lists, kinds, strict=True)]
                arrays += [_parts(light, cut), _parts(light_doc, cut)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held")).mapInArrow(task, BLOCK_SCHEMA)
    return materialize(rows, name="lm-blocks")


PART_SCHEMA = "block long, seg int, a binary, b binary, c binary"


def light_parts(blocks: DataFrame, counted: DataFrame, shared) -> DataFrame:
    """Partial sums of the light words per block and segment (documents, known words, log sums), from the exact counts of the
    segment, which meet all its occurrences in one group and are copied to none."""
    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        m = K.rebuilt(Model, shared)
        h, cut = _joined(asked["hash"], np.uint64)
        doc, _ = _joined(asked["doc"], np.uint32)
        c = exact_counts(h, *(_joined(held[name], kind)[0] for name, kind in (("uni_hash", np.uint64), ("uni_count", np.int64))))
        row = np.repeat(np.arange(len(cut) - 1, dtype=np.uint64), np.diff(cut))
        pairs, which = np.unique(row << np.uint64(32) | doc, return_inverse=True)
        end = np.searchsorted(pairs, np.arange(len(cut), dtype=np.uint64) << np.uint64(32))
        known = np.bincount(which, c > 0, len(pairs)).astype(np.int64)
        logs = np.bincount(which, np.log10((c + 1) / (m.tokens + m.words + 1)), len(pairs))
        return pa.table([asked["block"], asked["seg"], _parts((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), end),
                         _parts(known, end), _parts(logs, end)], names=[f.split()[0] for f in PART_SCHEMA.split(", ")])

    light = blocks.where("kind = 1").select("block", "seg", "hash", "doc")
    held = counted.select(F.col("seg").alias("segment"), "uni_hash", "uni_count")
    return light.groupBy("seg").cogroup(held.groupBy("segment")).applyInArrow(look_up, PART_SCHEMA)


def exact_counts(h: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of the words ``h`` from the sorted ``words``: 0 where there is none."""
    if not len(words):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, counts[at], 0)


def text_blocks(docs: DataFrame, held) -> DataFrame:
    """One row per block (slice): its documents, the lengths of their texts and the texts, compressed."""
    def task(batches):
        K.tidy()
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in K.row_slices(batch.column(1), SLICE_BYTES):
                n = hi - lo
                text, at = K.string_bytes(batch.column(1).slice(lo, n))
                lists = [batch.column(0).slice(lo, n).to_pylist(), batch.column(2).slice(lo, n).to_pylist(), np.diff(at)]
                arrays = [pa.array([x], pa.list_(getattr(pa, kind)()))
                          for x, kind in zip(lists, ["int64", "bool_", "int64"], strict=True)]
                packed = pa.compress(np.ascontiguousarray(text), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *arrays, pa.array([packed], pa.binary())],
                                                 names=[f.split()[0] for f in TEXT_SCHEMA.split(", ")])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held")).mapInArrow(task, TEXT_SCHEMA)
    return materialize(rows, name="lm-blocks")


def block_tokens(length: pa.Scalar, text: pa.Scalar) -> Tokens:
    """The tokens of a block of ``text_blocks``."""
    at = np.concatenate([[0], np.cumsum(length.values.to_numpy())]).astype(np.int64)
    data = pa.decompress(text.as_buffer(), int(at[-1]), "zstd") if at[-1] else pa.py_buffer(b"")
    return Tokens(pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), data]))


def group_starts(segments: int, regions: int) -> tuple[int, np.ndarray]:
    """Regions of a group, and the first segment of every group with ``segments`` at the end. A group is of whole regions."""
    together = max(1, min(GROUP_REGIONS, regions // LEAST_GROUPS))
    return together, np.append(-(-np.arange(0, regions, together) * segments // regions), segments)


ANSWER_SCHEMA = "block long, part int, pairs boolean, level binary, count binary"


def answers(blocks: DataFrame, counted: DataFrame, shared, pairs: bool) -> DataFrame:
    """Per block and group of regions the levels of its distinct n-grams (``pairs`` or else words) in the order of their
    hashes, and for words the exact counts. The group's part of the filter is filled from its segments, and all that the
    blocks ask of it is probed at once."""
    m = shared.value
    segments, regions, size = m["segments"], m["regions"], m["region"]
    together, starts = group_starts(segments, regions)

    def ask(batches):
        K.tidy()
        for batch in batches:
            for block, length, text in zip(*batch.columns, strict=True):
                t = block_tokens(length, text)
                h = _distinct(pair_hash(t.before, t.h) if pairs else t.h)
                cut = _split(segment_of(h, segments), segments)
                sent = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) if pairs else h  # the segment holds the upper bits
                rows = pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()] * (len(starts) - 1), pa.int64()), pa.array(np.arange(len(starts) - 1), pa.int32()),
                     _parts(sent, cut[starts]), _parts(np.diff(cut).astype(np.uint32), starts)],
                    names=["block", "part", "hash", "sizes"])
                yield rows.filter(pa.array(np.diff(cut[starts]) > 0))

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        h, cut = _joined(asked["hash"], np.uint32 if pairs else np.uint64)
        level, count = np.zeros(0, np.uint8), None if pairs else np.zeros(0, np.int64)
        if len(h):
            part = asked["part"][0].as_py()
            first, last = (int(s) * regions // segments for s in (starts[part], starts[part + 1] - 1))
            rows = sorted(held.to_pylist(), key=lambda row: row["seg"])
            bits = filled(rows, segments, regions, size, first, last - first + 1)
            if pairs:
                sizes, _ = _joined(asked["sizes"], np.uint32)
                seg = np.tile(np.arange(starts[part], starts[part + 1], dtype=np.uint64), asked.num_rows)
                h = _bi_key(h.astype(np.uint64), np.repeat(seg, sizes))
            h, which = np.unique(h, return_inverse=True)  # many blocks ask for the same
            level = np.zeros(len(h), np.uint8)
            for lo in range(0, len(h), PROBE_KEYS):
                some = h[lo:lo + PROBE_KEYS]
                seg = (some >> np.uint64(32)).astype(np.int64) if pairs else segment_of(some, segments)
                level[lo:lo + PROBE_KEYS] = probed_levels(bits, seg * regions // segments - first,
                                                          some if pairs else _uni_key(some), size)
            level = level[which]
            if not pairs:
                words, counts = (np.frombuffer(b"".join(row[c] for row in rows), kind)
                                 for c, kind in (("uni_hash", np.uint64), ("uni_count", np.int64)))
                count = exact_counts(h, words, counts)[which]
        return pa.table([asked["block"], asked["part"], pa.array(np.full(asked.num_rows, pairs)), _parts(level, cut),
                         pa.nulls(asked.num_rows, pa.binary()) if pairs else _parts(count, cut)],
                        names=[f.split()[0] for f in ANSWER_SCHEMA.split(", ")])

    asked = blocks.select("block", "length", "text").mapInArrow(ask, "block long, part int, hash binary, sizes binary")
    held = counted.select(F.expr(f"cast(cast(seg as long) * {regions} div {segments} div {together} as int)").alias("of"),
                          "seg", "uni_hash", "uni_count", "bi_hash", "bi_level")
    return asked.groupBy("part").cogroup(held.groupBy("of")).applyInArrow(probe, ANSWER_SCHEMA)


def answered_scores(docs: DataFrame, held, shared, counted: DataFrame) -> DataFrame:
    """The result without a broadcast filter: every block meets the answers to its words and pairs."""
    tokens = shared.value["tokens"]
    blocks = text_blocks(docs, held)
    given = answers(blocks, counted, shared, False).unionByName(answers(blocks, counted, shared, True))

    def task(block: pa.Table, given: pa.Table) -> pa.Table:
        m = K.rebuilt(Model, shared)
        doc_id, held_out, length, text = (block[c][0] for c in ("doc_id", "held", "length", "text"))
        t = block_tokens(length, text)
        n, row = len(length), t.rows()
        word, pair = (np.unique(h, return_inverse=True)[1] for h in (t.h, pair_hash(t.before, t.h)))
        given = given.sort_by("part")  # groups are hash ranges: the order of np.unique
        of_words, of_pairs = (given.filter(pc.equal(given["pairs"], kind)) for kind in (False, True))
        levels = [_joined(x["level"], np.uint8)[0] for x in (of_words, of_pairs)]
        count, _ = _joined(of_words["count"], np.int64)
        known = np.bincount(row, (count > 0)[word], n).astype(np.int64)
        total = np.bincount(row, np.log10((count + 1) / (m.tokens + m.words + 1))[word], n)
        score = np.bincount(row, m.log10_of(levels[0][word], levels[1][pair], t.first[:-1]), n)
        return pa.table([doc_id.values, held_out.values, pa.array(np.diff(t.first)), pa.array(known),
                         pa.array(np.full(n, tokens)), pa.array(total), pa.array(score)],
                        names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    whole = blocks.withColumnRenamed("block", "id")
    return whole.groupBy("id").cogroup(given.groupBy("block")).applyInArrow(task, RESULT_SCHEMA)


RESULT_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                 "base_score double, score double")


def score_texts(docs: DataFrame, held, bits: int = FILTER_BITS, heavy_words: int = HEAVY_WORDS,
                broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """Train on the rows where ``held`` (a Column) is not true and score every row; see RESULT_SCHEMA."""
    held = F.coalesce(held, F.lit(False))
    shared, counted = train(docs.where(~held), bits, heavy_words, broadcast_bits)
    if shared.value["bits"] is None:
        return answered_scores(docs, held, shared, counted)
    tokens = shared.value["tokens"]
    blocks = score_blocks(docs, shared, held)
    replies = light_parts(blocks, counted, shared)
    whole = blocks.where("kind = 0").select(F.col("block").alias("id"), "doc_id", "held", "n_tokens", "known", "log_sum",
                                           "score")

    def task(block: pa.Table, given: pa.Table) -> pa.Table:
        row = {name: block[name].combine_chunks() for name in block.column_names}
        doc_id, held_out, n_tokens, score = (row[c][0].values for c in ("doc_id", "held", "n_tokens", "score"))
        known, total = (row[c][0].values.to_numpy() for c in ("known", "log_sum"))
        given = given.sort_by("seg")
        kinds = {"a": np.uint32, "b": np.int64, "c": np.float64}
        doc, known_light, log_light = (_joined(given[c], kind)[0] for c, kind in kinds.items())
        known = known + np.bincount(doc, known_light, len(known)).astype(np.int64)
        total = total + np.bincount(doc, log_light, len(total))
        return pa.table([doc_id, held_out, n_tokens, pa.array(known), pa.array(np.full(len(known), tokens)),
                         pa.array(total), score], names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    # one block at a time reaches Python: an Arrow batch of joined rows would hold many, of megabytes each
    return whole.groupBy("id").cogroup(replies.groupBy("block")).applyInArrow(task, RESULT_SCHEMA)
