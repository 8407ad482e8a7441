"""Sequence packing along a space-filling curve: documents that lie near each other on a Hilbert curve share sequences.

Plan: (1) ``encoded`` tokenizes every text once. The token counts of a document, hashed with a sign into ``FEATURES``
places and damped by the square root, are projected on ``DIMS`` fixed random directions; a projection of a unit vector has
a known distribution, so fixed cells (no fit) turn it into grid coordinates, and these into a Hilbert key. Token ids are
written with the key, at most ``PART_TOKENS`` a row. (2) ``positions`` range-sorts one small row per document (key,
doc_id, row number, length) and numbers the tokens along the curve: a running sum inside each range, plus the sums of
the ranges before it (one number per range passes through the driver). (3) ``pack`` joins the positions to the token rows
and cuts them at the sequence borders. Tokens move through one shuffle; nothing is sorted with its tokens.

The curve is one stream, so sequences are full but for its end: the last tokens, fewer than a sequence, are cut into
sequences of falling powers of two, which need no padding. Equal keys (copies) are told apart by doc_id and row number,
so a range never has to hold a whole group of copies.

Texts are encoded by their distinct words, cut at ASCII white space and between ASCII letters and ASCII punctuation (but
quotes, bars and angle brackets), where the tokenizer's pattern always cuts; a worker remembers at most ``CACHE_WORDS``
words. A file whose pre-tokenizer keeps white space or joins letters and punctuation cannot be used.

Edge cases: a null or empty text is a document of the end id alone; null ids sort first and are documents of their own, so
are repeated rows and ids; an empty table gives an empty result; other columns are ignored; strings of special tokens in a
text become special ids, as the library does. A document of any length lies in as many sequences as it needs.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import discard, materialize
from . import kernels as K

TOKENIZER_FILE = "/opt/tokenizers/word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1
FEATURES = 1024
DIMS = 4
BITS = 15
SLICE_BYTES = 4 << 20
PART_TOKENS = 1 << 20
CACHE_WORDS = 1 << 19
JOINED = 512  # distinct words encoded in one call

TOKEN_SCHEMA = "row long, doc_id long, curve_key long, doc_tokens long, start long, width int, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: kind of a byte: 0 white space, 1 ASCII letter, 2 ASCII punctuation a word is cut at, 3 anything else
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'|<>"]] = 2
_BEGINS = np.zeros(16, bool)  # (kind before, kind here) where a word begins
_BEGINS[[1, 2, 3, 4 * 1 + 2, 4 * 2 + 1]] = True


#: words of A-Z, a-z and the letters from U+00C0 to U+00FF, whose lower case and composition no context changes
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid points (rows of ``cells``, ``bits`` bits a coordinate)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for d in range(dims):  # undo the turns of all coarser levels
            high = (x[d] & q) != 0
            turn = np.where(high, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ turn)
            x[d] ^= turn
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


class Projection:
    """Token counts -> Hilbert key; all of it is fixed by ``seed``."""

    def __init__(self, vocabulary: int, features: int = FEATURES, dims: int = DIMS, bits: int = BITS, seed: int = 12):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.place = rng.integers(0, features, vocabulary)
        self.sign = rng.choice([-1.0, 1.0], vocabulary)
        self.direction = rng.choice([-1.0, 1.0], (features, dims))
        self.features, self.bits = features, bits

    def keys(self, ids: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        n = len(per_row)
        row = np.repeat(np.arange(n), per_row)
        v = np.bincount(row * self.features + self.place[ids], weights=self.sign[ids],
                        minlength=n * self.features).reshape(n, self.features)
        v = np.sign(v) * np.sqrt(np.abs(v))
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        z = v @ self.direction / np.where(norm > 0, norm, 1)
        share = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution function: cells of like size
        return hilbert_key(np.minimum((share * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)


class WordCoder:
    """Token ids of texts by way of their distinct words. The ids of remembered words lie in one growing array."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        special = [t for t in parsed["added_tokens"] if t["special"]]
        self.special = [t["content"] for t in special]
        self.border = special[0] if special else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # lower-cased words of Latin-1 letters are whole words to the model: no pattern and no normalizer is needed, and
        # their last token carries the suffix that ends a word
        suffix = parsed["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix)
                              for i in range(self.size)])
        self.letters = None
        if suffix:
            self.letters = Tokenizer(Tokenizer.from_str(spec).model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = K.IdPool()

    def remember(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.known.update(zip(words, range(self.pool.size, self.pool.size + len(words))))
        self.pool.add(ids, count)

    def learn(self, words: list[str]) -> None:
        letters, rest = [], []
        plain = _PLAIN.fullmatch
        for w in words:
            (letters if self.letters and plain(w) else rest).append(w)
        for lo in range(0, len(letters), JOINED):
            part = letters[lo:lo + JOINED]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, np.int64)
            self.remember(part, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        for lo in range(0, len(rest), JOINED):
            part = rest[lo:lo + JOINED]
            text = "" if self.border is None else self.border["content"].join(part)
            if self.border is None or sum(text.count(s) for s in self.special) > len(part) - 1:
                coded = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                self.remember(part, np.array(list(itertools.chain.from_iterable(coded)), np.int64),
                              np.fromiter(map(len, coded), np.int64, len(part)))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(ids == self.border["id"])
            self.remember(part, np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)

    def encode(self, column: pa.Array):
        """(flat ids, tokens per row) of a slice of rows."""
        buf, off = K.string_bytes(column)
        n = len(buf)
        kind = _KIND[buf]
        word = kind > 0
        begins = np.zeros(n, bool)
        begins[1:] = _BEGINS[kind[:-1] * 4 + kind[1:]]
        first = off[:-1][np.diff(off) > 0]
        begins[first] = word[first]
        start = np.flatnonzero(begins)
        kept = np.cumsum(word, dtype=np.int32 if n < 1 << 31 else np.int64)
        bounds = np.append(kept[start] - 1, kept[-1] if n else 0)  # a word begins at a byte that is kept itself
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)),
                                                 pa.py_buffer(buf[word].tobytes()))
        coded = words.dictionary_encode()
        distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.forget()
        known = self.known
        self.learn([w for w in distinct if w not in known])
        ids, count = self.pool.take(K.numbered(distinct, self.known)[code])
        tokens = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(tokens[np.searchsorted(start, off)])


def encoded(docs: DataFrame, tokenizer_file: str = TOKENIZER_FILE, end_id: int = END_ID) -> DataFrame:
    """Token rows (``TOKEN_SCHEMA``) of all documents, written to the checkpoint folder; ``ids`` are little-endian numbers
    of ``width`` bytes, 2 where the vocabulary allows it."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def task(batches):
        K.tidy()
        spec = shared.value
        # the words learned in earlier tasks of this worker are still known
        coder = K.kept_by_worker(f"curve-pack {hashlib.sha256(spec.encode()).hexdigest()}", lambda: WordCoder(spec))
        project = Projection(max(coder.size, end_id + 1))
        kind = np.dtype("<u2" if max(coder.size, end_id + 1) <= 1 << 16 else "<u4")
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in K.row_slices(batch.column(1), SLICE_BYTES):
                ids, per_row = coder.encode(batch.column(1).slice(lo, hi - lo))
                keys = project.keys(ids, per_row)
                total = per_row + 1
                ends = np.cumsum(total)
                full = np.full(int(ends[-1]), end_id, kind)
                mask = np.ones(len(full), bool)
                mask[ends - 1] = False
                full[mask] = ids
                parts = -(-total // PART_TOKENS)
                which = np.repeat(np.arange(hi - lo), parts)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART_TOKENS
                offsets = kind.itemsize * np.append((ends - total)[which] + start, ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + which), batch.column(0).slice(lo, hi - lo).take(pa.array(which)),
                     pa.array(keys[which]), pa.array(total[which]), pa.array(start),
                     pa.array(np.full(len(which), kind.itemsize, np.int32)),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [
                         None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary())],
                    names=[f.split()[0] for f in TOKEN_SCHEMA.split(", ")])
                row += hi - lo

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, TOKEN_SCHEMA),
                       name="pack-tokens")


def positions(tokens: DataFrame) -> tuple[DataFrame, int]:
    """((row, position): where each document begins on the curve, in tokens; tokens in all)."""
    spark = tokens.sparkSession
    order = ["curve_key", "doc_id", "row"]
    light = (tokens.where("start = 0").select(*order, "doc_tokens")
             .repartitionByRange(*order).sortWithinPartitions(*order).select("row", "doc_tokens"))

    def task(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(before), batch.column(1)],
                names=["range", "row", "before", "doc_tokens"])

    ranges = materialize(light.mapInArrow(task, "range int, row long, before long, doc_tokens long"), name="pack-order")
    sums = sorted((r["range"], r["n"]) for r in ranges.groupBy("range").agg(F.sum("doc_tokens").alias("n")).collect())
    base = list(itertools.accumulate((n for _, n in sums), initial=0))
    starts = spark.createDataFrame([(r, b) for (r, _), b in zip(sums, base)], "range int, base long")
    return ranges.join(F.broadcast(starts), "range").select("row", (F.col("base") + F.col("before")).alias("position")), base[-1]


def borders(at: np.ndarray, total: int, size: int):
    """(sequence, its first token, its length) at stream positions ``at`` of a stream of ``total`` tokens."""
    whole = total // size
    rest = total % size
    tail = [1 << b for b in range(size.bit_length() - 1, -1, -1) if rest >> b & 1]
    first = whole * size + np.concatenate([[0], np.cumsum(tail)]).astype(np.int64)
    k = np.searchsorted(first, at, side="right") - 1
    full = at < whole * size
    k = np.where(full, 0, k)
    lengths = np.array([*tail, 1], np.int64)
    return (np.where(full, at // size, whole + k), np.where(full, at // size * size, first[k]),
            np.where(full, size, lengths[k]))


def cut(position: np.ndarray, length: np.ndarray, total: int, size: int):
    """Pieces of stretches of the stream at the sequence borders: (stretch, first token in it, length, sequence, offset)."""
    which, begin = np.arange(len(position)), np.zeros(len(position), np.int64)
    out = []
    while len(which):
        sequence, first, n = borders(position[which] + begin, total, size)
        offset = position[which] + begin - first
        take = np.minimum(n - offset, length[which] - begin)
        out.append(np.stack([which, begin, take, sequence, offset]))
        begin = begin + take
        more = begin < length[which]
        which, begin = which[more], begin[more]
    parts = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    return parts[:, np.lexsort((parts[1], parts[0]))]


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer_file: str = TOKENIZER_FILE, end_id: int = END_ID) -> DataFrame:
    """One row per piece (``PIECE_SCHEMA``): ``length`` tokens of a document from ``start`` on lie in sequence
    ``sequence_id`` from ``offset`` on; ``ids`` are their little-endian unsigned 32-bit ids."""
    if size < 1 or size & (size - 1):
        raise ValueError("the sequence length must be a power of two")
    tokens = encoded(docs, tokenizer_file, end_id)
    return cut_pieces(tokens, *positions(tokens), size)


def piece_digests(docs: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pack`` with the CRC-32 of every piece's ids in place of the ids; the token table is removed."""
    tokens = encoded(docs)
    pieces = cut_pieces(tokens, *positions(tokens), size)
    out = materialize(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                    "sequence_id", "offset"), name="pack-pieces")
    discard(tokens)
    return out


def cut_pieces(tokens: DataFrame, where: DataFrame, total: int, size: int) -> DataFrame:
    """Token rows cut at the sequence borders (``PIECE_SCHEMA``)."""
    joined = (tokens.join(where.hint("shuffle_hash"), "row")
              .select("doc_id", "doc_tokens", "start", "ids", "position", "width"))

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            start, position = (batch.column(k).to_numpy() for k in (2, 4))
            width = batch.column(5)[0].as_py()
            packed = batch.column(3).cast(pa.large_binary())
            at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1] // width
            ids = np.frombuffer(packed.buffers()[2], f"<u{width}")
            which, begin, length, sequence, offset = cut(position + start, np.diff(at), total, size)
            bounds = np.append(at[which] + begin, at[-1])
            for lo, hi in _chunks(bounds):
                w = pa.array(which[lo:hi])
                wide = ids[bounds[lo]:bounds[hi]].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(w), pa.array(start[which[lo:hi]] + begin[lo:hi]), pa.array(length[lo:hi]),
                     batch.column(1).take(w), pa.array(sequence[lo:hi]), pa.array(offset[lo:hi]),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [
                         None, pa.py_buffer(4 * (bounds[lo:hi + 1] - bounds[lo])), pa.py_buffer(wide)]).cast(pa.binary())],
                    names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])

    return joined.mapInArrow(task, PIECE_SCHEMA)


def _chunks(bounds: np.ndarray, limit: int = SLICE_BYTES):
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1))
        yield lo, hi
        lo = hi


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, tokens (array of the pieces' ids in order), doc_ids: the training sequences themselves.

    A sequence holds ``size`` tokens at most, so do the lists collected for it.
    """
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (pieces.groupBy("sequence_id").agg(in_order.alias("p"))
            .select("sequence_id", F.array_distinct("p.doc_id").alias("doc_ids"), F.col("p.ids").alias("ids")))
