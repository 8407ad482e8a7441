"""SentencePiece encoding and decoding by suffix-array matching.

The text of a batch is cut into words (a run of spaces with what follows it; no piece holds a space after another
character, so encoding words apart is exact), and the distinct words are concatenated. A suffix array of that text,
sorted to the depth of the longest piece, is built by prefix doubling; every piece is located by binary search as
one range of suffixes; the ranges give all edges (start, end, piece). The edges are sorted by their end and relaxed
from left to right for all words at once.

The public model is a byte-pair model, so relaxation cannot simply add scores: each prefix of a word has exactly one
encoding, and an edge extends the encoding of the prefix before it only if piece and predecessor stay apart when the
merges are replayed. ``Vocabulary.apart`` decides that for many pairs at once by undoing the later merge of the two
pieces and looking for an earlier merge across their border. The result equals the library's merge loop. Words with
two or more leading spaces hold pieces of equal score, where the order of merges depends on position; they are
encoded by the merge loop itself (``Vocabulary.merge``), and words beyond ``LONG_WORD`` characters are relaxed one
position at a time. Unknown characters become byte pieces.

Only the driver reads the model file (its path is a parameter); its tables (some 32,000 pieces) are broadcast.

Edge cases: null and empty text give no tokens and decode to empty text; repeated rows give equal rows; U+2581 counts
as a space, as in the library; a null token list decodes to null; byte pieces that are no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
TEXT_BYTES = 4 << 20    # text whose distinct words are encoded together
INDEX_CHARS = 1 << 18   # characters of one suffix array
CHECK_BYTES = 1 << 20   # text decoded at once
LONG_WORD = 96          # longer words are relaxed position by position
PAIR_SLOTS = 1 << 20


class Vocabulary:
    """Pieces of a byte-pair model with merge order, splits and the matching tables."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int]):
        self.size = len(pieces)
        self.unknown = self.size  # stands for one character without a piece
        self.byte_ids = np.array(byte_ids, np.int32)
        self.pieces = pieces
        use = [i for i in range(self.size) if normal[i]]
        self.id_of = {pieces[i]: i for i in use}
        self.score = scores
        multi = sorted((i for i in use if len(pieces[i]) > 1), key=lambda i: (-scores[i], i))
        self.rank = np.zeros(self.size + 1, np.int64)  # 0: a character, else the order of the merge that makes it
        self.rank[multi] = np.arange(1, len(multi) + 1)
        pairs, made = [], []
        for i in multi:
            p = pieces[i]
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(a * (self.size + 1) + b)
                    made.append(self.rank[i])
        order = np.argsort(np.array(pairs, np.int64))
        self.pair_key, self.pair_rank = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        self.left = np.arange(self.size + 1)
        self.right = np.arange(self.size + 1)
        usable = []
        for i in use:
            p = pieces[i]
            if len(p) == 1:
                usable.append(i)
                continue
            last = self.merge(p, trace=True)
            if last is not None:  # the piece is what its own characters merge to
                self.left[i], self.right[i] = last
                usable.append(i)
        usable.sort(key=lambda i: (len(pieces[i]), i))
        self.usable = np.array(usable, np.int32)
        self.length = np.ones(self.size + 1, np.int32)
        self.length[use] = [len(pieces[i]) for i in use]
        self.depth = int(self.length.max())
        self.chars = np.zeros((len(usable), self.depth), np.int64)
        for row, i in enumerate(usable):
            self.chars[row, :len(pieces[i])] = [ord(c) for c in pieces[i]]
        self.single = {ord(pieces[i]): i for i in use if len(pieces[i]) == 1}
        self.known_chars = np.array(sorted(self.single), np.int64)
        # bytes of every piece for decoding
        raw = [b""] * (self.size + 1)
        for i in use:
            raw[i] = pieces[i].replace(SPACE, " ").encode()
        for value, i in enumerate(byte_ids):
            raw[i] = bytes([value])
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def read(cls, model_file: str = MODEL_FILE) -> Vocabulary:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(pieces, [sp.get_score(i) for i in range(n)], normal, bytes_)

    def merge(self, word: str, trace: bool = False):
        """The merge loop: best score first, then leftmost. Token ids, characters without a piece as -codepoint.

        With ``trace``: the (left, right) ids of the last merge if the word ends as one piece, else None.
        """
        n = len(word)
        token = [word[i] for i in range(n)]
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def push(i):
            j = after[i]
            if j < n:
                t = self.id_of.get(token[i] + token[j])
                if t is not None:
                    heapq.heappush(heap, (-self.score[t], i, j, len(token[i]), len(token[j])))

        for i in range(n - 1):
            push(i)
        last = None
        while heap:
            _, i, j, li, lj = heapq.heappop(heap)
            if not (live[i] and j < n and live[j] and after[i] == j and len(token[i]) == li and len(token[j]) == lj):
                continue
            last = (token[i], token[j])
            token[i] += token[j]
            live[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out = [token[i] for i in range(n) if live[i]]
        if trace:
            return (self.id_of[last[0]], self.id_of[last[1]]) if len(out) == 1 and last else None
        return [self.id_of.get(t, -ord(t[0])) for t in out]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, are both left whole by the merges."""
        a, b = a.copy(), b.copy()
        ok = np.zeros(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = a * (self.size + 1) + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crossing = (self.pair_key[at] == key) & (self.pair_rank[at] < limit)
            ra, rb = self.rank[a], self.rank[b]
            done = ~crossing & (ra == 0) & (rb == 0)
            ok[live[done]] = True
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_a, b, self.left[b])
            keep = ~crossing & ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes ordered by their first ``depth`` symbols (prefix doubling).

    The first round packs as many symbols into a 64-bit key as fit (a power of two of them).
    """
    n = len(text)
    symbols, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    bits = int(len(symbols) + 1).bit_length()
    width = 1
    while width < depth and 2 * width * bits <= 63:
        nxt = np.zeros(n, np.int64)
        nxt[:max(n - width, 0)] = rank[width:]
        rank = (rank << (width * bits)) | nxt
        width *= 2
    while True:
        order = np.argsort(rank)
        if width >= depth or not n:
            return order
        ordered = rank[order]
        step = np.ones(n, np.int64)
        step[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:  # all suffixes differ already
            return order
        nxt = np.zeros(n, np.int64)
        nxt[:max(n - width, 0)] = rank[width:]
        rank = rank * (n + 2) + nxt
        width *= 2


def piece_ranges(text: np.ndarray, order: np.ndarray, chars: np.ndarray, length: np.ndarray):
    """Range of suffixes that begin with each piece, by binary search one character deeper at a time."""
    padded = np.concatenate([text, np.full(chars.shape[1], -1, np.int64)])
    lo, hi = np.zeros(len(chars), np.int64), np.full(len(chars), len(order), np.int64)
    for k in range(chars.shape[1]):
        rows = np.flatnonzero((length > k) & (lo < hi))
        if not len(rows):
            break
        want = chars[rows, k]
        bounds = []
        for right in (False, True):
            a, b = lo[rows].copy(), hi[rows].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + k]
                go = open_ & ((seen <= want) if right else (seen < want))
                a = np.where(go, mid + 1, a)
                b = np.where(open_ & ~go, mid, b)
            bounds.append(a)
        lo[rows], hi[rows] = bounds
    return lo, hi


class Encoder:
    """Encodes lists of distinct words; keeps decided pairs of pieces between calls."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.pair = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)

    def apart(self, a, b):
        key = a.astype(np.int64) * (self.v.size + 1) + b
        slot = (K.mix64(key.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        out = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair[slot] != key)
        if len(miss):
            wanted, inverse = np.unique(key[miss], return_inverse=True)
            ok = self.v.apart(wanted // (self.v.size + 1), wanted % (self.v.size + 1))
            out[miss] = ok[inverse]
            self.pair[slot[miss]], self.pair_ok[slot[miss]] = key[miss], out[miss]
        return out

    def edges(self, text: np.ndarray, first: np.ndarray):
        """(start, piece) of every piece inside one word; ``first``: n + 1 word starts."""
        v = self.v
        order = suffix_array(text, v.depth)
        length = v.length[v.usable]
        lo, hi = piece_ranges(text, order, v.chars, length)
        start = order[K.csr_indices(lo, hi - lo)].astype(np.int32)
        piece = np.repeat(v.usable, hi - lo)
        word = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        end = start + v.length[piece]
        inside = (end <= len(text)) & (word[start] == word[np.minimum(end, len(text)) - 1])
        strange = np.flatnonzero(~np.isin(text, v.known_chars)).astype(np.int32)
        start = np.concatenate([start[inside], strange])
        piece = np.concatenate([piece[inside], np.full(len(strange), v.unknown, np.int32)])
        return start, piece, word

    def relax(self, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Last piece of the encoding of every prefix, by end position (n + 1; all words at once)."""
        start, piece, word = self.edges(text, first)
        end = start + self.v.length[piece]
        base = first.astype(np.int32)[word[start]]
        at = end - base
        order = np.argsort(at.astype(np.uint16) if len(at) and at.max() < 65536 else at, kind="stable")
        start, piece, end, at, base = start[order], piece[order], end[order], at[order], base[order]
        last = np.full(len(text) + 1, -1, np.int32)  # by end position; ends of different words differ
        cut = np.flatnonzero(np.diff(at)) + 1
        for s, e in zip(np.r_[0, cut], np.r_[cut, len(at)], strict=True):
            st, pc = start[s:e], piece[s:e]
            ok = st == base[s:e]
            more = np.flatnonzero(~ok)
            if len(more):
                ok[more] = self.apart(last[st[more]], pc[more])
            last[end[s:e][ok]] = pc[ok]
        return last

    def relax_long(self, text: np.ndarray) -> np.ndarray:
        """The same for one long word, position by position."""
        start, piece, _ = self.edges(text, np.array([0, len(text)]))
        order = np.argsort(start, kind="stable")
        start, piece = start[order], piece[order]
        bounds = np.searchsorted(start, np.arange(len(text) + 1))
        last = np.full(len(text) + 1, -1, np.int64)
        for p in range(len(text)):
            pc = piece[bounds[p]:bounds[p + 1]]
            if p:
                pc = pc[self.apart(np.full(len(pc), last[p]), pc)]
            last[p + self.v.length[pc]] = pc
        return last

    def read_back(self, last: np.ndarray, text: np.ndarray, first: np.ndarray):
        """Token ids of every word from the last pieces: (ids, tokens per word)."""
        v = self.v
        at, begin = first[1:].copy(), first[:-1]
        live = np.flatnonzero(at > begin)
        words, tokens, places = [], [], []
        while len(live):
            t = last[at[live]]
            at[live] -= v.length[t]
            words.append(live)
            tokens.append(t)
            places.append(at[live])
            live = live[at[live] > begin[live]]
        word, token, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, tokens, places))
        order = np.argsort(place, kind="stable")
        word, token, place = word[order], token[order], place[order]
        lost = np.flatnonzero(token == v.unknown)
        count = np.ones(len(token), np.int64)
        raw = [chr(c).encode() for c in text[place[lost]].tolist()]
        count[lost] = [len(r) for r in raw]
        ids = np.repeat(token, count)
        if len(lost):
            at_ = np.cumsum(count) - count
            ids[K.csr_indices(at_[lost], count[lost])] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids.astype(np.int32), np.bincount(np.repeat(word, count), minlength=len(first) - 1)

    def encode_words(self, words: pa.Array):
        """(ids, first id, tokens per word) of distinct words, each beginning with a space mark."""
        size = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        spaced = pa.compute.starts_with(words, SPACE * 2).to_numpy(zero_copy_only=False)
        first, count, flat, held = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [], 0

        def add(rows, ids, n):
            nonlocal held
            first[rows], count[rows] = held + np.cumsum(n) - n, n
            flat.append(ids)
            held += len(ids)

        plain = np.flatnonzero(~spaced & (size <= LONG_WORD))
        ends = np.cumsum(size[plain])
        cuts = np.searchsorted(ends, np.arange(INDEX_CHARS, ends[-1], INDEX_CHARS)) if len(plain) else []
        for rows in np.split(plain, cuts):
            if len(rows):
                text = np.frombuffer("".join(words.take(pa.array(rows)).to_pylist()).encode("utf-32-le"), np.uint32)
                bounds = np.concatenate([[0], np.cumsum(size[rows])])
                text = text.astype(np.int64)
                add(rows, *self.read_back(self.relax(text, bounds), text, bounds))
        for i in np.flatnonzero(spaced | (size > LONG_WORD)).tolist():
            w = words[i].as_py()
            if spaced[i]:
                out = [x for t in self.v.merge(w) for x in (
                    [t] if t >= 0 else self.v.byte_ids[list(chr(-t).encode())].tolist())]
                add(np.array([i]), np.array(out, np.int32), np.array([len(out)]))
            else:
                text = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64)
                add(np.array([i]), *self.read_back(self.relax_long(text), text, np.array([0, len(text)])))
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), first, count

    def encode(self, column: pa.Array):
        """Per slice of rows: (lo, hi, flat ids, tokens per row, prepared bytes, row offsets)."""
        for lo, hi in K.row_slices(column, TEXT_BYTES):
            plain = pa.compute.fill_null(column.slice(lo, hi - lo).cast(pa.large_string()), "")
            plain = pa.compute.replace_substring(plain, SPACE, " ")
            space = pa.compute.if_else(pa.compute.equal(plain, ""), "", " ").cast(pa.large_string())
            buf, off = K.string_bytes(pa.compute.binary_join_element_wise(
                space, plain, pa.scalar("", pa.large_string())))
            space = buf == 32
            begins = space.copy()
            begins[1:] &= ~space[:-1]
            begins[off[:-1][np.diff(off) > 0]] = True
            start = np.flatnonzero(begins)
            bounds = np.append(start, len(buf)).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(buf.tobytes()))
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy()
            ids, begin, count = self.encode_words(pa.compute.replace_substring(coded.dictionary, " ", SPACE))
            flat = ids[K.csr_indices(begin[code], count[code])]
            tokens = np.concatenate([[0], np.cumsum(count[code])])
            per_row = np.diff(tokens[np.searchsorted(start, off)])
            yield lo, hi, flat, per_row, buf, off


def decode_bytes(v: Vocabulary, ids: np.ndarray, per_row: np.ndarray):
    """(bytes, row offsets) spelled by the tokens, still with the leading space of every row."""
    n = v.raw_len[ids]
    out = v.raw[K.csr_indices(v.raw_start[ids], n)]
    total = np.concatenate([[0], np.cumsum(n)])
    return out, total[np.concatenate([[0], np.cumsum(per_row)])]


def round_trips(v: Vocabulary, ids: np.ndarray, per_row: np.ndarray, buf: np.ndarray, off: np.ndarray):
    """(the tokens decode to the row's prepared bytes, code points of the row), some rows at a time."""
    n = len(per_row)
    same, chars = np.zeros(n, bool), np.zeros(n, np.int64)
    token = np.concatenate([[0], np.cumsum(per_row)])
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + CHECK_BYTES, side="right")) - 1))
        out, back = decode_bytes(v, ids[token[lo]:token[hi]], per_row[lo:hi])
        want, at = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        if np.array_equal(back, at):
            wrong = np.concatenate([[0], np.cumsum(out != want)])
            same[lo:hi] = wrong[at[1:]] == wrong[at[:-1]]
        else:
            same[lo:hi] = [out[back[r]:back[r + 1]].tobytes() == want[at[r]:at[r + 1]].tobytes() for r in range(hi - lo)]
        # a code point has one byte that is no continuation byte; the added space is not counted
        points = np.concatenate([[0], np.cumsum((want & 0xC0) != 0x80)])
        chars[lo:hi] = points[at[1:]] - points[at[:-1]] - (np.diff(at) > 0)
        lo = hi
    return same, chars


def _vocabulary(spark: SparkSession, model_file: str):
    return spark.sparkContext.broadcast(vars(Vocabulary.read(model_file)))


def encode(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, n_chars, round_trip (the ids decode to the text), one row per input row."""
    shared = _vocabulary(docs.sparkSession, model_file)

    def task(batches):
        K.tidy()
        enc = Encoder(K.rebuilt(Vocabulary, shared))
        for batch in batches:
            for lo, hi, flat, per_row, buf, off in enc.encode(batch.column(1)):
                same, n_chars = round_trips(enc.v, flat, per_row, buf, off)
                offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array(per_row), pa.array(n_chars), pa.array(same)],
                    names=["doc_id", "ids", "n_tokens", "n_chars", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        task, "doc_id long, ids array<int>, n_tokens long, n_chars long, round_trip boolean")


def with_text(tokens: DataFrame, model_file: str = MODEL_FILE, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the decoded text of its ``ids`` column added."""
    shared = _vocabulary(tokens.sparkSession, model_file)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        per_row = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
        out, at = decode_bytes(K.rebuilt(Vocabulary, shared), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), per_row)
        raw = out.tobytes()
        texts = [None if not ok else raw[at[r]:at[r + 1]].removeprefix(b" ").decode("utf-8", "replace")
                 for r, ok in enumerate(column.is_valid().to_pylist())]
        return pa.array(texts, pa.string())

    return tokens.withColumn(text, decode(F.col(ids)))
