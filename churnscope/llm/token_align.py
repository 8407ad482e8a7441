"""Cross-tokenizer alignment: two tokenizations of the same text matched by byte ranges with ``pandas.merge_asof``.

Tokenizer A is a byte-level BPE file (encodes space + text), B a SentencePiece model (adds that space itself). Both spell
the same bytes, so every token is a byte range. For a stretch of documents, one ``merge_asof`` keyed by document finds for
each start of an A token the B token that covers it, another one the A token that covers each start of a B token; the union
of both directions is the set of overlapping pairs (links). Offsets where a token ends on both sides close a group.

A link's id pair is weighed over the whole corpus: how many links hold it, and whether that is the highest number of its B
id. Plan: (1) ``aligned`` encodes and aligns in one pass and writes a row per stretch of ``BATCH_BYTES`` of text, with
per-document figures, the distinct id pairs of the stretch with their numbers, and for each document which of them it holds
how often; (2) the numbers are summed per pair by a partially aggregated shuffle, the highest per B id over the vocabulary;
(3) every stretch gets the sums of its own pairs by a join on the pair and turns them into document sums, one stretch at a
time (a cogroup by stretch), so that a task's memory does not depend on how many stretches a partition holds. What is shuffled
are distinct pairs per stretch and the compact rows of (1), never links; no key holds more rows than there are stretches.

Texts are cut into words at single spaces next to a visible character, where neither tokenizer has a token that crosses;
each distinct word is encoded once a task (at most ``CACHE_WORDS`` are remembered, which changes no result). Words are
aligned in runs of ``RUN_BYTES``, so that a text of any length needs bounded memory (a single word excepted).

Edge cases: a null or empty text, or one that a side does not spell byte for byte (U+2581, which B reads as a space), has
no tokens: zeros and an empty ``groups_sha256``; it adds nothing to the corpus numbers. Repeated rows and ids are separate
documents; null ids stay; an empty table gives an empty result; other columns are ignored. Strings of special tokens are
plain text.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import discard, materialize
from . import kernels as K

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: fixed value: the pre-tokenizer pattern of the byte-level tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
CACHE_WORDS = 1 << 19
JOINED = 4096  # words encoded in one call

FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
STRETCH_SCHEMA = ("batch long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in FIGURES)
                  + ", groups_sha256 array<string>, pair array<long>, links array<long>, "
                  "first binary, which binary, times binary")
RESULT_SCHEMA = ("doc_id long, " + ", ".join(f"{c} long" for c in FIGURES)
                 + ", n_best long, count_sum long, groups_sha256 string")


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: visible Latin-1 bytes stand for themselves, the others follow 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def byte_ranks(model_file: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file whose ids follow the order of its merges."""
    with open(model_file, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["id"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if any(x >= y for x, y in itertools.pairwise(made)):
        raise ValueError(f"ids of {model_file} do not follow its merges")
    byte = byte_alphabet()
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if i not in special}


def flat_bytes(spelled: list[bytes]):
    """(all bytes, start, length) of a list of byte strings."""
    n = np.array([len(x) for x in spelled], np.int64)
    return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(n) - n, n


class Tokenizers:
    """Both encoders and the bytes of their tokens; ``shared`` holds (ranks of A, model bytes of B)."""

    def __init__(self, shared):
        import sentencepiece
        import tiktoken
        ranks, model = shared
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            spelled[i] = raw
        self.bytes_a = flat_bytes(spelled)
        n = self.b.get_piece_size()
        self.bytes_b = flat_bytes([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else b"" if self.b.is_control(i) or self.b.is_unknown(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)])
        self.size_b = n
        self.pairs = len(spelled) * n
        self.digits = flat_bytes([str(i).encode() for i in range(max(len(spelled), n))])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pools = K.IdPool(), K.IdPool()

    def encode(self, words: list[str], code: np.ndarray):
        """Per side (ids, tokens of each word) of the words numbered ``code`` in the distinct ``words``, each of which begins
        with a space."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.forget()
        known = self.known
        new = [w for w in words if w not in known]
        for lo in range(0, len(new), JOINED):
            part = new[lo:lo + JOINED]
            known.update(zip(part, range(len(known), len(known) + len(part))))
            plain = self.a.encode_ordinary
            for pool, coded in zip(self.pools, ([plain(w) for w in part], self.b.encode([w[1:] for w in part], num_threads=1)),
                                   strict=True):
                pool.add(np.array(list(itertools.chain.from_iterable(coded)), np.int64),
                         np.fromiter(map(len, coded), np.int64, len(part)))
        at = K.numbered(words, known)[code]
        return [(ids.astype(np.int64), n) for ids, n in (pool.take(at) for pool in self.pools)]


def spaced_words(column: pa.Array):
    """(bytes of space + text of all rows, row offsets, start of every word)."""
    plain = pa.compute.fill_null(column.cast(pa.large_string()), "")
    space = pa.compute.if_else(pa.compute.equal(plain, ""), "", " ").cast(pa.large_string())
    buf, off = K.string_bytes(pa.compute.binary_join_element_wise(space, plain, pa.scalar("", pa.large_string())))
    n = len(buf)
    begins = np.zeros(n, bool)
    if n > 2:
        before, here, after = buf[:-2], buf[1:-1], buf[2:]
        visible = (after > 32) & (after < 127)
        begins[1:-1] = (here == 32) & (after != 32) & (
            ((before > 32) & (before < 127)) | ((before >= 128) & visible))
    # neither the last byte of a row nor the byte before it may look into the next row
    ends = off[1:][np.diff(off) > 0]
    begins[ends - 1] = False
    begins[off[:-1][np.diff(off) > 0]] = True
    return buf, off, np.flatnonzero(begins)


def spelled_wrong(side, ids, count, buf, start):
    """Words whose tokens do not spell their bytes; ``start`` has the end of the last word behind it."""
    raw, begin, length = side
    n = length[ids]
    per_word = np.bincount(np.repeat(np.arange(len(count)), count), weights=n, minlength=len(count)).astype(np.int64)
    wrong = per_word != np.diff(start)
    out = raw[K.csr_indices(begin[ids], n)]
    if not wrong.any():
        differ = np.concatenate([[0], np.cumsum(out != buf)])
        return differ[start[1:] - start[0]] != differ[start[:-1] - start[0]]
    at = np.concatenate([[0], np.cumsum(per_word)])
    for w in np.flatnonzero(~wrong).tolist():
        wrong[w] = out[at[w]:at[w + 1]].tobytes() != buf[start[w] - start[0]:start[w + 1] - start[0]].tobytes()
    return wrong


def overlaps(start_a, start_b, doc_a, doc_b):
    """(index into A, index into B) of all overlapping tokens; starts rise over the whole run."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    covers_a = pd.merge_asof(a, b.assign(other=b["at"]), on="at", by="doc")
    covers_b = pd.merge_asof(b, a.assign(other=a["at"]), on="at", by="doc")
    covers_b = covers_b[covers_b["other"] != covers_b["at"]]  # equal starts: the pair came from the first direction
    return (np.concatenate([covers_a["a"].to_numpy(), covers_b["a"].to_numpy()]),
            np.concatenate([covers_a["b"].to_numpy(), covers_b["b"].to_numpy()]))


def group_bytes(digits, ids, sides, closing):
    """Bytes of ``a1,a2|b1;...`` for tokens in group order, and the end of every token in them."""
    chars, begin, length = digits
    n = length[ids]
    ends = np.cumsum(n + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    mark = np.zeros(len(out), bool)
    mark[ends - 1] = True
    out[mark] = np.where(closing, np.where(sides == 0, ord("|"), ord(";")), ord(","))
    out[~mark] = chars[K.csr_indices(begin[ids], n)]
    return out, ends


class Stretch:
    """Documents aligned so far and what they hold."""

    def __init__(self, t: Tokenizers):
        self.t, self.bytes = t, 0
        self.doc_id, self.figures, self.hashes, self.keys, self.times, self.bad = [], [], {}, [], [], set()

    def add(self, ids: pa.Array, column: pa.Array):
        first = len(self.doc_id)
        self.doc_id += ids.to_pylist()
        figures = np.zeros((len(ids), len(FIGURES)), np.int64)
        self.figures.append(figures)
        buf, off, start = spaced_words(column)
        self.bytes += len(buf)
        doc = np.searchsorted(off, start, side="right") - 1
        bounds = np.append(start, len(buf))
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + RUN_BYTES, side="right")) - 1)
            self.run(buf[bounds[lo]:bounds[hi]], bounds[lo:hi + 1], doc[lo:hi], first, figures)
            lo = hi

    def run(self, buf, bounds, doc, first, figures):
        t = self.t
        at = bounds - bounds[0]
        words = pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf.tobytes()))
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        sides = []
        wrong = np.zeros(len(doc), bool)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for table, (ids, n) in zip((t.bytes_a, t.bytes_b), t.encode(words, code), strict=True):
            wrong |= spelled_wrong(table, ids, n, buf, bounds)
            sides.append([ids, n, table[2]])
        if wrong.any():
            self.bad |= set((first + np.unique(doc[wrong])).tolist())
        if self.bad:
            good = ~np.isin(doc + first, list(self.bad))
            for s in sides:
                s[0], s[1] = s[0][np.repeat(good, s[1])], s[1][good]
            doc = doc[good]
        if not len(doc):
            return
        (a, n_a, len_a), (b, n_b, len_b) = sides
        doc_a, doc_b = np.repeat(doc, n_a), np.repeat(doc, n_b)
        end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        i, j = overlaps(end_a - len_a[a], end_b - len_b[b], doc_a, doc_b)
        key, times = np.unique((doc_a[i] + first) * t.pairs + a[i] * t.size_b + b[j], return_counts=True)
        self.keys.append(key)
        self.times.append(times)
        closes_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        closes_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        for c, which in enumerate((doc_a, doc_b, doc_a[closes_a], doc_a[i])):
            figures[:, c] += np.bincount(which, minlength=len(figures))
        order = np.argsort(np.concatenate([2 * (np.cumsum(closes_a) - closes_a), 2 * (np.cumsum(closes_b) - closes_b) + 1]),
                           kind="stable")
        side = (order >= len(a)).astype(np.int8)
        text, ends = group_bytes(t.digits, np.concatenate([a, b])[order], side,
                                 np.concatenate([closes_a, closes_b])[order])
        rows, last = np.unique(np.concatenate([doc_a, doc_b])[order][::-1], return_index=True)
        stop = ends[len(order) - 1 - last]
        for d, x, y in zip((rows + first).tolist(), [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            if d in self.hashes:
                self.hashes[d].update(b";")
            else:
                self.hashes[d] = hashlib.sha256()
            self.hashes[d].update(text[x:y - 1])

    def row(self, batch: int) -> pa.RecordBatch:
        n = len(self.doc_id)
        figures = np.concatenate(self.figures) if self.figures else np.zeros((0, len(FIGURES)), np.int64)
        sha = [self.hashes[d].hexdigest() if d in self.hashes else "" for d in range(n)]
        key = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        times = np.concatenate(self.times) if self.times else np.zeros(0, np.int64)
        if self.bad:
            bad = sorted(self.bad)
            figures[bad] = 0
            for d in bad:
                sha[d] = ""
            good = ~np.isin(key // self.t.pairs, bad)
            key, times = key[good], times[good]
        pair, which = np.unique(key % self.t.pairs, return_inverse=True)
        links = np.bincount(which, weights=times, minlength=len(pair)).astype(np.int64)
        first = np.searchsorted(key // self.t.pairs, np.arange(n + 1))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([batch], pa.int64()), one(self.doc_id, pa.int64()), *(one(f, pa.int64()) for f in figures.T),
             one(sha, pa.string()), one(pair, pa.int64()), one(links, pa.int64()),
             *(pa.array([x.astype(kind).tobytes()], pa.binary())
               for x, kind in ((first, np.int64), (which, np.uint32), (times, np.uint32)))],
            names=[f.split()[0] for f in STRETCH_SCHEMA.split(", ")])


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per stretch of documents (``STRETCH_SCHEMA``), written to the checkpoint folder."""
    with open(b_file, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((byte_ranks(a_file), model))

    def task(batches):
        K.tidy()
        t = Tokenizers(shared.value)
        held, batch = Stretch(t), TaskContext.get().partitionId() << 32
        for rows in batches:
            for lo, hi in K.row_slices(rows.column(1), SLICE_BYTES):
                held.add(rows.column(0).slice(lo, hi - lo), rows.column(1).slice(lo, hi - lo))
                if held.bytes >= BATCH_BYTES:
                    yield held.row(batch)
                    held, batch = Stretch(t), batch + 1
        if held.doc_id:
            yield held.row(batch)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, STRETCH_SCHEMA),
                       name="token-align")


def pair_weights(stretches: DataFrame, size_b: int) -> DataFrame:
    """(pair, total, best): links of every id pair over the corpus; best where no pair of the same B id has more."""
    total = (stretches.select(F.inline(F.arrays_zip("pair", "links"))).groupBy("pair")
             .agg(F.sum("links").alias("total")).withColumn("b", F.col("pair") % size_b))
    highest = total.groupBy("b").agg(F.max("total").alias("highest"))  # a row per id of the vocabulary at most
    return total.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document: tokens of both sides, groups, links, how many links are a best pair, the sum of the links' corpus
    numbers and the digest of the groups."""
    import sentencepiece
    stretches = aligned(docs, a_file, b_file)
    weights = pair_weights(stretches, sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size())
    wanted = stretches.select("batch", F.explode("pair").alias("pair")).join(weights, "pair")
    held = stretches.drop("pair", "links").withColumnRenamed("batch", "stretch")

    def task(stretch: pa.Table, pairs: pa.Table) -> pa.Table:
        row = stretch.combine_chunks().to_batches()[0]
        value = {name: row.column(k)[0] for k, name in enumerate(row.schema.names)}
        first, which, times = (np.frombuffer(value[c].as_buffer(), kind) for c, kind in (
            ("first", np.int64), ("which", np.uint32), ("times", np.uint32)))
        order = np.argsort(pairs["pair"].to_numpy())  # each pair of the stretch once: the order of its numbers
        sums = []
        for c in ("best", "total"):
            added = pairs[c].to_numpy().astype(np.int64)[order][which]
            added *= times
            np.cumsum(added, out=added)
            added = np.concatenate([[0], added])
            sums.append(added[first[1:]] - added[first[:-1]])
        return pa.table([value["doc_id"].values, *(value[c].values for c in FIGURES), *sums, value["groups_sha256"].values],
                        names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    # one stretch at a time reaches Python: an Arrow batch of joined rows would hold many, of tens of megabytes each
    both = held.groupBy("stretch").cogroup(wanted.groupBy("batch")).applyInArrow(task, RESULT_SCHEMA)
    out = materialize(both, name="token-align-result")
    discard(stretches)
    return out
