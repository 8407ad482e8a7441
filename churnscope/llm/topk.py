"""Exact top-k inner-product search, block at a time.

Vectors become integer vectors floor(scale * x). They are put in order of their nearest pivot (a bounded sample of
vectors), so that neighbours in the order are alike, and cut into document-range blocks. A block row holds its vector
ids, its forward index (the integer matrix) and, per term (component), the largest and smallest value in the block.

The bound of a query for a block is the sum over its terms of the largest possible product. Queries form chunks of
consecutive blocks; the k-th score inside a query's own block is its first threshold. For every chunk, the blocks whose
bound reaches the threshold of one of its queries are sent to it in order of falling bound; the task scores a block
through its forward index for those queries only whose current k-th score the bound reaches, and raises the k-th scores.
A block below all k-th scores is skipped, so is all that follows for a query once its bounds fall below. Equal bounds are
scored, because ties go to the smaller id. The result is exact.

The queries are a stated set (``is_query``) met with all rows in blocks. Block summaries reach the tasks as broadcasts of
at most ``PAGE_BYTES``; further pages are further passes over the chunks. Block and chunk sizes are fixed, a task holds
one chunk and one block at a time.

Edge cases: vectors that are null, empty or hold null or non-finite components, and null ids, take no part; shorter
vectors are padded with zeros; rows with the query's own vec_id are no candidates; repeated ids are separate candidates
and separate queries; fewer than k candidates are all returned; an empty table gives an empty result; products beyond
2^53 are computed in Python integers and cut to 64 bits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialize

SCALE = 64
K = 20
PIVOTS = 64
BLOCK = 1024
CHUNK = 512
PAGE_BYTES = 32 << 20

BLOCK_SCHEMA = "block long, dim int, ids binary, own binary, forward binary, high binary, low binary"
CHUNK_SCHEMA = "chunk long, dim int, ids binary, vectors binary, kth binary"
RESULT_SCHEMA = "query_id long, rank int, vec_id long, score long"


def integer_vectors(table: DataFrame, is_query: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, q, v): valid rows with their components floor(scale * x) as double and the query mark."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (table.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
            .where((F.size("embedding") > 0) & good)
            .select(F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("q"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = int(n.max(initial=0))
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where no sum can pass 2^53, else in Python integers."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not dim:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim < 2**53:
        return a @ b.T
    ints = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return ints[0] @ ints[1].T


def as_long(score) -> int:
    return max(-2**63, min(2**63 - 1, int(score)))


def best(scores: np.ndarray, ids: np.ndarray, k: int):
    """The k best (score, id) of one query: falling score, then rising id."""
    if len(scores) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        scores, ids = scores[keep], ids[keep]
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return scores[order], ids[order]


def compact(m: np.ndarray) -> bytes:
    """Integer matrix in the least of four widths; the first byte tells which."""
    top = np.abs(m).max(initial=0)
    for code, kind, limit in ((1, np.int8, 128), (2, np.int16, 2**15), (4, np.int32, 2**31)):
        if top < limit:
            return bytes([code]) + m.astype(kind).tobytes()
    return bytes([8]) + m.astype(np.float64).tobytes()


def expand(raw: bytes, dim: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[raw[0]]
    return np.frombuffer(raw, kind, offset=1).astype(np.float64).reshape(-1, dim)


def build_blocks(vectors: DataFrame, size: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The block table, written to the checkpoint folder."""
    spark = vectors.sparkSession
    sample = [r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()]
    dim = max(map(len, sample), default=0)
    centres = np.array([x + [0.0] * (dim - len(x)) for x in sample]).reshape(len(sample), dim)
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(centres / np.where(norm > 0, norm, 1))

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        m, c = matrix(v), shared.value
        d = min(m.shape[1], c.shape[1]) if len(c) else 0
        return pa.array(np.argmax(m[:, :d] @ c[:, :d].T, axis=1).astype(np.int32) if d else np.zeros(len(m), np.int32))

    def task(batches):
        block = TaskContext.get().partitionId() << 32
        ids, marks, rows, held = [], [], [], 0

        def flush(ids, marks, rows):
            dim = max(r.shape[1] for r in rows)
            m = np.concatenate([np.pad(r, ((0, 0), (0, dim - r.shape[1]))) for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([dim], pa.int32()),
                 *(pa.array([x], pa.binary()) for x in (
                     np.concatenate(ids).tobytes(), np.concatenate(marks).tobytes(), compact(m),
                     m.max(axis=0).tobytes(), m.min(axis=0).tobytes()))],
                names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            m = matrix(batch.column(2))
            i, q = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(i):
                n = min(size - held, len(i) - at)
                ids.append(i[at:at + n])
                marks.append(q[at:at + n])
                rows.append(m[at:at + n])
                at, held = at + n, held + n
                if held == size:
                    yield flush(ids, marks, rows)
                    ids, marks, rows, held, block = [], [], [], 0, block + 1
        if held:
            yield flush(ids, marks, rows)

    ordered = (vectors.withColumn("pivot", nearest("v")).repartitionByRange("pivot", "vec_id")
               .sortWithinPartitions("pivot", "vec_id").select("vec_id", "q", "v"))
    return materialize(ordered.mapInArrow(task, BLOCK_SCHEMA), name="topk-blocks")


def build_chunks(blocks: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """Chunks of queries of consecutive blocks with the k-th score inside each query's own block."""
    def task(batches):
        chunk = TaskContext.get().partitionId() << 32
        ids, vectors, kth, held = [], [], [], 0

        def flush():
            dim = max(v.shape[1] for v in vectors)
            m = np.concatenate([np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in vectors])
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([dim], pa.int32()),
                 *(pa.array([x], pa.binary()) for x in (np.concatenate(ids).tobytes(), compact(m),
                                                        np.concatenate(kth).tobytes()))],
                names=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                m, own = expand(row["forward"], row["dim"]), np.frombuffer(row["own"], bool)
                if not own.any():
                    continue
                i = np.frombuffer(row["ids"], np.int64)
                scores = product(m[own], m).astype(np.float64)
                scores[i[own][:, None] == i[None, :]] = -np.inf
                t = np.full(own.sum(), -np.inf)
                if len(i) >= k:
                    t = np.partition(scores, len(i) - k, axis=1)[:, len(i) - k]
                t = np.where(np.abs(t) < 2**52, t, -np.inf)  # beyond exact doubles no threshold is taken
                for s in range(0, len(t), size):
                    ids.append(i[own][s:s + size])
                    vectors.append(m[own][s:s + size])
                    kth.append(t[s:s + size])
                    held += len(ids[-1])
                    if held >= size:
                        yield flush()
                        ids, vectors, kth, held, chunk = [], [], [], 0, chunk + 1
        if held:
            yield flush()

    return materialize(blocks.mapInArrow(task, CHUNK_SCHEMA), name="topk-chunks")


def bounds(vectors: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x blocks) of the scores, from the term maxima and minima of the blocks."""
    up = product(np.maximum(vectors, 0), high)
    return (up + product(np.minimum(vectors, 0), low)).astype(np.float64)


def candidate_blocks(chunks: DataFrame, blocks: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(chunk, block, top, bound): blocks that some query of the chunk must look at, with every query's bound."""
    spark = chunks.sparkSession
    summary = blocks.select("block", "high", "low")
    size = summary.agg(F.sum(F.length("high") + F.length("low"))).first()[0] or 0
    pages = max(1, -(-int(size) // page_bytes))
    out = None
    for p in range(pages):
        rows = summary.where(F.pmod(F.xxhash64("block"), F.lit(pages)) == p).collect()
        shared = spark.sparkContext.broadcast([(r.block, bytes(r.high), bytes(r.low)) for r in rows])

        def task(batches, shared=shared):
            names = np.array([b for b, _, _ in shared.value], np.int64)
            dim = max((len(h) // 8 for _, h, _ in shared.value), default=0)
            ends = [np.zeros((len(names), dim)) for _ in range(2)]
            for i, (_, *both) in enumerate(shared.value):
                for end, raw in zip(ends, both, strict=True):
                    end[i, :len(raw) // 8] = np.frombuffer(raw)
            for batch in batches:
                for row in batch.to_pylist():
                    v = expand(row["vectors"], row["dim"])
                    b = bounds(v, *ends)
                    need = np.flatnonzero((b >= np.frombuffer(row["kth"])[:, None]).any(axis=0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(need), row["chunk"])), pa.array(names[need]),
                         pa.array(b[:, need].max(axis=0) if len(need) else np.zeros(0)),
                         pa.array([b[:, j].tobytes() for j in need], pa.binary())],
                        names=["chunk", "block", "top", "bound"])

        part = chunks.mapInArrow(task, "chunk long, block long, top double, bound binary")
        out = part if out is None else out.union(part)
    return out


def search(table: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK,
           chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row of ``table`` (vec_id, embedding)."""
    blocks = build_blocks(integer_vectors(table, is_query, scale), block)
    chunks = build_chunks(blocks, k, chunk)
    wanted = candidate_blocks(chunks, blocks)
    forward = blocks.select("block", F.col("dim").alias("block_dim"), F.col("ids").alias("block_ids"), "forward")
    # the first row of a chunk carries its queries; its blocks follow in order of falling bound
    heads = chunks.select("chunk", F.lit(float("inf")).alias("top"), F.col("kth").alias("bound"),
                          F.col("dim").alias("d"), F.col("ids").alias("i"), F.col("vectors").alias("m"),
                          F.lit(-1).cast("long").alias("block"))
    bodies = wanted.join(forward, "block").select("chunk", "top", "bound", F.col("block_dim").alias("d"),
                                                  F.col("block_ids").alias("i"), F.col("forward").alias("m"), "block")
    stream = (heads.union(bodies).repartition("chunk")
              .sortWithinPartitions("chunk", F.desc("top"), F.asc("block")))

    def task(batches):
        state = None

        def results(state):
            q, rank, vec, score = [], [], [], []
            for qid, (s, i) in zip(state["ids"], state["found"], strict=True):
                q += [qid] * len(i)
                rank += range(1, len(i) + 1)
                vec += i.tolist()
                score += [as_long(x) for x in s]
            return pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(vec, pa.int64()),
                 pa.array(score, pa.int64())], names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                ids, m = np.frombuffer(row["i"], np.int64), expand(row["m"], row["d"])
                if row["block"] == -1:
                    if state:
                        yield results(state)
                    none = (np.zeros(0), np.zeros(0, np.int64))
                    state = {"ids": ids, "vectors": m, "found": [none] * len(ids),
                             "kth": np.frombuffer(row["bound"]).copy()}
                    continue
                live = np.flatnonzero(np.frombuffer(row["bound"]) >= state["kth"])
                if not len(live):
                    continue
                scores = product(state["vectors"][live], m)
                for at, s in zip(live, scores, strict=True):
                    keep = (ids != state["ids"][at]) & (s >= state["kth"][at])
                    have_s, have_i = state["found"][at]
                    s, i = best(np.concatenate([have_s, s[keep]]), np.concatenate([have_i, ids[keep]]), k)
                    state["found"][at] = (s, i)
                    if len(i) == k and abs(s[-1]) < 2**52:
                        state["kth"][at] = max(state["kth"][at], float(s[-1]))
        if state:
            yield results(state)

    return stream.select("bound", "d", "i", "m", "block").mapInArrow(task, RESULT_SCHEMA)
