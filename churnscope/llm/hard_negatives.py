"""Hard negatives by Four-Russians scoring: exact integer inner products from tables of subset sums.

Components become floor(scale * x). A candidate is stored as bit planes: for plane p, the p-th bits (two's complement) of
eight neighbouring dimensions form one byte. For an anchor and each group of eight dimensions a table holds the sums of all
256 subsets of its components, so a byte of a plane looks up what these eight bits contribute; the planes are added from
the sign plane down, doubling in between (shift and add). The result is the full inner product, no estimate.

An anchor's positives are its best other rows of the same label; its negatives, for each positive, the best rows of another
label whose score lies between ``low`` and ``high`` percent of the positive's. Plan: (1) rows are dealt by (label bucket,
vec_id) in ranges and packed into candidate blocks of ``BLOCK`` rows; anchors are written as rows. (2) positives: in each
bucket, anchors and blocks form a grid of cells of bounded size; a task keeps the best of its cell, a window the best of
all cells. (3) negatives: the same over one grid of all anchors and all blocks. A cell receives its anchors first, builds
the tables, then streams its blocks; blocks of a hot label are as many cells as they need. Anchors are a stated set (2 % of
the rows by default) met with all rows in blocks: the work grows with their product, as any exact form does.

Edge cases: rows with a null id or label, a null vector or a null or non-finite component take no part; vectors of
different length count as padded with zeros (an empty one is the zero vector); components beyond 64 bits are cut to that
range, scores likewise, and compare as cut; rows with the anchor's own vec_id are never its candidates; repeated ids are
separate anchors and candidates; a negative positive score leaves no room for negatives, a score of 0 admits exactly 0;
anchors without positives give no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import discard, materialize
from . import kernels as K

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95      # percent of the positive's score
BUCKETS = 64            # label buckets of the grid for positives
BLOCK = 2048            # candidates of a block
CELL_BLOCKS = 4         # blocks of a cell
TILE = 64               # anchors whose tables are used together
TABLE_BYTES = 32 << 20  # tables of a cell

MOST = 2**63 - 1
BLOCK_SCHEMA = "bucket int, block long, n int, dim int, planes int, ids binary, labels binary, codes binary"
CELL_SCHEMA = ("cell long, uid long, vec_id long, label long, v array<long>, targets array<struct<id:long,score:long>>, "
               "planes int, dim int, ids binary, labels binary, codes binary")
FOUND_SCHEMA = "uid long, anchor_id long, target long, target_score long, slot int, vec_id long, score long"


def integer_rows(table: DataFrame, label: Column, is_anchor: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, anchor, v): rows that take part, with their integer components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Spark's floor of a double is a long, cut to its range
    return (table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
            .where(good)
            .select(F.col("vec_id").cast("long"), label.cast("long").alias("label"),
                    F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to a multiple of eight columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), -(-int(n.max(initial=0)) // 8) * 8), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def bit_planes(m: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of planes, bytes (plane, group of eight columns, row)) of the two's complement bits of ``m``."""
    top = max(int(m.max(initial=0)), ~int(m.min(initial=0)))
    planes = top.bit_length() + 1
    codes = np.empty((planes, m.shape[1] // 8, len(m)), np.uint8)
    for p in range(planes):
        codes[p] = np.packbits((m >> p & 1).astype(np.uint8), axis=1, bitorder="little").T
    return planes, codes


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Table (group, byte, anchor): the sum of an anchor's components of the group whose bits are set in the byte."""
    groups = anchors.reshape(len(anchors), -1, 8)
    out = np.zeros((groups.shape[1], 256, len(anchors)), anchors.dtype)
    for bit in range(8):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + groups[:, :, bit].T[:, None, :]
    return out


def table_type(anchors: np.ndarray, planes: int):
    """Narrowest type in which no table entry and no score can overflow."""
    most = max(int(anchors.max(initial=0)), -int(anchors.min(initial=0))) * max(1, anchors.shape[1]) << planes
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(row, anchor) inner products: one lookup per plane and group, planes joined by doubling."""
    planes, groups, n = codes.shape
    total = np.zeros((n, table.shape[2]), table.dtype)
    for p in range(planes - 1, -1, -1):
        if p < planes - 1:
            total += total
        for g in range(groups):
            found = table[g].take(codes[p, g], axis=0)
            if p == planes - 1 and planes:
                total -= found  # the sign plane
            else:
                total += found
    return total


def as_long(s: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers, cut to their range."""
    return s.astype(np.int64) if s.dtype != object else np.array(
        [[max(-MOST - 1, min(MOST, x)) for x in row] for row in s], np.int64).reshape(s.shape)


class Best:
    """The ``k`` best (score, id) of every slot (anchor, target) with floor <= score <= ceiling."""

    def __init__(self, floor: np.ndarray, ceiling: np.ndarray, k: int):
        self.floor, self.ceiling, self.k = floor.copy(), ceiling, k  # the floor rises to the k-th score
        n = len(floor)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, MOST, np.int64)

    def offer(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score >= self.floor[slots]) & (score <= self.ceiling[slots])
        if not keep.any():
            return
        slot = np.concatenate([self.slot, slots[keep]])
        score = np.concatenate([self.score, score[keep]])
        ids = np.concatenate([self.id, ids[keep]])
        order = np.lexsort((ids, ~score, slot))  # ~score: falling, without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.concatenate([[True], slot[1:] != slot[:-1]])
        first = np.flatnonzero(new)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        best = rank < self.k
        self.slot, self.score, self.id = slot[best], score[best], ids[best]
        full = rank == self.k - 1
        self.floor[slot[full]] = score[full]


def pack_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Candidate blocks (``BLOCK_SCHEMA``) of one label bucket each, written to the checkpoint folder."""
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]

    def block(number, bucket, ids, labels, m):
        planes, codes = bit_planes(m)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], kind) for x, kind in ((bucket, pa.int32()), (number, pa.int64()), (len(ids), pa.int32()),
                                                 (m.shape[1], pa.int32()), (planes, pa.int32()))]
            + [pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, codes)], names=names)

    def task(batches):
        number, held = TaskContext.get().partitionId() << 32, []

        def flush():
            dim = max(h[3].shape[1] for h in held)
            m = np.concatenate([np.pad(h[3], ((0, 0), (0, dim - h[3].shape[1]))) for h in held])
            return block(number, held[0][0], np.concatenate([h[1] for h in held]),
                         np.concatenate([h[2] for h in held]), m)

        for batch in batches:
            bucket, ids, labels = (batch.column(k).to_numpy() for k in range(3))
            m = matrix(batch.column(3))
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (held[0][0] != bucket[lo] or sum(len(h[1]) for h in held) >= size):
                        yield flush()
                        held, number = [], number + 1
                    n = min(hi - lo, size - sum(len(h[1]) for h in held))
                    held.append((int(bucket[lo]), ids[lo:lo + n], labels[lo:lo + n], m[lo:lo + n]))
                    lo += n
        if held:
            yield flush()

    ordered = (rows.select(bucket_of("label"), "vec_id", "label", "v").repartitionByRange("bucket", "vec_id", "label")
               .sortWithinPartitions("bucket").select("bucket", "vec_id", "label", "v"))
    return materialize(ordered.mapInArrow(task, BLOCK_SCHEMA), name="hardneg-blocks")


def bucket_of(label: str) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(BUCKETS)).cast("int").alias("bucket")


def grid(anchors: DataFrame, blocks: DataFrame, by_bucket: bool, cell_anchors: int, cell_blocks: int) -> DataFrame:
    """Rows of all cells, a cell's anchors before its blocks. A cell is (bucket, part of the anchors, part of the blocks);
    one of ``BUCKETS`` buckets of labels, or all in one."""
    spark = anchors.sparkSession
    across_down = lambda a, b: (-(-a // cell_anchors), -(-b // cell_blocks))
    if by_bucket:
        sizes = (anchors.groupBy("bucket").agg(F.count("*").alias("a"))
                 .join(blocks.groupBy("bucket").agg(F.count("*").alias("b")), "bucket").collect())
        cells, layout = 0, []
        for r in sorted(sizes):
            across, down = across_down(r["a"], r["b"])
            layout.append((r["bucket"], cells, across, down))
            cells += across * down
        plan = F.broadcast(spark.createDataFrame(layout, "bucket int, base long, across int, down int"))  # BUCKETS rows at most
        anchors, blocks = anchors.join(plan, "bucket"), blocks.join(plan, "bucket")
    else:
        across, down = across_down(anchors.count(), blocks.count())
        cells = across * down
        whole = {"base": F.lit(0).cast("long"), "across": F.lit(max(across, 1)), "down": F.lit(max(down, 1))}
        anchors, blocks = anchors.withColumns(whole), blocks.withColumns(whole)
    i, j = F.col("i"), F.col("j")
    cell = (F.col("base") + i * F.col("down") + j).alias("cell")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    empty = {c.split(" ", 1)[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in CELL_SCHEMA.split(", ")}
    heads = (anchors.withColumn("i", part("uid", "across"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("down") - 1))))
    bodies = (blocks.withColumn("j", part("block", "down"))
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("across") - 1))))
    names = list(empty)
    heads = heads.select(cell, *(c if c in anchors.columns else empty[c].alias(c) for c in names[1:]))
    bodies = bodies.select(cell, *(c if c in blocks.columns else empty[c].alias(c) for c in names[1:]))
    both = heads.union(bodies)
    # cells take far longer to score than to read: one cell a task, up to a number of tasks any cluster schedules
    return (both.repartitionById(min(max(cells, 1), 100_000), (F.col("cell") % min(max(cells, 1), 100_000)).cast("int"))
            .sortWithinPartitions("cell", F.col("uid").asc_nulls_last()))


class Cell:
    """Anchors of a cell with their tables, and the best candidates so far."""

    def __init__(self, rows: list[dict], same_label: bool, k: int, low: int, high: int):
        self.same = same_label
        rows.sort(key=lambda r: r["label"])
        self.uid, self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("uid", "vec_id", "label"))
        dim = -(-max((len(r["v"]) for r in rows), default=0) // 8) * 8
        self.m = np.zeros((len(rows), dim), np.int64)
        for r, row in enumerate(rows):
            self.m[r, :len(row["v"])] = row["v"]
        targets = [r["targets"] or [None] for r in rows]
        self.width = max(map(len, targets), default=1)
        floor, ceiling = (np.full((len(rows), self.width), x, np.int64) for x in (MOST, -MOST - 1))
        self.target = np.zeros((len(rows), self.width, 2), np.int64)
        for r, mine in enumerate(targets):
            for c, t in enumerate(mine):
                if t is None:
                    floor[r, c], ceiling[r, c] = -MOST - 1, MOST
                else:
                    self.target[r, c] = t["id"], t["score"]
                    floor[r, c], ceiling[r, c] = -(-low * t["score"] // 100), high * t["score"] // 100
        self.best = Best(floor.ravel(), ceiling.ravel(), k)
        self.tables: dict = {}

    def table(self, lo: int, dim: int, planes: int) -> np.ndarray:
        kind = table_type(self.m, planes)
        if (lo, kind) not in self.tables:
            part = self.m[lo:lo + TILE]
            if kind is object:
                part = np.array([[int(x) for x in row] for row in part], object).reshape(part.shape)
            self.tables[lo, kind] = subset_sums(part.astype(kind))
        return self.tables[lo, kind][:dim // 8]

    def meet(self, row: dict) -> None:
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        codes = np.frombuffer(row["codes"], np.uint8).reshape(row["planes"], row["dim"] // 8, len(ids))
        dim = min(row["dim"], self.m.shape[1])
        codes = codes[:, :dim // 8]
        for lo in range(0, len(self.m), TILE):
            mine = self.labels[lo:lo + TILE]
            rows = np.arange(len(ids))
            if self.same:
                rows = np.flatnonzero(np.isin(labels, mine))
                if not len(rows):
                    continue
            # the sign plane needs a table even when no dimension is shared
            s = (as_long(scores(self.table(lo, dim, row["planes"]), codes[:, :, rows])) if dim
                 else np.zeros((len(rows), len(mine)), np.int64))
            fits = ((labels[rows][:, None] == mine) == self.same) & (ids[rows][:, None] != self.ids[lo:lo + TILE])
            slots = np.arange(lo, lo + len(mine))[:, None] * self.width + np.arange(self.width)
            for c in range(self.width):
                f, top = self.best.floor[slots[:, c]], self.best.ceiling[slots[:, c]]
                r, a = np.nonzero(fits & (s >= f) & (s <= top))
                self.best.offer(slots[a, c], s[r, a], ids[rows[r]])

    def found(self) -> pa.RecordBatch:
        at, c = self.best.slot // self.width, self.best.slot % self.width
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.uid[at], self.ids[at], self.target[at, c, 0], self.target[at, c, 1],
                                   c.astype(np.int32), self.best.id, self.best.score)],
            names=[f.split()[0] for f in FOUND_SCHEMA.split(", ")])


def best_of_cells(cells: DataFrame, same_label: bool, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(``FOUND_SCHEMA``, rank): the k best per anchor and target over all cells."""
    def task(batches):
        K.tidy()
        at, anchors, cell = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r].as_py() for k, name in enumerate(batch.schema.names)}
                if row["cell"] != at:
                    if cell is not None:
                        yield cell.found()
                    at, anchors, cell = row["cell"], [], None
                if row["uid"] is not None:
                    anchors.append(row)
                elif anchors:
                    cell = cell or Cell(anchors, same_label, k, low, high)
                    cell.meet(row)
        if cell is not None:
            yield cell.found()

    w = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "vec_id")
    return cells.mapInArrow(task, FOUND_SCHEMA).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(table: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK,
         cell_blocks: int = CELL_BLOCKS, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchor rows of ``table``
    (vec_id, embedding, label)."""
    rows = integer_rows(table, F.col("label") if label is None else label, is_anchor, scale)
    blocks = pack_blocks(rows, block)
    anchors = materialize(rows.where("anchor").select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v",
                                                      bucket_of("label")), name="hardneg-anchors")
    dim = anchors.agg(F.max(F.size("v"))).first()[0] or 8
    cell_anchors = max(TILE, table_bytes // (-(-dim // 8) * 256 * 8) // TILE * TILE)
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("targets")
    same = best_of_cells(grid(anchors.select("*", none), blocks, True, cell_anchors, cell_blocks), True, positives)
    targets = (same.where("score >= 0").groupBy("uid")
               .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("t"))
               .select("uid", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["score"].alias("score")))
                       .alias("targets")))
    wanted = materialize(anchors.join(targets, "uid"), name="hardneg-targets")
    found = best_of_cells(grid(wanted, blocks, False, cell_anchors, cell_blocks), False, negatives, low, high)
    out = materialize(found.select("anchor_id", F.col("target").alias("positive_id"), "rank",
                                   F.col("vec_id").alias("negative_id"), F.col("target_score").alias("positive_score"),
                                   F.col("score").alias("negative_score")), name="hardneg")
    discard(blocks, anchors, wanted)
    return out
