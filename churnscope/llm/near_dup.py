"""MinHash near-duplicates: bottom-k sketches from one hash function.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; the set of a document is its distinct
runs of five words (its whole word sequence when it has fewer), kept as 64-bit hashes. Two documents are
linked when ``100 * |A and B| >= 85 * |A or B|`` (``LINK_PERCENT``).

Method
1. One pass computes every set, its size, a 128-bit digest and the ``k`` smallest hashes (the sketch). Sketch values
   are stored with the top bit flipped, so that Spark's signed order is the unsigned order they were chosen by. Equal
   sets form a class, represented by its smallest doc_id; only representatives go on.
2. Inverted lists of retained values: a linked pair shares at least ``o`` sketch values (5 standard deviations
   below the expected share, ``least_overlap``), so it must share one of the ``k - o + 1`` rarest values of
   either sketch. Values are ranked by the number of sketches that hold them; values held by one sketch only
   produce no list. Frequent passages are never the rarest values of a text that has anything of its own.
3. Lists generate pairs in rounds instead of all pairs: a round compares up to 64^r centres of a list with its
   members, links are verified and merged into components, and the next round takes centres only from members outside
   the component of the list's first centre. The rounds end when every such member has been a centre, so no link
   between two components is left out, and a family of n near copies costs about n pairs. A pair leaves the join only
   if its parity maps allow it: the map has 1,024 bits, each the parity of the number of hashes that fall on it, so
   the bits in which two maps differ never exceed the number of hashes that only one of the sets holds.
4. The union sketch (k smallest values of both sketches) estimates the similarity and drops pairs 5 standard
   deviations below the threshold; the exact Jaccard similarity of the full sets decides.

Edge cases: null text, empty text or text without words has an empty set (n_shingles 0), is linked with nothing
and keeps its own id as component. Repeated doc_ids: one row per input row; rows of one id with
different texts are one node of the link graph, whose links are verified on the text with the smaller set. Null doc_id: the row is returned with its set size and a null component, and links nothing. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import discard, materialize
from . import kernels as K
from .graph import components

SHINGLE_WORDS = 5
SKETCH_SIZE = 64
PARITY_LONGS = 16
CENTRES = 64
LINK_PERCENT = 85
DEVIATIONS = 5.0
TOP_BIT = np.uint64(1 << 63)

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, digest_a long, digest_b long, sketch array<long>, parity array<long>"


def text_sets(column: pa.Array, shingle: int = SHINGLE_WORDS):
    """Sorted distinct shingle hashes of every row, slice by slice: yields (row number, uint64 array)."""
    for lo, hi in K.row_slices(column):
        w = K.Words(column.slice(lo, hi - lo), K.SPACE_WORD)
        h = w.hashes()
        for r in range(hi - lo):
            a, b = w.first[r], w.first[r + 1]
            words = h[a:b]
            s = K.runs(words, min(shingle, b - a)) if b > a else words
            s.sort()
            if len(s) > 1:
                keep = np.ones(len(s), dtype=bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield lo + r, s


def signatures(docs: DataFrame, k: int = SKETCH_SIZE, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its ``k`` smallest hashes, one row per input row."""
    def task(batches):
        K.tidy()
        for batch in batches:
            n, da, db = [], [], []
            flat, size = [], []
            bits = 64 * PARITY_LONGS
            maps = np.zeros((batch.num_rows, bits), bool)
            for r, s in text_sets(batch.column(1), shingle):
                n.append(len(s))
                mixed = K.mix64(s + np.uint64(0x51ED27))
                da.append(int(np.add.reduce(mixed, dtype=np.uint64).view(np.int64)))
                db.append(int(np.bitwise_xor.reduce(mixed).view(np.int64)) if len(s) else 0)
                flat.append(s[:k] ^ TOP_BIT)  # signed order of the column = unsigned order of the hashes
                size.append(min(k, len(s)))
                maps[r] = np.bincount(((s >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            off = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=off[1:])
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            parity = np.packbits(maps, axis=1, bitorder="little").view(np.int64).reshape(-1)
            every = np.arange(len(n) + 1, dtype=np.int32) * PARITY_LONGS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(da, pa.int64()), pa.array(db, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(values)),
                 pa.ListArray.from_arrays(pa.array(every), pa.array(parity))],
                names=["doc_id", "n_shingles", "digest_a", "digest_b", "sketch", "parity"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, SIGNATURE_SCHEMA)


def least_overlap(n, percent: int = LINK_PERCENT, deviations: float = DEVIATIONS):
    """Fewest shared values of two sketches of ``n`` values whose sets are linked (a Column or a number)."""
    j = percent / 100.0
    if isinstance(n, int):
        return max(1, math.floor(n * j - deviations * math.sqrt(n * j * (1 - j))))
    return F.greatest(F.lit(1), F.floor(n * j - F.sqrt(n * (j * (1 - j))) * deviations).cast("int"))


def inverted_lists(reps: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """(v, rep, n): the lists of retained values, only the rarest values of each sketch (see module text)."""
    postings = reps.where("n_shingles > 0").select("rep", "n_shingles", F.size("sketch").alias("held"),
                                                   F.explode("sketch").alias("v"))
    shared = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = (postings.join(shared, "v").groupBy("rep")
            .agg(F.first("n_shingles").alias("n"), F.first("held").alias("held"),
                 F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")))  # at most k values
    prefix = F.col("held") - least_overlap(F.col("held"), percent) + 1
    rare = held.withColumn("take", prefix - (F.col("held") - F.size("vs"))).where("take > 0")
    return rare.select("rep", "n", F.explode(F.slice("vs", F.lit(1), F.col("take"))).alias("x")).select("x.v", "rep", "n")


def estimated(pairs: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule out a link."""
    s = sketches.select("rep", "sketch", "n_shingles")
    p = (pairs.join(s.toDF("a", "sa", "na"), "a").join(s.toDF("b", "sb", "nb"), "b"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    j = percent / 100.0
    p = p.withColumn("u", union)
    both = F.size(F.array_intersect("u", F.array_intersect("sa", "sb")))
    floor = F.size("u") * j - F.sqrt(F.size("u") * (j * (1 - j))) * DEVIATIONS
    return p.where(both >= floor).select("a", "b")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(rep, s): the sorted shingle hashes of the documents named in ``ids`` (column rep)."""
    def sets(batches):
        for batch in batches:
            blobs = [s.tobytes() for _, s in text_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["rep", "s"])

    texts = docs.join(ids, F.col("doc_id") == F.col("rep")).select("doc_id", "text")
    # repeated rows of a doc_id with different texts: the smallest set stands for the id
    return materialize(texts.mapInArrow(sets, "rep long, s binary").groupBy("rep").agg(F.min("s").alias("s")),
                       name="nd-sets")


def least_difference(one: list[str], other: list[str]):
    """A lower bound of the number of hashes in one set only: bits in which the parity maps differ."""
    return sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(one[1:], other[1:], strict=True)),
               F.bit_count(F.col(one[0]).bitwiseXOR(F.col(other[0]))))


def exact_links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are linked."""
    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                m = np.concatenate([x, y])
                m.sort()
                both = int(np.count_nonzero(m[1:] == m[:-1]))
                keep.append(100 * both >= percent * (len(m) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                             names=["a", "b"])

    joined = (pairs.join(full.toDF("b", "sb"), "b").join(full.toDF("a", "sa"), "a").select("a", "b", "sa", "sb"))
    return joined.mapInArrow(compare, "a long, b long")


def links(reps: DataFrame, docs: DataFrame, k: int = SKETCH_SIZE, shingle: int = SHINGLE_WORDS,
          percent: int = LINK_PERCENT) -> DataFrame:
    """(node, component) over representatives (rep, n_shingles, sketch) of classes of equal sets.

    ``docs`` holds one text per representative (doc_id = rep) at least.
    """
    lists = inverted_lists(reps, percent).join(
        reps.select("rep", *[F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY_LONGS)]), "rep")
    every = lists = materialize(lists, name="nd-lists")
    own = [f"p{i}" for i in range(PARITY_LONGS)]
    theirs = [f"q{i}" for i in range(PARITY_LONGS)]
    first = lists.groupBy("v").agg(F.min("rep").alias("c"), F.count("*").alias("m")).where("m > 1").select("v", "c")
    lists = materialize(lists.join(first, "v"), name="nd-lists")
    discard(every)
    full = full_sets(docs, lists.select("rep").distinct(), shingle)
    # |A xor B| <= (100 - percent) / (100 + percent) * (|A| + |B|) holds for every link
    possible = (least_difference(own, theirs) * (100 + percent)
                <= (F.col("n") + F.col("nx")) * (100 - percent))
    found = tried = comp = None
    r = 0
    while True:
        if r == 0:
            members = lists
            rest = lists.where("rep = c").select("v", F.col("rep").alias("x"), F.col("n").alias("nx"),
                                                 *[F.col(a).alias(b) for a, b in zip(own, theirs, strict=True)])
            centre, apart = rest, F.lit(True)
        else:
            of = comp.toDF("rep", "k1")
            members = lists.join(of, "rep", "left").withColumn("k1", F.coalesce("k1", "rep"))
            main = comp.toDF("c", "kc")
            rest = (members.join(main, "c", "left").withColumn("kc", F.coalesce("kc", "c")).where("k1 <> kc")
                    .join(tried.select("v", F.col("x").alias("rep")), ["v", "rep"], "left_anti"))
            rest = rest.select("v", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("k1").alias("kx"),
                               *[F.col(a).alias(b) for a, b in zip(own, theirs, strict=True)])
            bucket = F.pmod(F.xxhash64("x", F.lit(r)), F.lit(CENTRES ** min(r, 10)))
            centre = (rest.groupBy("v", bucket.alias("b"))
                      .agg(F.min(F.struct("x", "nx", "kx", *theirs)).alias("z")).select("v", "z.*"))
            centre = materialize(centre, name="nd-centres")
            if centre.isEmpty():
                break
            apart = F.col("k1") != F.col("kx")
        near = members.join(centre, "v").where((F.col("rep") != F.col("x")) & possible & apart)
        pairs = near.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()
        pairs = materialize(estimated(pairs, reps, k, percent), name="nd-pairs")
        new = materialize(exact_links(pairs, full, percent), name="nd-links")
        discard(pairs)
        tried = centre.select("v", "x") if tried is None else tried.union(centre.select("v", "x"))
        if comp is None or not new.isEmpty():  # a round without links leaves the components as they are
            found = new if found is None else found.union(new)
            before, comp = comp, materialize(components(found.toDF("u", "v")), name="nd-components")
            if before is not None:
                discard(before)
        r += 1
    discard(lists, full)
    return comp


def near_duplicates(docs: DataFrame, k: int = SKETCH_SIZE, shingle: int = SHINGLE_WORDS,
                    percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept. One row per input row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sig = materialize(signatures(docs, k, shingle), name="nd-signatures")
    key = ["n_shingles", "digest_a", "digest_b"]
    classes = (sig.where("n_shingles > 0 and doc_id is not null")
               .groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"),
                                  F.first("parity").alias("parity")))
    classes = materialize(classes, name="nd-classes")
    found = links(classes, docs, k, shingle, percent)
    named = (classes.select(*key, "rep").join(found, F.col("rep") == F.col("node"), "left")
             .select(*key, F.coalesce("component", "rep").alias("component_id")))
    out = (sig.select("doc_id", *key).join(named, key, "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
