"""Line dedup over overlapping three-line windows, in DataFrame functions only.

A text is split at ``\\n``; lines without a visible character are not counted and always stay. Every three
consecutive counted lines are a window, known by a 64-bit hash of its lines. A window that occurs more than once in
the corpus keeps its first occurrence, by (doc_id, position); all later occurrences are removed, in other documents
and further down in the same one. Overlapping removed windows are merged: a line goes if any later occurrence covers
it. Texts of fewer than three counted lines never change.

Plan: one pass writes the windows (a few numbers each, no text) to the shared checkpoint folder; the first occurrence
per hash is a partially aggregated minimum; the windows meet it in one join on the hash, which adaptive execution
splits where a hash is frequent; the lines to drop are gathered per document (bounded by its own lines) and the texts
are joined to them once. The kept stretches between dropped lines are sliced out, so the cost is linear in the lines.

Edge cases: null text stays null with n_lines 0; empty text stays empty; a null doc_id sorts before all others; rows
repeated in full (same doc_id and text) count as one and get the same result; rows of one doc_id with different texts
are ordered by a hash of the text. Other columns are returned unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialize

WINDOW_LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(doc_id: str, text: str) -> list[Column]:
    """A document's place in the order of occurrences."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-2**63)).alias("__k1"), F.xxhash64(text).alias("__k2")]


def windows(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(__k1, __k2, pos, h): line numbers and hash of every window of ``size`` counted lines."""
    numbered = F.transform(_lines(F.col("text")), lambda line, i: F.struct(
        i.alias("p"), F.when(line.rlike(r"\S"), F.xxhash64(line)).alias("h")))
    counted = (docs.where("text is not null").select(*_keys("doc_id", "text"),
                                                     F.filter(numbered, lambda x: x.h.isNotNull()).alias("x"))
               .where(F.size("x") >= size))
    starts = F.sequence(F.lit(0), F.size("x") - size)
    each = F.transform(starts, lambda i: F.struct(
        F.array(*[F.get(F.col("x"), i + k).p for k in range(size)]).alias("pos"),
        F.xxhash64(*[F.get(F.col("x"), i + k).h for k in range(size)]).alias("h")))
    return counted.select("__k1", "__k2", F.explode(each).alias("w")).select("__k1", "__k2", "w.pos", "w.h")


def covered_lines(found: DataFrame) -> DataFrame:
    """(__k1, __k2, __drop): sorted line numbers covered by later occurrences of a repeated window."""
    place = F.struct("__k1", "__k2", "pos")
    first = (found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where("first < last").select("h", "first"))
    later = found.join(first, "h").where(place > F.col("first"))
    lines = F.sort_array(F.array_distinct(F.flatten(F.collect_list("pos"))))
    return later.groupBy("__k1", "__k2").agg(lines.alias("__drop"))


def without_lines(lines: Column, drop: Column) -> Column:
    """The lines between the dropped ones, sliced stretch by stretch."""
    stretches = F.transform(F.sequence(F.lit(0), F.size(drop)), lambda j: F.struct(
        F.when(j == 0, F.lit(0)).otherwise(F.get(drop, j - 1) + 1).alias("a"),
        F.when(j == F.size(drop), F.size(lines)).otherwise(F.get(drop, j)).alias("b")))
    kept = F.filter(stretches, lambda s: s.b > s.a)
    return F.flatten(F.transform(kept, lambda s: F.slice(lines, s.a + 1, s.b - s.a)))


def dedup_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with later occurrences removed from ``text``, plus ``n_lines`` and ``n_removed`` (long)."""
    found = materialize(windows(docs, size), name="line-windows")
    drop = covered_lines(found)
    rows = docs.select("*", *_keys("doc_id", "text"))
    joined = rows.join(drop.hint("shuffle_hash"), ["__k1", "__k2"], "left")
    lines = _lines(F.col("text"))
    out = {
        "text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(
            F.array_join(without_lines(lines, F.col("__drop")), "\n")),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
    }
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*[out["text"].alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
                         out["n_lines"].alias("n_lines"), out["n_removed"].alias("n_removed"))
