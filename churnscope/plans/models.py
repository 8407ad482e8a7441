"""Store of fitted models: thresholds, tercile edges, caps, levels and rule texts as rows of a versioned table.

A version is a folder ``version=<n>`` of parquet rows (model, kind, feature, position, value, text). It is written under
a hidden name and renamed at the end, so readers never see half a version, and an existing version is never changed. The
numbers are doubles and come back bit by bit; another session applies them without the data they were fitted on.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import binning
from ..operators.features import RateModel

SCHEMA = "model string, kind string, feature string, position int, value double, text string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions in the store, rising."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def save(spark: SparkSession, path: str, rows: list[tuple]) -> int:
    """Write the rows as the next version; returns its number. Raises if another writer took that number first."""
    done = versions(spark, path)
    version = done[-1] + 1 if done else 1
    hidden = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(hidden)
    fs, target = _fs(spark, f"{path.rstrip('/')}/version={version}")
    if fs.exists(target) or not fs.rename(_fs(spark, hidden)[1], target):
        fs.delete(_fs(spark, hidden)[1], True)
        raise RuntimeError(f"version {version} of {path} was written meanwhile")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the latest by default)."""
    done = versions(spark, path)
    if not done or (version is not None and version not in done):
        raise ValueError(f"{path} holds no version {version or ''}".rstrip())
    return spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/version={version or done[-1]}")


def _of(rows: DataFrame, model: str) -> list:
    return sorted(rows.where(rows["model"] == model).collect(), key=lambda r: (r["kind"], r["feature"] or "", r["position"]))


# ------------------------------------------------------------------ the models

def threshold_rows(model: DataFrame, name: str = "states") -> list[tuple]:
    """Rows of fitted state thresholds (E1) and their rule texts."""
    out = []
    for r in model.select("feature", "low_threshold", "high_threshold").collect():
        out += [(name, "threshold", r[0], i, r[i + 1], None) for i in (0, 1)]
    out += [(name, "rule", r["feature"], r["position"], None, f"{r['rule']}: {r['label']}")
            for r in binning.state_rules(model).collect()]
    return out


def thresholds(rows: DataFrame, name: str = "states") -> dict[str, tuple[float, float]]:
    """Stored thresholds, as ``binning.apply_states`` takes them."""
    got: dict = {}
    for r in _of(rows, name):
        if r["kind"] == "threshold":
            got.setdefault(r["feature"], {})[r["position"]] = r["value"]
    rank = {f: i for i, f in enumerate(binning.STATE_FEATURES)}
    return {f: (v[0], v[1]) for f, v in sorted(got.items(), key=lambda kv: (rank.get(kv[0], len(rank)), kv[0]))}


def rules(rows: DataFrame, name: str = "states") -> dict[str, list[str]]:
    """Stored rule texts per feature, in order."""
    out: dict = {}
    for r in _of(rows, name):
        if r["kind"] == "rule":
            out.setdefault(r["feature"], []).append(r["text"])
    return out


def edge_rows(edges: dict[str, tuple], name: str = "terciles") -> list[tuple]:
    """Rows of tercile edges (E5) from ``binning.collect_edges``."""
    return [row for f, (*e, degenerate) in edges.items() for row in
            [*((name, "edge", f, i, x, None) for i, x in enumerate(e)), (name, "degenerate", f, 0, float(degenerate), None)]]


def edges(rows: DataFrame, name: str = "terciles") -> dict[str, tuple]:
    """Stored tercile edges, as ``binning.tercile_label`` takes them."""
    got: dict = {}
    for r in _of(rows, name):
        got.setdefault(r["feature"], {})[r["kind"], r["position"]] = r["value"]
    return {f: (*(v["edge", i] for i in range(4)), bool(v["degenerate", 0])) for f, v in got.items()}


def rate_rows(model: RateModel, name: str = "rates") -> list[tuple]:
    """Rows of the caps, region levels and reference date of the rate formulas."""
    out = [(name, "cap", "avg_transaction_value", 0, model.txn_cap, None),
           (name, "cap", "points_per_day", 0, model.points_cap, None),
           (name, "date", "joining_date", 0, None, None if model.reference_date is None else model.reference_date.isoformat())]
    return out + [(name, "level", "region_category", i, None, x) for i, x in enumerate(model.region_levels)]


def rate_model(rows: DataFrame, name: str = "rates") -> RateModel:
    """The stored rate model, as ``features.apply_rate_features`` takes it."""
    got = _of(rows, name)
    caps = {r["feature"]: r["value"] for r in got if r["kind"] == "cap"}
    day = next((r["text"] for r in got if r["kind"] == "date"), None)
    return RateModel(caps.get("avg_transaction_value"), caps.get("points_per_day"),
                     [r["text"] for r in got if r["kind"] == "level"], day and datetime.date.fromisoformat(day))
