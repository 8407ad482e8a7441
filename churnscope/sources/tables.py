"""Readers for the driver's parquet tables and for raw customer CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import to_numeric
from ..functions.materialize import materialize
from ..functions.stats import nan_to_null

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one driver table; selecting ``cols`` here lets the scan prune columns."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


# The missing-value tokens pandas' read_csv recognises by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def na_normalise(df: DataFrame, cols: list[str] | None = None, tokens=NA_TOKENS) -> DataFrame:
    """A2: string cells equal to an NA token (after trimming blanks) and NaN cells become NULL."""
    types = dict(df.dtypes)
    cols = cols or [c for c, t in df.dtypes if t in ("string", "double", "float")]
    token_list = list(tokens)
    return df.withColumns({
        c: (F.when(F.trim(F.col(c)).isin(token_list), F.lit(None)).otherwise(F.col(c)) if types[c] == "string"
            else nan_to_null(c)) for c in cols})


def infer_types(df: DataFrame) -> DataFrame:
    """A1: text columns whose every value is a number become long or double, as a typed CSV read gives.

    One aggregate over all columns; a column without any value stays text.
    """
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    whole = r"^\s*[+-]?\d{1,18}\s*$"
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.count(to_numeric(c)).alias("num"),
                            F.count_if(F.col(c).rlike(whole)).alias("int")).alias(c) for c in text]).first()
    out = {}
    for c in text:
        s = row[c]
        if s["n"] and s["int"] == s["n"]:
            out[c] = F.trim(F.col(c)).cast("long")
        elif s["n"] and s["num"] == s["n"]:
            out[c] = to_numeric(c)
    return df.withColumns(out)


def read_customer_csv(spark: SparkSession, path: str, schema=None, drop_index: bool = True,
                      target_from: str | None = "churn_risk_score") -> DataFrame:
    """A1/A3/A4/A5: header CSV scan with stripped column names and NA tokens.

    Without a ``schema`` the columns are read as text, NA tokens become NULL and numeric columns get their type
    (``infer_types``: one aggregate); pass a schema to save that pass.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return clean_customers(reader.csv(path), schema is not None, drop_index, target_from)


def clean_customers(df: DataFrame, typed: bool, drop_index: bool = True,
                    target_from: str | None = "churn_risk_score") -> DataFrame:
    """A3/A4/A5 and A2 on parsed rows; without types (``typed`` false) also ``infer_types``."""
    df = df.toDF(*[c.strip() for c in df.columns])
    if drop_index and df.columns and df.columns[0] in ("", "_c0", "Unnamed: 0"):
        df = df.drop(df.columns[0])
    if target_from and target_from in df.columns:
        df = df.withColumnRenamed(target_from, "churn")
    df = na_normalise(df)
    return df if typed else infer_types(df)


CORRUPT = "_corrupt_record"


def read_quarantined(spark: SparkSession, path: str, quarantine: str, schema=None, **options) -> tuple[DataFrame, dict]:
    """``read_customer_csv`` for files with broken rows: (well-formed rows, counts).

    A row that does not fit the header (too few or too many cells, a quote that never closes) or, with a ``schema``, holds
    a cell of the wrong type goes whole into the parquet table ``quarantine`` (source_file, record), which the call
    overwrites. No row is lost: ``read`` = ``kept`` + ``quarantined``. The files are parsed once; both parts are read back
    from the parsed table. The header of the first file names the columns; a broken row must not be its first line.
    """
    names = spark.read.option("header", True).csv(path).columns
    fields = [f"`{c}` string" for c in names] if schema is None else None
    typed = spark.createDataFrame([], ", ".join(fields) if fields else schema).schema
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .schema(typed.add(CORRUPT, "string")))
    parsed = materialize(reader.csv(path).withColumn("_source_file", F.col("_metadata.file_path")), name="parsed_csv")
    broken = parsed.where(F.col(CORRUPT).isNotNull()).select(F.col("_source_file").alias("source_file"),
                                                             F.col(CORRUPT).alias("record"))
    write_table(broken, quarantine)
    row = parsed.agg(F.count(F.lit(1)).alias("read"), F.count(CORRUPT).alias("quarantined")).first()
    kept = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_source_file")
    counts = {"read": row["read"], "kept": row["read"] - row["quarantined"], "quarantined": row["quarantined"]}
    return clean_customers(kept, typed=schema is not None, **options), counts


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A6/A7/A8 sink: overwrite a table; nested report columns need parquet or JSON."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def preview(df: DataFrame, cols: list[str], order_by: list[str | Column], n: int = 5) -> DataFrame:
    """First ``n`` rows of selected columns after an explicit order."""
    return df.orderBy(*order_by).select(*cols).limit(n)
