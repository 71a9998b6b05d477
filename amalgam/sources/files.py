"""CSV, Parquet and JSON-lines sources."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SAMPLE_ROWS

ENCODINGS = ("utf-8", "ISO-8859-1")


def sniff_separator(header: str) -> str:
    """The more frequent of ; and :, else what a header line without either shows."""
    if ";" in header or ":" in header:
        return ";" if header.count(";") >= header.count(":") else ":"
    try:
        return csv.Sniffer().sniff(header, delimiters=",\t|").delimiter
    except csv.Error:
        return ","


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of unknown encoding and separator; every column is a string, so digits of ids and phones stay.

    Bytes that UTF-8 can't read make the file Latin-1.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    header = first[0].value.lstrip("﻿")
    return spark.read.option("sep", sniff_separator(header)).option("header", True).option("encoding", ENCODINGS[1] if broken else ENCODINGS[0]).csv(path)


def parse_payload(spark: SparkSession, payload: bytes) -> DataFrame:
    """An uploaded CSV: UTF-8 with replacement, ; or : as separator."""
    text = payload.decode("utf-8", errors="replace").lstrip("﻿")
    header = text.split("\n", 1)[0]
    rows = list(csv.reader(io.StringIO(text), delimiter=":" if header.count(":") > header.count(";") else ";"))
    names = rows[0] if rows else []
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:] if r], schema)


def read_dataset(spark: SparkSession, batches: list[tuple[str, str]]) -> DataFrame:
    """(batch id, path) in registry order -> all rows with batch_id and row_no, which fix the order of record ids."""
    from ..ranking import global_row_number

    parts = []
    for k, (batch, path) in enumerate(batches):
        rows = read_csv_any(spark, path).withColumn("__at", F.monotonically_increasing_id())
        parts.append(global_row_number(rows, ["__at"], "row_no").drop("__at").withColumns({"batch_id": F.lit(batch), "batch_no": F.lit(k)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def rows_by_id(stored: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_semi")


def count_rows(spark: SparkSession, path: str) -> int:
    """0 if nothing is there."""
    try:
        return spark.read.parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def load_records(df: DataFrame, full: bool = False, rows: int = SAMPLE_ROWS) -> DataFrame:
    """All records, or the first by record_id."""
    return df if full else df.orderBy("record_id").limit(rows)


def read_history(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """A JSON-lines log, on request the lines that touch an entity."""
    log = spark.read.json(path)
    if entity is None:
        return log
    hit = [F.col(c) == entity for c in ("from_entity", "to_entity") if c in log.columns]
    if "records" in log.columns:
        hit.append(F.array_contains("records", entity))
    return log.where(reduce(lambda a, b: a | b, hit)) if hit else log.limit(0)


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def read_meta(artifact: str) -> dict:
    p = Path(f"{artifact}.meta.json")
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
