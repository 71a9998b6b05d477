"""The command line: a run over a CSV or Parquet table, look-ups in what it stored, and the service.

    python -m amalgam run customers.csv --out /data/linkage --order customer_id
    python -m amalgam entity rec_000001 --out /data/linkage
    python -m amalgam serve --out /data/linkage --port 8080
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import run_pipeline
from .config import load_settings, read_text, resolve
from .operators import entities as E
from .operators.model import Model
from .sinks import Staging, atomic_json, atomic_text, persist_run
from .sources.files import load_records, read_csv_any, read_meta

#: The steps of a run, in order; --skip names the last ones that may be left out.
STEPS = ("read", "standardize", "train", "score", "cluster", "master", "persist", "evaluate")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="amalgam", description="record linkage of customer data")
    p.add_argument("--out", default=".", help="folder of the stored tables, on any file system that Spark knows")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="raw rows to golden records")
    run.add_argument("input")
    run.add_argument("--out", default=argparse.SUPPRESS)
    run.add_argument("--order", nargs="+", help="columns that fix the order of record ids")
    run.add_argument("--columns", nargs="+", help="comparison columns, with fixed m")
    run.add_argument("--date-order", choices=("dmy", "mdy", "iso"))
    run.add_argument("--sample", action="store_true", help="the first rows only")
    run.add_argument("--force", action="store_true", help="let a sample replace a full map")
    run.add_argument("--reuse-model", help="JSON file of a trained model")
    run.add_argument("--skip", nargs="+", choices=STEPS[-2:], default=[])
    run.add_argument("--thresholds", help="JSON file with match_threshold and review_threshold")
    run.add_argument("--rules", help="JSON file of blocking rules")
    for name, text in (("entity", "golden record of a record"), ("serve", "HTTP service over the stored tables")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--out", default=argparse.SUPPRESS)
        if name == "entity":
            s.add_argument("record_id")
        else:
            s.add_argument("--port", type=int, default=8080)
    return p.parse_args(argv)


def read_input(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv_any(spark, path)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One run: what was stored, and how long it took. A run that fails stores nothing."""
    from dataclasses import replace

    began, run_id = time.time(), time.strftime("%Y%m%d_%H%M%S_") + uuid.uuid4().hex[:6]
    E.check_scope(read_meta(f"{a.out}/entity_map"), not a.sample, a.force)
    settings = load_settings(read_text(a.thresholds) if a.thresholds else None, read_text(a.rules) if a.rules else None)
    settings = replace(settings, date_order=resolve(a.date_order, default=settings.date_order))
    raw = read_input(spark, a.input)
    order = a.order or raw.columns[:1]
    if a.sample:
        raw = load_records(raw.withColumn("record_id", F.col(order[0]))).drop("record_id") if "record_id" not in raw.columns else load_records(raw)
    trained = Model.from_json(read_text(a.reuse_model)) if a.reuse_model else None
    found = run_pipeline(raw, settings, a.columns, trained, order)
    out = {"run_id": run_id, "scope": "sample" if a.sample else "full"}
    if "persist" not in a.skip:
        version = found.model.fingerprint()[:12]
        out["rows"] = persist_run(spark, a.out, run_id, found.records, found.pairs, found.entities, found.master, scope=out["scope"], version=version)
        atomic_text(found.model.to_json(), f"{a.out}/model.json")
        atomic_json({"scope": out["scope"], "run_id": run_id, "model_version": version}, f"{a.out}/entity_map.meta.json")
    if "evaluate" not in a.skip:
        out["entities"] = E.summary(found.entities).first().asDict()
    return out | {"seconds": round(time.time() - began, 1)}


def entity(spark: SparkSession, root: str, record_id: str) -> dict | None:
    """The golden record that a stored record belongs to."""
    state = Staging(spark, root)
    mapped, master = state.read("entity_map"), state.read("master_customer_current")
    if mapped is None or master is None:
        return None
    hit = mapped.where(F.col("record_id") == record_id).select("entity_id")
    row = master.join(hit, "entity_id", "left_semi").first()
    return None if row is None else row.asDict(True)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("amalgam").getOrCreate()
    if a.command == "run":
        try:
            print(json.dumps(run(spark, a), default=str))
        except ValueError as e:  # a guard's word: the run stops, nothing is stored
            print(e, file=sys.stderr)
            return 1
    elif a.command == "entity":
        found = entity(spark, a.out, a.record_id)
        print(json.dumps(found, default=str))
        return int(found is None)
    else:
        from .service import serve

        serve(spark, a.out, a.port)
    return 0
