"""A thin HTTP service (WSGI, standard library only) over the stored tables and the functions of the engine."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .api import run_pipeline
from .config import MATCH_THRESHOLD
from .operators import entities as E, labels, profile
from .operators.blocking import PAIR
from .sinks import Staging
from .sources import serving
from .sources.files import parse_payload

MOST_ROWS = 500


class Missing(LookupError):
    """What was asked for is not there."""


class Service:
    """Handlers by method and path; each takes the path's parts, the query and the body, and returns JSON, text or CSV."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.cache = spark, root, serving.TtlCache()
        self.routes: list[tuple[str, str, Callable]] = [
            ("GET", r"/health", self.health),
            ("GET", r"/metrics", self.metrics),
            ("GET", r"/status", self.status),
            ("GET", r"/stats", self.stats),
            ("GET", r"/pairs", self.pairs),
            ("GET", r"/search", self.search),
            ("GET", r"/review-queue", self.queue),
            ("POST", r"/review-queue", self.label),
            ("GET", r"/entity/([^/]+)", self.entity),
            ("GET", r"/record/([^/]+)", self.record),
            ("GET", r"/download/pairs\.csv", self.download),
            ("POST", r"/run", self.run),
            ("POST", r"/predict", self.predict),
        ]

    def table(self, name: str) -> DataFrame:
        found = Staging(self.spark, self.root).read(name)
        if found is None:
            raise Missing(f"{name} is not stored")
        return found

    @staticmethod
    def rows(df: DataFrame, n: int = MOST_ROWS) -> list[dict]:
        return [r.asDict(True) for r in df.limit(n).collect()]

    def snapshot(self) -> dict:
        """What alerts look at; kept for a minute."""

        def compute() -> dict:
            sizes, pairs = E.summary(self.table("entity_map")).first(), self.table("dedup_outputs")
            rate = profile.match_rate(pairs).first()
            return {"job_status": "succeeded", "largest_entity": sizes.largest, "records": sizes.records, "entities": sizes.entities, "pairs": rate.pairs, "auto_match_rate": rate.match_rate, "review_pending": pairs.where("decision = 'REVIEW'").count()}

        return self.cache.get("snapshot", compute)

    def health(self, *_):
        values = self.snapshot()
        found = profile.alerts(values)
        return {"status": profile.overall(found), "alerts": found, **values}

    def metrics(self, *_):
        return profile.prometheus_text({k: v for k, v in self.snapshot().items() if not isinstance(v, str)})

    def status(self, *_):
        return Staging(self.spark, self.root).manifest()

    def stats(self, *_):
        return self.rows(self.table("dedup_outputs").groupBy("decision").agg(F.count(F.lit(1)).alias("pairs"), F.avg("match_probability").alias("mean_probability")))

    def pairs(self, _, query, __):
        chosen = serving.band(self.table("dedup_outputs"), query.get("decision"))
        return self.rows(serving.page(chosen, [F.desc("match_probability"), *PAIR], int(query.get("page", 0)), min(MOST_ROWS, int(query.get("size", 50)))))

    def search(self, _, query, __):
        return self.rows(serving.search(self.table("processed_customers"), query.get("q", ""), ["first_name", "last_name", "email", "phone"]))

    def queue(self, *_):
        state = Staging(self.spark, self.root)
        stored = state.read("review_queue")
        if stored is None:
            none = F.lit(None).cast("string")
            stored = serving.band(self.table("dedup_outputs"), "REVIEW").select(*PAIR, "match_probability", none.alias("label"), none.alias("reviewer"), F.lit("pending").alias("review_status"))
        return self.rows(stored.orderBy(F.desc_nulls_last("match_probability"), *PAIR))

    def label(self, _, __, body):
        """An answer {record_id_l, record_id_r, label, reviewer} to a pair of the queue."""
        answer = json.loads(body)
        if self.spark.range(1).select(sinks.label_of(F.lit(answer["label"])).alias("l")).first().l is None:
            raise ValueError("the label is in neither vocabulary")
        state, none = Staging(self.spark, self.root), F.lit(None).cast("string")
        stored = state.read("review_queue")
        if stored is None:
            stored = serving.band(self.table("dedup_outputs"), "REVIEW").select(*PAIR, "match_probability", none.alias("label"), none.alias("reviewer"), F.lit("pending").alias("review_status"))
        answers = self.spark.createDataFrame([(answer[PAIR[0]], answer[PAIR[1]], answer["label"], answer.get("reviewer"))], f"{PAIR[0]} string, {PAIR[1]} string, label string, reviewer string")
        if not labels.keyed(stored).join(labels.keyed(answers).select("pair_id"), "pair_id", "left_semi").limit(1).count():
            raise Missing("the pair is not in the queue")
        state.write(sinks.update_decisions(stored, answers), "review_queue")
        state.commit()
        return {"status": "reviewed"}

    def entity(self, parts, *_):
        row = self.table("master_customer_current").where(F.col("entity_id") == parts[0]).first()
        if row is None:
            raise Missing(parts[0])
        members = self.table("entity_map").where(F.col("entity_id") == parts[0]).orderBy("record_id").limit(MOST_ROWS).collect()
        return row.asDict(True) | {"records": [m.record_id for m in members]}

    def record(self, parts, *_):
        row = self.table("processed_customers").where(F.col("record_id") == parts[0]).first()
        if row is None:
            raise Missing(parts[0])
        return row.asDict(True) | {"candidates": self.rows(serving.candidates_of(self.table("dedup_outputs"), parts[0]))}

    def download(self, _, query, __):
        found = self.rows(serving.top_pairs(serving.band(self.table("dedup_outputs"), query.get("decision")), MOST_ROWS))
        text = io.StringIO()
        writer = csv.DictWriter(text, list(found[0]) if found else PAIR)
        writer.writeheader()
        writer.writerows(found)
        return text.getvalue()

    def run(self, _, query, body):
        """A run over an uploaded CSV that is stored; columns=a,b chooses comparisons."""
        found = self._run(query, body)
        run_id = query.get("run_id", "upload")
        counts = sinks.persist_run(self.spark, self.root, run_id, found.records, found.pairs, found.entities, found.master)
        self.cache.clear()
        return {"run_id": run_id, "rows": counts}

    def predict(self, _, query, body):
        """The matching pairs of an uploaded CSV; nothing is stored."""
        return self.rows(self._run(query, body).pairs.where(F.col("match_probability") >= float(query.get("threshold", MATCH_THRESHOLD))).select(*PAIR, "match_probability", "decision"))

    def _run(self, query, body):
        raw = parse_payload(self.spark, body)
        said = profile.validate(raw, rules=()) if query.get("columns") else profile.validate(raw)
        if said["status"] == "rejected":
            raise ValueError("; ".join(said["blocking"]))
        return run_pipeline(raw, columns=query["columns"].split(",") if query.get("columns") else None)

    def __call__(self, environ: dict, start: Callable) -> Iterable[bytes]:
        method, path = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/")
        query = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
        body = environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0))
        status, out = "404 Not Found", {"error": f"no {method} {path}"}
        for verb, pattern, handler in self.routes:
            if verb == method and (m := re.fullmatch(pattern, path)):
                try:
                    status, out = "200 OK", handler(m.groups(), query, body)
                except Missing as e:
                    status, out = "404 Not Found", {"error": str(e)}
                except (ValueError, KeyError) as e:
                    status, out = "422 Unprocessable Content", {"error": str(e)}
                break
        text = out if isinstance(out, str) else json.dumps(out, default=str)
        start(status, [("Content-Type", "text/plain; charset=utf-8" if isinstance(out, str) else "application/json")])
        return [text.encode()]


def serve(spark: SparkSession, root: str, port: int = 8080) -> None:
    from wsgiref.simple_server import make_server

    make_server("", port, Service(spark, root)).serve_forever()
