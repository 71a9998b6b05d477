"""WARC revisit resolution: a not-modified record takes its body from the latest earlier full response.

An as-of join by canonical URL finds that response; the revisit's validator (ETag, else Last-Modified)
must not contradict it; then the revisit's header fields replace the stored ones, but for those that
describe the body or the connection. One URL may hold most records: time is cut into spans, the join
runs within (URL, span), and each span takes over the last response of the spans before it.

Defined results: a null url is a URL of its own; null times come first and find no earlier response; of
responses at one time the largest record_id counts as the latest; records at the same time are not
earlier; header names are compared in lower case, and of names that differ in case only the last counts;
null headers are none; no validator at all contradicts nothing; repeated rows are resolved each; an empty
table gives an empty result; extra columns pass through, but an input column named like one of the result
(url_key, outcome, source_id, source_digest, merged) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import all_of, chunks_for, materialize

#: Header fields that a 304 response does not change in the stored response (RFC 9111, 3.2) or that belong to the connection.
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"utm_[^=&]*|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, ``www.``, tracking parameters and slashes at the path's end; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def lower_headers(headers: Column) -> Column:
    """Header fields with names in lower case, the last of equal names; null as no field."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    backward = F.reverse(names)
    last = F.filter(entries, lambda e, i: F.size(names) - F.array_position(backward, F.lower(e["key"])) == i)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def permitted(headers: Column) -> Column:
    """The fields, with names in lower case, that a 304 response may put over stored ones."""
    return F.map_filter(headers, lambda k, _: ~k.isin(*KEPT))


def merged_headers(stored: Column, allowed: Column) -> Column:
    """The stored fields with those ``allowed`` put over them; both with names in lower case."""
    names = F.map_keys(allowed)
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(names, k)), allowed)


RESULT = ("url_key", "outcome", "source_id", "source_digest", "merged")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """All rows of ``records`` (record_id long, ts long, kind 'response' or 'revisit', url, headers map, digest) with
    url_key, outcome, source_id, source_digest, merged (map with lower-case names)."""
    passed = [c for c in records.columns if c.lower() not in RESULT]
    row = F.struct(*[c for c, n in zip(all_of(records), records.columns, strict=True) if n in passed]).alias("row")
    lower = records.select(row, "record_id", "ts", "kind", "digest", lower_headers(F.col("headers")).alias("headers"), canonical_url(F.col("url")).alias("url_key"))
    base = materialize(lower.withColumn("allowed", permitted(F.col("headers"))), "warc-records")
    low, high, rows = base.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    spans = chunks_for(rows)
    width = max(1, -(-((high or 0) - (low or 0) + 1) // spans))
    base = base.withColumn("span", F.coalesce(F.floor((F.col("ts") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)))
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "digest", "headers"))
    order = ["ts", F.col("kind") == "response", "record_id"]
    inside = Window.partitionBy("url_key", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = base.where("kind = 'response'").groupBy("url_key", "span").agg(F.max_by(full, F.struct("ts", "record_id")).alias("last"))
    spans_of = base.select("url_key", "span").distinct()
    before = Window.partitionBy("carried_key").orderBy("carried_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spans_of.join(lasts, spans_of.url_key.eqNullSafe(lasts.url_key) & (spans_of["span"] == lasts["span"]), "left")
        .select(spans_of.url_key.alias("carried_key"), spans_of["span"].alias("carried_span"), "last")
        .withColumn("carried", F.last("last", ignorenulls=True).over(before))
        .drop("last")
    )
    near = base.withColumn("near", F.last(full, ignorenulls=True).over(inside))
    found = near.join(carried, near.url_key.eqNullSafe(F.col("carried_key")) & (F.col("span") == F.col("carried_span")), "left").withColumn("full", F.coalesce("near", "carried"))
    revisit = F.col("kind") == "revisit"
    own = lambda name: F.col("headers")[name]
    theirs = lambda name: F.col("full.headers")[name]
    differs = F.when(own("etag").isNotNull() & theirs("etag").isNotNull(), own("etag") != theirs("etag")).when(
        own("last-modified").isNotNull() & theirs("last-modified").isNotNull(), own("last-modified") != theirs("last-modified")
    )
    outcome = (
        F.when(~revisit, "full")
        .when(F.col("ts").isNull() | F.col("full").isNull(), "no earlier response")
        .when(F.coalesce(differs, F.lit(False)), "validator differs")
        .otherwise("resolved")
    )
    resolved = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        *[F.col("row")[c].alias(c) for c in passed],
        "url_key",
        "outcome",
        F.when(resolved, F.col("full.record_id")).when(~revisit, F.col("record_id")).alias("source_id"),
        F.when(resolved, F.col("full.digest")).when(~revisit, F.col("digest")).alias("source_digest"),
        F.when(resolved, merged_headers(F.col("full.headers"), F.col("allowed"))).when(~revisit, F.col("headers")).alias("merged"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two records per page: its full response, and a later revisit of the same URL.

    Of the revisits, those whose page_id divides by 4 carry another ETag, those with remainder 1 only Last-Modified.
    """
    page, body = F.col("page_id"), F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    etag = F.substring(body, 1, 16)
    modified = (page % 97).cast("string")
    fields = lambda *pairs: F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    response = fields(("etag", etag), ("last-modified", modified), ("content-length", F.octet_length("html").cast("string")), ("cache-control", F.lit("max-age=60")))
    fresh = fields(
        ("etag", F.when(page % 4 == 0, F.concat(F.lit("x"), etag)).when(page % 4 != 1, etag)),
        ("last-modified", modified),
        ("content-length", F.lit("0")),
        ("cache-control", F.lit("max-age=600")),
        ("expires", page.cast("string")),
    )
    return pages.select(
        F.explode(
            F.array(
                F.struct((page * 2).alias("record_id"), (page * 10).alias("ts"), F.lit("response").alias("kind"), "url", response.alias("headers"), body.alias("digest")),
                F.struct((page * 2 + 1).alias("record_id"), (page * 10 + 25).alias("ts"), F.lit("revisit").alias("kind"), "url", fresh.alias("headers"), F.lit(None).cast("string").alias("digest")),
            )
        ).alias("r")
    ).select("r.*")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.where("kind = 'revisit'").select("record_id", "url_key", "outcome", "source_id", "source_digest", F.array_join(lines, "\n").alias("merged_headers"))


ORACLE = {
    "op9_warc_revisits": r"""
        WITH p AS (
            SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
                   sha256(coalesce(html, '')) AS body
            FROM pages
        ), q AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
                       '([?&])(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', '') AS rest
            FROM p
        ), u AS (
            SELECT *, host || regexp_replace(rest, '/+(\?|$)', '\1', 'g') AS url_key, substr(body, 1, 16) AS etag, CAST(page_id % 97 AS VARCHAR) AS modified
            FROM q
        ), j AS (
            SELECT r.page_id * 2 + 1 AS record_id, r.url_key, f.page_id AS full_page, f.body AS full_body, f.etag AS full_etag, f.modified AS full_modified,
                   strlen(f.html) AS full_length, r.modified,
                   CASE WHEN r.page_id % 4 = 0 THEN 'x' || r.etag WHEN r.page_id % 4 <> 1 THEN r.etag END AS etag, r.page_id
            FROM (SELECT *, page_id * 10 + 25 AS ts FROM u) r
            ASOF LEFT JOIN (SELECT *, page_id * 10 AS ts FROM u) f ON r.url_key = f.url_key AND r.ts > f.ts
        ), o AS (
            SELECT *, CASE WHEN full_page IS NULL THEN 'no earlier response'
                           WHEN etag IS NOT NULL AND etag <> full_etag THEN 'validator differs'
                           WHEN etag IS NULL AND modified <> full_modified THEN 'validator differs'
                           ELSE 'resolved' END AS outcome
            FROM j
        )
        SELECT record_id, url_key, outcome,
               CASE WHEN outcome = 'resolved' THEN full_page * 2 END AS source_id,
               CASE WHEN outcome = 'resolved' THEN full_body END AS source_digest,
               CASE WHEN outcome = 'resolved' THEN
                   'cache-control: max-age=600' || chr(10) || 'content-length: ' || full_length || chr(10) || 'etag: ' || coalesce(etag, full_etag)
                   || chr(10) || 'expires: ' || page_id || chr(10) || 'last-modified: ' || modified END AS merged_headers
        FROM o
    """
}
QUERIES = {"op9_warc_revisits": op9_warc_revisits}
