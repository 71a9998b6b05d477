"""Standardization, profiles, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..crm import CRM_SQL, crm, standardized, soundex_sql, text_sql
from ..functions import text as T
from ..operators import evaluate, profile, standardize, stress
from .registry import query, std, table

CRM = f"WITH {CRM_SQL}"


@query(f"SELECT p_partkey, {text_sql('p_name')} AS name_std, {text_sql('p_brand')} AS brand_std, {text_sql('p_type')} AS type_std FROM part")
def std_text(spark, d):
    t = lambda c: T.normalize_text(F.col(c), False)
    return table(spark, d, "part").select("p_partkey", t("p_name").alias("name_std"), t("p_brand").alias("brand_std"), t("p_type").alias("type_std"))


@query(std("SELECT record_id, first_name_std, last_name_std FROM std"))
def std_person_name(spark, d):
    return standardized(spark, d).select("record_id", "first_name_std", "last_name_std")


@query(std("SELECT record_id, email_std, email_domain_pre4, split_part(email_std, '@', 1) AS email_local FROM std"))
def std_email(spark, d):
    return standardized(spark, d).select("record_id", "email_std", "email_domain_pre4", F.substring_index("email_std", "@", 1).alias("email_local"))


@query(std("SELECT record_id, phone_std, phone_pre7, phone_last4 FROM std"))
def std_phone(spark, d):
    return standardized(spark, d).select("record_id", "phone_std", "phone_pre7", "phone_last4")


@query(std("SELECT record_id, dob_std, dob_year_std FROM std"))
def std_date(spark, d):
    return standardized(spark, d).select("record_id", "dob_std", "dob_year_std")


@query(f"""{CRM}, n AS (SELECT CAST(substr(dob, 1, 2) AS INT) AS a, CAST(substr(dob, 4, 2) AS INT) AS b FROM crm)
    SELECT CAST(0 AS BIGINT) AS year_first_rows, count(*) FILTER (a > 12) AS day_gt_12, count(*) FILTER (b > 12) AS month_gt_12,
           count(*) FILTER (a <= 12 AND b <= 12) AS ambiguous_rows, 'dmy' AS detected_order FROM n""")
def date_order_evidence(spark, d):
    return standardize.date_order_evidence(crm(spark, d), "dob")


@query("""SELECT event_id, list_filter([lower(trim(event_type)), 'u' || user_id, lower(trim(event_type))], lambda x: x <> '') AS items FROM events""")
def device_ids(spark, d):
    joined = F.concat(F.lit(" "), F.upper("event_type"), F.lit(";; U "), F.col("user_id").cast("string"), F.lit("|"), F.col("event_type"), F.lit(","))
    return table(spark, d, "events").select("event_id", T.normalize_device_ids(joined).alias("items"))


@query(f"SELECT p_partkey, {soundex_sql('p_name')} AS sx_name, {soundex_sql('p_type')} AS sx_type, {soundex_sql('p_brand')} AS sx_brand FROM part")
def soundex_ref(spark, d):
    return table(spark, d, "part").select("p_partkey", *[T.soundex(F.col(f"p_{c}")).alias(f"sx_{c}") for c in ("name", "type", "brand")])


@query(std("SELECT record_id, first_name_std_pre3, last_name_std_pre3, email_domain_pre4, phone_pre7, phone_last4, dob_year_std, phonetic_first_name, phonetic_last_name FROM std"))
def blocking_keys(spark, d):
    return standardized(spark, d).select("record_id", "first_name_std_pre3", "last_name_std_pre3", "email_domain_pre4", "phone_pre7", "phone_last4", "dob_year_std", "phonetic_first_name", "phonetic_last_name")


@query("SELECT o_orderkey, 'rec_' || printf('%06d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS record_id FROM orders")
def record_ids(spark, d):
    return standardize.add_record_id(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "record_id")


@query(f"""{CRM} SELECT record_id, concat(upper(substr(first_name, 1, 1)), lower(substr(first_name, 2))) AS first_name, lower(coalesce(email, '')) AS email,
    CASE WHEN email IS NULL THEN '' ELSE lower(split_part(email, '@', 2)) END AS email_domain, phone_number AS phone, right(phone_number, 4) AS phone_last4,
    upper(state) AS state, substr(dob, 7, 4) || '-' || substr(dob, 4, 2) || '-' || substr(dob, 1, 2) AS dob FROM crm""")
def old_standard(spark, d):
    c = crm(spark, d)
    cols = T.old_standard({k: F.col(v) for k, v in {"first_name": "first_name", "last_name": "last_name", "email": "email", "phone": "phone_number", "address": "address", "city": "city", "state": "state", "dob": "dob"}.items()})
    return c.select("record_id", *[cols[k].alias(k) for k in ("first_name", "email", "email_domain", "phone", "phone_last4", "state", "dob")])


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'match' WHEN quality = 0 THEN 'no_match' END AS label FROM labels")
def label_vocabulary(spark, d):
    raw = F.when(F.col("quality") == 1, F.lit(" Match ")).otherwise(F.lit("Beda-Orang"))
    return table(spark, d, "labels").select("doc_id", T.label_of(raw).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) || '__' || greatest(l_partkey, l_suppkey) AS pair_id FROM lineitem""")
def pair_keys(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("pair_id"))


@query("""SELECT c.column_name AS "column", c.rows, c.nulls, c.distinct_values, c.blank_strings, round(100.0 * c.nulls / c.rows, 3) AS null_pct FROM (
    SELECT 'c_name' AS column_name, count(*) AS rows, count(*) - count(c_name) AS nulls, count(DISTINCT c_name) AS distinct_values, count(*) FILTER (trim(c_name) = '') AS blank_strings FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), count(*) FILTER (trim(c_mktsegment) = '') FROM customer
    UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey), CAST(0 AS BIGINT) FROM customer) c""")
def profile_columns(spark, d):
    return profile.profile_columns(table(spark, d, "customer").select("c_name", "c_mktsegment", "c_nationkey"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_values(spark, d):
    return profile.top_values(table(spark, d, "part"), "p_name")


@query("WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicated_values, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_groups FROM s")
def duplicate_ids(spark, d):
    return profile.duplicate_ids(table(spark, d, "orders"), "o_custkey")


@query('WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n AS "size", count(*) AS ids FROM s WHERE n > 1 GROUP BY 1')
def duplicate_group_sizes(spark, d):
    return profile.group_sizes(table(spark, d, "orders"), "o_custkey")


@query("SELECT count(*) FILTER (p_brand <> lower(p_brand)) AS mixed_case_or_upper, count(*) FILTER (regexp_matches(p_brand, '[0-9]')) AS digits, count(*) FILTER (regexp_matches(p_brand, '[^A-Za-z\\s''’-]')) AS symbols, count(*) FILTER (regexp_matches(p_brand, 'aa|bb|nn|rr|dd|11|22|33|44|55|66|77|88|99|00|##')) AS repeated_character FROM part")
def name_anomalies(spark, d):
    return profile.name_anomalies(table(spark, d, "part"), "p_brand")


@query(f"{CRM} SELECT count(*) FILTER (regexp_matches(phone_number, '[A-Za-z]')) AS letters, count(*) FILTER (regexp_matches(phone_number, '[^0-9+()\\-\\s]')) AS punctuation FROM crm")
def phone_anomalies(spark, d):
    return profile.phone_anomalies(crm(spark, d), "phone_number")


@query(f"{CRM} SELECT CAST(length(phone_number) AS INTEGER) AS digits, count(*) AS n FROM crm GROUP BY 1 ORDER BY 1 LIMIT 20")
def phone_lengths(spark, d):
    return profile.phone_lengths(crm(spark, d), "phone_number")


@query(f"{CRM} SELECT count(*) AS records, count(*) - count(email) AS missing_email, count(*) - count(phone_number) AS missing_phone, count(*) - count(dob) AS missing_dob, count(*) FILTER (email IS NULL AND phone_number IS NULL) AS missing_both, round(100.0 * count(*) FILTER (email IS NULL AND phone_number IS NULL) / count(*), 4) AS unlinkable_pct FROM crm")
def identifier_coverage(spark, d):
    return profile.identifier_coverage(crm(spark, d))


@query(f"""{CRM} SELECT 'email' AS field, count(email) AS non_blank, count(*) - count(email) AS blank, CAST(0 AS BIGINT) AS unshaped FROM crm
    UNION ALL SELECT 'phone', count(phone_number), count(*) - count(phone_number), CAST(0 AS BIGINT) FROM crm
    UNION ALL SELECT 'dob', count(dob), count(*) - count(dob), CAST(0 AS BIGINT) FROM crm""")
def shape_report(spark, d):
    return profile.shape_report(crm(spark, d))


@query(f"{CRM} SELECT CAST(1 AS DOUBLE) AS email, CAST(1 AS DOUBLE) AS phone, CAST(1 AS DOUBLE) AS dob FROM (SELECT count(*) FROM crm)")
def cast_baseline(spark, d):
    return profile.cast_baseline(crm(spark, d))


@query("""SELECT o_orderkey, length(regexp_replace(o_orderpriority, '[^0-9]', '', 'g')) + length(regexp_replace(lower(o_orderpriority), '[a-z\\s''’-]', '', 'g')) AS corruption,
    length(regexp_replace(lower(o_orderpriority), '[a-z\\s''’-]', '', 'g')) AS as_address FROM orders""")
def corruption_scores(spark, d):
    v = F.lower("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", T.corruption_score(v, "first_name_std").cast("long").alias("corruption"), T.corruption_score(v, "address_std").cast("long").alias("as_address"))


@query(std("""SELECT record_id, CASE WHEN length(first_name_std) < 2 THEN first_name_std || 'x' ELSE substr(first_name_std, 1, 1) || substr(first_name_std, 3, 1) || substr(first_name_std, 2, 1) || substr(first_name_std, 4) END AS name,
    substr(phone_std, 1, length(phone_std) - 1) || (CAST(right(phone_std, 1) AS INT) + 1) % 10 AS phone, split_part(email_std, '@', 1) || '@elsewhere.example' AS email,
    'no ' || (CAST(regexp_extract(address_std, '[0-9]+') AS INT) + 1) || regexp_extract(address_std, '^[^0-9]*[0-9]+(.*)$', 1) AS address, (CAST(substr(dob_std, 1, 4) AS INT) + 1) || substr(dob_std, 5) AS dob FROM std"""))
def mutations(spark, d):
    c = F.col
    return standardized(spark, d).select("record_id", stress.second_and_third_swapped(c("first_name_std")).alias("name"), stress.next_last_digit(c("phone_std")).alias("phone"), stress.at_another_domain(c("email_std")).alias("email"), stress.next_house_number(c("address_std")).alias("address"), stress.a_year_later(c("dob_std")).alias("dob"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, lower(trim(lang)) AS lang FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), T.compare_text(F.col("lang")).alias("lang"))


@query("""SELECT doc_id, CAST(quality AS BIGINT) AS k, CAST(3 + toxic AS BIGINT) AS n,
    round(greatest(0.0, (p + z * z / (2 * n1)) / (1 + z * z / n1) - z * sqrt(p * (1 - p) / n1 + z * z / (4 * n1 * n1)) / (1 + z * z / n1)), 4) AS low,
    round(least(1.0, (p + z * z / (2 * n1)) / (1 + z * z / n1) + z * sqrt(p * (1 - p) / n1 + z * z / (4 * n1 * n1)) / (1 + z * z / n1)), 4) AS high
    FROM (SELECT *, CAST(1.96 AS DOUBLE) AS z, CAST(3 + toxic AS DOUBLE) AS n1, CAST(quality AS DOUBLE) / (3 + toxic) AS p FROM labels)""")
def wilson_interval(spark, d):
    k, n = F.col("quality").cast("long"), (F.col("toxic") + 3).cast("long")
    low, high = evaluate.wilson(k, n)
    return table(spark, d, "labels").select("doc_id", k.alias("k"), n.alias("n"), low.alias("low"), high.alias("high"))
