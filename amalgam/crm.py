"""A customer table with planted duplicates, derived from the generated tables by integer arithmetic alone.

Every tenth customer is a copy of the one before, some of them damaged; ``device_ids`` tells which rows
are the same person. ``CRM_SQL`` and ``STD_SQL`` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators.standardize import standardize


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part = read("part").select("p_partkey", "p_name")
    parts = part.count()
    nation = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    k, g, d = F.col("k"), F.col("g"), F.col("d")
    rows = read("customer").select(F.col("c_custkey").alias("k"), "c_nationkey").withColumn("g", k - F.when(k % 10 == 9, 1).otherwise(0)).withColumn("d", k % 40)
    rows = rows.join(part, (g * 7) % parts == F.col("p_partkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    tail = g * 7919 % 900_000_000
    return rows.select(
        F.format_string("rec_%06d", k + 1).alias("record_id"),
        F.format_string("CUS%07d", g).alias("customer_id"),
        F.when(d == 9, F.concat(F.substring(first, 1, 1), F.substring(first, 3, 100))).otherwise(first).alias("first_name"),
        last.alias("last_name"),
        F.when(d != 19, F.concat(F.translate("p_name", " ", "."), g.cast("string"), F.lit("@Mail"), (g % 5).cast("string"), F.lit(".com"))).alias("email"),
        F.concat(F.lit("0"), (8_100_000_000 + tail - tail % 10 + F.when(d == 29, (g + 1) % 10).otherwise(g % 10)).cast("string")).alias("phone_number"),
        F.format_string("%02d/%02d/%04d", 1 + g * 11 % 28, 1 + g * 5 % 12, 1950 + g % 50).alias("dob"),
        F.concat(F.lit("No. "), (g % 300 + 1).cast("string"), F.lit(" "), "n_name", F.lit(" Street")).alias("address"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.lit("Country").alias("country"),
        F.concat(F.lit("dev_"), g.cast("string")).alias("device_ids"),
        F.element_at(F.array(F.lit("desk"), F.lit("phone_line"), F.lit("app"), F.lit("reseller")), (k % 4 + 1).cast("int")).alias("source"),
    )


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table standardized; its text is ASCII, so no compatibility mapping is needed."""
    return standardize(crm(spark, sf_dir), Settings(nfkc=False, date_order="dmy"))


CRM_SQL = """
    raw AS (
        SELECT *, k - CASE WHEN k % 10 = 9 THEN 1 ELSE 0 END AS g, k % 40 AS d
        FROM (SELECT c_custkey AS k, c_nationkey FROM customer)
    ), crm AS (
        SELECT 'rec_' || printf('%06d', k + 1) AS record_id,
               'CUS' || printf('%07d', g) AS customer_id,
               CASE WHEN d = 9 THEN substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 1), 3) ELSE split_part(p_name, ' ', 1) END AS first_name,
               split_part(p_name, ' ', 2) AS last_name,
               CASE WHEN d <> 19 THEN replace(p_name, ' ', '.') || g || '@Mail' || (g % 5) || '.com' END AS email,
               '0' || (8100000000 + g * 7919 % 900000000 - g * 7919 % 900000000 % 10 + CASE WHEN d = 29 THEN (g + 1) % 10 ELSE g % 10 END) AS phone_number,
               printf('%02d/%02d/%04d', 1 + g * 11 % 28, 1 + g * 5 % 12, 1950 + g % 50) AS dob,
               'No. ' || (g % 300 + 1) || ' ' || n_name || ' Street' AS address,
               n_name AS city, r_name AS state, 'Country' AS country, 'dev_' || g AS device_ids,
               ['desk', 'phone_line', 'app', 'reseller'][k % 4 + 1] AS source
        FROM raw JOIN part ON p_partkey = (g * 7) % (SELECT count(*) FROM part)
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    )"""

_SOUNDEX = "CASE WHEN length({n}) > 0 THEN rpad(substr(substr({n}, 1, 1) || {collapsed}, 1, 4), 4, '0') END"


def soundex_sql(c: str) -> str:
    name = f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    collapsed = f"translate(substr({name}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556')"
    for digit in "123456":
        collapsed = f"regexp_replace({collapsed}, '{digit}+', '{digit}', 'g')"
    return _SOUNDEX.format(n=name, collapsed=collapsed)


def text_sql(c: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_\\s''’-]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def person_sql(c: str) -> str:
    return text_sql(f"translate({c}, '0134578@$!', 'oieastbasi')")


STD_SQL = f"""WITH RECURSIVE {CRM_SQL}, s0 AS (
        SELECT *, {person_sql("first_name")} AS first_name_std, {person_sql("last_name")} AS last_name_std,
               {text_sql("address")} AS address_std, {text_sql("city")} AS city_std, {text_sql("state")} AS state_std, {text_sql("country")} AS country_std,
               nullif(lower(trim(email)), '') AS email_std,
               nullif(regexp_replace(regexp_replace(regexp_replace(phone_number, '\\D', '', 'g'), '^00', ''), '^0', ''), '') AS phone_std,
               substr(dob, 7, 4) || '-' || substr(dob, 4, 2) || '-' || substr(dob, 1, 2) AS dob_std
        FROM crm
    ), std AS (
        SELECT *, substr(first_name_std, 1, 3) AS first_name_std_pre3, substr(last_name_std, 1, 3) AS last_name_std_pre3,
               substr(split_part(email_std, '@', 2), 1, 4) AS email_domain_pre4, substr(phone_std, 1, 7) AS phone_pre7, right(phone_std, 4) AS phone_last4,
               substr(dob_std, 1, 4) AS dob_year_std,
               {soundex_sql("first_name_std")} AS phonetic_first_name, {soundex_sql("last_name_std")} AS phonetic_last_name
        FROM s0
    )"""
