"""Every scalar the reports use, over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, times
from .registry import plan


@plan("h01_left_substring", """
SELECT doc_id, left(text, 100) AS head, substring(text, 1, 20) AS part FROM documents
""")
def left_substring(t):
    return t.documents.select("doc_id", F.left("text", F.lit(100)).alias("head"), F.substring("text", 1, 20).alias("part"))


@plan("h02_concat_format", """
SELECT c_custkey, c_name || '@' || c_mktsegment AS joined, printf('%s has %d', c_name, c_nationkey) AS formatted FROM customer
""")
def concat_format(t):
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("@"), "c_mktsegment").alias("joined"),
                             F.format_string("%s has %d", "c_name", "c_nationkey").alias("formatted"))


@plan("h03_round", """
SELECT o_orderkey, round(o_totalprice / 8, 0) AS half_up, round_even(CAST(o_orderkey AS DOUBLE) / 2, 0) AS half_even FROM orders
""")
def rounding(t):
    return t.orders.select("o_orderkey", numbers.round_to(F.col("o_totalprice") / 8, 0).alias("half_up"),
                           numbers.round_to(F.col("o_orderkey") / 2, 0, "half_even").alias("half_even"))


@plan("h04_floor_mod_div_abs", """
SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS floored, c_custkey % 7 AS rest, c_custkey // 7 AS whole, abs(c_acctbal) AS magnitude FROM customer
""")
def floor_mod_div_abs(t):
    return t.customer.select("c_custkey", F.floor("c_acctbal").cast("long").alias("floored"),
                             F.pmod("c_custkey", F.lit(7)).alias("rest"),
                             numbers.whole_div("c_custkey", 7).alias("whole"), F.abs("c_acctbal").alias("magnitude"))


@plan("h05_coalesce_nullif", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status FROM orders
""")
def coalesce_nullif(t):
    return t.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("none")).alias("status"))


@plan("h06_casts", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS price,
       TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS rank, TRY_CAST(o_orderstatus AS INTEGER) AS not_a_number FROM orders
""")
def casts(t):
    return t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(10,2)").cast("double").alias("price"),
                           F.substring("o_orderpriority", 1, 1).try_cast("int").alias("rank"),
                           F.col("o_orderstatus").try_cast("int").alias("not_a_number"))


@plan("h07_age", """
SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1e6::DOUBLE AS age_seconds FROM events
""")
def age(t):
    return t.events.select("event_id", times.seconds_since("ts", "2024-01-31").alias("age_seconds"))


@plan("h08_intervals", """
SELECT event_id, ts + INTERVAL 5 MINUTE AS later, ts - INTERVAL 24 HOUR AS day_before, ts - INTERVAL 7 DAY AS week_before FROM events
""")
def intervals(t):
    return t.events.select("event_id", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("later"),
                           (F.col("ts") - F.make_dt_interval(hours=F.lit(24))).alias("day_before"),
                           (F.col("ts") - F.make_dt_interval(days=F.lit(7))).alias("week_before"))


@plan("h09_datediff", """
SELECT event_id, date_diff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS minutes,
       date_diff('second', TIMESTAMP '2024-01-01 00:00:30', ts) AS seconds FROM events
""")
def datediff(t):
    start = F.lit("2024-01-01 00:00:30")
    return t.events.select("event_id", times.elapsed(start, "ts", "minute").alias("minutes"),
                           times.elapsed(start, "ts").alias("seconds"))


@plan("h10_date_format", """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events
""")
def date_format(t):
    return t.events.select("event_id", times.stamp(F.col("ts")).alias("stamp"),
                           F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@plan("h11_parse_time", """
SELECT event_id, date_trunc('second', ts) AS from_epoch, date_trunc('second', ts) AS from_text FROM events
""")
def parse_time(t):
    return t.events.select(
        "event_id", F.timestamp_seconds(times.seconds("ts")).cast("timestamp_ntz").alias("from_epoch"),
        F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("from_text"))


@plan("h12_key_prefix", """
WITH k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '_' || lang || ':' || doc_id WHEN 1 THEN source || ':' || lang || '_x' ELSE source || lang END AS key FROM documents)
SELECT doc_id, CASE WHEN contains(key, ':') OR contains(key, '_') THEN split_part(split_part(key, ':', 1), '_', 1) ELSE 'simple' END AS pattern FROM k
""")
def key_prefix(t):
    key = (F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_"), "lang", F.lit(":"), "doc_id"))
           .when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(":"), "lang", F.lit("_x")))
           .otherwise(F.concat("source", "lang")))
    return t.documents.select("doc_id", text.key_prefix(key).alias("pattern"))


@plan("h13_packed_numbers", """
SELECT user_id, event_id, event_id AS keys, user_id * 2 AS expires, 0::BIGINT AS avg_ttl FROM events
""")
def packed_numbers(t):
    packed = F.concat(F.lit("keys="), "event_id", F.lit(",expires="), F.col("user_id") * 2, F.lit(",avg_ttl=0"))
    return t.events.select("user_id", "event_id", text.packed_numbers(packed).alias("m")).select(
        "user_id", "event_id", *[F.element_at("m", k).alias(k) for k in ("keys", "expires", "avg_ttl")])


@plan("h14_joined_args", """
SELECT event_id, 'GET ' || event_type || ' ' || user_id AS command FROM events
""")
def joined_args(t):
    words = F.array(F.lit("GET"), "event_type", F.col("user_id").cast("string"))
    return t.events.select("event_id", text.joined_args(words).alias("command"))


@plan("h15_lengths", """
SELECT doc_id, len(string_split(text, ' ')) AS words, length(text) AS chars FROM documents
""")
def lengths(t):
    return t.documents.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("words"),
                              F.length("text").cast("long").alias("chars"))


@plan("h16_json", """
SELECT event_id, '{"user":' || user_id || ',"type":"' || event_type || '"}' AS encoded, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_text(t):
    return t.events.select(
        "event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("encoded"),
        F.from_json("props", "k bigint").getField("k").alias("k"))


@plan("h17_map_entries", """
SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events
""")
def map_entries(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))


@plan("h18_grouped_digits", """
SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) AS shown FROM orders
""")
def grouped_digits(t):
    return t.orders.select("o_orderkey", numbers.grouped_digits(F.round(F.col("o_totalprice") * 100).cast("long")).alias("shown"))


@plan("h19_text_tests", """
SELECT p_partkey, p_name LIKE '%ring%' AS has_ring, regexp_matches(p_name, '^(red|blue)') AS coloured,
       starts_with(p_type, 'S') AS s_type, contains(p_name, 'widget') AS widget FROM part
""")
def text_tests(t):
    return t.part.select("p_partkey", F.col("p_name").like("%ring%").alias("has_ring"),
                         F.col("p_name").rlike("^(red|blue)").alias("coloured"),
                         F.col("p_type").startswith("S").alias("s_type"), F.col("p_name").contains("widget").alias("widget"))


@plan("h20_regex_extract", """
SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) AS number, len(regexp_extract_all(c_name, '[0-9]')) AS digits FROM customer
""")
def regex_extract(t):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", "#0*([0-9]+)", 1).alias("number"),
                             F.size(F.regexp_extract_all("c_name", F.lit("([0-9])"))).cast("long").alias("digits"))


@plan("h21_in_list", "SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag IN ('A', 'R') AS listed FROM lineitem WHERE l_linestatus NOT IN ('F')")
def in_list(t):
    return t.lineitem.filter(~F.col("l_linestatus").isin("F")).select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").isin("A", "R").alias("listed"))


@plan("h22_null_safe_equal", """
SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM CASE WHEN o_orderpriority = '5-LOW' THEN 'O' END AS same FROM orders
""")
def null_safe_equal(t):
    other = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("O"))
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).eqNullSafe(other).alias("same"))


@plan("h23_strip_affixes", "SELECT c_custkey, c_mktsegment AS name FROM customer")
def strip_affixes(t):
    file = F.concat(F.lit("db."), "c_mktsegment", F.lit("_data.csv"))
    return t.customer.select("c_custkey", text.strip_affixes(file, "db.", "_data.csv").alias("name"))
