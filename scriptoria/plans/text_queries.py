"""Groups A and B on the driver's tables: sources, cleaning, validation and masking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx
from ..session import ensure_checkpoint_dir
from ..sources import corpus, courseware, event_log, exports, vector_store
from ..sources.tables import table
from . import sqltext as q
from .registry import query

CLEAN_SQL = (
    r"""trim(regexp_replace(regexp_replace(translate(text, '“”‘’', '""' || ''''''), """
    rf"""'[{q.WS}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ .,!?;:\-''"()]', '', 'g'))"""
)


def documents(spark, d):
    return table(spark, d, "documents")


@query("A1_submissions_scan", f"""
SELECT doc_id AS submission_id, source AS owner, source || ' essay ' || doc_id AS title, text AS content,
       CAST(len({q.raw_words()}) AS BIGINT) AS word_count, sha256(text) AS file_hash
FROM documents""")
def submissions_scan(spark, d):
    return corpus.submissions(documents(spark, d))


@query("A2_text_file_ingest", f"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^[{q.WS}]+|[{q.WS}]+$', '', 'g') AS text FROM documents
           WHERE doc_id % 5 <> 4)
SELECT 'upload/' || doc_id || '.txt' AS path, text, CAST(len({q.raw_words()}) AS BIGINT) AS word_count
FROM t WHERE len({q.raw_words()}) BETWEEN 50 AND 10000""")
def text_file_ingest(spark, d):
    """Documents as uploaded bytes: odd ids in Latin-1, every fifth with a suffix that is refused."""
    latin = F.col("doc_id") % 2 == 1
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    suffix = F.when(F.col("doc_id") % 5 == 4, ".exe").otherwise(".txt")
    files = documents(spark, d).select(
        F.concat(F.lit("upload/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("length"),
    )
    return corpus.accept_text_files(files)


@query("A3_training_rows_by_label", """
SELECT CASE quality WHEN 0 THEN 'human' ELSE 'ai' END AS kind, source AS author, text
FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)""")
def training_rows_by_label(spark, d):
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    return corpus.training_rows(rows, "text", "source", "quality")


@query("A3_training_rows_by_author", "SELECT 'author' AS kind, source AS author, text FROM documents")
def training_rows_by_author(spark, d):
    return corpus.training_rows(documents(spark, d), "text", "source")


@query("A4_event_lines", """
SELECT event_type AS "eventType", strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id AS "blockNumber",
       user_id AS "tokenId", value AS "authorshipScore" FROM events""")
def event_lines(spark, d):
    events = table(spark, d, "events").select(
        F.to_json(
            F.struct(
                F.col("event_type").alias("eventType"), F.col("ts").alias("timestamp"),
                F.col("event_id").alias("blockNumber"), F.col("user_id").alias("tokenId"),
                F.col("value").alias("authorshipScore"),
            )
        ).alias("value")
    )
    parsed = event_log.parse_lines(events)
    return parsed.select(
        "eventType", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "blockNumber", "tokenId",
        "authorshipScore",
    )


def _payloads(rows, **fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("payload")


@query("A5_course_payloads", """
SELECT 'canvas' AS vendor, CAST(o_orderkey AS VARCHAR) AS course_id, 'Course ' || o_orderkey AS name,
       o_orderstatus AS code, o_orderpriority AS term, epoch(o_orderdate)::BIGINT AS start_epoch, CAST(NULL AS BIGINT) AS end_epoch
FROM orders WHERE o_orderkey % 3 = 0
UNION ALL
SELECT 'blackboard', CAST(o_orderkey AS VARCHAR), 'Course ' || o_orderkey, o_orderstatus, '',
       epoch(o_orderdate)::BIGINT, epoch(o_orderdate)::BIGINT FROM orders WHERE o_orderkey % 3 = 1
UNION ALL
SELECT 'moodle', CAST(o_orderkey AS VARCHAR), 'Course ' || o_orderkey, o_orderstatus, o_orderpriority,
       epoch(o_orderdate)::BIGINT, NULL FROM orders WHERE o_orderkey % 3 = 2""")
def course_payloads(spark, d):
    """Orders written as three vendors' course payloads and normalised again."""
    o = table(spark, d, "orders")
    key, name = F.col("o_orderkey"), F.concat(F.lit("Course "), F.col("o_orderkey").cast("string"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    epoch = F.unix_timestamp("o_orderdate")
    canvas = o.filter(key % 3 == 0).select(_payloads(
        o, id=key, name=name, course_code=F.col("o_orderstatus"),
        term=F.struct(F.col("o_orderpriority").alias("name")), start_at=iso))
    blackboard = o.filter(key % 3 == 1).select(_payloads(
        o, id=key, name=name, courseId=F.col("o_orderstatus"),
        availability=F.struct(F.struct(iso.alias("from"), iso.alias("until")).alias("available"))))
    moodle = o.filter(key % 3 == 2).select(_payloads(
        o, id=key, fullname=name, shortname=F.col("o_orderstatus"), category=F.col("o_orderpriority"),
        startdate=epoch, enddate=F.lit(0)))
    out = courseware.courses(canvas, blackboard, moodle)
    return out.select("vendor", "course_id", "name", "code", "term",
                      F.unix_timestamp("start_at").alias("start_epoch"), F.unix_timestamp("end_at").alias("end_epoch"))


@query("A6_assignment_payloads", """
SELECT 'canvas' AS vendor, CAST(l_orderkey AS VARCHAR) AS course_id, CAST(l_partkey AS VARCHAR) AS assignment_id,
       'Part ' || l_partkey AS name, '' AS description, epoch(l_shipdate)::BIGINT AS due_epoch,
       l_quantity AS points_possible, 'online_upload' AS submission_types
FROM lineitem WHERE l_orderkey % 3 = 0
UNION ALL
SELECT 'blackboard', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), 'Part ' || l_partkey, l_returnflag,
       epoch(l_shipdate)::BIGINT, 0.0, 'online_text_entry' FROM lineitem WHERE l_orderkey % 3 = 1 AND l_linestatus = 'F'
UNION ALL
SELECT 'moodle', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), 'Part ' || l_partkey, l_returnflag,
       NULL, l_quantity, 'online_text' FROM lineitem WHERE l_orderkey % 3 = 2""")
def assignment_payloads(spark, d):
    """Line items written as three vendors' assignment payloads and normalised again."""
    li = table(spark, d, "lineitem").withColumn("course_id", F.col("l_orderkey").cast("string"))
    key, id_ = F.col("l_orderkey"), F.col("l_partkey").cast("string")
    name = F.concat(F.lit("Part "), id_)
    iso = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    canvas = li.filter(key % 3 == 0).select("course_id", _payloads(
        li, id=id_, name=name, due_at=iso, points_possible=F.col("l_quantity"),
        submission_types=F.array(F.lit("online_upload"))))
    handler = F.when(F.col("l_linestatus") == "F", courseware.BLACKBOARD_ASSIGNMENT).otherwise("resource/x-bb-file")
    blackboard = li.filter(key % 3 == 1).select("course_id", _payloads(
        li, id=id_, name=name, description=F.col("l_returnflag"), dueDate=iso,
        contentHandler=F.struct(handler.alias("id"))))
    moodle = li.filter(key % 3 == 2).select("course_id", _payloads(
        li, courses=F.array(F.struct(F.lit("c").alias("id"), F.array(F.struct(
            id_.alias("id"), name.alias("name"), F.col("l_returnflag").alias("intro"),
            F.lit(0).alias("duedate"), F.col("l_quantity").alias("grade"))).alias("assignments")))))
    out = courseware.assignments(canvas, blackboard, moodle)
    return out.select("vendor", "course_id", "assignment_id", "name", "description",
                      F.unix_timestamp("due_at").alias("due_epoch"), "points_possible",
                      F.array_join("submission_types", ",").alias("submission_types"))


@query("A8_record_export", """
SELECT o_custkey, CAST(0 AS BIGINT) AS part,
       CAST(to_json({'o_custkey': o_custkey, 'exported_at': '2002-01-01',
            'records': list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus,
                             'created_at': strftime(o_orderdate, '%Y-%m-%d')} ORDER BY o_orderkey)}) AS VARCHAR) AS document
FROM orders GROUP BY o_custkey""")
def record_export(spark, d):
    rows = table(spark, d, "orders").withColumn("created_at", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return exports.chunked_documents(
        rows, "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "created_at"],
        {"exported_at": F.lit("2002-01-01")})


@query("A9_bulk_export", """
WITH latest AS (SELECT max(o_orderdate) AS ref FROM orders),
     items AS (SELECT l_orderkey, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS created_on, n_items, quantity
FROM orders CROSS JOIN latest LEFT JOIN items ON l_orderkey = o_orderkey
WHERE o_orderdate >= ref - INTERVAL 365 DAY""")
def bulk_export(spark, d):
    orders = table(spark, d, "orders")
    details = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    ref = orders.agg(F.max("o_orderdate")).scalar()
    out = exports.bulk_export(orders, "o_orderdate", "1y", ref, "o_orderpriority", details, "o_orderkey")
    return out.withColumn("created_on", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")


@query("A10_vector_lookup", """
SELECT d.doc_id, e.vec_id IS NOT NULL AS stored, CAST(len(e.embedding) AS BIGINT) AS dimension, round(e.embedding[1]::DOUBLE, 6) AS first_value
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def vector_lookup(spark, d):
    store = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = vector_store.lookup(documents(spark, d).select("doc_id"), store, "doc_id")
    return found.select(
        "doc_id", F.col("embedding").isNotNull().alias("stored"), F.size("embedding").cast("long").alias("dimension"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


# -- B ------------------------------------------------------------------------------------

@query("B1_clean_text", f"SELECT doc_id, {CLEAN_SQL} AS clean_text FROM documents")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("clean_text"))


SANITIZE_SQL = (
    "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
)
for _p, _f in (
    ("<script[^>]*>.*?</script>", "gis"), ("<iframe[^>]*>.*?</iframe>", "gis"), ("javascript:", "gi"),
    (rf"on[\p{{{{L}}}}\p{{{{N}}}}_]+[{q.WS.replace('{', '{{').replace('}', '}}')}]*=", "gi"),
):
    SANITIZE_SQL = f"regexp_replace({SANITIZE_SQL}, '{_p}', '', '{_f}')"
SANITIZE_SQL = "trim(regexp_replace(" + SANITIZE_SQL + ", '[" + q.WS.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'))"


@query("B2_sanitize_text", f"SELECT page_id, {SANITIZE_SQL.format('html')} AS safe FROM pages")
def sanitize_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.sanitize_text(F.col("html")).alias("safe"))


@query("B3_sanitize_json", f"""
SELECT page_id, {SANITIZE_SQL.format('url')} AS url, {SANITIZE_SQL.format('html')} AS html,
       {SANITIZE_SQL.format("url || ' <b>'")} AS tag FROM pages""")
def sanitize_json(spark, d):
    pages = table(spark, d, "pages")
    fields = tx.sanitize_map(F.create_map(F.lit("url"), F.col("url"), F.lit("html"), F.col("html")))
    tags = tx.sanitize_array(F.array(F.concat("url", F.lit(" <b>"))))
    out = pages.select("page_id", fields.alias("fields"), tags.alias("tags"))
    return out.select("page_id", F.col("fields")["url"].alias("url"), F.col("fields")["html"].alias("html"),
                      F.get("tags", F.lit(0)).alias("tag"))


@query("B4_text_statistics", f"""
WITH t AS (SELECT doc_id, text, {q.raw_words()} AS w, {q.sentences()} AS s FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS word_count, CAST(len(s) AS BIGINT) AS sentence_count,
       CAST(length(text) AS BIGINT) AS character_count,
       CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, ''))::DOUBLE / len(w), 6) ELSE 0 END AS avg_word_length,
       CASE WHEN len(s) > 0 THEN round(len(w)::DOUBLE / len(s), 6) ELSE 0 END AS avg_sentence_length
FROM t""")
def text_statistics(spark, d):
    t = documents(spark, d).select("doc_id", "text", tx.raw_words(F.col("text")).alias("w"),
                                   F.size(tx.sentences(F.col("text"))).alias("s"))
    n = F.size("w")
    return t.select(
        "doc_id", n.cast("long").alias("word_count"), F.col("s").cast("long").alias("sentence_count"),
        F.length("text").cast("long").alias("character_count"),
        F.when(n > 0, F.round(F.length(F.array_join("w", "")) / n, 6)).otherwise(0.0).alias("avg_word_length"),
        F.when(F.col("s") > 0, F.round(n / F.col("s"), 6)).otherwise(0.0).alias("avg_sentence_length"))


@query("B5_content_validation", f"""
WITH t AS (SELECT doc_id, text, {q.raw_words()} AS w FROM documents),
     u AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: lower(x) IN {q.in_list(fixed.COMMON_ENGLISH)}))::DOUBLE / len(w)
                     ELSE 0 END AS ratio FROM t)
SELECT doc_id,
       CASE WHEN length(text) = 0 THEN 'content is required' WHEN length(text) < 100 THEN 'fewer than 100 characters'
            WHEN length(text) > 50000 THEN 'more than 50,000 characters' WHEN len(w) < 50 THEN 'fewer than 50 words'
            WHEN len(w) > 10000 THEN 'more than 10,000 words' END AS rejected,
       round(ratio, 6) AS english_ratio,
       regexp_matches(text, '(?i)lorem ipsum') AS placeholder,
       regexp_matches(text, '(?i)test test test') AS test_text,
       ratio < 0.05 AS not_english
FROM u""")
def content_validation(spark, d):
    """The two back-reference rules have no RE2 form; the tests check them on literals."""
    t = documents(spark, d).select("doc_id", "text", tx.raw_words(F.col("text")).alias("w"))
    checks = tx.content_checks(F.col("text"), F.col("w"))
    out = t.select("doc_id", *[c.alias(n) for n, c in checks.items()])
    found = lambda p: F.array_contains("warnings", p)
    return out.select(
        "doc_id", "rejected", F.round("english_ratio", 6).alias("english_ratio"),
        found("Suspicious pattern detected: lorem ipsum").alias("placeholder"),
        found("Suspicious pattern detected: test test test").alias("test_text"),
        found("Content may not be in English").alias("not_english"))


@query("B5_content_warnings")
def content_warnings(spark, d):
    t = documents(spark, d).select("doc_id", "text", tx.raw_words(F.col("text")).alias("w"))
    checks = tx.content_checks(F.col("text"), F.col("w"))
    return t.select("doc_id", F.array_join(checks["warnings"], "; ").alias("warnings"),
                    (F.size(checks["warnings"]) == 0).alias("is_valid"))


@query("B6_identifier_predicates", r"""
SELECT c_custkey,
       regexp_matches(lower(c_mktsegment) || c_custkey || '@example.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS email_ok,
       regexp_matches(c_name, '^[a-zA-Z0-9_-]+$') AND length(c_name) <= 100 AS name_ok,
       regexp_matches(c_mktsegment, '^[a-zA-Z0-9_-]+$') AND length(c_mktsegment) <= 100 AS segment_ok
FROM customer""")
def identifier_predicates(spark, d):
    email = F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    return table(spark, d, "customer").select(
        "c_custkey", tx.valid_email(email).alias("email_ok"), tx.valid_identifier(F.col("c_name")).alias("name_ok"),
        tx.valid_identifier(F.col("c_mktsegment")).alias("segment_ok"))


@query("B8_profile_issues", """
SELECT c_custkey, concat_ws('; ',
         CASE WHEN c_nationkey % 3 = 0 THEN 'Missing required field: lexical_features' END,
         CASE WHEN c_nationkey % 5 = 0 THEN 'Missing required field: syntactic_features' END,
         CASE WHEN c_acctbal < 0 THEN 'Total words must be a non-negative integer' END,
         CASE WHEN c_custkey % 120 > 100 THEN 'Confidence score must be between 0 and 100' END) AS issues
FROM customer""")
def profile_issues(spark, d):
    full = F.create_map(F.lit("ttr"), F.lit(0.5))
    empty = F.create_map().cast("map<string,double>")
    lexical = F.when(F.col("c_nationkey") % 3 != 0, full)
    syntactic = F.when(F.col("c_nationkey") % 5 == 0, empty).otherwise(full)
    issues = tx.profile_issues(lexical, syntactic, full, F.col("c_acctbal"), F.col("c_custkey") % 120)
    return table(spark, d, "customer").select("c_custkey", F.array_join(issues, "; ").alias("issues"))


@query("B9_content_fingerprint", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_fingerprint(spark, d):
    return documents(spark, d).select("doc_id", tx.fingerprint(F.col("text")).alias("content_hash"))


@query("B10_salted_hash", """
SELECT c_custkey, sha256(c_mktsegment || c_name) AS hashed, c_custkey % 2 = 0 AS verified FROM customer""")
def salted_hash(spark, d):
    c = table(spark, d, "customer").withColumn("hashed", tx.salted_hash(F.col("c_name"), F.col("c_mktsegment")))
    claimed = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("x")))
    return c.select("c_custkey", "hashed",
                    tx.matches_salted_hash(claimed, F.col("c_mktsegment"), F.col("hashed")).alias("verified"))


@query("B11_mask_email", """
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE
             CASE WHEN c_custkey % 5 = 0 THEN 'ab' ELSE lower(c_mktsegment) END || '@host' || c_nationkey || '.org' END AS e FROM customer),
     s AS (SELECT *, split_part(e, '@', 1) AS l FROM t)
SELECT c_custkey, CASE WHEN contains(e, '@') THEN
         CASE WHEN length(l) <= 2 THEN '**' ELSE left(l, 1) || repeat('*', length(l) - 2) || right(l, 1) END || '@' || split_part(e, '@', 2)
       ELSE 'anonymous@example.com' END AS masked FROM s""")
def mask_email(spark, d):
    local = F.when(F.col("c_custkey") % 5 == 0, "ab").otherwise(F.lower("c_mktsegment"))
    email = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(
        F.concat(local, F.lit("@host"), F.col("c_nationkey").cast("string"), F.lit(".org")))
    return table(spark, d, "customer").select("c_custkey", tx.mask_email(email).alias("masked"))


def event_ip():
    """An address per event: IPv4 for most users, IPv6 for some, malformed for a few."""
    u = F.col("user_id")
    return (
        F.when(u % 11 == 0, F.concat_ws(":", F.lit("2001"), F.lit("db8"), F.lit("0"), u.cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4")))
        .when(u % 13 == 0, F.lit("unknown"))
        .otherwise(F.concat_ws(".", F.when(u % 2 == 0, "10").otherwise("203"), F.lit("0"), (u % 256).cast("string"), (u % 250 + 1).cast("string")))
    )


EVENT_IP_SQL = """CASE WHEN user_id % 11 = 0 THEN '2001:db8:0:' || user_id || ':1:2:3:4' WHEN user_id % 13 = 0 THEN 'unknown'
  ELSE CASE WHEN user_id % 2 = 0 THEN '10' ELSE '203' END || '.0.' || (user_id % 256) || '.' || (user_id % 250 + 1) END"""


@query("B12_mask_ip", f"""
SELECT event_id, CASE WHEN user_id % 11 = 0 THEN '2001:db8:0:' || user_id || '::0' WHEN user_id % 13 = 0 THEN '0.0.0.0'
  ELSE CASE WHEN user_id % 2 = 0 THEN '10' ELSE '203' END || '.0.' || (user_id % 256) || '.0' END AS masked FROM events""")
def mask_ip(spark, d):
    return table(spark, d, "events").select("event_id", tx.mask_ip(event_ip()).alias("masked"))


def event_agent():
    """A client string per event."""
    u = F.col("event_id") % 7
    return (
        F.when(u == 0, "Mozilla/5.0 Chrome/120 Safari/537").when(u == 1, "Mozilla/5.0 Firefox/121")
        .when(u == 2, "Mozilla/5.0 Version/17 Safari/605").when(u == 3, "Mozilla/5.0 Edge/18")
        .when(u == 4, "curl/8.0").when(u == 5, "searchbot/2.1 (+http://example.org)").otherwise("")
    )


EVENT_AGENT_SQL = """CASE event_id % 7 WHEN 0 THEN 'Mozilla/5.0 Chrome/120 Safari/537' WHEN 1 THEN 'Mozilla/5.0 Firefox/121'
  WHEN 2 THEN 'Mozilla/5.0 Version/17 Safari/605' WHEN 3 THEN 'Mozilla/5.0 Edge/18' WHEN 4 THEN 'curl/8.0'
  WHEN 5 THEN 'searchbot/2.1 (+http://example.org)' ELSE '' END"""


@query("B13_browser_family", """
SELECT CASE event_id % 7 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' WHEN 3 THEN 'Edge'
       WHEN 6 THEN 'Unknown' ELSE 'Other' END AS family, count(*) AS n FROM events GROUP BY 1""")
def browser_family(spark, d):
    family = table(spark, d, "events").select(tx.browser_family(event_agent()).alias("family"))
    return family.groupBy("family").agg(F.count("*").alias("n"))


@query("B14_pseudonym", "SELECT c_custkey, 'User_' || left(sha256('salt' || c_custkey), 8) AS pseudonym FROM customer")
def pseudonym(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.pseudonym(F.col("c_custkey"), "salt").alias("pseudonym"))


@query("B15_path_normaliser", r"""
SELECT regexp_replace(regexp_replace(url, '/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '/{id}', 'gi'),
                      '/\d+', '/{id}', 'g') AS path, count(*) AS n FROM pages GROUP BY 1""")
def path_normaliser(spark, d):
    paths = table(spark, d, "pages").select(tx.normalize_path(F.col("url")).alias("path"))
    return paths.groupBy("path").agg(F.count("*").alias("n"))


@query("B16_substring_search", """
SELECT doc_id FROM documents WHERE contains(lower(source || ' essay ' || doc_id), 'src7') OR contains(lower(text), 'the then')""")
def substring_search(spark, d):
    from ..operators.submissions import search
    rows = corpus.submissions(documents(spark, d))
    hits = search(rows, "src7").select("submission_id").unionByName(search(rows, "THE then").select("submission_id"))
    return hits.distinct().withColumnRenamed("submission_id", "doc_id")


@query("B16_indexed_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the then')")
def indexed_search(spark, d):
    """The search in texts over a stored index of three-character runs."""
    from ..operators import submissions as sb
    rows = documents(spark, d).select("doc_id", "text")
    path = f"{ensure_checkpoint_dir(spark)}/substrings-{uuid.uuid4().hex}"
    sb.build_substring_index(rows, path, "doc_id", ["text"])
    return sb.indexed_search(rows, path, "doc_id", "THE then", ("text",)).select("doc_id")
