"""Groups I, J and K on the driver's tables: profiles, submission queries and dashboards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx
from ..operators import institution as inst
from ..operators import profiles as pr
from ..operators import stylometry as st
from ..operators import submissions as sb
from ..session import ensure_checkpoint_dir, spread
from ..sources.tables import table
from . import records as rec
from . import sqltext as q
from .registry import query
from .style_queries import LEXICON, PROFILE_LEX_SQL, PROFILE_SYN_SQL, SUFFIX_TAGS, lexicon_rows


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "source", "text", "n_chars"))


# -- I ------------------------------------------------------------------------------------

@query("I1_changed_counters", """
SELECT source, count(*) AS total_submissions, sum(length(text))::BIGINT AS total_chars FROM documents GROUP BY source
HAVING count(*) <> count(*) FILTER (doc_id % 7 <> 0) OR sum(length(text)) <> coalesce(sum(length(text)) FILTER (doc_id % 7 <> 0), 0)""")
def changed_counters(spark, d):
    """Stored profiles that missed every seventh submission, against the whole table."""
    docs = documents(spark, d)
    stored = docs.groupBy("source").agg(
        F.count_if(F.col("doc_id") % 7 != 0).alias("total_submissions"),
        F.coalesce(F.sum(F.when(F.col("doc_id") % 7 != 0, F.length("text"))), F.lit(0)).alias("total_chars"))
    return pr.changed_counters(stored, docs, "source", "text").select("source", "total_submissions", "total_chars")


OWNER_LEX = f"""ow AS (SELECT source, word, count(*) AS f FROM (SELECT source, unnest({q.words()}) AS word FROM documents) GROUP BY 1, 2),
olex AS (SELECT source, sum(f)::BIGINT AS total_words, count(*) AS unique_words, count(*) / sum(f)::DOUBLE AS type_token_ratio,
  sum(f * length(word))::DOUBLE / sum(f)::DOUBLE AS avg_word_length, 10000 * (sum(f * f) - sum(f))::DOUBLE / (sum(f) * sum(f))::DOUBLE AS vocabulary_richness FROM ow GROUP BY source)"""


@query("I2_profile_initialisation", f"""
WITH {OWNER_LEX} SELECT source, total_words, unique_words, round(type_token_ratio, 6) AS type_token_ratio, round(avg_word_length, 6) AS avg_word_length,
  round(vocabulary_richness, 5) AS vocabulary_richness FROM olex""")
def profile_initialisation(spark, d):
    out = pr.owner_lexical(documents(spark, d), "source", "text")
    return out.select("source", "total_words", "unique_words", F.round("type_token_ratio", 6).alias("type_token_ratio"),
                      F.round("avg_word_length", 6).alias("avg_word_length"), F.round("vocabulary_richness", 5).alias("vocabulary_richness"))


PROFILES = f"""{PROFILE_LEX_SQL}, {PROFILE_SYN_SQL}, {OWNER_LEX},
psum AS (SELECT a.source, count(*) AS total_submissions, sum(total_sentences)::BIGINT AS total_sentences FROM plex a JOIN psyn b USING (doc_id) GROUP BY a.source),
prof AS (SELECT source, total_submissions, o.total_words, total_sentences, o.type_token_ratio, o.total_words / total_sentences::DOUBLE AS avg_sentence_length
  FROM psum JOIN olex o USING (source)),
conf AS (SELECT *, least(100, CASE WHEN total_submissions >= 5 THEN 40 WHEN total_submissions >= 3 THEN 30 WHEN total_submissions >= 2 THEN 20 ELSE 10 END
  + CASE WHEN total_words >= 5000 THEN 30 WHEN total_words >= 2000 THEN 25 WHEN total_words >= 1000 THEN 20 ELSE 10 END
  + CASE WHEN type_token_ratio BETWEEN 0.3 AND 0.8 THEN 30 ELSE 15 END)::BIGINT AS confidence FROM prof)"""


def owner_profiles(spark, d):
    return pr.initialise(documents(spark, d), "source", "text")


@query("I4_profile_confidence", f"WITH {PROFILES} SELECT source, total_submissions, total_words, confidence FROM conf")
def profile_confidence(spark, d):
    return owner_profiles(spark, d).select("source", "total_submissions", "total_words", F.col("confidence").cast("long").alias("confidence"))


@query("I3_weighted_merge", f"""
WITH w AS (SELECT doc_id, source, category, count(*) AS n FROM (SELECT doc_id, source, unnest({q.words()}) AS word FROM documents)
   JOIN {q.values([(x, c) for c, ws in fixed.FUNCTION_WORDS.items() for x in ws], 'lex_word, category')} ON word = lex_word GROUP BY 1, 2, 3),
p AS (SELECT source, category, sum(n)::DOUBLE AS total FROM w GROUP BY 1, 2),
wt AS (SELECT source, count(*) AS ew FROM documents GROUP BY 1),
one AS (SELECT doc_id, source, category, n::DOUBLE AS n FROM w),
keys AS (SELECT DISTINCT doc_id, p.source, p.category, p.total FROM documents d JOIN p ON p.source = d.source)
SELECT k.doc_id, k.category, round((k.total * ew + coalesce(n, 0.0)) / (ew + 1), 6) AS value
FROM keys k JOIN wt ON wt.source = k.source LEFT JOIN one ON one.doc_id = k.doc_id AND one.category = k.category""")
def weighted_merge(spark, d):
    """An owner's category totals merged with one document's counts, weight 1 against the owner's count."""
    pairs = [(w, c) for c, ws in fixed.FUNCTION_WORDS.items() for w in ws]
    lexicon = spark.createDataFrame(pairs, "word string, category string")
    docs = documents(spark, d)
    counts = docs.select("doc_id", "source", F.explode(tx.words(F.col("text"))).alias("word")).join(lexicon, "word").groupBy(
        "doc_id", "source", "category").agg(F.count("*").cast("double").alias("n"))
    new = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("new"))
    totals = counts.groupBy("source", "category").agg(F.sum("n").alias("n"))
    existing = totals.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("existing"))
    weights = docs.groupBy("source").agg(F.count("*").alias("ew"))
    rows = docs.select("doc_id", "source").join(existing, "source").join(weights, "source").join(new, "doc_id", "left")
    empty = F.create_map().cast("map<string,double>")
    merged = pr.merge_features(F.col("existing"), F.coalesce("new", empty), F.col("ew"), F.lit(1))
    return rows.select("doc_id", F.explode(merged).alias("category", "value")).withColumn("value", F.round("value", 6))


@query("I5_profile_strength", f"""
WITH {PROFILES}, s AS (SELECT *, (CASE WHEN total_submissions >= 5 THEN 1.0 WHEN total_submissions >= 3 THEN 0.8 ELSE 0.5 END::DOUBLE
  + CASE WHEN total_words >= 5000 THEN 1.0 WHEN total_words >= 2000 THEN 0.8 ELSE 0.6 END::DOUBLE + CASE WHEN total_sentences % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE) / 3 AS st FROM conf)
SELECT source, round(st, 6) AS strength, CASE WHEN st >= 0.8 THEN 'high' WHEN st >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_level,
  concat_ws('; ', CASE WHEN total_submissions >= 5 THEN NULL WHEN total_submissions >= 3 THEN 'Add more sample essays for better accuracy' ELSE 'Add at least 3 sample essays for reliable profiling' END,
    CASE WHEN total_words >= 5000 THEN NULL WHEN total_words >= 2000 THEN 'Add longer essays to improve profile accuracy' ELSE 'Add more substantial writing samples' END) AS recommendations,
  CASE WHEN total_sentences % 2 = 0 THEN '' ELSE 'Semantic features' END AS missing_features FROM s""")
def profile_strength(spark, d):
    p = owner_profiles(spark, d).withColumns(
        {"has_lexical": F.lit(True), "has_syntactic": F.lit(True), "has_semantic": F.col("total_sentences") % 2 == 0})
    return pr.strength(p).select("source", F.round("strength", 6).alias("strength"), "confidence_level",
                                 F.array_join("recommendations", "; ").alias("recommendations"),
                                 F.array_join("missing_features", "; ").alias("missing_features"))


@query("I6_strengths_and_areas", f"""
WITH {PROFILES} SELECT source, concat_ws('; ', CASE WHEN type_token_ratio > 0.6 THEN 'Vocabulary Diversity' END, CASE WHEN avg_sentence_length BETWEEN 15 AND 25 THEN 'Sentence Structure' END,
   CASE WHEN confidence >= 80 THEN 'Profile Confidence' END) AS strengths,
  concat_ws('; ', CASE WHEN type_token_ratio < 0.4 THEN 'Vocabulary Diversity' END, CASE WHEN avg_sentence_length < 10 OR avg_sentence_length > 30 THEN 'Sentence Structure' END) AS areas FROM conf""")
def strengths_and_areas(spark, d):
    p = pr.strengths_and_areas(owner_profiles(spark, d))
    names = lambda c: F.array_join(F.transform(c, lambda e: e["category"]), "; ")
    return p.select("source", names("strengths").alias("strengths"), names("improvement_areas").alias("areas"))


@query("I7_profile_deviation", f"""
WITH {PROFILES} SELECT doc_id, round(abs(c.type_token_ratio - p.type_token_ratio), 6) AS deviation,
  CASE WHEN abs(c.type_token_ratio - p.type_token_ratio) > 0.2 THEN 'high' WHEN abs(c.type_token_ratio - p.type_token_ratio) > 0.1 THEN 'medium' ELSE 'low' END AS significance
FROM plex p JOIN conf c ON c.source = p.source WHERE p.type_token_ratio <> 0""")
def profile_deviation(spark, d):
    own = st.with_profile_lexical(documents(spark, d)).select("doc_id", "source", F.col("type_token_ratio").alias("ttr"))
    rows = own.join(owner_profiles(spark, d).select("source", "type_token_ratio"), "source")
    dev, level = pr.deviation(F.col("type_token_ratio"), F.col("ttr"))
    return rows.select("doc_id", F.round(dev, 6).alias("deviation"), level.alias("significance")).filter("deviation is not null")


def scores(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", (F.col("user_id") % 10).alias("cohort"))


@query("I8_score_trend", """
WITH r AS (SELECT max(ts) AS ref FROM events), t AS (SELECT user_id, value, floor(epoch(ref))::BIGINT - floor(epoch(ts))::BIGINT AS age FROM events CROSS JOIN r)
SELECT user_id, floor(age / 259200)::BIGINT AS point, round(avg(value), 5) AS score, count(*) AS n FROM t WHERE age >= 0 AND age < 30 * 86400 GROUP BY 1, 2""")
def score_trend(spark, d):
    s = scores(spark, d)
    ref = s.agg(F.max("ts")).scalar()
    return pr.analytics(s, "user_id", "ts", "value", "30d", ref).withColumn("score", F.round("score", 5))


@query("I9_peer_comparison", """
WITH m AS (SELECT user_id, user_id % 10 AS cohort, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2)
SELECT user_id, mean, round((sum(mean) OVER (PARTITION BY cohort) - mean) / (count(*) OVER (PARTITION BY cohort) - 1), 4) AS peer_mean,
  round(avg(mean) OVER (), 4) AS institution_mean, round(percent_rank() OVER (ORDER BY mean) * 100, 6) AS percentile FROM m""")
def peer_comparison(spark, d):
    p = pr.peer_comparison(scores(spark, d), "user_id", "cohort", "value")
    return p.select("user_id", "mean", F.round("peer_mean", 4).alias("peer_mean"), F.round("institution_mean", 4).alias("institution_mean"),
                    F.round("percentile", 6).alias("percentile"))


@query("I10_recent_improvement", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, round(arg_min(value, k) - arg_max(value, k), 6) AS improvement FROM r WHERE k <= 3 GROUP BY user_id""")
def recent_improvement(spark, d):
    out = pr.recent_improvement(scores(spark, d), "user_id", [F.desc("ts"), F.desc("event_id")], "value")
    return out.withColumn("improvement", F.round("improvement", 6))


@query("I11_radar", f"""
WITH {PROFILE_LEX_SQL}, {PROFILE_SYN_SQL}
SELECT doc_id, round(least(type_token_ratio * 100, 100), 6) AS lexical_richness, round(least(avg_sentence_length / 30 * 100, 100), 6) AS sentence_complexity,
  round(least(vocabulary_richness, 100), 6) AS vocabulary_diversity, round(least((comma + semicolon + exclamation) * 1000, 100), 6) AS punctuation_variety
FROM plex JOIN psyn USING (doc_id)""")
def radar(spark, d):
    df = st.with_profile_syntactic(st.with_profile_lexical(documents(spark, d)))
    marks = F.col("punctuation_frequency")
    cols = pr.radar(F.col("type_token_ratio"), F.col("avg_sentence_length"), F.col("vocabulary_richness"),
                    marks["comma"] + marks["semicolon"] + marks["exclamation"])
    return df.select("doc_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("I12_top_tags", f"""
WITH tok AS (SELECT unnest({q.letters()}) AS word FROM documents),
tagged AS (SELECT coalesce(tag, CASE {' '.join(f"WHEN word LIKE '%{s}' THEN '{t}'" for s, t in SUFFIX_TAGS)} ELSE 'NN' END) AS tag FROM tok LEFT JOIN {q.values(lexicon_rows(), 'lex_word, tag')} ON word = lex_word)
SELECT tag, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tagged), 6) AS percentage FROM tagged GROUP BY tag ORDER BY n DESC, tag LIMIT 8""")
def top_tags(spark, d):
    lexicon = spark.createDataFrame(lexicon_rows(), "word string, tag string")
    tagged = st.tag_tokens(st.tokens(documents(spark, d), letters_only=True), lexicon, SUFFIX_TAGS)
    return pr.top_shares(tagged, "tag", 8).withColumn("percentage", F.round("percentage", 6))


@query("I12_top_function_words", f"""
WITH tok AS (SELECT unnest({q.letters()}) AS word FROM documents), f AS (SELECT word FROM tok WHERE word IN {q.in_list(sorted({w for ws in fixed.FUNCTION_WORDS.values() for w in ws}))})
SELECT word, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f), 6) AS percentage FROM f GROUP BY word ORDER BY n DESC, word LIMIT 12""")
def top_function_words(spark, d):
    known = sorted({w for ws in fixed.FUNCTION_WORDS.values() for w in ws})
    words = st.tokens(documents(spark, d), letters_only=True).filter(F.col("word").isin(known))
    return pr.top_shares(words, "word", 12).withColumn("percentage", F.round("percentage", 6))


@query("I13_mean_length", f"WITH {PROFILES} SELECT source, (total_words // greatest(total_submissions, 1))::BIGINT AS mean_length FROM conf")
def mean_length(spark, d):
    p = owner_profiles(spark, d)
    return p.select("source", pr.mean_length(F.col("total_words"), F.col("total_submissions")).alias("mean_length"))


# -- J ------------------------------------------------------------------------------------

PAGE_SQL = f"WITH {rec.SUBMISSIONS} SELECT submission_id, owner, status, strftime(submitted_at, '%Y-%m-%d') AS submitted_on FROM subs WHERE status = 'FLAGGED' ORDER BY submitted_at DESC, submission_id DESC LIMIT 25 OFFSET 25"


@query("J1_paged_listing", PAGE_SQL)
def paged_listing(spark, d):
    rows, _ = sb.page(rec.submissions(spark, d), [F.desc("submitted_at"), F.desc("submission_id")], 2, 25, status=("status", "FLAGGED"))
    return rows.select("submission_id", "owner", "status", day("submitted_at").alias("submitted_on"))


@query("J1_ranged_page", PAGE_SQL)
def ranged_page(spark, d):
    """The same page of a listing written in ranges."""
    rows, order = rec.submissions(spark, d).filter("status = 'FLAGGED'"), ["submitted_at", "submission_id"]
    path = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    sb.build_pages(rows, path, order, ranges=20)
    return sb.ranged_page(spark, path, order, 2, 25).select("submission_id", "owner", "status", day("submitted_at").alias("submitted_on"))


@query("J1_paged_total", f"WITH {rec.SUBMISSIONS} SELECT count(*) AS total, ceil(count(*) / 25.0)::BIGINT AS pages FROM subs WHERE status = 'FLAGGED'")
def paged_total(spark, d):
    return sb.page(rec.submissions(spark, d), [F.desc("submitted_at")], 1, 25, status=("status", "FLAGGED"))[1]


@query("J2_enriched_listing", f"WITH {rec.RECORDS} SELECT submission_id, owner, status, authorship_score, ai_probability, ledger_status FROM recs")
def enriched_listing(spark, d):
    return rec.joined(spark, d).select("submission_id", "owner", "status", "authorship_score", "ai_probability", "ledger_status")


@query("J2_content_preview", "SELECT doc_id, left(text, 500) AS text, coalesce(quality::DOUBLE, 0.65) AS authorship_score, coalesce(toxic::DOUBLE, 0.0) AS ai_probability, 'PENDING' AS ledger_status FROM documents LEFT JOIN labels USING (doc_id)")
def content_preview(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("authorship_score"), F.col("toxic").cast("double").alias("ai_probability"))
    none = table(spark, d, "labels").filter(F.lit(False)).select("doc_id", F.lit("").alias("ledger_status"))
    out = sb.enriched(table(spark, d, "documents").select("doc_id", "text"), labels, none, "doc_id", "text")
    return out.select("doc_id", "text", "authorship_score", "ai_probability", "ledger_status")


@query("J3_records_by_owner", f"""
WITH {rec.SUBMISSIONS}, {rec.LEDGER} SELECT submission_id, owner, ledger_status, token_id FROM ledg JOIN subs USING (submission_id)
WHERE ledger_status = 'CONFIRMED' ORDER BY recorded_at DESC, submission_id LIMIT 50""")
def records_by_owner(spark, d):
    rows = rec.ledger(spark, d).join(rec.submissions(spark, d), "submission_id")
    out, _ = sb.page(rows, [F.desc("recorded_at"), F.asc("submission_id")], 1, 50, status=("ledger_status", "CONFIRMED"))
    return out.select("submission_id", "owner", "ledger_status", "token_id")


@query("J4_progress", f"""
WITH {rec.SUBMISSIONS} SELECT submission_id, CASE status WHEN 'UPLOADED' THEN 'UPLOADING' WHEN 'PROCESSING' THEN 'PROCESSING' WHEN 'VERIFIED' THEN 'COMPLETED' WHEN 'FLAGGED' THEN 'COMPLETED' WHEN 'REJECTED' THEN 'COMPLETED' ELSE 'UNKNOWN' END AS stage,
  CASE status WHEN 'UPLOADED' THEN 10 WHEN 'PROCESSING' THEN 50 ELSE 100 END::BIGINT AS progress FROM subs""")
def progress(spark, d):
    return sb.with_progress(rec.submissions(spark, d)).select("submission_id", "stage", F.col("progress").cast("long").alias("progress"))


@query("J5_status_counts", f"""
WITH {rec.SUBMISSIONS} SELECT count(*) FILTER (status IN ('VERIFIED', 'FLAGGED', 'REJECTED')) AS completed, count(*) FILTER (status IN ('UPLOADED', 'PROCESSING')) AS processing,
  count(*) FILTER (status = 'ERROR') AS failed, count(*) AS total FROM subs""")
def status_counts(spark, d):
    return sb.status_counts(rec.submissions(spark, d))


@query("J6_cascade_delete", """
SELECT 'submissions' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")
    kept = sb.cascade_delete({"submissions": orders, "items": items}, orders.filter("o_orderstatus = 'P'"), "id")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1])


@query("J7_bulk_operations", f"""
WITH {rec.SUBMISSIONS}, r AS (SELECT submission_id, CASE WHEN amount > 400000 THEN 'REJECTED' ELSE status END AS status, CASE WHEN amount > 400000 THEN 'too long' END AS review_notes FROM subs)
SELECT 'review' AS operation, status, coalesce(review_notes, '') AS notes, count(*) AS n FROM r GROUP BY 2, 3
UNION ALL SELECT 'verify', CASE WHEN amount > 400000 AND status NOT IN ('VERIFIED', 'FLAGGED', 'REJECTED') THEN 'PROCESSING' ELSE status END AS status, '', count(*) FROM subs GROUP BY 2""")
def bulk_operations(spark, d):
    s = rec.submissions(spark, d)
    ids = s.filter("amount > 400000")
    reviewed = sb.bulk_review(s, ids, "submission_id", "reject", "too long").groupBy("status", F.coalesce("review_notes", F.lit("")).alias("notes")).agg(F.count("*").alias("n"))
    again = sb.bulk_verify(s, ids, "submission_id").groupBy("status").agg(F.count("*").alias("n")).withColumn("notes", F.lit(""))
    return reviewed.withColumn("operation", F.lit("review")).unionByName(again.withColumn("operation", F.lit("verify")))


@query("J8_awaiting_verification", "SELECT doc_id FROM documents WHERE length(text) > 50 AND doc_id % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def awaiting_verification(spark, d):
    docs = documents(spark, d).withColumn("status", F.when(F.col("doc_id") % 5 == 0, "PROCESSING").otherwise("UPLOADED"))
    return sb.awaiting_verification(docs, table(spark, d, "labels"), "doc_id", F.length("text")).select("doc_id")


@query("J9_flagged_queue", f"""
WITH {rec.RECORDS} SELECT submission_id, owner, CASE WHEN authorship_score < 50 OR ai_probability > 80 OR duplicates > 2 THEN 'HIGH'
  WHEN authorship_score < 70 OR ai_probability > 50 OR duplicates > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM recs WHERE status = 'FLAGGED'""")
def flagged_queue(spark, d):
    out = sb.flagged_queue(rec.joined(spark, d), "severity", "submission_id", "FLAGGED")
    return out.select("submission_id", "owner", "severity")


# -- K ------------------------------------------------------------------------------------

TREND = f"""WITH {rec.RECORDS}, trend AS (SELECT CAST(submitted_at AS DATE) AS day, count(*) AS n, avg(CASE WHEN status = 'VERIFIED' THEN 1.0 ELSE 0.0 END) * 100 AS pass_rate FROM recs GROUP BY 1)"""
AI_TREND = f"""WITH {rec.RECORDS}, ai AS (SELECT CAST(submitted_at AS DATE) AS day, avg(ai_probability) AS ai_probability, count(*) FILTER (ai_probability > 70) AS flagged FROM recs GROUP BY 1)"""


def trend_rows(spark, d):
    return inst.submission_trend(rec.submissions(spark, d), "submitted_at", F.col("status") == "VERIFIED")


def ai_rows(spark, d):
    return inst.ai_usage_trend(rec.joined(spark, d), "submitted_at", F.col("ai_probability"))


@query("K1_submission_trend", f"{TREND} SELECT CAST(day AS VARCHAR) AS day, n, round(pass_rate, 6) AS pass_rate, round(100 - pass_rate, 6) AS fail_rate FROM trend")
def submission_trend(spark, d):
    t = trend_rows(spark, d)
    return t.select(F.col("day").cast("string").alias("day"), "n", F.round("pass_rate", 6).alias("pass_rate"), F.round("fail_rate", 6).alias("fail_rate"))


@query("K2_ai_usage_trend", f"{AI_TREND} SELECT CAST(day AS VARCHAR) AS day, round(ai_probability, 8) AS ai_probability, flagged, round(100 - ai_probability, 8) AS human_probability FROM ai")
def ai_usage_trend(spark, d):
    t = ai_rows(spark, d)
    return t.select(F.col("day").cast("string").alias("day"), F.round("ai_probability", 8).alias("ai_probability"), "flagged", F.round("human_probability", 8).alias("human_probability"))


@query("K3_duplicate_shares", "SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 6) AS percentage FROM events GROUP BY 1")
def duplicate_shares(spark, d):
    return inst.shares(table(spark, d, "events"), "event_type").withColumn("percentage", F.round("percentage", 6))


@query("K4_outliers_by_type", f"WITH {rec.OUTLIERS} SELECT kind, count(*) AS n FROM outl GROUP BY kind")
def outliers_by_type(spark, d):
    return inst.outliers_by_type(rec.outliers(spark, d), "kind")


@query("K4_outliers_by_severity", f"WITH {rec.OUTLIERS} SELECT severity, count(event_id) AS n FROM (VALUES ('low'), ('medium'), ('high')) AS s(severity) LEFT JOIN outl USING (severity) GROUP BY severity")
def outliers_by_severity(spark, d):
    return inst.outliers_by_severity(rec.outliers(spark, d), "severity")


def direction_sql(table_name, value):
    return f"""(SELECT (r - o) / o * 100 AS change FROM (SELECT avg({value}) AS r FROM (SELECT {value} FROM {table_name} ORDER BY day DESC LIMIT 3)), (SELECT avg({value}) AS o FROM (SELECT {value} FROM {table_name} ORDER BY day LIMIT 3)))"""


@query("K5_trend_direction", f"{TREND}, c AS {direction_sql('trend', 'n')} SELECT CASE WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END AS direction, round(abs(change), 6) AS percentage FROM c")
def trend_direction(spark, d):
    return inst.trend_direction(trend_rows(spark, d), "day", "n").withColumn("percentage", F.round("percentage", 6))


TOTALS = f"""{rec.RECORDS}, stats AS (SELECT count(DISTINCT owner) AS owners, count(*) AS submissions, count(*) FILTER (status IN ('UPLOADED', 'PROCESSING')) AS pending, count(*) FILTER (status = 'FLAGGED') AS flagged,
  avg(authorship_score) AS mean_authorship, avg(ai_probability) AS mean_ai, count(*) FILTER (duplicates > 0) AS duplicates, count(*) FILTER (attested) AS attestations FROM recs)"""


@query("K6_institution_kpis", f"""WITH {TOTALS} SELECT round(attestations * 100.0::DOUBLE / submissions)::BIGINT AS verification_success_rate, round((submissions - flagged) * 100.0::DOUBLE / submissions)::BIGINT AS integrity_rate,
  round(duplicates * 100.0::DOUBLE / submissions)::BIGINT AS duplicate_rate, round(mean_authorship)::BIGINT AS mean_authorship FROM stats""")
def institution_kpis(spark, d):
    return inst.kpis(inst.admin_totals(rec.joined(spark, d)))


@query("K7_top_outliers", f"WITH {rec.OUTLIERS} SELECT event_id, user_id, value FROM outl WHERE severity = 'high' ORDER BY value DESC, event_id LIMIT 5")
def top_outliers(spark, d):
    return inst.top_outliers(rec.outliers(spark, d), "severity", [F.desc("value"), F.asc("event_id")]).select("event_id", "user_id", "value")


@query("K8_kpi_summary", f"""{TREND}, ai AS (SELECT avg(ai_probability) AS p FROM recs GROUP BY CAST(submitted_at AS DATE)), {rec.OUTLIERS}
SELECT (SELECT round(avg(pass_rate))::BIGINT FROM trend) AS mean_pass_rate, (SELECT round(avg(p))::BIGINT FROM ai) AS mean_ai,
  (SELECT count(*) FROM outl) AS outliers, (SELECT count(*) FROM events) AS duplicate_cases""")
def kpi_summary(spark, d):
    return inst.summary(trend_rows(spark, d), ai_rows(spark, d), rec.outliers(spark, d), inst.shares(table(spark, d, "events"), "event_type"))


@query("K9_recommendations", f"""WITH {TOTALS}, {rec.OUTLIERS},
trend AS (SELECT CAST(submitted_at AS DATE) AS day, count(*) AS n, avg(CASE WHEN status = 'VERIFIED' THEN 1.0 ELSE 0.0 END) * 100 AS pass_rate, avg(ai_probability) AS ai FROM recs GROUP BY 1),
c1 AS {direction_sql('trend', 'n')}, c2 AS {direction_sql('trend', 'pass_rate')}, c3 AS {direction_sql('trend', 'ai')},
h AS (SELECT count(*) AS high FROM outl WHERE severity = 'high')
SELECT concat_ws('; ', CASE WHEN mean_authorship >= 80 THEN 'High average authorship verification scores' END, CASE WHEN flagged / submissions < 0.1 THEN 'Low academic integrity violation rate' END,
   CASE WHEN attestations / submissions >= 0.9 THEN 'Excellent attestation success rate' END, CASE WHEN high = 0 THEN 'No high-severity outliers detected' END) AS strengths,
  concat_ws('; ', CASE WHEN mean_authorship < 70 THEN 'Consider additional writing profile training' END, CASE WHEN flagged / submissions > 0.15 THEN 'Implement additional academic integrity education' END,
   CASE WHEN pending > submissions * 0.1 THEN 'Review queue requires attention' END, CASE WHEN high > 0 THEN 'Address high-priority outlier detections promptly' END) AS improvements,
  concat_ws('; ', CASE WHEN c1.change > 5 THEN 'Submission volume is trending upward' END, CASE WHEN c2.change < -5 THEN 'Pass rates are declining' END,
   CASE WHEN c3.change > 5 THEN 'AI usage appears to be increasing' END, CASE WHEN high > 0 THEN 'High-severity outliers detected' END) AS trends
FROM stats, h, c1, c2, c3""")
def recommendations(spark, d):
    t, a = trend_rows(spark, d), ai_rows(spark, d)
    direction = lambda df, v: inst.trend_direction(df, "day", v).select("direction").scalar()
    high = rec.outliers(spark, d).agg(F.count_if(F.col("severity") == "high")).scalar()
    stats = inst.admin_totals(rec.joined(spark, d)).withColumns(
        {"high": high, "t1": direction(t, "n"), "t2": direction(t, "pass_rate"), "t3": direction(a, "ai_probability")})
    out = inst.recommendations(stats, F.col("high"), F.col("t1"), F.col("t2"), F.col("t3"))
    return out.select(*[F.array_join(c, "; ").alias(c) for c in ("strengths", "improvements", "trends")])


@query("K10_admin_totals", f"""WITH {rec.RECORDS}, ref AS (SELECT max(submitted_at) AS r FROM recs), recent AS (SELECT recs.* FROM recs CROSS JOIN ref WHERE submitted_at >= r - INTERVAL 90 DAY)
SELECT count(DISTINCT owner) AS owners, count(*) AS submissions, count(*) FILTER (status IN ('UPLOADED', 'PROCESSING')) AS pending, count(*) FILTER (status = 'FLAGGED') AS flagged,
  round(avg(authorship_score), 5) AS mean_authorship, round(avg(ai_probability), 5) AS mean_ai, count(*) FILTER (duplicates > 0) AS duplicates, count(*) FILTER (attested) AS attestations FROM recent""")
def admin_totals(spark, d):
    from ..sources.exports import in_range
    rows = rec.joined(spark, d)
    ref = rec.submissions(spark, d).agg(F.max("submitted_at")).scalar()
    out = inst.admin_totals(in_range(rows, "submitted_at", "90d", ref))
    return out.withColumns({c: F.round(c, 5) for c in ("mean_authorship", "mean_ai")})
