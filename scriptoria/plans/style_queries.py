"""Group C on the driver's tables: tokens and style features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx
from ..operators import stylometry as st
from ..session import spread, stage
from ..sources.tables import table
from . import sqltext as q
from .registry import query
from .text_queries import CLEAN_SQL


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


def rounded(df, keys, names, digits=6):
    return df.select(*keys, *[F.round(F.col(n), digits).alias(n) for n in names])


BASE = f"""base AS (
  SELECT doc_id, source, text, {q.letters('clean')} AS tokens,
         list_transform({q.sentences('clean')}, lambda s: len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'))) AS sw
  FROM (SELECT doc_id, source, text, {CLEAN_SQL} AS clean FROM documents))"""

LEXICAL = f"""lex AS (
  SELECT doc_id, count(word) AS v, count(*) FILTER (n = 1) AS h, count(*) FILTER (n = 2) AS dd
  FROM ({q.frequencies('tokens', 'base')}) GROUP BY doc_id),
lexical AS (
  SELECT doc_id, coalesce(v / nullif(len(tokens), 0), 0.0) AS type_token_ratio, coalesce(v, 0)::BIGINT AS vocabulary_size,
         coalesce(h / nullif(len(tokens), 0), 0.0) AS hapax_legomena_ratio,
         coalesce(dd / nullif(len(tokens), 0), 0.0) AS dis_legomena_ratio
  FROM base LEFT JOIN lex USING (doc_id))"""

SENTENCE = """sent AS (
  SELECT doc_id, coalesce(list_sum(sw) / nullif(len(sw), 0), 0.0) AS avg_sentence_length,
         coalesce((len(sw) * list_sum(list_transform(sw, lambda x: x * x)) - list_sum(sw) * list_sum(sw))::DOUBLE / nullif(len(sw) * len(sw), 0), 0.0) AS sentence_length_variance,
         coalesce(len(list_filter(sw, lambda x: x < 10)) / nullif(len(sw), 0), 0.0) AS short_sentence_ratio,
         coalesce(len(list_filter(sw, lambda x: x > 25)) / nullif(len(sw), 0), 0.0) AS long_sentence_ratio,
         len(sw)::BIGINT AS sentence_count FROM base)"""


def mark_sql(chars):
    return "(" + " + ".join(q.occurrences("text", c) for c in chars) + ")"


PUNCT = "punct AS (SELECT doc_id, " + ", ".join(
    f"coalesce({mark_sql(c)} / nullif(length(text), 0), 0.0) AS {n}_frequency" for n, c in fixed.PUNCTUATION.items()
) + ", coalesce((" + " + ".join(mark_sql(c) for c in fixed.PUNCTUATION.values()) + \
    ") / nullif(length(text), 0), 0.0) AS total_punctuation_ratio FROM base)"

FUNCTION = "func AS (SELECT doc_id, " + ", ".join(
    f"coalesce({q.member_count('tokens', w)} / nullif(len(tokens), 0), 0.0) AS {c}_frequency"
    for c, w in fixed.FUNCTION_WORDS.items()
) + ", coalesce((" + " + ".join(q.member_count("tokens", w) for w in fixed.FUNCTION_WORDS.values()) + \
    ") / nullif(len(tokens), 0), 0.0) AS function_word_ratio FROM base)"

SYLLABLES = """list_transform(list_transform(tokens, lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w:
    greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN right(w, 1) = 'e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))"""

READ = f"""syl AS (SELECT doc_id, len(tokens)::DOUBLE AS n, len(sw)::DOUBLE AS s, length(array_to_string(tokens, '')) AS chars, {SYLLABLES} AS y FROM base),
reading AS (
  SELECT doc_id, CASE WHEN n > 0 AND s > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (list_sum(y) / n) ELSE 0 END AS flesch_reading_ease,
         CASE WHEN n > 0 AND s > 0 THEN 0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (list_sum(y) / n) - 15.59::DOUBLE ELSE 0 END AS flesch_kincaid_grade,
         CASE WHEN n > 0 AND s > 0 THEN chars / n ELSE 0 END AS avg_word_length,
         CASE WHEN n > 0 AND s > 0 THEN len(list_filter(y, lambda x: x >= 3)) / n ELSE 0 END AS complex_word_ratio FROM syl)"""


def features_sql(prefix=""):
    return f"WITH {BASE}, {LEXICAL}, {SENTENCE}, {PUNCT}, {FUNCTION}, {READ}, feats AS (SELECT * FROM base " + " ".join(
        f"JOIN {t} USING (doc_id)" for t in ("lexical", "sent", "punct", "func", "reading")) + ")"


def select_rounded(names, source, key="doc_id"):
    cast = {"vocabulary_size", "sentence_count", "total_words", "unique_words", "total_sentences", "text_length", "word_count"}
    return f"SELECT {key}, " + ", ".join(n if n in cast else f"round({n}, 6) AS {n}" for n in names) + f" FROM {source}"


@query("C1_tokens", f"""
SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos, w[p] AS word
FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, {q.words()} AS w FROM documents))""")
def tokens(spark, d):
    rows = st.tokens(table(spark, d, "documents"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


@query("C1_sentences", f"""
SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos, s[p] AS sentence
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM (SELECT doc_id, {q.sentences()} AS s FROM documents))""")
def sentences(spark, d):
    rows = st.sentence_rows(table(spark, d, "documents"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


LEX_NAMES = st.FEATURES[:4]


@query("C2_lexical_richness", f"WITH {BASE}, {LEXICAL} " + select_rounded(LEX_NAMES, "lexical"))
def lexical_richness(spark, d):
    return rounded(st.with_lexical_richness(st.prepare(documents(spark, d))), ["doc_id"], LEX_NAMES)


def factors_sql(words):
    """Segments closed by a type-token ratio under 0.72, by their words themselves, and one for a rest."""
    seen = "CASE WHEN list_contains(a.seen, x.w) THEN a.seen ELSE list_append(a.seen, x.w) END"
    closes = f"len({seen}) / (a.k + 1) < 0.72"
    start = "{'w': '', 'seen': []::VARCHAR[], 'c': 0, 'k': 0}"
    rows = f"list_prepend({start}, list_transform({words}, lambda w: {{'w': w, 'seen': []::VARCHAR[], 'c': 0, 'k': 0}}))"
    step = f"{{'w': x.w, 'seen': CASE WHEN {closes} THEN []::VARCHAR[] ELSE {seen} END, 'c': a.c + CASE WHEN {closes} THEN 1 ELSE 0 END, 'k': CASE WHEN {closes} THEN 0 ELSE a.k + 1 END}}"
    return f"list_reduce({rows}, lambda a, x: {step})"


@query("C3_mtld", f"""
WITH {BASE}, runs AS (SELECT doc_id, len(tokens) AS n, {factors_sql('tokens')} AS f, {factors_sql('list_reverse(tokens)')} AS b FROM base)
SELECT doc_id, CASE WHEN n < 50 OR n IS NULL THEN 0.0 ELSE round(2.0::DOUBLE * n / (f.c + b.c + CASE WHEN f.k > 0 THEN 1 ELSE 0 END + CASE WHEN b.k > 0 THEN 1 ELSE 0 END), 6) END AS mtld FROM runs""")
def mtld(spark, d):
    df = st.prepare(documents(spark, d))
    return df.select("doc_id", F.round(st.mtld(F.col("tokens")), 6).alias("mtld"))


@query("C4_sentence_structure", f"WITH {BASE}, {SENTENCE} " + select_rounded(st.FEATURES[4:9], "sent"))
def sentence_structure(spark, d):
    return rounded(st.with_sentence_structure(st.prepare(documents(spark, d))), ["doc_id"], st.FEATURES[4:9])


@query("C5_punctuation_profile", f"WITH {BASE}, {PUNCT} " + select_rounded(st.FEATURES[9:18], "punct"))
def punctuation_profile(spark, d):
    return rounded(st.with_punctuation(documents(spark, d)), ["doc_id"], st.FEATURES[9:18])


# Tags of the example lexicon and suffix rules.
LEXICON = {"article": "DT", "preposition": "IN", "pronoun": "PRP", "conjunction": "CC", "auxiliary_verb": "VB"}
SUFFIX_TAGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ble", "JJ"), ("s", "NNS")]


def lexicon_rows():
    """One tag per word: the first category that lists it."""
    seen = {}
    for category, words in fixed.FUNCTION_WORDS.items():
        for word in words:
            seen.setdefault(word, LEXICON[category])
    return sorted(seen.items())


@query("C6_tag_ratios", f"""
WITH tok AS (SELECT doc_id, unnest({q.letters()}) AS word FROM documents),
     tagged AS (SELECT doc_id, coalesce(tag, CASE {' '.join(f"WHEN word LIKE '%{s}' THEN '{t}'" for s, t in SUFFIX_TAGS)} ELSE 'NN' END) AS tag
                FROM tok LEFT JOIN {q.values(lexicon_rows(), 'lex_word, tag')} ON word = lex_word)
SELECT doc_id, {', '.join(f"round(avg(CASE WHEN tag IN {q.in_list(t)} THEN 1.0 ELSE 0.0 END), 6) AS {n}_ratio" for n, t in fixed.POS_GROUPS.items())}
FROM tagged GROUP BY doc_id""")
def tag_ratios(spark, d):
    lexicon = spark.createDataFrame(lexicon_rows(), "word string, tag string")
    tagged = st.tag_tokens(st.tokens(documents(spark, d), letters_only=True), lexicon, SUFFIX_TAGS)
    return rounded(st.tag_ratios(tagged), ["doc_id"], [f"{g}_ratio" for g in fixed.POS_GROUPS])


@query("C7_function_words", f"WITH {BASE}, {FUNCTION} " + select_rounded(st.FEATURES[18:24], "func"))
def function_words(spark, d):
    return rounded(st.with_function_words(st.prepare(documents(spark, d))), ["doc_id"], st.FEATURES[18:24])


@query("C8_readability", f"WITH {BASE}, {READ} " + select_rounded(st.FEATURES[24:], "reading"))
def readability(spark, d):
    return rounded(st.with_readability(st.prepare(documents(spark, d))), ["doc_id"], st.FEATURES[24:])


@query("C9_syllables", f"""
WITH {BASE} SELECT doc_id, coalesce(list_sum({SYLLABLES}), 0)::BIGINT AS syllables FROM base""")
def syllables(spark, d):
    from ..functions import arrays as ar
    df = st.prepare(documents(spark, d)).withColumn("y", F.transform("tokens", st.syllables))
    return df.select("doc_id", ar.total(F.col("y")).alias("syllables"))


PROFILE_LEX = ["type_token_ratio", "avg_word_length", "vocabulary_richness", "total_words", "unique_words", "total_sentences"]
PROFILE_LEX_SQL = f"""pw AS (SELECT doc_id, source, text, {q.words()} AS w, len({q.sentences()}) AS s FROM documents),
pf AS (SELECT doc_id, count(*) AS v, sum(n * n)::BIGINT AS ff FROM ({q.frequencies('w', 'pw')}) GROUP BY doc_id),
plex AS (SELECT doc_id, source, text, coalesce(v / nullif(len(w), 0), 0.0) AS type_token_ratio,
   coalesce(length(array_to_string(w, '')) / nullif(len(w), 0), 0.0) AS avg_word_length,
   CASE WHEN len(w) > 1 THEN 10000 * (ff - len(w)) / (len(w) * len(w)) ELSE 0.0 END AS vocabulary_richness,
   len(w)::BIGINT AS total_words, coalesce(v, 0)::BIGINT AS unique_words, s::BIGINT AS total_sentences
   FROM pw LEFT JOIN pf USING (doc_id))"""


@query("C10_profile_lexical", f"WITH {PROFILE_LEX_SQL} " + select_rounded(PROFILE_LEX, "plex"))
def profile_lexical(spark, d):
    return rounded(st.with_profile_lexical(documents(spark, d)), ["doc_id"], PROFILE_LEX)


PROFILE_SYN_SQL = f"""ps AS (SELECT doc_id, source, text, list_transform({q.sentences()}, lambda s: len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'))) AS sw FROM documents),
psyn AS (SELECT doc_id, source, coalesce(list_sum(sw) / nullif(len(sw), 0), 0.0) AS avg_sentence_length,
   coalesce((len(sw) * list_sum(list_transform(sw, lambda x: x * x)) - list_sum(sw) * list_sum(sw))::DOUBLE / nullif(len(sw) * len(sw), 0), 0.0) AS sentence_length_variance,
   {', '.join(f"coalesce({mark_sql(c)} / nullif(length(text), 0), 0.0) AS {n}" for n, c in fixed.PROFILE_PUNCTUATION.items())} FROM ps)"""
SYN_NAMES = ["avg_sentence_length", "sentence_length_variance", *fixed.PROFILE_PUNCTUATION]


@query("C11_profile_syntactic", f"WITH {PROFILE_SYN_SQL} " + select_rounded(SYN_NAMES, "psyn"))
def profile_syntactic(spark, d):
    df = st.with_profile_syntactic(documents(spark, d))
    flat = df.withColumns({n: F.col("punctuation_frequency")[n] for n in fixed.PROFILE_PUNCTUATION})
    return rounded(flat, ["doc_id"], SYN_NAMES)


PROFILE_SEM_SQL = f"""psem AS (SELECT doc_id, source, {', '.join(f"coalesce({q.member_count('w', w)} / nullif(len(w), 0), 0.0) AS {n}" for n, w in fixed.PROFILE_FUNCTION_WORDS.items())},
   length(text)::BIGINT AS text_length, len(w)::BIGINT AS word_count FROM (SELECT *, {q.words()} AS w FROM documents))"""
SEM_NAMES = [*fixed.PROFILE_FUNCTION_WORDS, "text_length", "word_count"]


@query("C12_profile_semantic", f"WITH {PROFILE_SEM_SQL} " + select_rounded(SEM_NAMES, "psem"))
def profile_semantic(spark, d):
    df = st.with_profile_semantic(documents(spark, d))
    flat = df.withColumns({n: F.col("function_word_frequency")[n] for n in fixed.PROFILE_FUNCTION_WORDS})
    return rounded(flat, ["doc_id"], SEM_NAMES)


@query("C13_extract_features", features_sql() + " " + select_rounded(st.FEATURES, "feats"))
def extract_features(spark, d):
    return rounded(st.extract_features(documents(spark, d)), ["doc_id"], st.FEATURES)


@query("C14_profile_comparison", features_sql() + f""",
prof AS (SELECT source, {', '.join(f'avg({n}) AS {n}' for n in st.FEATURES)} FROM feats GROUP BY source),
a AS (UNPIVOT (SELECT doc_id, source, {', '.join(f'{n}::DOUBLE AS {n}' for n in st.FEATURES)} FROM feats) ON {', '.join(st.FEATURES)} INTO NAME feature VALUE x),
b AS (UNPIVOT prof ON {', '.join(st.FEATURES)} INTO NAME feature VALUE y),
c AS (SELECT doc_id, avg(abs(x - y) / greatest(abs(x), abs(y), 1e-10)) AS m, count(*) AS n FROM a JOIN b USING (source, feature) GROUP BY doc_id)
SELECT doc_id, round(m, 5) AS avg_difference, round(greatest(0, 1 - m), 5) AS similarity_score, n AS feature_count FROM c""")
def profile_comparison(spark, d):
    """Each document against the mean profile of its owner."""
    feats = stage(st.extract_features(documents(spark, d).select("doc_id", "source", "text")).drop("text"), "features")
    profiles = feats.groupBy("source").agg(*[F.avg(n).alias(n) for n in st.FEATURES])
    profiles = profiles.select("source", st.feature_map(st.FEATURES).alias("owner_profile"))
    own = feats.select("doc_id", "source", st.feature_map(st.FEATURES).alias("profile"))
    out = st.compare_profiles(own.join(profiles, "source"), "profile", "owner_profile")
    return out.select("doc_id", F.round("avg_difference", 5).alias("avg_difference"),
                      F.round("similarity_score", 5).alias("similarity_score"), "feature_count")


@query("C15_split_diversity", """
SELECT doc_id, round(len(list_distinct(string_split(lower(text), ' '))) / len(string_split(lower(text), ' ')), 6) AS diversity FROM documents""")
def split_diversity(spark, d):
    return documents(spark, d).select("doc_id", F.round(st.split_diversity(F.col("text")), 6).alias("diversity"))


@query("C16_split_sentence_length", """
SELECT doc_id, round(CASE WHEN len(string_split(text, '.')) > 1 THEN len(string_split(text, ' ')) / (len(string_split(text, '.')) - 1) ELSE 0 END, 6) AS mean_length FROM documents""")
def split_sentence_length(spark, d):
    return documents(spark, d).select("doc_id", F.round(st.split_sentence_length(F.col("text")), 6).alias("mean_length"))


@query("C17_feature_matrix", f"""
WITH w AS (SELECT doc_id, unnest({q.words()}) AS word FROM documents),
     c AS (SELECT doc_id, category AS feature, count(*) AS n FROM w JOIN
           {q.values([(x, c) for c, ws in fixed.FUNCTION_WORDS.items() for x in ws], 'lex_word, category')} ON word = lex_word GROUP BY 1, 2),
     names AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT feature FROM c)),
     docs AS (SELECT DISTINCT doc_id FROM c)
SELECT docs.doc_id, pos, coalesce(n, 0)::DOUBLE AS value FROM docs CROSS JOIN names LEFT JOIN c ON c.doc_id = docs.doc_id AND c.feature = names.feature""")
def feature_matrix(spark, d):
    """Category counts per document, aligned; shown with the zeros."""
    pairs = [(w, c) for c, ws in fixed.FUNCTION_WORDS.items() for w in ws]
    lexicon = spark.createDataFrame(pairs, "word string, feature string")
    sparse = st.tokens(documents(spark, d)).join(lexicon, "word").groupBy("doc_id", "feature").agg(
        F.count("*").cast("double").alias("value"))
    _, matrix = st.feature_matrix(sparse, "doc_id")
    held = F.map_from_arrays("pos", "values").alias("held")
    dense = matrix.select("doc_id", held, F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pos"))
    return dense.select("doc_id", "pos", F.coalesce(F.col("held")[F.col("pos")], F.lit(0.0)).alias("value"))


@query("C18_anomaly_flags", features_sql() + """
SELECT doc_id, concat_ws('; ', CASE WHEN type_token_ratio < 0.3 THEN 'Very low lexical diversity' END,
   CASE WHEN avg_sentence_length > 50 THEN 'Unusually long sentences' WHEN avg_sentence_length < 5 THEN 'Unusually short sentences' END,
   CASE WHEN total_punctuation_ratio > 0.2 THEN 'Excessive punctuation usage' END) AS flags FROM feats""")
def anomaly_flags(spark, d):
    f = st.extract_features(documents(spark, d))
    flags = st.anomaly_flags(F.col("type_token_ratio"), F.col("avg_sentence_length"), F.col("total_punctuation_ratio"))
    return f.select("doc_id", F.array_join(flags, "; ").alias("flags"))


@query("A7_profile_metrics", f"""
WITH {PROFILE_LEX_SQL},
p AS (SELECT source, count(*) AS total_submissions, sum(total_words) AS words, avg(type_token_ratio) AS ttr, avg(avg_word_length) AS awl FROM plex GROUP BY source)
SELECT source, metric, round(value, 6) AS value FROM (
  SELECT source, unnest(['Total Submissions', 'Total Words', 'type_token_ratio', 'avg_word_length']) AS metric,
         unnest([total_submissions::DOUBLE, words::DOUBLE, ttr, awl]) AS value FROM p)""")
def profile_metrics(spark, d):
    from ..sources import exports
    lexical = st.with_profile_lexical(documents(spark, d))
    profiles = lexical.groupBy("source").agg(
        F.count("*").alias("total_submissions"), F.sum("total_words").alias("words"),
        F.avg("type_token_ratio").alias("type_token_ratio"), F.avg("avg_word_length").alias("avg_word_length"))
    rows = exports.metric_rows(profiles, "source", {"Total Submissions": "total_submissions", "Total Words": "words"},
                               ["type_token_ratio", "avg_word_length"])
    return rows.withColumn("value", F.round("value", 6))


@query("A7_profile_documents", f"""
WITH {PROFILE_LEX_SQL} SELECT source, CAST(to_json({{'source': source, 'submissions': count(*), 'words': sum(total_words)::BIGINT}}) AS VARCHAR) AS document FROM plex GROUP BY source""")
def profile_documents(spark, d):
    from ..sources import exports
    lexical = st.with_profile_lexical(documents(spark, d))
    profiles = lexical.groupBy("source").agg(F.count("*").alias("submissions"), F.sum("total_words").alias("words"))
    return exports.profile_documents(profiles, "source")
