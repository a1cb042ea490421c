"""Group D on the driver's tables: how machine-like texts read.

The stock English phrases do not occur in the driver's invented prose, so the checks pass
vocabularies that do; the defaults are checked on literals in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ailike as ai
from ..operators import bigrams as bg
from ..session import ensure_checkpoint_dir, spread
from ..sources.tables import table
from . import sqltext as q
from .registry import query

LEXICONS = {
    "phrases": ["of the", "in the", "is and", "le la"],
    "transitions": ["and", "und", "et", "with"],
    "formal": ["from", "auch", "dans", "this"],
    "hedges": ["that", "nicht", "is a"],
    "generic": ["the of", "der die", "on the"],
    "personal": ["it is", "ein", "elle"],
    "structure": ["thth", "eau", "en la"],
}


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


RAW = f"""base AS (SELECT doc_id, source, text, {q.raw_words('lower(text)')} AS rw, string_split(text, '.') AS parts,
   list_filter(list_transform(string_split(text, '.'), lambda s: len({q.raw_words('s')})), lambda n: n > 0) AS pw FROM documents)"""

BURST = f"""bf AS (SELECT doc_id, count(*) AS v, sum(n * n)::BIGINT AS ff, sum(n)::BIGINT AS t FROM ({q.frequencies('rw', 'base')}) GROUP BY doc_id),
burst AS (SELECT doc_id, CASE WHEN len(rw) < 10 OR v < 2 THEN 0.5 ELSE least(1.0, sqrt((v * ff - t * t)::DOUBLE) / t / 2.0) END AS burstiness
          FROM base LEFT JOIN bf USING (doc_id))"""


def capped(count, per):
    return f"CASE WHEN {per} > 0 THEN least(1.0, {count} / {per}) ELSE 0.0 END"


N100, N50 = "(len(rw) / 100.0::DOUBLE)", "(len(rw) / 50.0::DOUBLE)"
D6 = capped(q.phrases("text", LEXICONS["phrases"]), N100)
D7 = capped(q.member_count("rw", LEXICONS["transitions"]), N50)
D8 = capped(q.member_count("rw", LEXICONS["formal"]), N100)
D9 = capped(q.phrases("text", LEXICONS["hedges"]), N50)
D10 = capped(q.phrases("text", LEXICONS["generic"]), "len(parts)")
D11 = f"greatest(0.0, 1.0 - {q.phrases('text', LEXICONS['personal'])}::DOUBLE / len(parts) * 5)"
D12 = capped(q.phrases("text", LEXICONS["structure"]), r"len(string_split(text, chr(10) || chr(10)))")


def grams(n):
    parts = " || ' ' || ".join(f"rw[i + {k}]" if k else "rw[i]" for k in range(n))
    return f"list_transform(range(1, greatest(len(rw) - {n - 1}, 0) + 1), lambda i: {parts})"


D4 = """CASE WHEN len(parts) < 3 OR len(pw) = 0 THEN 0.0 ELSE least(1.0, (list_max(map_values(list_histogram)) - 1) / len(pw)) END"""
REPEAT = f"""lens AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(pw) AS w FROM base) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, {grams(2)} AS g2, {grams(3)} AS g3 FROM base),
repeats AS (SELECT base.doc_id,
   CASE WHEN len(parts) < 3 OR len(pw) = 0 THEN 0.0 ELSE least(1.0, (m - 1) / len(pw)) END AS sentence_repetition,
   CASE WHEN len(g2) > 0 THEN (len(g2) - len(list_distinct(g2))) / len(g2) ELSE 0.0 END AS bigram_repetition,
   CASE WHEN len(g3) > 0 THEN (len(g3) - len(list_distinct(g3))) / len(g3) ELSE 0.0 END AS trigram_repetition,
   {D6} AS phrase_repetition, {D7} AS transition_overuse
   FROM base JOIN g USING (doc_id) LEFT JOIN lens USING (doc_id))"""
MARKERS = f"""markers AS (SELECT doc_id, {D8} AS excessive_formality, {D9} AS hedging_language, {D10} AS generic_language,
   {D11} AS lack_personal_experience, {D12} AS overly_structured FROM base)"""
ANOMALY = """anom AS (SELECT doc_id,
   greatest(0.0, 0.5 - CASE WHEN len(rw) > 0 THEN len(list_distinct(rw)) / len(rw) ELSE 0.0 END) * 2 AS low_vocab_diversity,
   CASE WHEN len(parts) > 1 AND len(pw) > 0 THEN greatest(0.0, 1 - sqrt((len(pw) * list_sum(list_transform(pw, lambda x: x * x)) - list_sum(pw) * list_sum(pw))::DOUBLE) / len(pw)
        / (list_sum(pw)::DOUBLE / len(pw) + 1) - 0.3) / 0.7 ELSE 0.0 END AS sentence_uniformity,
   abs(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[.,!?;:]')) / length(text) ELSE 0.0 END - 0.05) * 10 AS punctuation_anomaly FROM base)"""
PERPLEXITY = f"""wl AS (SELECT doc_id, {q.words()} AS w FROM documents),
bg AS (SELECT doc_id, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM wl)),
c12 AS (SELECT w1, w2, count(*) AS c FROM bg GROUP BY 1, 2),
c1 AS (SELECT w1, sum(c)::BIGINT AS c1 FROM c12 GROUP BY 1),
vocab AS (SELECT count(DISTINCT w2) AS v FROM c12),
ppl AS (SELECT doc_id, coalesce(p, 50.0) AS perplexity FROM documents LEFT JOIN (
   SELECT doc_id, exp(-avg(ln((c + 1.0::DOUBLE) / (c1 + 1.0::DOUBLE * v)))) AS p FROM bg JOIN c12 USING (w1, w2) JOIN c1 USING (w1) CROSS JOIN vocab GROUP BY doc_id) USING (doc_id))"""


def rounded(df, names, digits=6):
    return df.select("doc_id", *[F.round(F.col(n), digits).alias(n) for n in names])


def select(names, source):
    return "SELECT doc_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f" FROM {source}"


@query("D1_perplexity", f"WITH {PERPLEXITY} SELECT doc_id, round(perplexity, 4) AS perplexity FROM ppl")
def perplexity(spark, d):
    return rounded(ai.perplexity(documents(spark, d)), ["perplexity"], 4)


def backoff_sql(fitted, scored, own=False):
    """Back-off perplexity of the documents ``scored`` under the counts of ``fitted``, each document's own counts taken off with ``own``."""
    off = lambda c: c if own else "0"
    return f"""wl AS (SELECT doc_id, source, {q.words()} AS w FROM documents),
bg AS (SELECT doc_id, source, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, source, w, unnest(range(1, len(w))) AS i FROM wl)),
m AS (SELECT * FROM bg WHERE {fitted}),
c12 AS (SELECT w1, w2, count(*) AS c FROM m GROUP BY 1, 2),
c1 AS (SELECT w1, sum(c)::BIGINT AS c1, count(*) AS kinds FROM c12 GROUP BY 1),
c2 AS (SELECT w2, sum(c)::BIGINT AS c2 FROM c12 GROUP BY 1),
tot AS (SELECT sum(c2)::BIGINT AS tokens, count(*) AS vocab FROM c2),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w1, w2) AS o12, count(*) OVER (PARTITION BY doc_id, w1) AS o1,
   count(*) OVER (PARTITION BY doc_id, w2) AS o2, count(*) OVER (PARTITION BY doc_id) AS o FROM bg WHERE {scored}),
lost AS (SELECT doc_id, w1, count(DISTINCT w2) AS lost FROM s JOIN c12 USING (w1, w2) WHERE o12 = c GROUP BY 1, 2),
p AS (SELECT s.doc_id, (coalesce(c, 0) - {off('o12')})::DOUBLE AS c, (coalesce(c1, 0) - {off('o1')})::DOUBLE AS c1, coalesce(kinds, 0) - {off('coalesce(lost, 0)')} AS kinds,
   (coalesce(c2, 0) - {off('o2')} + 1.0::DOUBLE) / (tokens - {off('o')} + vocab + 1) AS pu
   FROM s LEFT JOIN c12 USING (w1, w2) LEFT JOIN c1 USING (w1) LEFT JOIN c2 USING (w2) LEFT JOIN lost ON lost.doc_id = s.doc_id AND lost.w1 = s.w1 CROSS JOIN tot),
ppl AS (SELECT doc_id, coalesce(x, 50.0) AS perplexity FROM (SELECT doc_id FROM documents WHERE {scored}) LEFT JOIN (
   SELECT doc_id, exp(-avg(ln(CASE WHEN c1 > 0 THEN (greatest(c - 0.5, 0) + 0.5::DOUBLE * kinds * pu) / c1 ELSE pu END))) AS x FROM p GROUP BY doc_id) USING (doc_id))"""


@query("D1_perplexity_stored_model", f"WITH {backoff_sql('source <> ' + chr(39) + 'src0' + chr(39), 'source = ' + chr(39) + 'src0' + chr(39))} SELECT doc_id, round(perplexity, 4) AS perplexity FROM ppl")
def perplexity_stored_model(spark, d):
    """A model of all other sources' texts, stored and read again, scores those of one source."""
    docs = documents(spark, d)
    folder = f"{ensure_checkpoint_dir(spark)}/bigram-model-{uuid.uuid4().hex}"
    bg.fit(docs.filter("source <> 'src0'")).save(folder)
    return rounded(bg.perplexity(docs.filter("source = 'src0'"), bg.BigramModel.load(spark, folder)), ["perplexity"], 4)


@query("D1_perplexity_leave_one_out", f"WITH {backoff_sql('true', 'true', own=True)} SELECT doc_id, round(perplexity, 4) AS perplexity FROM ppl")
def perplexity_leave_one_out(spark, d):
    docs = documents(spark, d)
    return rounded(bg.perplexity(docs, bg.fit(docs), leave_out=True), ["perplexity"], 4)


@query("D2_perplexity_band", f"""
WITH {PERPLEXITY} SELECT CASE WHEN perplexity / 30 < 20 THEN 0.8 WHEN perplexity / 30 < 50 THEN 0.5 ELSE 0.2 END::DOUBLE AS band, count(*) AS n FROM ppl GROUP BY 1""")
def perplexity_band(spark, d):
    """Band of a thirtieth of the perplexity: the small corpus gives high values throughout."""
    from ..functions import ladders
    p = ai.perplexity(documents(spark, d))
    return p.groupBy(ladders.perplexity_score(F.col("perplexity") / 30).alias("band")).agg(F.count("*").alias("n"))


@query("D3_burstiness", f"WITH {RAW}, {BURST} " + select(["burstiness"], "burst"))
def burstiness(spark, d):
    return rounded(ai.with_burstiness(ai.prepare(documents(spark, d))), ["burstiness"])


def _repetition(spark, d):
    df = ai.prepare(documents(spark, d))
    return ai.with_repetition(df, phrases=LEXICONS["phrases"], transitions=LEXICONS["transitions"])


def _markers(spark, d):
    names = ("formal", "hedges", "generic", "personal", "structure")
    return ai.with_markers(ai.prepare(documents(spark, d)), **{n: LEXICONS[n] for n in names})


def _register():
    """One query per score: the optimizer prunes the columns a query does not read."""
    for name, build, column, sql in (
        ("D4_sentence_repetition", _repetition, "sentence_repetition", f"WITH {RAW}, {REPEAT} " + select(["sentence_repetition"], "repeats")),
        ("D6_stock_phrases", _repetition, "phrase_repetition", f"WITH {RAW}, {REPEAT} " + select(["phrase_repetition"], "repeats")),
        ("D7_transition_words", _repetition, "transition_overuse", f"WITH {RAW}, {REPEAT} " + select(["transition_overuse"], "repeats")),
        ("D8_formality", _markers, "excessive_formality", f"WITH {RAW}, {MARKERS} " + select(["excessive_formality"], "markers")),
        ("D9_hedging", _markers, "hedging_language", f"WITH {RAW}, {MARKERS} " + select(["hedging_language"], "markers")),
        ("D10_generic_phrases", _markers, "generic_language", f"WITH {RAW}, {MARKERS} " + select(["generic_language"], "markers")),
        ("D11_personal_voice", _markers, "lack_personal_experience", f"WITH {RAW}, {MARKERS} " + select(["lack_personal_experience"], "markers")),
        ("D12_over_structuring", _markers, "overly_structured", f"WITH {RAW}, {MARKERS} " + select(["overly_structured"], "markers")),
    ):
        query(name, sql)(lambda spark, d, build=build, column=column: rounded(build(spark, d), [column]))


_register()


@query("D5_ngram_repetition", f"WITH {RAW}, {REPEAT} " + select(["bigram_repetition", "trigram_repetition"], "repeats"))
def ngram_repetition(spark, d):
    return rounded(_repetition(spark, d), ["bigram_repetition", "trigram_repetition"])


@query("D13_style_anomalies", f"WITH {RAW}, {ANOMALY} " + select(ai.ANOMALIES, "anom"))
def style_anomalies(spark, d):
    return rounded(ai.with_style_anomalies(ai.prepare(documents(spark, d))), ai.ANOMALIES)


SCORES = f"""{RAW}, {BURST}, {REPEAT}, {MARKERS}, {ANOMALY}, {PERPLEXITY},
methods AS (SELECT doc_id, source, perplexity, burstiness,
   greatest({', '.join(ai.REPETITION)}) AS top_repetition, greatest({', '.join(ai.MARKERS)}) AS top_marker,
   CASE WHEN perplexity < 20 THEN 0.8::DOUBLE WHEN perplexity < 50 THEN 0.5 ELSE 0.2 END AS score_perplexity,
   1.0 - burstiness AS score_burstiness, ({' + '.join(ai.REPETITION)}) / 5 AS score_repetition,
   ({' + '.join(ai.MARKERS)}) / 5 AS score_linguistic, ({' + '.join(ai.ANOMALIES)}) / 3 AS score_stylometric
   FROM base JOIN burst USING (doc_id) JOIN repeats USING (doc_id) JOIN markers USING (doc_id) JOIN anom USING (doc_id) JOIN ppl USING (doc_id)),
mean AS (SELECT *, (score_perplexity + score_burstiness + score_repetition + score_linguistic + score_stylometric) / 5 AS ai_probability FROM methods),
ens AS (SELECT *, greatest(0.1, 1.0 - sqrt(({' + '.join(f'(score_{m} - ai_probability) ** 2' for m in ai.METHODS)}) / 5)) AS confidence FROM mean)"""
METHOD_COLUMNS = [f"score_{m}" for m in ai.METHODS] + ["ai_probability", "confidence"]


def detected(spark, d):
    return ai.detect(documents(spark, d), **LEXICONS)


@query("D14_ensemble", f"WITH {SCORES} " + select(METHOD_COLUMNS, "ens"))
def ensemble(spark, d):
    return rounded(detected(spark, d), METHOD_COLUMNS)


def _indicator(m):
    return f"CASE WHEN score_{m} > 0.7 THEN 'High {m} score (' || printf('%.2f', round(score_{m}, 2)) || ')' END"


@query("D15_explanation", f"""WITH {SCORES}
SELECT doc_id, concat_ws('; ', {', '.join(_indicator(m) for m in ai.METHODS)}) AS indicators,
  CASE WHEN ai_probability > 0.8 THEN 'High risk of AI generation' WHEN ai_probability > 0.6 THEN 'Moderate risk of AI generation'
       WHEN ai_probability > 0.4 THEN 'Low risk of AI generation' ELSE 'Likely human-written' END AS risk,
  coalesce(nullif(concat_ws('. ', CASE WHEN perplexity < 30 THEN 'Text shows low perplexity (highly predictable)' END,
     CASE WHEN burstiness < 0.3 THEN 'Low burstiness indicates uniform word distribution' END,
     CASE WHEN top_repetition > 0.5 THEN 'Repetitive patterns detected' END,
     CASE WHEN top_marker > 0.5 THEN 'AI-typical linguistic markers found' END), ''), 'No strong AI indicators detected') || '.' AS summary
FROM ens""")
def explanation(spark, d):
    out = ai.explain(detected(spark, d))
    return out.select("doc_id", F.array_join("indicators", "; ").alias("indicators"), "risk", "summary")
