"""How machine-like a text reads: phrase rates, repetition, burstiness and their ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import fixed_values as fixed
from ..functions import ladders
from ..functions import text as tx
from ..session import stage
from . import bigrams as bg


def _capped(count: Column, per: Column) -> Column:
    """count / per, at most 1; 0 where there is nothing to count in."""
    return F.when(per > 0, F.least(F.lit(1.0), count / per)).otherwise(0.0)


def prepare(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``rw`` (lower-cased whitespace tokens), ``n_parts`` (full-stop pieces) and their word counts."""
    parts = F.split(F.col(text), r"\.")
    counted = F.transform(parts, lambda s: F.regexp_count(s, F.lit(f"[^{tx.WS}]+")))
    return docs.withColumns(
        {
            "rw": tx.raw_words(F.lower(text)),
            "n_parts": F.size(parts),
            "part_words": F.filter(counted, lambda n: n > 0),
        }
    )


def with_burstiness(docs: DataFrame) -> DataFrame:
    """Half the variation coefficient of word frequencies, at most 1; 0.5 for short or uniform vocabularies."""
    df = ar.with_run_lengths(docs, "rw", "__freq")
    f = F.col("__freq")
    cv = F.sqrt(ar.variance_numerator(f).cast("double")) / F.size("rw")
    value = F.when((F.size("rw") < 10) | (F.size(f) < 2), 0.5).otherwise(F.least(F.lit(1.0), cv / 2.0))
    return df.withColumn("burstiness", value).drop("__freq")


def with_repetition(
    docs: DataFrame, text: str = "text", phrases: list[str] | None = None, transitions: list[str] | None = None
) -> DataFrame:
    """Sentence-length, bigram, trigram, stock-phrase and transition-word repetition."""
    df = ar.with_run_lengths(docs, "part_words", "__len")
    # counted by 64-bit hashes, as in the bigram models; strings of all grams take several times as long
    df = df.withColumn("__h", F.transform("rw", lambda w: F.xxhash64(w)))
    df = df.withColumns({"__g2": ar.ngram_hashes(F.col("__h"), 2), "__g3": ar.ngram_hashes(F.col("__h"), 3)})
    n = F.size("rw")
    repeated = lambda g: ar.ratio(F.size(g) - F.size(F.array_distinct(g)), F.size(g))
    parts = F.size("part_words")
    structure = F.when((F.col("n_parts") < 3) | (parts == 0), 0.0).otherwise(
        F.least(F.lit(1.0), (F.array_max("__len") - 1) / parts)
    )
    return df.withColumns(
        {
            "sentence_repetition": structure,
            "bigram_repetition": repeated(F.col("__g2")),
            "trigram_repetition": repeated(F.col("__g3")),
            "phrase_repetition": _capped(tx.phrase_count(F.col(text), phrases or fixed.STOCK_PHRASES), n / 100),
            "transition_overuse": _capped(tx.member_count(F.col("rw"), transitions or fixed.TRANSITION_WORDS), n / 50),
        }
    ).drop("__len", "__h", "__g2", "__g3")


def with_markers(
    docs: DataFrame, text: str = "text", formal: list[str] | None = None, hedges: list[str] | None = None,
    generic: list[str] | None = None, personal: list[str] | None = None, structure: list[str] | None = None,
) -> DataFrame:
    """Formality, hedging, generic wording, missing personal voice and over-structuring."""
    t, n, parts = F.col(text), F.size("rw"), F.col("n_parts")
    paragraphs = F.size(F.split(t, "\n\n"))
    return docs.withColumns(
        {
            "excessive_formality": _capped(tx.member_count(F.col("rw"), formal or fixed.FORMAL_WORDS), n / 100),
            "hedging_language": _capped(tx.phrase_count(t, hedges or fixed.HEDGES), n / 50),
            "generic_language": _capped(tx.phrase_count(t, generic or fixed.GENERIC_PHRASES), parts),
            "lack_personal_experience": F.greatest(
                F.lit(0.0), 1.0 - tx.phrase_count(t, personal or fixed.PERSONAL_PHRASES) / parts * 5
            ),
            "overly_structured": _capped(tx.phrase_count(t, structure or fixed.STRUCTURE_MARKERS), paragraphs),
        }
    )


def with_style_anomalies(docs: DataFrame, text: str = "text") -> DataFrame:
    """Low vocabulary diversity, uniform sentence length and unusual punctuation."""
    n, parts, s = F.size("rw"), F.size("part_words"), F.col("part_words")
    diversity = ar.ratio(F.size(F.array_distinct("rw")), n)
    std, mean = F.sqrt(ar.variance_numerator(s).cast("double")) / parts, ar.total(s) / parts
    uniform = F.when(
        (F.col("n_parts") > 1) & (parts > 0), F.greatest(F.lit(0.0), 1 - std / (mean + 1) - 0.3) / 0.7
    ).otherwise(0.0)
    punctuation = ar.ratio(F.regexp_count(text, F.lit("[.,!?;:]")), F.length(text))
    return docs.withColumns(
        {
            "low_vocab_diversity": F.greatest(F.lit(0.0), 0.5 - diversity) * 2,
            "sentence_uniformity": uniform,
            "punctuation_anomaly": F.abs(punctuation - 0.05) * 10,
        }
    )


# -- perplexity under a bigram model of the corpus -------------------------------------------

def bigram_model(counts: DataFrame, add: float = 1.0, vocabulary: int | None = None) -> DataFrame:
    """(w1, w2, log_p): log probability of w2 after w1 with add-k smoothing over the second-word vocabulary.

    ``vocabulary`` is its size where ``counts`` are those of some first words only.
    """
    pairs = counts.groupBy("w1", "w2").agg(F.sum("n").alias("c"))
    firsts = pairs.groupBy("w1").agg(F.sum("c").alias("c1"))
    size = pairs.agg(F.countDistinct("w2")).scalar() if vocabulary is None else F.lit(vocabulary)
    p = (F.col("c") + add) / (F.col("c1") + add * size)
    return pairs.join(firsts, "w1").select("w1", "w2", F.log(p).alias("log_p"))


def perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", add: float = 1.0, default: float = 50.0) -> DataFrame:
    """(key, perplexity) under the model of the same corpus; ``default`` for texts of fewer than two words."""
    # A pair's log probability is log(c + add) of the pair less log(c1 + add * vocabulary) of its first word. Both are summed per text, so
    # that pairs meet their count without their words, and the words theirs once per text.
    words = bg.word_rows(docs, key, text)
    totals = stage(words.groupBy("w").agg(F.sum("n1").alias("c1"), F.sum("n2").alias("c2")), "word_totals")
    vocabulary = totals.filter("c2 > 0").count()
    pairs = bg.pair_rows(docs, key, text).withColumn("c", F.sum("n").over(W.partitionBy("pair")))
    firsts = words.filter("n1 > 0").select(key, "w", "n1").join(totals.select("w", "c1"), "w")
    logs = pairs.select(key, (F.col("n") * F.log(F.col("c") + add)).alias("x"), "n").unionByName(
        firsts.select(key, (-F.col("n1") * F.log(F.col("c1") + add * vocabulary)).alias("x"), F.lit(0).alias("n")))
    scored = logs.groupBy(key).agg(F.exp(-F.sum("x") / F.sum("n")).alias("perplexity"))
    return docs.select(key).join(scored, key, "left").select(key, F.coalesce("perplexity", F.lit(default)).alias("perplexity"))


def scored_by(docs: DataFrame, counts: DataFrame, model: DataFrame, key: str = "doc_id", default: float = 50.0) -> DataFrame:
    """(key, perplexity) of documents by their ``counts`` under a model that holds all their pairs."""
    scored = counts.join(model, ["w1", "w2"]).groupBy(key).agg(
        F.exp(-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("perplexity")
    )
    return docs.select(key).join(scored, key, "left").select(key, F.coalesce("perplexity", F.lit(default)).alias("perplexity"))


# -- ensemble --------------------------------------------------------------------------------

REPETITION = ["sentence_repetition", "bigram_repetition", "trigram_repetition", "phrase_repetition", "transition_overuse"]
MARKERS = ["excessive_formality", "hedging_language", "generic_language", "lack_personal_experience", "overly_structured"]
ANOMALIES = ["low_vocab_diversity", "sentence_uniformity", "punctuation_anomaly"]
METHODS = ["perplexity", "burstiness", "repetition", "linguistic", "stylometric"]


def _mean(names: list[str]) -> Column:
    out = F.col(names[0])
    for name in names[1:]:
        out = out + F.col(name)
    return out / len(names)


def features(docs: DataFrame, text: str = "text", **lexicons: list[str]) -> DataFrame:
    """All scores but perplexity as columns, without a shuffle."""
    repetition = {k: v for k, v in lexicons.items() if k in ("phrases", "transitions")}
    markers = {k: v for k, v in lexicons.items() if k not in repetition}
    df = with_burstiness(prepare(docs, text))
    df = with_style_anomalies(with_markers(with_repetition(df, text, **repetition), text, **markers), text)
    return df.drop("rw", "n_parts", "part_words")


def ensemble(scores: DataFrame) -> DataFrame:
    """Five method scores, their mean as ``ai_probability`` and agreement as ``confidence``."""
    df = scores.withColumns(
        {
            "score_perplexity": ladders.perplexity_score(F.col("perplexity")),
            "score_burstiness": 1.0 - F.col("burstiness"),
            "score_repetition": _mean(REPETITION),
            "score_linguistic": _mean(MARKERS),
            "score_stylometric": _mean(ANOMALIES),
        }
    )
    names = [f"score_{m}" for m in METHODS]
    df = df.withColumn("ai_probability", _mean(names))
    squares = sum(((F.col(n) - F.col("ai_probability")) ** 2 for n in names[1:]),
                  (F.col(names[0]) - F.col("ai_probability")) ** 2)
    return df.withColumn("confidence", F.greatest(F.lit(0.1), 1.0 - F.sqrt(squares / len(names))))


def detect(
    docs: DataFrame, key: str = "doc_id", text: str = "text", add: float = 1.0, model: bg.BigramModel | None = None, leave_out: bool = False, **lexicons: list[str]
) -> DataFrame:
    """Every score of every document: features, perplexity and ensemble.

    The perplexity is that under a stored ``model`` (see `bigrams.perplexity`), or else under one of the same documents.
    """
    measured = perplexity(docs, key, text, add) if model is None else bg.perplexity(docs, model, key, text, leave_out)
    return ensemble(features(docs, text, **lexicons).join(measured, key))


def risk_label(p: Column) -> Column:
    return (
        F.when(p > 0.8, "High risk of AI generation")
        .when(p > 0.6, "Moderate risk of AI generation")
        .when(p > 0.4, "Low risk of AI generation")
        .otherwise("Likely human-written")
    )


def explain(scored: DataFrame) -> DataFrame:
    """Add ``indicators``, ``risk`` and ``summary`` to ensemble rows."""
    indicators = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"score_{m}") > 0.7,
                    F.format_string(f"High {m} score (%.2f)", F.round(F.col(f"score_{m}"), 2)),
                )
                for m in METHODS
            ]
        )
    )
    above_half = lambda names: F.greatest(*[F.col(n) for n in names]) > 0.5
    found = F.array_compact(
        F.array(
            F.when(F.col("perplexity") < 30, F.lit("Text shows low perplexity (highly predictable)")),
            F.when(F.col("burstiness") < 0.3, F.lit("Low burstiness indicates uniform word distribution")),
            F.when(above_half(REPETITION), F.lit("Repetitive patterns detected")),
            F.when(above_half(MARKERS), F.lit("AI-typical linguistic markers found")),
        )
    )
    parts = F.when(F.size(found) == 0, F.array(F.lit("No strong AI indicators detected"))).otherwise(found)
    return scored.withColumns(
        {
            "indicators": indicators,
            "risk": risk_label(F.col("ai_probability")),
            "summary": F.concat(F.array_join(parts, ". "), F.lit(".")),
        }
    )
