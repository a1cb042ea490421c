"""Style features of documents.

A document's words fit in one row, so its features are computed inside the row: reading,
tokenising and measuring a corpus needs no shuffle. Only operators that look across documents
(profile comparison, feature alignment, tagging against a lexicon) join or group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from ..functions import arrays as ar
from ..functions import fixed_values as fixed
from ..functions import text as tx

WORD = r"[\p{L}\p{N}_]+"


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", letters_only: bool = False) -> DataFrame:
    """(key, pos, word) in reading order."""
    words = tx.letters(F.col(text)) if letters_only else tx.words(F.col(text))
    return docs.select(key, F.posexplode(words).alias("pos", "word"))


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sentence) in reading order."""
    return docs.select(key, F.posexplode(tx.sentences(F.col(text))).alias("pos", "sentence"))


def prepare(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` (letter runs), and ``sentence_words`` (words per sentence) of the cleaned text."""
    cleaned = docs.withColumn("clean", tx.clean_text(F.col(text)))
    return cleaned.withColumns(
        {
            "tokens": tx.letters(F.col("clean")),
            # cleaned text has no whitespace but spaces, so that a piece is blank if nothing is left of it without them
            "sentence_words": F.transform(
                F.filter(F.split("clean", "[.!?]+"), lambda s: F.trim(s) != ""), lambda s: F.regexp_count(s, F.lit(WORD))
            ),
        }
    ).drop("clean")


def with_lexical_richness(docs: DataFrame) -> DataFrame:
    """Type-token ratio, vocabulary size, and shares of words seen once and twice."""
    df = ar.with_run_lengths(docs, "tokens", "__freq")
    n, f = F.size("tokens"), F.col("__freq")
    seen = lambda k: F.size(F.filter(f, lambda x: x == k))
    return df.withColumns(
        {
            "type_token_ratio": ar.ratio(F.size(f), n),
            "vocabulary_size": F.size(f).cast("long"),
            "hapax_legomena_ratio": ar.ratio(seen(1), n),
            "dis_legomena_ratio": ar.ratio(seen(2), n),
        }
    ).drop("__freq")


def _factors(seen: Column, n: Column, threshold: float) -> Column:
    """Segments of a reading (see `arrays.seen_before`) of n words whose type-token ratio falls below the threshold; a rest counts as one.

    A word is new in a segment if its last place is before the segment's start, so the state is three numbers however many words
    a segment has.
    """
    state_of = lambda *c: F.struct(*(x.alias(name) for x, name in zip(c, ("count", "start", "types"))))

    def step(state, word):
        types = state["types"] + (ar.seen_of(word) <= state["start"]).cast("int")
        end = ar.place_of(word) + 1
        return F.when(types / (end - state["start"]) < threshold, state_of(state["count"] + 1, end, F.lit(0))).otherwise(
            state_of(state["count"], state["start"], types)
        )

    rest = lambda state: state["count"] + (state["start"] < n).cast("int")
    return F.aggregate(seen, state_of(F.lit(0), F.lit(0), F.lit(0)), step, rest)


def mtld(tokens_column: Column, threshold: float = 0.72) -> Column:
    """Words per factor, averaged over a forward and a backward reading; 0 below 50 words and for null."""
    n = F.size(tokens_column)
    both = lambda held: _factors(ar.seen_before(held), F.size(held), threshold) + _factors(ar.seen_behind(held), F.size(held), threshold)
    return F.when(n >= 50, 2.0 * n / ar.let(ar.placed(tokens_column), both)).otherwise(0.0)


def with_sentence_structure(docs: DataFrame) -> DataFrame:
    """Mean and population variance of sentence length, shares under 10 and over 25 words, count."""
    s = F.col("sentence_words")
    n = F.size(s)
    share = lambda keep: ar.ratio(F.size(F.filter(s, keep)), n)
    return docs.withColumns(
        {
            "avg_sentence_length": ar.ratio(ar.total(s), n),
            "sentence_length_variance": ar.ratio(ar.variance_numerator(s), n.cast("long") * n),
            "short_sentence_ratio": share(lambda x: x < 10),
            "long_sentence_ratio": share(lambda x: x > 25),
            "sentence_count": n.cast("long"),
        }
    )


def with_punctuation(docs: DataFrame, text: str = "text", marks: dict[str, list[str]] | None = None) -> DataFrame:
    """Frequency per character of each mark, and of all of them."""
    marks = marks or fixed.PUNCTUATION
    t, n = F.col(text), F.length(text)
    counts = {name: sum((tx.occurrences(t, c) for c in chars[1:]), tx.occurrences(t, chars[0])) for name, chars in marks.items()}
    df = docs.withColumns({f"__n_{name}": c for name, c in counts.items()})
    everything = sum((F.col(f"__n_{m}") for m in list(marks)[1:]), F.col(f"__n_{list(marks)[0]}"))
    return df.withColumns(
        {f"{name}_frequency": ar.ratio(F.col(f"__n_{name}"), n) for name in marks}
        | {"total_punctuation_ratio": ar.ratio(everything, n)}
    ).drop(*[f"__n_{name}" for name in marks])


def with_function_words(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Frequency per word of each function-word category; a word in two lists counts in both."""
    lexicon = lexicon or fixed.FUNCTION_WORDS
    n = F.size("tokens")
    df = docs.withColumns({f"__n_{c}": tx.member_count(F.col("tokens"), words) for c, words in lexicon.items()})
    names = list(lexicon)
    everything = sum((F.col(f"__n_{c}") for c in names[1:]), F.col(f"__n_{names[0]}"))
    return df.withColumns(
        {f"{c}_frequency": ar.ratio(F.col(f"__n_{c}"), n) for c in names}
        | {"function_word_ratio": ar.ratio(everything, n)}
    ).drop(*[f"__n_{c}" for c in names])


def syllables(word: Column) -> Column:
    """Vowel groups of the ASCII letters, less a silent final e, at least one."""
    plain = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(plain, F.lit("[aeiouy]+"))
    silent = (F.right(plain, F.lit(1)) == "e") & (groups > 1)
    return F.greatest(F.lit(1), F.when(silent, groups - 1).otherwise(groups))


def with_readability(docs: DataFrame) -> DataFrame:
    """Flesch reading ease and grade, mean word length, share of words of three or more syllables."""
    df = docs.withColumn("__syl", F.transform("tokens", syllables))
    n, s = F.size("tokens"), F.size("sentence_words")
    known = (n > 0) & (s > 0)
    per_sentence, per_word = n / s, ar.total(F.col("__syl")) / n
    return df.withColumns(
        {
            "flesch_reading_ease": F.when(known, 206.835 - 1.015 * per_sentence - 84.6 * per_word).otherwise(0.0),
            "flesch_kincaid_grade": F.when(known, 0.39 * per_sentence + 11.8 * per_word - 15.59).otherwise(0.0),
            "avg_word_length": F.when(known, F.length(F.array_join("tokens", "")) / n).otherwise(0.0),
            "complex_word_ratio": F.when(known, F.size(F.filter("__syl", lambda x: x >= 3)) / n).otherwise(0.0),
        }
    ).drop("__syl")


# -- tagging against a lexicon --------------------------------------------------------------

def tag_tokens(token_rows: DataFrame, lexicon: DataFrame, suffix_tags: list[tuple[str, str]], default: str = "NN") -> DataFrame:
    """Tag (key, pos, word) rows: lexicon first, then the first matching suffix, then ``default``."""
    fallback = F.lit(default)
    for suffix, tag in reversed(suffix_tags):
        fallback = F.when(F.col("word").endswith(suffix), tag).otherwise(fallback)
    return token_rows.join(lexicon, "word", "left").withColumn("tag", F.coalesce("tag", fallback))


def tag_ratios(tagged: DataFrame, key: str = "doc_id", groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Share of each tag group among a document's tokens."""
    groups = groups or fixed.POS_GROUPS
    return tagged.groupBy(key).agg(
        *[
            (F.sum(F.col("tag").isin(tags).cast("int")) / F.count("*")).alias(f"{name}_ratio")
            for name, tags in groups.items()
        ]
    )


# -- profile features -----------------------------------------------------------------------

def with_profile_lexical(docs: DataFrame, text: str = "text") -> DataFrame:
    """Type-token ratio, mean word length, Yule's K and totals over word-character runs."""
    df = docs.withColumn("__w", tx.words(F.col(text)))
    df = ar.with_run_lengths(df, "__w", "__freq")
    n, f = F.size("__w"), F.col("__freq")
    return df.withColumns(
        {
            "type_token_ratio": ar.ratio(F.size(f), n),
            "avg_word_length": ar.ratio(F.length(F.array_join("__w", "")), n),
            "vocabulary_richness": F.when(
                n > 1, 10000 * (ar.total_of_squares(f) - n) / (n.cast("long") * n)
            ).otherwise(0.0),
            "total_words": n.cast("long"),
            "unique_words": F.size(f).cast("long"),
            "total_sentences": F.size(tx.sentences(F.col(text))).cast("long"),
        }
    ).drop("__w", "__freq")


def with_profile_syntactic(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentence length mean and variance, and a map of punctuation frequencies."""
    t, n = F.col(text), F.length(text)
    df = docs.withColumn(
        "__s", F.transform(tx.sentences(t), lambda s: F.regexp_count(s, F.lit(WORD)))
    )
    s, k = F.col("__s"), F.size("__s")
    marks = [
        F.struct(
            F.lit(name).alias("key"),
            ar.ratio(sum((tx.occurrences(t, c) for c in chars[1:]), tx.occurrences(t, chars[0])), n).alias("value"),
        )
        for name, chars in fixed.PROFILE_PUNCTUATION.items()
    ]
    return df.withColumns(
        {
            "avg_sentence_length": ar.ratio(ar.total(s), k),
            "sentence_length_variance": ar.ratio(ar.variance_numerator(s), k.cast("long") * k),
            "punctuation_frequency": F.map_from_entries(F.array(*marks)),
        }
    ).drop("__s")


def with_profile_semantic(docs: DataFrame, text: str = "text", lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Map of function-word frequencies, text length and word count."""
    lexicon = lexicon or fixed.PROFILE_FUNCTION_WORDS
    df = docs.withColumn("__w", tx.words(F.col(text)))
    n = F.size("__w")
    entries = [
        F.struct(F.lit(c).alias("key"), ar.ratio(tx.member_count(F.col("__w"), words), n).alias("value"))
        for c, words in lexicon.items()
    ]
    return df.withColumns(
        {
            "function_word_frequency": F.map_from_entries(F.array(*entries)),
            "text_length": F.length(text).cast("long"),
            "word_count": n.cast("long"),
        }
    ).drop("__w")


# -- assembly -------------------------------------------------------------------------------

FEATURES = [
    "type_token_ratio", "vocabulary_size", "hapax_legomena_ratio", "dis_legomena_ratio",
    "avg_sentence_length", "sentence_length_variance", "short_sentence_ratio", "long_sentence_ratio", "sentence_count",
    "comma_frequency", "period_frequency", "exclamation_frequency", "question_frequency", "semicolon_frequency",
    "colon_frequency", "dash_frequency", "quotation_frequency", "total_punctuation_ratio",
    "article_frequency", "preposition_frequency", "pronoun_frequency", "conjunction_frequency",
    "auxiliary_verb_frequency", "function_word_ratio",
    "flesch_reading_ease", "flesch_kincaid_grade", "avg_word_length", "complex_word_ratio",
]


def extract_features(docs: DataFrame, text: str = "text", with_mtld: bool = False) -> DataFrame:
    """All style features as columns beside the input's other columns, in one pass without a shuffle."""
    df = prepare(docs, text)
    df = with_readability(with_function_words(with_punctuation(
        with_sentence_structure(with_lexical_richness(df)), text)))
    if with_mtld:
        df = df.withColumn("mtld", mtld(F.col("tokens")))
    return df.drop("tokens", "sentence_words")


def feature_map(names: list[str]) -> Column:
    """``map<string,double>`` of the named feature columns."""
    return F.map_from_entries(
        F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])
    )


def compare_profiles(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Similarity of two feature maps per row: 1 - mean relative difference of the shared features."""
    a, b = F.col(left), F.col(right)
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    df = pairs.withColumn(
        "__diff",
        F.transform(
            shared,
            lambda k: F.abs(F.element_at(a, k) - F.element_at(b, k))
            / F.greatest(F.abs(F.element_at(a, k)), F.abs(F.element_at(b, k)), F.lit(1e-10)),
        ),
    )
    n = F.size("__diff")
    mean = F.aggregate("__diff", F.lit(0.0), lambda acc, x: acc + x) / n
    return df.withColumns(
        {
            "avg_difference": F.when(n > 0, mean),
            "similarity_score": F.when(n > 0, F.greatest(F.lit(0.0), 1.0 - mean)).otherwise(0.0),
            "feature_count": n.cast("long"),
        }
    ).drop("__diff")


def feature_matrix(features: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Align (key, feature, value) rows: (feature, pos) in the order of the names, and (key, size, pos, values) per key.

    ``pos`` counts from 0 and ``size`` is the number of names; positions that a key does not list are 0.0, so a row stays as
    long as what its key has, however many names there are. Names are numbered within ranges of names, from the sizes of the
    ranges before. Rows with a null feature take no part. Runs a job that writes the distinct names.
    """
    known = features.filter(F.col("feature").isNotNull())
    ranges = known.select("feature").distinct().repartitionByRange("feature").select("feature", F.spark_partition_id().alias("__range"))
    ranges = stage(ranges, "feature-names")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    ends = F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow))
    sizes = sizes.select("__range", (ends - F.col("__n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range").orderBy("feature")) - 1
    names = ranges.withColumn("__place", place).join(sizes, "__range").select("feature", (F.col("__before") + F.col("__place")).alias("pos"))
    rows = known.join(names, "feature").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("__held"))
    return names, rows.select(key, ranges.agg(F.count("*")).scalar().alias("size"), F.col("__held.pos").alias("pos"), F.col("__held.value").alias("values"))


def anomaly_flags(ttr: Column, sentence_length: Column, punctuation: Column) -> Column:
    """Texts of the violated rules; a missing feature counts as 0 and so trips the low limits."""
    t, s, p = (F.coalesce(c, F.lit(0.0)) for c in (ttr, sentence_length, punctuation))
    return F.array_compact(
        F.array(
            F.when(t < 0.3, F.lit("Very low lexical diversity")),
            F.when(s > 50, F.lit("Unusually long sentences")).when(s < 5, F.lit("Unusually short sentences")),
            F.when(p > 0.2, F.lit("Excessive punctuation usage")),
        )
    )


def split_diversity(text: Column) -> Column:
    """Distinct share of the single-space pieces of the lower-cased text."""
    pieces = F.split(F.lower(text), " ")
    return F.size(F.array_distinct(pieces)) / F.size(pieces)


def split_sentence_length(text: Column) -> Column:
    """Single-space pieces per full stop, 0 without one."""
    stops = F.size(F.split(text, r"\.")) - 1
    return F.when(stops > 0, F.size(F.split(text, " ")) / stops).otherwise(0.0)
