"""Duplicate and plagiarism detection over submissions.

Copies of a text are compared once. A pair of texts stands for all pairs of their copies, and the
reports per owner follow from the number of copies each owner holds; a text copied n times adds
n rows to the work, not n^2 pairs. In the same way texts whose embeddings are equal are one class of vectors, and a pair of
classes stands for all pairs of their texts but those that their words put in a row of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import ladders
from ..session import small, stage
from . import lexical as lx
from . import vector_join as vj

#: More than two ways of multiplying the same vectors differ by.
SLACK = 1e-6
#: Score from which a potential duplicate is an alert.
LOWEST_ALERT = 0.7


@dataclass(frozen=True)
class Thresholds:
    """Limits of the combined detection; the defaults are the moderate preset."""

    duplicate: float = 0.80
    potential: float = 0.50
    semantic: float = 0.80
    lexical: float = 0.75

    @classmethod
    def preset(cls, level: str) -> Thresholds:
        semantic, lexical = fixed.SENSITIVITY[level]
        return cls(duplicate=semantic, semantic=semantic, lexical=lexical)

    @classmethod
    def plagiarism(cls, p: float) -> Thresholds:
        return cls(duplicate=p, potential=p * 0.7, semantic=p, lexical=p * 0.8)

    @property
    def lowest_semantic(self) -> float:
        return min(self.duplicate, self.potential, self.semantic)

    @property
    def lowest(self) -> float:
        """Score under which neither method flags a pair."""
        return min(self.duplicate, self.potential, self.semantic, self.lexical)


# -- exact copies ---------------------------------------------------------------------------

def reuploads(submissions: DataFrame, key: str, owner: str, content_hash: str) -> DataFrame:
    """Submissions whose owner already handed in the same content: (key, first_match)."""
    first = submissions.groupBy(owner, content_hash).agg(F.min(key).alias("first_match"), F.count("*").alias("n"))
    repeated = first.filter("n > 1").drop("n")
    return submissions.join(repeated, [owner, content_hash]).filter(F.col(key) != F.col("first_match")).select(key, "first_match")


def first_wins(submissions: DataFrame, content_hash: str, order: list[str]) -> DataFrame:
    """The earliest submission of each content: (content_hash, order columns)."""
    best = submissions.groupBy(content_hash).agg(F.min(F.struct(*order)).alias("first"))
    return best.select(content_hash, "first.*")


# -- combined detection ---------------------------------------------------------------------

def flag(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """Score, duplicate and potential flags, reason and confidence of (semantic, lexical) rows.

    A missing score counts as an unused method.
    """
    semantic, lexical = F.col("semantic"), F.col("lexical")
    over = lambda c, limit: F.coalesce(c >= limit, F.lit(False))
    score = F.coalesce(F.greatest(semantic, lexical), F.lit(0.0))
    duplicate = over(semantic, t.semantic) | over(lexical, t.lexical) | (score >= t.duplicate)
    return pairs.withColumns(
        {
            "score": score,
            "is_duplicate": duplicate,
            "is_potential": ~duplicate & (score >= t.potential),
            "reason": flagging_reason(semantic, lexical, score, t),
            "confidence": ladders.similarity_confidence(score),
        }
    )


def flagging_reason(semantic: Column, lexical: Column, score: Column, t: Thresholds) -> Column:
    reasons = F.array_compact(
        F.array(
            F.when(semantic >= t.semantic, F.lit("semantic_embedding_threshold_exceeded")),
            F.when(lexical >= t.lexical, F.lit("lexical_tfidf_threshold_exceeded")),
            F.when(score >= t.duplicate, F.lit("high_overall_similarity")).when(
                score >= t.potential, F.lit("moderate_similarity")
            ),
        )
    )
    return (
        F.when(semantic.isNull() & lexical.isNull(), "no_analysis")
        .when(F.size(reasons) == 0, "low_similarity")
        .otherwise(F.array_join(reasons, "; "))
    )


@dataclass(frozen=True)
class _Compared:
    """Members, and text pairs (kind, a, b, n_texts, lexical, semantic) that are not staged; with vectors the classes (rep, vector, copies), texts' classes and unit vectors.

    ``near_a`` and ``near_b`` of a pair are its vector classes where these can be a pair themselves, else null.
    """

    members: DataFrame
    rows: DataFrame
    groups: DataFrame | None = None
    of: DataFrame | None = None
    units: DataFrame | None = None


def _compare(docs: DataFrame, key: str, text: str, vectors: DataFrame | None, t: Thresholds, use_lexical: bool, stop_words: list[str] | None) -> _Compared:
    members, texts = lx.collapse(docs, key, text, stop_words, vectors)
    copied = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("rep").alias("a"), F.col("rep").alias("b")
    )
    # copies agree in what they have: content words, an embedding, or neither
    worded = texts.select(F.col("rep").alias("a"), (F.size("tokens") > 0).alias("worded"))
    same = copied.join(worded, "a").select("a", "b", F.when(F.col("worded"), 1.0).otherwise(0.0).alias("lexical"))
    none = F.lit(None).cast("double")
    if not use_lexical:
        same = same.withColumn("lexical", none)
    scored = lambda units: [lx.pairs_above(texts, t.lowest, units)] if use_lexical else []
    every = lambda parts: reduce(DataFrame.unionByName, parts).withColumns({"kind": F.lit("text"), "n_texts": F.lit(1).cast("long")})
    columns = ["kind", "a", "b", "n_texts", "lexical", "semantic"]
    if vectors is None:
        no_class = F.lit(None).cast(members.schema["rep"].dataType)
        rows = every([same, *scored(None)]).withColumn("semantic", none).select(*columns, no_class.alias("near_a"), no_class.alias("near_b"))
        return _Compared(members.withColumn("vector_class", no_class), rows)
    held = vectors.select(F.col(vectors.columns[0]).alias("text"), F.col(vectors.columns[1]).alias("v"))
    held = stage(held.join(members.select(F.col("rep").alias("text")).distinct(), "text", "left_semi").filter("v IS NOT NULL").dropDuplicates(["text"]), "text_vectors")
    groups, of = vj.distinct_vectors(held, "text", "v")
    of = stage(of.select(F.col("text").alias("rep"), F.col("rep").alias("vector_class")), "vector_classes")
    units = vj.unit_rows(groups, "rep", "vector")
    # a pair's vectors are multiplied where its texts are scored, so that no vector is sent with every pair
    with_units = of.join(units.withColumnRenamed("id", "vector_class"), "vector_class").select("rep", "vector_class", "u")
    near = (F.col("a") != F.col("b")) & (F.col("semantic") >= t.lowest_semantic - SLACK)
    rows = every([with_semantic(same, of, units), *scored(with_units)]).select(
        *columns, F.when(near, F.least("class_a", "class_b")).alias("near_a"), F.when(near, F.greatest("class_a", "class_b")).alias("near_b")
    )
    return _Compared(members.join(of, "rep", "left"), rows, groups, of, units)


def detect(
    docs: DataFrame, key: str, text: str, vectors: DataFrame | None = None, t: Thresholds = Thresholds(),
    use_lexical: bool = True, stop_words: list[str] | None = None, least: float = 0.0, columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Flagged pairs, and members (key, rep, vector_class).

    ``vectors`` has (key, embedding). Documents are one text when their tokens and their embeddings agree; every
    embedding is compared. A pair (kind, a, b, n_texts, semantic, lexical, score, flags) has a <= b and is of one of two kinds. ``text``: two
    texts whose lexical score is not below all limits, or a = b for a text with several copies. ``vector``: two classes of equal
    embeddings, named by their smallest text, or a = b for a class of several texts; it stands for the ``n_texts`` pairs of their texts
    that have no row of their own, whose lexical score is below all limits and not given. Texts without content
    words have no lexical score above 0, and without an embedding match nothing.

    For reports that list no potential duplicates with a score below ``least``, these are not kept. With ``columns`` the pairs have, beside kind, a, b and
    n_texts, only these of the scores and flags.
    """
    found = _compare(docs, key, text, vectors, t, use_lexical, stop_words)
    flagged = F.col("is_duplicate") | (F.col("is_potential") & (F.col("score") >= least - SLACK))
    # Every report reads the pairs, some through a sort that samples them first; unless columns are named, their flags follow from the staged scores.
    shown = ["kind", "a", "b", "n_texts", *(["lexical", "semantic"] if columns is None else columns)]
    kept = flag(found.rows, t).withColumn("flagged", flagged).filter(F.col("flagged") | F.col("near_a").isNotNull())
    rows = stage(kept.select(*shown, "near_a", "near_b", "flagged"), "text_rows")
    out = rows.filter("flagged").select(*shown)
    if found.groups is not None:
        close = flag(_vector_rows(_listed(rows), found.groups, found.units, t.lowest_semantic), t).filter(flagged)
        out = out.unionByName(stage(close.select(*shown), "vector_rows"))
    members = stage(found.members.select(key, "rep", "vector_class"), "members_classes")
    return flag(out, t) if columns is None else out, members


def flagged_counts(
    docs: DataFrame, key: str, text: str, labels: dict[str, Column], vectors: DataFrame | None = None, t: Thresholds = Thresholds(),
    use_lexical: bool = True, stop_words: list[str] | None = None,
) -> DataFrame:
    """(labels, n): how many of the pairs of texts that `detect` flags have each value of ``labels``, which read scores and flags.

    The pairs are counted in the tasks that score them, so that nothing is written or sent per pair.
    """
    found = _compare(docs, key, text, vectors, t, use_lexical, stop_words)
    of_rows = lambda rows: flag(rows, t).withColumns({"flagged": F.col("is_duplicate") | F.col("is_potential"), **labels})
    counted = of_rows(found.rows).groupBy("flagged", "near_a", "near_b", *labels).agg(F.sum("n_texts").alias("n_texts"))
    counted = stage(counted, "pair_counts")
    parts = [counted.filter("flagged")]
    if found.groups is not None:
        parts.append(of_rows(_vector_rows(_listed(counted), found.groups, found.units, t.lowest_semantic)).filter("flagged"))
    return reduce(DataFrame.unionByName, (part.select(*labels, "n_texts") for part in parts)).groupBy(*labels).agg(F.sum("n_texts").alias("n"))


def with_semantic(rows: DataFrame, of: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` (a, b, ...) with both texts' vector classes and the cosine of their embeddings; null without them."""
    side = lambda n: of.join(units.withColumnRenamed("id", "vector_class"), "vector_class").select(
        F.col("rep").alias(n), F.col("vector_class").alias(f"class_{n}"), F.col("u").alias(f"u{n}")
    )
    product = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cosine = F.when(F.col("class_a") == F.col("class_b"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)))
    return (
        rows.join(side("a"), "a", "left").join(side("b"), "b", "left")
        .withColumn("semantic", F.when(F.col("ua").isNotNull() & F.col("ub").isNotNull(), cosine)).drop("ua", "ub")
    )


def _listed(rows: DataFrame) -> DataFrame:
    """(a, b, listed): how many text pairs have a row of their own, for pairs of vector classes."""
    near = rows.filter("near_a IS NOT NULL")
    return near.groupBy(F.col("near_a").alias("a"), F.col("near_b").alias("b")).agg(F.sum("n_texts").alias("listed"))


def _vector_rows(listed: DataFrame, groups: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Rows of vector classes that reach the threshold, with the number of pairs of texts that are not ``listed``."""
    close = vj.pairs_above(units, threshold).withColumnRenamed("score", "semantic")
    equal = groups.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("semantic"))
    size = lambda n: groups.select(F.col("rep").alias(n), F.col("copies").alias(f"n{n}"))
    every = F.when(F.col("a") == F.col("b"), (F.col("na") * (F.col("na") - 1) / 2).cast("long")).otherwise(F.col("na") * F.col("nb"))
    out = close.unionByName(equal).join(size("a"), "a").join(size("b"), "b").join(listed, ["a", "b"], "left")
    out = out.withColumn("n_texts", every - F.coalesce("listed", F.lit(0))).filter("n_texts > 0")
    return out.select(F.lit("vector").alias("kind"), "a", "b", "n_texts", F.lit(None).cast("double").alias("lexical"), "semantic")


# -- owners -----------------------------------------------------------------------------------

def holdings(members: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """(rep, owner, n): how many copies of each text each owner holds."""
    return members.join(owners.select(key, F.col(owner).alias("owner")), key).groupBy("rep", "owner").agg(F.count("*").alias("n"))


def against_others(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(owner, rep, own, matched, others, doc_pairs, pair columns): matches of an owner's text held by other owners.

    Each flagged pair is read from both sides; ``others`` is the number of matching submissions
    that do not belong to the owner, ``own`` the number of the owner's copies, ``doc_pairs`` their product.
    """
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    way = lambda x, y: F.struct(F.col(x).alias("rep"), F.col(y).alias("matched"))
    both = F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    directed = pairs.select(F.inline(both), *rest)
    held = stage(held, "held")
    totals = held.groupBy("rep").agg(F.sum("n").alias("held")).withColumnRenamed("rep", "matched")
    own = held.select("rep", "owner", F.col("n").alias("own"))
    theirs = held.select(F.col("rep").alias("matched"), "owner", F.col("n").alias("same_owner"))
    rows = directed.join(small(own), "rep").join(small(totals), "matched").join(small(theirs), ["matched", "owner"], "left")
    others = F.col("held") - F.coalesce("same_owner", F.lit(0))
    return rows.withColumn("others", others).drop("held", "same_owner").filter("others > 0").withColumn("doc_pairs", F.col("own") * F.col("others"))


def holdings_of_both(members: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """(rep, vector_class, owner, n): how many copies of each text each owner holds."""
    rows = members.join(owners.select(key, F.col(owner).alias("owner")), key)
    return stage(rows.groupBy("rep", "vector_class", "owner").agg(F.count("*").alias("n")), "holdings")


def _both_kinds(held: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches of texts, matches of vector classes, and the text matches that lie in a flagged pair of classes.

    The last (owner, rep, rep_class, matched_class, others, doc_pairs) are to be taken off the second, with its flags.
    """
    held_texts = held.select("rep", "owner", "n")
    of_texts = pairs.filter("kind = 'text'")
    texts = against_others(of_texts, held_texts)
    classed = held.filter("vector_class IS NOT NULL")
    class_held = classed.groupBy(F.col("vector_class").alias("rep"), "owner").agg(F.sum("n").alias("n"))
    classes = against_others(pairs.filter("kind = 'vector'"), class_held)
    of = lambda n: classed.select(F.col("rep").alias(n), F.col("vector_class").alias(f"{n}_class")).distinct()
    flags = pairs.filter("kind = 'vector'").select(
        F.col("a").alias("x"), F.col("b").alias("y"), F.col("is_duplicate").alias("class_duplicate"), F.col("is_potential").alias("class_potential")
    )
    # only texts whose vectors are as close as some flagged pair of classes can lie in one
    least_of = pairs.filter("kind = 'vector'").agg(F.min("semantic")).first()[0]
    near = against_others(of_texts.filter(F.col("semantic") >= F.lit(least_of).cast("double") - SLACK), held_texts)
    placed = near.select("owner", "rep", "matched", "others", "doc_pairs").join(of("rep"), "rep").join(of("matched"), "matched")
    least, greatest = F.least("rep_class", "matched_class"), F.greatest("rep_class", "matched_class")
    listed = placed.join(flags, (least == F.col("x")) & (greatest == F.col("y"))).drop("x", "y")
    return texts, classes, listed


def matches(docs: DataFrame, key: str, owner: str, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, owner, rep, matched, own, others, doc_pairs, pair columns): an owner's texts, or vector classes, that match others' work.

    ``own`` and ``others`` are the owner's submissions of ``rep`` and other owners' of ``matched``; ``doc_pairs`` counts pairs of a submission of the owner with one of another owner; each such pair is counted in one row.
    """
    texts, classes, listed = _both_kinds(holdings_of_both(members, docs, key, owner), pairs)
    off = listed.groupBy("owner", F.col("rep_class").alias("rep"), F.col("matched_class").alias("matched")).agg(F.sum("doc_pairs").alias("listed"))
    rest = classes.join(off, ["owner", "rep", "matched"], "left").withColumn("doc_pairs", F.col("doc_pairs") - F.coalesce("listed", F.lit(0)))
    return texts.unionByName(rest.filter("doc_pairs > 0").drop("listed"))


def analysis_report(docs: DataFrame, key: str, owner: str, members: DataFrame, pairs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Per submission: comparisons, duplicates, potential duplicates and highest similarity; own work excluded.

    ``held`` (rep, vector_class, owner, n) counts the submissions to compare with where ``docs`` are not all of them.
    """
    held = holdings_of_both(members, docs, key, owner) if held is None else held
    texts, classes, listed = _both_kinds(held, pairs)
    count = lambda c: F.sum(F.when(F.col(c), F.col("others")).otherwise(0))
    summary = lambda rows, n, by: rows.groupBy(F.col("rep").alias(by), "owner").agg(
        count("is_duplicate").alias(f"duplicates_{n}"), count("is_potential").alias(f"potentials_{n}"),
        F.max(F.when(F.col("is_duplicate"), F.col("score"))).alias(f"best_{n}"), F.max("score").alias(f"highest_{n}"),
    )
    # a text row scores no less than the pair of classes that it is taken off, so the classes' best scores stay
    off = listed.groupBy("rep", "owner").agg(count("class_duplicate").alias("duplicates_off"), count("class_potential").alias("potentials_off"))
    owners = docs.select(key, F.col(owner).alias("owner"))
    per_owner = stage(held.groupBy("owner").agg(F.sum("n").alias("own_total")), "owner_totals")
    everything = per_owner.agg(F.sum("own_total")).scalar()
    rows = owners.join(members, key)
    out = rows.join(summary(texts, "texts", "rep"), ["rep", "owner"], "left").join(summary(classes, "classes", "vector_class"), ["vector_class", "owner"], "left")
    out = out.join(off, ["rep", "owner"], "left").join(per_owner, "owner")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda c: zero(f"{c}_texts") + zero(f"{c}_classes") - zero(f"{c}_off")
    highest = F.coalesce(F.greatest("best_texts", "best_classes"), F.greatest("highest_texts", "highest_classes"), F.lit(0.0))
    return out.select(
        key, "owner", (everything - F.col("own_total")).alias("total_comparisons"),
        total("duplicates").alias("duplicates_found"), total("potentials").alias("potential_duplicates"), highest.alias("highest_similarity"),
    )


def alerts(matches: DataFrame) -> DataFrame:
    """Alert rows of `matches`: duplicates by score, potential ones from `LOWEST_ALERT` as low."""
    level = F.when(
        F.col("is_duplicate"), ladders.at_least(F.col("score"), [(0.95, "high"), (0.85, "medium")], "low")
    ).when(F.col("score") >= LOWEST_ALERT, "low")
    return matches.withColumn("alert_level", level).filter(F.col("alert_level").isNotNull())


def batch_summary(report: DataFrame) -> DataFrame:
    """One row: processed submissions, how many have duplicates or potential ones, pairs found."""
    return report.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("duplicates_found") > 0).alias("with_duplicates"),
        F.count_if(F.col("potential_duplicates") > 0).alias("with_potential"),
        F.sum("duplicates_found").alias("duplicates"),
        F.sum("potential_duplicates").alias("potentials"),
    )


def cross_owner(found: DataFrame, p: float = 0.8) -> DataFrame:
    """Those of the `matches` to report: duplicates, and potential ones from 0.8 p."""
    return found.filter(F.col("is_duplicate") | (F.col("score") >= p * 0.8))


def cross_owner_vectors(store: DataFrame, key: str, vector: str, owner: str, p: float = 0.8) -> DataFrame:
    """Cross-owner matches by embedding alone: score >= 0.7 p, duplicate from p."""
    groups, members = vj.distinct_vectors(store, key, vector)
    pairs = vj.pairs_above(vj.unit_rows(groups, "rep", "vector"), 0.7 * p)
    copied = groups.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("score"))
    flagged = pairs.unionByName(copied).withColumn("is_duplicate", F.col("score") >= p)
    return against_others(flagged, holdings(members, store, key, owner))


def owner_rollup(matches: DataFrame) -> DataFrame:
    """Per owner: submissions matched, alerts, and alerts of level high (score >= 0.9) and medium."""
    n = F.col("doc_pairs")
    return matches.groupBy("owner").agg(
        F.sum(n).alias("alerts"),
        F.sum(F.when(F.col("score") >= 0.9, n).otherwise(0)).alias("high_alerts"),
        F.sum(F.when(F.col("score") < 0.9, n).otherwise(0)).alias("medium_alerts"),
        F.max("score").alias("top_score"),
    )


def preset_hits() -> dict[str, Column]:
    """Whether each sensitivity level calls a row of scores a duplicate, by the level's name."""
    over = lambda c, limit: F.coalesce(F.col(c) >= limit, F.lit(False))
    best = F.coalesce(F.greatest("semantic", "lexical"), F.lit(0.0))
    return {level: over("semantic", s) | over("lexical", l) | (best >= s) for level, (s, l) in fixed.SENSITIVITY.items()}


def preset_counts(counts: DataFrame) -> DataFrame:
    """(level, duplicates, pairs): how many flagged pairs of texts each sensitivity level calls duplicates, from `flagged_counts` of `preset_hits`."""
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).alias("hit")) for level in fixed.SENSITIVITY])
    rows = counts.select("n", F.inline(levels))
    return rows.groupBy("level").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("duplicates"), F.sum("n").alias("pairs"))


def membership(members: DataFrame, key: str) -> DataFrame:
    """(kind, a, b): what pairs of representatives stand for. ``member``: a document and its text; ``class``: a text and its vector class."""
    texts = members.select(F.lit("member").alias("kind"), F.col(key).alias("a"), F.col("rep").alias("b"))
    classed = members.filter("vector_class IS NOT NULL").select(F.lit("class").alias("kind"), F.col("rep").alias("a"), F.col("vector_class").alias("b"))
    return texts.unionByName(classed.distinct())


def enrich_pairs(pairs: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add both sides' columns (suffix ``_a``/``_b``) to (a, b) pairs."""
    side = lambda n: small(rows.select(F.col(key).alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns]))
    return pairs.join(side("a"), "a").join(side("b"), "b")
