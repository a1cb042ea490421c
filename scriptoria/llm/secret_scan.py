"""Operator 7: secrets by fixed patterns and by windows of high entropy. DataFrame functions only."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

# Base kinds in their order, each with its pattern, the group whose length counts and its least length.
BASE_KINDS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a text must hold for a kind to be looked for at all.
GATES = {
    "assign": r"""(?:[Rr][Dd]|[Ww][Dd]|[Ee][Tt]|[Ee][Nn]|[Ee][Yy])["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Character classes of candidate strings, with the entropy in bits that a window must reach.
ENTROPY_KINDS = {"hex_entropy": ("0-9A-Fa-f", 3.0), "base64_entropy": ("A-Za-z0-9+/_=-", 3.8)}
WINDOW = 20
#: Windows that overlap one of these are no secrets: UUIDs, placeholders, one character over and over.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?i)example|placeholder|changeme|your[_-]|dummy|lorem",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij",
)
#: Windows whose states are counted in one run, and the scale at which c * log2(c) is held as an integer.
RUN, SCALE = 1024, 1 << 20


def _matches(text: Column, pattern: str, gate: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, len, value): positions follow from what stands between the matches."""
    def of(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: let(
            F.zip_with(F.slice(F.split(t, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m)),
            lambda steps: F.arrays_zip(
                F.zip_with(running_sums(steps), found, lambda end, m: end - F.length(m)).alias("start"),
                F.transform(found, lambda m: F.length(m).cast("long")).alias("len"),
                (F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else found).alias("value"),
            ),
        ))

    none = F.array().cast("array<struct<start:bigint,len:bigint,value:string>>")
    return F.when(text.rlike(gate), of(text)).otherwise(none)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, kind, end) of a base kind, in code points."""
    pattern, group, least = BASE_KINDS[kind]
    found = _matches(text, f"[0-9a-f]{{{least},}}" if kind == "hex" else pattern, GATES[kind], group)
    return F.transform(F.filter(found, lambda m: F.length(m["value"]) >= least), lambda m: F.struct(
        m["start"].alias("start"), F.lit(list(BASE_KINDS).index(kind)).alias("rank"), (m["start"] + m["len"]).alias("end")
    ))


def weight(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count else 0


def limit(bits: float, window: int) -> int:
    """Entropy is log2(window) - S / window with S the sum of c * log2(c): greatest S that reaches ``bits``."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def _high_windows(value: Column, bits: float, window: int) -> Column:
    """Start positions, from 0, of the windows of ``value`` whose entropy reaches ``bits``.

    The sum S changes with the character that leaves and the one that enters only, by their counts in what
    two neighbouring windows share; S is counted in full once per run of windows.
    """
    weights = F.array(*(F.lit(weight(c)).cast("long") for c in range(window + 1)))
    most = F.lit(limit(bits, window)).cast("long")
    count = lambda c, s: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    w = lambda n: F.get(weights, n)

    def run(part: Column, base: Column) -> Column:
        head = F.substring(part, 1, window)
        total = F.aggregate(
            F.array_distinct(F.split(head, "")), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", F.lit(0)).otherwise(w(count(c, head)))
        )
        mark = lambda s, at: F.when(s <= most, F.array(at.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        start = let(total, lambda s: F.struct(s.alias("s"), mark(s, base).alias("at")))

        def step(state: Column, i: Column) -> Column:
            both = F.substring(part, i + 1, F.lit(window - 1))
            out, new = F.substring(part, i, F.lit(1)), F.substring(part, i + window, F.lit(1))
            return let(both, lambda b: let(F.struct(count(out, b).alias("o"), count(new, b).alias("n")), lambda k: let(
                state["s"] - w(k["o"] + 1) + w(k["o"]) - w(k["n"]) + w(k["n"] + 1),
                lambda s: F.struct(s.alias("s"), F.concat(state["at"], mark(s, base + i)).alias("at")),
            )))

        n = F.length(part) - window
        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step)["at"]

    parts = F.sequence(F.lit(0), F.floor((F.length(value) - window) / RUN).cast("int"))
    return F.flatten(F.transform(parts, lambda c: let(
        F.substring(value, c * RUN + 1, F.lit(RUN + window - 1)), lambda part: run(part, c * RUN)
    )))


def entropy_spans(text: Column, kind: str, allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW) -> Column:
    """Array of (start, kind, end): overlapping or touching windows of high entropy, joined, within a candidate.

    Windows that overlap a match of an ``allowed`` pattern are left out; the rest of the candidate is looked at.
    """
    letters, bits = ENTROPY_KINDS[kind]
    rank = len(BASE_KINDS) + list(ENTROPY_KINDS).index(kind)
    found = _matches(text, f"[{letters}]{{{window},}}", f"[{letters}]{{{window}}}")

    suspect = F.filter(found, lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")

    def free(value: Column, at: Column) -> Column:
        hits = F.concat(*(_matches(value, pattern, pattern) for pattern in allowed)) if allowed else F.array()
        return let(hits, lambda held: F.filter(at, lambda x: ~F.exists(held, lambda h: (x < h["start"] + h["len"]) & (x + window > h["start"])))) if allowed else at

    def joined(m: Column) -> Column:
        high = let(_high_windows(m["value"], bits, window), lambda at: F.when(F.size(at) > 0, free(m["value"], at)).otherwise(at))
        return let(high, lambda at: F.zip_with(
            F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + window)),
            F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + window)),
            lambda a, b: F.struct((m["start"] + a).alias("start"), F.lit(rank).alias("rank"), (m["start"] + b + window).alias("end")),
        ))

    return F.when(text.rlike("[0-9]"), F.flatten(F.transform(suspect, joined))).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for n in [*BASE_KINDS, *ENTROPY_KINDS]))
    return F.array_join(F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW
) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans) of every row; one pass over the texts, no shuffle.

    ``base`` and ``spans`` are ``kind:start:end`` joined by commas, by start and then kind, in code points with
    the end exclusive; ``spans`` has those of ``base`` and the windows of high entropy. Base kinds
    match as their patterns say, the allow-list holds for windows of high entropy that overlap its matches. Candidates need a digit and a letter.
    Null texts are empty; empty texts have no spans. Null and repeated keys stay; other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), *(base_spans(t, k).alias(k) for k in BASE_KINDS), *(
        entropy_spans(t, k, allowed, window).alias(k) for k in ENTROPY_KINDS
    ))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return base.select(
        "key", *(count(k) for k in BASE_KINDS), _written(F.concat(*BASE_KINDS)).alias("base"),
        _written(F.concat(*BASE_KINDS, *ENTROPY_KINDS)).alias("spans"),
    )
