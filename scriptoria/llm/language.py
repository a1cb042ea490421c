"""Operator 8: language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage

#: Characters of labelled text, over all languages, from which models are learned; at most about so many are read into them.
TRAIN_CHARS = 20_000_000
ORDER = 4
#: Languages that are learned at most: those with most labelled text.
LANGUAGES = 256
#: Share of the sample that is kept from the models and used to calibrate rejection.
CALIBRATION = 0.2
#: A text is rejected beyond this quantile of the calibration texts' deviations, times the slack.
QUANTILE, SLACK = 0.999, 2.0
#: With fewer calibration texts a language rejects nothing; with fewer than `ENOUGH` its spread is no less than that of all.
FEW, ENOUGH = 5, 20
#: Words whose scores a worker keeps.
MOST_WORDS = 600_000
UNKNOWN = "und"


def _word_patterns() -> tuple[frozenset[str], re.Pattern]:
    """Characters that need care, and words: letters (categories L*) and the marks (M*) within or after them; other numerals are no letters."""
    numerals, marks = [], []
    for code in range(128, sys.maxunicode + 1):
        category = unicodedata.category(chr(code))
        if category in ("Nl", "No"):
            numerals.append(code)
        elif category[0] == "M":
            marks.append(code)

    def ranges(codes):
        starts = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
        ends = [c for c, after in zip(codes, [*codes[1:], -1]) if c + 1 != after]
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))

    letter = rf"[^\W\d_{ranges(numerals)}]"
    return frozenset(map(chr, numerals + marks)), re.compile(f"{letter}+(?:[{ranges(marks)}]+{letter}*)*")


ODD, LETTERS = _word_patterns()
#: The same words where no character needs care.
PLAIN = re.compile(r"[^\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
START, END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    lowered = text.lower()
    return (PLAIN if lowered.isascii() or ODD.isdisjoint(set(lowered)) else LETTERS).findall(lowered)


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every ``size`` consecutive characters."""
    n = len(codes) - size + 1
    keys = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size):
        keys = (keys ^ (codes[i : i + n] + np.uint64(1))) * MULTIPLIER
        keys ^= keys >> np.uint64(29)
    return keys


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


@dataclass
class LanguageModels:
    """Per order, sorted hashes of grams with a log probability per language, and of contexts with a back-off weight."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: np.ndarray
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray
    limit: float = math.inf

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, its end included, in each language."""
        order = len(self.grams)
        codes = _codes("".join(START * (order - 1) + w + END for w in words))
        sizes = np.array([len(w) + order for w in words])
        ends = np.cumsum(sizes)
        inner = np.ones(len(codes), dtype=bool)
        for i in range(order - 1):
            inner[ends - sizes + i] = False
        at = np.flatnonzero(inner)
        total = np.zeros((len(at), len(self.languages)))
        left = np.arange(len(at))
        for size in range(order, 0, -1):
            keys = _keys(codes, size)[at[left] - size + 1]
            found, values = _look_up(*self.grams[size - 1], keys)
            total[left[found]] += values
            left = left[~found]
            if not len(left):
                break
            if size > 1:
                context = _keys(codes, size - 1)[at[left] - size + 1]
                known, weights = _look_up(*self.contexts[size - 1], context)
                total[left[known]] += weights
            else:
                total[left] += self.base
        word = np.repeat(np.arange(len(words)), sizes - order + 1)
        sums = np.zeros((len(words), len(self.languages)))
        np.add.at(sums, word, total)
        return sums


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
    return found, values[at[found]]


def build_models(counts: list[tuple[str, str, int]], order: int = ORDER) -> LanguageModels:
    """Models from (language, gram of ``order`` characters, count).

    The highest order counts occurrences, lower ones the different characters that come before. Each order takes a
    discount off, by its numbers of grams seen once and twice, and spreads it by the next lower order.
    """
    languages = sorted({c[0] for c in counts})
    number = {name: i for i, name in enumerate(languages)}
    levels: list[list[dict[str, int]]] = [[{} for _ in languages] for _ in range(order)]
    for name, gram, n in counts:
        levels[order - 1][number[name]][gram] = n
    for size in range(order - 1, 0, -1):
        for upper, own in zip(levels[size], levels[size - 1]):
            own.update(Counter(g[1:] for g in upper))
    letters = {g for own in levels[0] for g in own}
    grams, contexts = [], []
    base = np.full(len(languages), -math.log(len(letters) + 1))
    for size in range(1, order + 1):
        seen = sorted({g for own in levels[size - 1] for g in own})
        heads = sorted({g[:-1] for g in seen})
        weight = np.zeros((len(heads), len(languages)))
        row = {h: i for i, h in enumerate(heads)}
        lower = np.empty((len(seen), len(languages)))
        if size == 1:
            lower[:] = base
        else:  # every gram's ending is a gram of the order below
            keys, values = grams[-1]
            tails = _codes("".join(g[1:] for g in seen))
            lower = values[np.searchsorted(keys, _keys(tails, size - 1)[:: size - 1])]
        head_of = np.array([row[g[:-1]] for g in seen], dtype=np.int64)
        logs = np.empty_like(lower)
        for i, own in enumerate(levels[size - 1]):
            n1, n2 = (sum(v == k for v in own.values()) for k in (1, 2))
            discount = n1 / (n1 + 2 * n2) if n1 else 0.5
            c = np.array([own.get(g, 0) for g in seen], dtype=float)
            totals = np.bincount(head_of, weights=c, minlength=len(heads))
            kinds = np.bincount(head_of, weights=c > 0, minlength=len(heads))
            back = np.where(totals > 0, discount * kinds / np.maximum(totals, 1), 1.0)
            weight[:, i] = np.log(back)
            logs[:, i] = np.log(np.maximum(c - discount, 0) / np.maximum(totals, 1)[head_of] + back[head_of] * np.exp(lower[:, i]))
        text = _codes("".join(seen))
        keys = _keys(text, size)[::size]
        sort = np.argsort(keys)
        grams.append((keys[sort], logs[sort]))
        if size > 1:
            keys = _keys(_codes("".join(heads)), size - 1)[:: size - 1]
            sort = np.argsort(keys)
            contexts.append((keys[sort], weight[sort]))
        else:
            contexts.append((np.zeros(0, dtype=np.uint64), np.zeros((0, len(languages)))))
            base = base + weight[0] if len(heads) else base
    zeros = np.zeros(len(languages))
    return LanguageModels(languages, grams, contexts, base, zeros, zeros, zeros + 1)


class _Scorer:
    """Sums of word scores per text; words are scored in one go per batch and kept, up to `MOST_WORDS`."""

    def __init__(self, models: LanguageModels):
        self.models = models
        self._clear()

    def _clear(self):
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.models.languages)), dtype=np.float64)
        self.sizes = np.zeros(0)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            if self.used + len(part) > len(self.sizes):
                more = max(len(part), len(self.sizes))
                self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]))])
                self.sizes = np.concatenate([self.sizes, np.zeros(more)])
            self.scores[self.used : self.used + len(part)] = self.models.word_scores(part)
            self.sizes[self.used : self.used + len(part)] = [len(w) + 1 for w in part]
            self.rows.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, characters with one end per word) of each text."""
        counts = [Counter(words_of(t)) for t in texts]
        if self.used > MOST_WORDS:
            self._clear()
        self._learn(list({w for c in counts for w in c if w not in self.rows}))
        logs, sizes = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts))
        for i, c in enumerate(counts):
            if c:
                at = np.fromiter(map(self.rows.__getitem__, c), dtype=np.int64, count=len(c))
                n = np.fromiter(c.values(), dtype=np.float64, count=len(c))
                logs[i], sizes[i] = n @ self.scores[at], n @ self.sizes[at]
        return logs, sizes


def _scored(rows: DataFrame, models: LanguageModels, text: str, names: list[str], batch_rows: int = 256) -> DataFrame:
    """``rows`` with prediction, score, cross-entropy in nats per character, characters and deviation."""
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    at = rows.columns.index(text)

    def run(batches):
        scorer = _Scorer(models)
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                logs, sizes = scorer.sums(batch.column(at).to_pylist())
                if models.languages:
                    per = -logs / np.maximum(sizes, 1)[:, None]
                    best = per.argmin(axis=1)
                    least = per[np.arange(len(per)), best]
                    shares = np.exp(20 * (least[:, None] - per))
                    score = 1 / shares.sum(axis=1)
                    deviation = (least - models.mean[best]) / np.sqrt(models.between[best] + models.within[best] / np.maximum(sizes, 1))
                else:
                    best, least, score, deviation = (np.zeros(len(sizes)) for _ in range(4))
                none = (sizes == 0) | (not models.languages)
                named = [UNKNOWN if n else models.languages[int(b)] for n, b in zip(none, best)]
                out = [pa.array(named, pa.string()), *(
                    pa.array(np.where(none, 0.0, v).astype(float), pa.float64()) for v in (score, least, sizes, deviation)
                )]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=schema.names)

    return rows.mapInArrow(run, schema)


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, train_chars: int = TRAIN_CHARS, languages: int = LANGUAGES
) -> LanguageModels:
    """Models of every non-null ``lang``, or the ``languages`` of most text if there are more, learned from a sample of about ``train_chars`` characters of whole texts.

    The sample takes texts by their hash, a smaller share of a larger language, and copies once, so that a text which
    fills the table cannot fill the sample. Languages have equal shares; what small ones leave goes to the others,
    and each has one text at least. Of the sample, `CALIBRATION` is
    kept from the models and gives each language's mean cross-entropy, its variance between texts and within them (a text of n
    characters has between + within / n, and texts longer than usual are held to no less than the usual one), and the limit of deviation. A language with
    under `FEW` texts on either side of that split is learned from all of them; it can't be calibrated and accepts
    whatever is nearest to it.
    What reaches the driver is the grams of the sample, bounded by ``train_chars``. Null texts and texts without letters teach
    nothing; without any labelled text there are no languages. Runs four small jobs.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    found = rows.withColumn("draw", draw).groupBy("lang").agg(F.sum(F.length("text").cast("double")).alias("size"), F.min("draw").alias("least"))
    sizes = {r.lang: r for r in found.orderBy(F.desc("size"), "lang").limit(languages).collect()}
    share = _equal_share([r.size for r in sizes.values()], train_chars)
    settings = [(x, min(1.0, share / max(r.size, 1.0)), r.least) for x, r in sizes.items()]
    rates = docs.sparkSession.createDataFrame(settings, "lang string, rate double, least double")
    taken = rows.withColumn("draw", draw).join(F.broadcast(rates), "lang").filter("draw < rate OR draw = least").select(
        "text", "lang", (F.col("draw") / F.col("rate")).alias("draw")
    ).dropDuplicates(["text", "lang"])
    sample = stage(taken, "language-sample")

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(words_of(t)).items():
                    found[name, word] += n
            yield pa.record_batch(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    held = F.col("draw") < CALIBRATION
    split = sample.groupBy("lang").agg(F.count_if(held).alias("kept"), F.count_if(~held).alias("learned")).collect()
    has_more = min(sum(r.kept for r in split), sum(r.learned for r in split)) >= ENOUGH  # a tiny table is used for both
    small = F.col("lang").isin([r.lang for r in split if min(r.kept, r.learned) < FEW])
    learned = sample.filter(~held | small) if has_more else sample
    words = learned.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    grams = words.select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order))
    )).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    models = build_models([(r.lang, r.gram, r.n) for r in grams.collect()], order)
    if not models.languages:
        return models
    kept = sample.filter(held & ~small) if has_more else sample
    names = ["pred", "score", "entropy", "size", "deviation"]
    scored = stage(_scored(kept.select("text", "lang"), models, "text", names).filter("lang = pred AND size > 0").select("lang", *names[2:]), "calibration")
    size, entropy = F.col("size"), F.col("entropy")
    fits = {r.lang: r for r in scored.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(size).alias("s"), F.sum(1 / size).alias("h"), F.sum(size * entropy).alias("se"), F.sum(size * entropy * entropy).alias("see"),
        F.sum(entropy).alias("e"), F.sum(entropy * entropy).alias("ee"), F.percentile_approx("size", 0.5).alias("usual"),
    ).collect() if r.n >= FEW}
    if not fits:
        models.within = np.full(len(models.languages), math.inf)
        return models
    variances = {x: _variances(r) for x, r in fits.items()}
    total = sum(r.n for r in fits.values())
    pooled = [sum(v[i] * fits[x].n for x, v in variances.items()) / total for i in (0, 1)]
    for x, r in fits.items():
        if r.n < ENOUGH:
            variances[x] = tuple(max(v, w) for v, w in zip(variances[x], pooled))
    models.mean = np.array([fits[x].se / fits[x].s if x in fits else 0.0 for x in models.languages])
    models.between, models.within = (np.array([variances[x][i] if x in fits else math.inf for x in models.languages]) for i in (0, 1))
    scored = scored.filter(F.col("lang").isin(list(fits)))
    table = F.create_map(*(F.lit(v) for x in fits for v in (x, F.array(F.lit(fits[x].se / fits[x].s), *(F.lit(v) for v in variances[x])))))
    far = (entropy - table[F.col("lang")][0]) / F.sqrt(table[F.col("lang")][1] + table[F.col("lang")][2] / size)
    limit = scored.agg(F.percentile_approx(far, QUANTILE, 100_000)).first()[0]
    models.limit = math.inf if limit is None else max(limit, 1.0) * SLACK
    return models


def _variances(r) -> tuple[float, float]:
    """(between, within) texts' variance of cross-entropy, by the moments of its squares weighed by size and not weighed."""
    mean = r.se / r.s
    weighed, plain = max(r.see - mean * r.se, 0.0), max(r.ee - 2 * mean * r.e + r.n * mean * mean, 0.0)
    whole = r.s * r.h - r.n**2
    between = (weighed * r.h - r.n * plain) / whole if whole > 1e-6 * r.n**2 else 0.0
    within = (weighed - r.s * between) / r.n
    if between < 0 or within < 0:
        between, within = (0.0, weighed / r.n) if between < 0 else (plain / r.n, 0.0)
    within = max(within, 1e-2)
    return max(between, within / r.usual), within


def _equal_share(sizes: list[float], most: float) -> float:
    """The greatest share at which languages that give no more than it, or all they have, give ``most`` together."""
    left = most
    for n, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - n) >= left:
            return left / (len(sizes) - n)
        left -= size
    return math.inf


def identify(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``accepted``; no shuffle.

    The whole text counts: letters, lower-cased, word by word. The language of the lowest cross-entropy per character is
    chosen. Texts that are null or have no letter get `und`, score 0 and are not accepted; a text whose cross-entropy lies beyond
    the calibrated limit for its length is not accepted either. New columns get longer names where the table has them.
    """
    new = [fresh(n, docs) for n in ("lang_pred", "score", "cross_entropy", "size__", "deviation__", "accepted")]
    scored = _scored(docs, models, text, new[:5])
    accepted: Column = (F.col(new[0]) != UNKNOWN) & (F.col(new[4]) <= models.limit)
    return scored.withColumn(new[5], accepted).drop(new[3], new[4])


def keep_identified(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that `identify` accepts, with their own columns."""
    named = identify(docs, models, text)
    return named.filter(F.col(named.columns[-1])).select(*docs.columns)
