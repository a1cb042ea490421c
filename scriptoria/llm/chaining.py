"""Operator 9: repeated and fuzzy passages across documents, by chains of shared k-mer seeds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage
from .wordhash import WORD, rolled, word_hashes

#: Words of a seed; of every so many consecutive seeds the one with the least hash is taken.
SEED, WINNOW = 8, 16
#: Words that a repeated passage must have, and the share of them that must match.
LEAST_WORDS, IDENTITY = 50, 0.8
#: What a word of gap costs in a chain, on either side; a seed gains its number of words.
GAP_COST = 0.1
#: Words beyond a chain's ends that the alignment may extend into.
PAD = 64
#: Slices of a document that one task cuts from one copy of its text.
SLICES = 256


def winnowed(words: np.ndarray, seed: int = SEED, window: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): any ``seed + window - 1`` words that two texts share have a seed in common."""
    keys = rolled(words, seed)
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if len(keys) <= window:
        at = np.array([keys.argmin()])
    else:
        view = np.lib.stride_tricks.sliding_window_view(keys, window)
        at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return keys[at], at


def chains(anchors: list[tuple[int, int]], seed: int = SEED, gap: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Anchors (target, source) as collinear chains, best first; each anchor is in one chain.

    A chain grows on both sides. Its score is ``seed`` per anchor less ``gap`` per word between two anchors on either side;
    that cost splits into a part of each anchor, so the best anchor before another one is a maximum over
    smaller source positions, kept in a Fenwick tree.
    """
    order = sorted(set(anchors))
    sources = sorted({s for _, s in order})
    rank = {s: i + 1 for i, s in enumerate(sources)}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(sources) + 1)
    score, before = [0.0] * len(order), [-1] * len(order)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:  # equal targets don't follow each other
            t, s = order[j]
            best, r = (float("-inf"), -1), rank[s] - 1
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            value = best[0] - gap * (t + s)
            score[j] = seed + max(0.0, value)
            before[j] = best[1] if value > 0 else -1
            j += 1
        for n in range(i, j):
            t, s = order[n]
            own, r = (score[n] + gap * (t + s), n), rank[s]
            while r < len(tree):
                if tree[r] < own:
                    tree[r] = own
                r += r & -r
        i = j
    out, used = [], [False] * len(order)
    for n in sorted(range(len(order)), key=lambda n: (-score[n], n)):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(order[n])
            n = before[n]
        if chain:
            out.append(chain[::-1])
    return out


def _ordered_chains(links: dict[tuple, list[tuple[int, int, int]]], seed: int, dense: int) -> list[tuple[int, bool, list[tuple[int, int]]]]:
    """Chains of a document's links, by source, longest first, and whether they lie where others are already.

    A chain occupies its seeds and the gaps between them of at most ``dense`` words; a chain that brings no seed outside
    waits until the others are aligned. Near copies of a text differ in a few seeds each, and would otherwise all be each
    other's sources. Returned with the index of a link to their source.
    """
    all_chains = []
    for number, (_, own) in enumerate(sorted(links.items(), key=lambda x: (x[0][0] is not None, *x[0]))):
        index = own[0][2]
        all_chains += [(-len(c), number, c, index) for c in chains([(t, s) for t, s, _ in own], seed)]
    taken, out = set(), []
    for _, _, chain, index in sorted(all_chains):
        waits = all(t in taken for t, _ in chain)
        out.append((index, waits, chain))
        if waits:
            continue
        for (t, _), (u, _) in zip(chain, [*chain[1:], chain[-1]]):
            taken.update(range(t, u if u - t <= dense else t + seed))
        taken.update(range(chain[-1][0], chain[-1][0] + seed))
    return out


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two gaps; a row of the table is the bits of one number."""
    if not a or not b:
        return 0
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        at = places.get(x)
        if at:
            taken = row & at
            row = (row + taken | row - taken) & full
    return len(b) - row.bit_count()


def _extended(a: list[int], b: list[int], near: int = 8, sure: int = 4, identity: float = 0.0) -> tuple[int, int, int]:
    """Words that follow in both: how far in ``a``, in ``b``, and how many match.

    Where they differ, the nearest place is sought at which ``sure`` words agree again, at most ``near`` words on. With
    ``identity`` it ends where the matches are the most above that share of the words.
    """
    i = j = matched = 0
    end, most = (0, 0, 0), 0.0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
            over = matched - identity * max(i, j)
            if over >= most or not identity:
                end, most = (i, j, matched), over
            continue
        for step in range(1, near + 1):
            skips = sorted(((x, step - x) for x in range(step + 1)), key=lambda p: abs(p[0] - p[1]))
            skips = [(step, step), *skips] if step <= near // 2 else skips
            go = next(((x, y) for x, y in skips if a[i + x : i + x + sure] == b[j + y : j + y + sure] and i + x + sure <= len(a) and j + y + sure <= len(b)), None)
            if go:
                i, j = i + go[0], j + go[1]
                break
        else:
            break
    return end


def _joined(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], seed: int = SEED) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, matched words) of a chain's seeds, and of the gap before each but the first."""
    out: list[tuple[int, int, int, int, int]] = []
    ai, bj = chain[0]
    for t, s in chain:
        length = seed
        if t < ai or s < bj:  # seeds that overlap the one before: only what lies beyond it
            over = max(ai - t, bj - s)
            if over >= seed:
                continue
            t, s, length = t + over, s + over, seed - over
        if out:
            x, y = a[ai:t], b[bj:s]
            out.append((ai, t, bj, s, len(x) if len(x) == len(y) and (x == y).all() else _common(x.tolist(), y.tolist())))
        ai, bj = t + length, s + length
        out.append((t, ai, s, bj, length))
    return out


def _merged(pieces: list[tuple[int, int, int, int, int]]) -> tuple[int, int, int, int, int]:
    return pieces[0][0], pieces[-1][1], pieces[0][2], pieces[-1][3], sum(p[4] for p in pieces)


def _over(span: tuple[int, int, int, int, int], identity: float) -> float:
    """Matched words beyond the share ``identity`` of the longer side."""
    return span[4] - identity * max(span[1] - span[0], span[3] - span[2]) + 1e-9


def _parts(pieces: list[tuple[int, int, int, int, int]], identity: float) -> list[tuple[int, int, int, int, int]]:
    """A chain's parts that reach ``identity``, in order.

    Seeds and gaps score what they match beyond the share; the maximal scoring runs are the parts. Neighbours
    are joined, best first, as long as they reach the share together. A heap of neighbours' scores and a stack of runs keep this at
    n log n for n pieces.
    """
    # score before and after, first and last piece, and the nearest earlier run with less before it
    runs: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for n, piece in enumerate(pieces):
        before, total = total, total + _over(piece, identity)
        if total <= before:
            continue
        low, first, k = before, n, len(runs) - 1
        while True:  # the nearest run with less before it takes this one in if its score after is smaller
            while k >= 0 and runs[k][0] >= low:
                k = runs[k][4]
            if k < 0 or runs[k][1] >= total:
                break
            low, first, above = runs[k][0], runs[k][2], runs[k][4]
            del runs[k:]
            k = above
        runs.append((low, total, first, n, k))

    matched = np.concatenate([[0], np.cumsum([p[4] for p in pieces])]).tolist()
    whole = lambda first, last: (pieces[first][0], pieces[last][1], pieces[first][2], pieces[last][3], matched[last + 1] - matched[first])
    firsts, lasts = [r[2] for r in runs], [r[3] for r in runs]
    left, right = list(range(-1, len(runs) - 1)), [*range(1, len(runs)), -1]
    changed, alive = [0] * len(runs), [True] * len(runs)
    score = lambda x, y: _over(whole(firsts[x], lasts[y]), identity)
    heap = [(-score(x, x + 1), x, x + 1, 0, 0) for x in range(len(runs) - 1)]
    heapq.heapify(heap)
    while heap and heap[0][0] <= 0:
        _, x, y, at_x, at_y = heapq.heappop(heap)
        if not (alive[x] and alive[y]) or (changed[x], changed[y]) != (at_x, at_y):
            continue
        lasts[x], alive[y], right[x] = lasts[y], False, right[y]
        changed[x] += 1
        if right[x] >= 0:
            left[right[x]] = x
            heapq.heappush(heap, (-score(x, right[x]), x, right[x], changed[x], changed[right[x]]))
        if left[x] >= 0:
            heapq.heappush(heap, (-score(left[x], x), left[x], x, changed[left[x]], changed[x]))
    return [whole(firsts[x], lasts[x]) for x in range(len(runs)) if alive[x]]


def _grown(a: np.ndarray, b: np.ndarray, span: tuple[int, int, int, int, int], identity: float = 0.0) -> tuple[int, int, int, int, int]:
    start, end, source_start, source_end, matched = span
    left_i, left_j, left_m = _extended(a[:start][::-1].tolist(), b[:source_start][::-1].tolist(), identity=identity)
    right_i, right_j, right_m = _extended(a[end:].tolist(), b[source_end:].tolist(), identity=identity)
    return start - left_i, end + right_i, source_start - left_j, source_end + right_j, matched + left_m + right_m


def align(
    a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], seed: int = SEED, identity: float = IDENTITY
) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, matched words) of a chain, with what follows on both sides.

    If the whole is under ``identity`` it is cut into the parts that reach it, each with what follows on its sides.
    """
    pieces = _joined(a, b, chain, seed)
    whole = _merged(pieces)
    grown = _grown(a, b, whole)
    if _over(grown, identity) >= 0:
        return [grown]
    out = []
    for part in [whole] if _over(whole, identity) >= 0 else _parts(pieces, identity):
        grown = _grown(a, b, part)
        out.append(grown if _over(grown, identity) >= 0 else _grown(a, b, part, identity))
    return out


def _pairs_type(a: str, b: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(a, T.IntegerType()), T.StructField(b, T.IntegerType())]))


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, identity: float = IDENTITY,
    seed: int = SEED, window: int = WINNOW,
) -> DataFrame:
    """(key, print, start, end, source, source_print, source_start, source_end, matched): later occurrences of passages.

    Positions are in words. Every seed links its later occurrences with its first document in the order
    (key, print), so a seed that fills the table gives one link per occurrence, not per pair. A document's links are
    chained by source and aligned with the words around them. A chain under ``identity`` is cut into the parts that reach it.
    Chains that lie within longer ones are left out if these are found to hold all their seeds. A document's
    alignments that overlap or touch, to whatever sources, count as one passage; it is reported if
    it has ``least_words`` words, once for each source: where the source's part of it starts and ends, and the longest
    of its alignments there. Exact copies are passages too. Seeds within one document do not link.

    Null and short texts have no passages. ``print`` is a hash of the text: rows with equal keys and other texts are
    apart, rows equal in both are one document. Null keys come first. Empty tables give no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))
    key_field = rows.schema["key"]
    seeds_type = T.StructType([T.StructField("seed", T.LongType()), key_field, rows.schema["print"], T.StructField("pos", T.IntegerType())])

    def find_seeds(batches):
        for batch in batches:
            of, keys, places = [], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for row, t in enumerate(batch.column(2).to_pylist()):
                own, at = winnowed(word_hashes(t), seed, window)
                of.append(np.full(len(at), row))
                keys.append(own)
                places.append(at)
            take = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *of]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(places).astype(np.int32))],
                names=seeds_type.names,
            )

    seeds = stage(rows.mapInArrow(find_seeds, seeds_type), "seeds")  # read twice; a text's seeds are found once
    place = F.struct("key", "print", "pos")
    first = seeds.groupBy("seed").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stage(first, "first-seeds")  # read again, it has an exchange of its own, so that the join can split a hot seed
    anchors = seeds.join(first, "seed").filter(F.struct("key", "print") > F.struct("first.key", "first.print"))
    # a document's links are no more than its own seeds
    linked = anchors.groupBy("key", "print").agg(F.collect_list(F.struct(
        F.col("first.key").alias("source"), F.col("first.print").alias("source_print"), F.col("pos").alias("t"), F.col("first.pos").alias("s")
    )).alias("links"))
    source_fields = linked.schema["links"].dataType.elementType.fields[:2]
    chain_type = T.StructType([*linked.schema.fields[:2], *source_fields, T.StructField("waits", T.BooleanType()), T.StructField("chain", _pairs_type("t", "s"))])

    def find_chains(batches):
        for batch in batches:
            of, at, waiting, out = [], [], [], []
            links = batch.column(2)
            base = links.offsets.to_pylist()
            source, source_print, t, s = links.values.flatten()
            names, places = list(zip(source.to_pylist(), source_print.to_pylist())), list(zip(t.to_pylist(), s.to_pylist()))
            for row in range(batch.num_rows):
                own: dict[tuple, list[tuple[int, int, int]]] = {}
                for i in range(base[row], base[row + 1]):
                    own.setdefault(names[i], []).append((*places[i], i))
                for i, waits, chain in _ordered_chains(own, seed, 3 * window):
                    of.append(row)
                    at.append(i)
                    waiting.append(waits)
                    out.append([{"t": x, "s": y} for x, y in chain])
            take, at = pa.array(of, pa.int64()), pa.array(at, pa.int64())
            kind = pa.list_(pa.struct([("t", pa.int32()), ("s", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), source.take(at), source_print.take(at), pa.array(waiting, pa.bool_()), pa.array(out, kind)], names=chain_type.names
            )

    at = lambda c, end: F.element_at(f"chain.{c}", end)
    found = linked.mapInArrow(find_chains, chain_type).withColumns({
        "from": F.greatest(at("t", 1) - PAD, F.lit(0)), "to": at("t", -1) + seed + PAD,
        "source_from": F.greatest(at("s", 1) - PAD, F.lit(0)), "source_to": at("s", -1) + seed + PAD,
    })
    found = stage(found, "chains")

    spans = _aligned(rows, found.filter("NOT waits"), seed, identity)
    waiting = found.filter("waits")
    if not waiting.isEmpty():  # those with a seed that no alignment holds
        spans = stage(spans, "spans")
        held = spans.groupBy(F.col("key").alias("k"), F.col("print").alias("p")).agg(F.collect_list(F.struct("start", "end")).alias("held"))
        outside = F.exists("chain", lambda c: ~F.exists("held", lambda h: (h["start"] <= c["t"]) & (c["t"] + seed <= h["end"])))
        late = waiting.join(held, [waiting["key"].eqNullSafe(held["k"]), waiting["print"] == held["p"]], "left").filter(
            F.col("held").isNull() | outside
        )
        late = stage(late.select(*found.columns), "late-chains")
        if not late.isEmpty():
            spans = spans.unionAll(_aligned(rows, late, seed, identity))
    by_doc = W.partitionBy("key", "print").orderBy("start", "end", "source", "source_print", "source_start")
    reach = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc))
    whole = W.partitionBy("key", "print", "island")
    sized = islands.withColumn("words", F.max("end").over(whole) - F.min("start").over(whole))
    longest = F.max(F.struct("matched", *(-F.col(n) for n in ("start", "end", "source_start", "source_end")))).alias("m")
    kept = sized.filter(F.col("words") >= least_words).groupBy("key", "print", "island", "source", "source_print").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), longest
    )
    return kept.select(
        "key", "print", "start", "end", "source", "source_print",
        (-F.col("m.col4")).alias("source_start"), (-F.col("m.col5")).alias("source_end"), "m.matched",
    )


def _aligned(rows: DataFrame, found: DataFrame, seed: int, identity: float) -> DataFrame:
    """(key, print, source, source_print, start, end, source_start, source_end, matched): alignments of chains that reach ``identity``."""
    slices = _slices(rows, found.select("key", "print", "from", "to").unionAll(
        found.select("source", "source_print", "source_from", "source_to")
    ).distinct())
    same = lambda a, b, names: [a[x].eqNullSafe(b[y]) for x, y in names.items()]
    targets = slices.toDF("k", "p", "f", "e", "a")
    sources = slices.toDF("sk", "sp", "sf", "se", "b")
    both = found.join(targets, same(found, targets, {"key": "k", "print": "p", "from": "f", "to": "e"})).join(
        sources, same(found, sources, {"source": "sk", "source_print": "sp", "source_from": "sf", "source_to": "se"})
    ).select("key", "print", "source", "source_print", "from", "source_from", "chain", "a", "b")
    names = ["start", "end", "source_start", "source_end", "matched"]
    span_type = T.StructType([*both.schema.fields[:4], *(T.StructField(n, T.IntegerType()) for n in names)])

    def align_all(batches):
        for batch in batches:
            of, out = [], []
            for row, (t0, s0, chain, a, b) in enumerate(zip(*(batch.column(i) for i in range(4, 9)))):
                t0, s0 = t0.as_py(), s0.as_py()
                t, s = (c.to_pylist() for c in chain.values.flatten())
                a, b = (np.frombuffer(x.as_buffer(), dtype="<u4") for x in (a, b))
                for start, end, ss, se, matched in align(a, b, [(x - t0, y - s0) for x, y in zip(t, s)], seed, identity):
                    of.append(row)
                    out.append((start + t0, end + t0, ss + s0, se + s0, matched))
            columns = list(zip(*out)) or [()] * 5
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(4)), *(pa.array(c, pa.int32()) for c in columns)], names=span_type.names)

    return both.mapInArrow(align_all, span_type)


def _slices(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, print, from, to, words): slices of texts as 32-bit word hashes.

    The slices asked of one text are dealt to groups of about `SLICES`, so a text that is everyone's source is not one
    task, and it is sent once per group, not once per slice.
    """
    wanted = stage(wanted, "slices-wanted")
    sizes = wanted.groupBy("key", "print").agg(F.ceil(F.count("*") / SLICES).alias("parts"))
    s = sizes.toDF("k", "p", "parts")
    salted = wanted.join(s, [wanted["key"].eqNullSafe(s["k"]), wanted["print"] == s["p"]]).withColumn(
        "salt", F.pmod(F.xxhash64("from", "to"), F.col("parts"))
    )
    asked = salted.groupBy("key", "print", "salt").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    a = asked.select(F.col("key").alias("k"), F.col("print").alias("p"), "salt", "spans")
    once = rows.join(a, [rows["key"].eqNullSafe(a["k"]), rows["print"] == a["p"]]).select("key", "print", "text", "spans")
    schema = T.StructType([*once.schema.fields[:2], T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            of, out = [], []
            for row, (t, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                words = (word_hashes(t) >> np.uint64(32)).astype("<u4")
                for start, end in zip(*(c.to_pylist() for c in spans.values.flatten())):
                    of.append(row)
                    out.append((start, end, words[start:end].tobytes()))
            take = pa.array(of, pa.int64())
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    # rows equal in key and text give the same slices
    return stage(once.mapInArrow(cut, schema).dropDuplicates(["key", "print", "from", "to"]), "slices")


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the passages of `repeated_passages` cut out of ``text``, and ``n_removed`` words."""
    k, p, s, n = (fresh(x, docs) for x in ("key__", "print__", "spans__", "n_removed"))
    spans = passages.groupBy(F.col("key").alias(k), F.col("print").alias(p)).agg(F.collect_set(F.struct("start", "end")).alias(s))
    joined = docs.join(spans, [docs[key].eqNullSafe(spans[k]), F.xxhash64(docs[text]) == spans[p]], "left").drop(k, p)
    schema = T.StructType([*docs.schema.fields, T.StructField(n, T.LongType())])
    at, width = docs.columns.index(text), len(docs.columns)

    def cut(batches):
        for batch in batches:
            texts, removed = [], []
            for t, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                gone = 0
                if own:
                    words = [m.span() for m in WORD.finditer(t)]
                    out, done = [], 0
                    for start, end in sorted((x["start"], x["end"]) for x in own):
                        start = max(start, done)
                        if start < end:
                            out.append(t[words[done][0] if done else 0 : words[start][0]] if done < len(words) else "")
                            gone, done = gone + end - start, end
                    out.append(t[words[done][0] :] if done < len(words) else "")
                    t = "".join(out)
                texts.append(t)
                removed.append(gone)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)
