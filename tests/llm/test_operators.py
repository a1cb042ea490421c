"""The operators of scriptoria.llm against brute force, on literals with nulls, ties, copies and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptoria.llm import chaining, language, lines, packing, perspectives, secret_scan, simhash, tiling, token_files, voronoi
from scriptoria.llm.components import connected_components
from scriptoria.llm.encoding import encoder
from scriptoria.llm.queries import tokenizer_path

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "si", "tu", "ve") for c in ("n", "st", "l", "m")]
DOCS = "doc_id long, text string, pos string, key int, print string, fp string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "x", 1, "p", "f") for i, t in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null and equal keys, repeated rows, a very long text."""
    rows = [(1, None), (2, ""), (None, "alone here now"), (3, "same row"), (3, "same row"), (3, "other text of the key"), (4, prose(4, 60_000)), (5, " \n\t")]
    return docs(spark, rows)


# 1 ------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    held = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in held:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(held[q], held[d])), d) for d in held if d != q)
            out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 7])
def test_top_k_equals_brute_force(spark, pivots, monkeypatch):
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 40)
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 3)
    r = random.Random(5)
    rows = [(i, [r.choice((-1, 1)) * 0.9 + r.gauss(0, 0.05) for _ in range(6)] if i % 3 else [0.5] * 6) for i in range(300)]
    rows += [(1000, None), (1020, [0.1, None] * 3), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [1.0] * 6), (1080, [0.25, 0.5])]
    data = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<double>, id int, score double")
    got = voronoi.nearest(data, data.filter("vec_id % 20 = 0"), 5, pivots=pivots).select("query_id", "rank", "id", "score")
    padded = [(i, v + [0.0] * (6 - len(v)) if v else v) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute_top(padded, 5)
    assert voronoi.nearest(data.limit(0), data.limit(0), 5).count() == 0


def test_clustered_data_is_pruned():
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0]])
    bounds = voronoi.group_bounds(pivots, np.array([1.0, 1.0]), [(i // 4, i, 1.0) for i in range(8)], 3)
    assert (bounds > 9000).all()  # rows of the other cell score about -10000


# 2 ------------------------------------------------------------------------------------------------


def test_rotation(spark):
    rows = [(1, 2, "bob", "b"), (1, 1, "ann", "hi"), (1, 2, None, None), (1, 2, "bob", "b"), (None, None, "eve", ""), (2, 1, "ann", "x" * 50), (2, 2, "bob", "y")]
    turns = spark.createDataFrame([(*r, "z", 9) for r in rows], "conv_id long, turn int, role string, text string, speaker string, part int")
    got = {(r.conv_id, r.speaker): r for r in perspectives.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (2, "bob"), (None, "eve")}
    bob = got[1, "bob"]
    assert bob.text == (
        "<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\nb<|im_end|>\n" * 2 + "<|im_start|>user name=unknown\n<|im_end|>\n"
    )
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["b<|im_end|>"] * 2
    parts = perspectives.rotate(turns, part_chars=40).filter("conv_id = 2").orderBy("speaker", "part").collect()
    for who in ("ann", "bob"):
        own = [p for p in parts if p.speaker == who]
        assert "".join(p.text for p in own) == got[2, who].text
        assert [p.start for p in own] == [sum(len(q.text) for q in own[:i]) for i in range(len(own))] and len(own) == 2
    assert perspectives.rotate(turns.limit(0)).count() == 0


# 3, 6 ---------------------------------------------------------------------------------------------


def test_ids_equal_whole_texts():
    source = encoder(tokenizer_path())
    r = random.Random(1)
    letters = "aZé ÉßöŒœ\t\n\x0b\x1c  'st.,!?09Σςı İ́ñ<|endoftext|>中文"
    for i in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40))) + "<|endoftext|>" * (i % 5 == 0)
        assert source.ids(text).tolist() == source.tokenizer.encode(text, add_special_tokens=False).ids


def whole_ids(text, end):
    return [*encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files_round_trip(spark, odd):
    files = token_files.write_token_files(odd, tokenizer_path(), 1)
    got = sorted(((r.start, r.key, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files).collect()))
    expected, start = [], 0
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    for has, key, text in rows:
        ids = whole_ids(text, 1)
        expected.append((start, key if has else None, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0), tokenizer_path(), 1)).count() == 0


def test_packing_is_whole_and_tight(spark, odd):
    pieces = packing.cut(odd, tokenizer_path(), 0, 100, with_ids=True)
    packed = packing.pack(pieces, 100, group_pieces=50)
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(len(whole_ids(r.text, 0)) for r in odd.collect())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 100) + 1
    long = [r for r in rows if r.key == 4]
    joined = b"".join(bytes(r.ids) for r in sorted(long, key=lambda r: r.piece))
    assert np.frombuffer(joined, dtype="<u4").tolist() == whole_ids(odd.filter("doc_id = 4").first().text, 0)
    made = {r.sequence_id: bytes(r.ids) for r in packing.assemble(packed).collect()}
    assert sum(map(len, made.values())) == 4 * sum(r.length for r in rows)
    assert packing.pack(pieces.limit(0), 100).count() == 0


def test_gaps_are_repacked(spark):
    # thirds and halves: groups that are unlucky leave gaps, the exchange closes them
    r = random.Random(3)
    sizes = [r.choice([26, 34, 51, 66, 74, 49]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, length int")
    alone = packing.pack(df, 100, rounds=0, group_pieces=40).select("sequence_id").distinct().count()
    better = packing.pack(df, 100, group_pieces=40)
    n = better.select("sequence_id").distinct().count()
    assert packing.lower_bound(np.array(sizes), 100) <= n <= alone and better.count() == 3000
    assert better.groupBy("sequence_id").agg(F.sum("length").alias("s")).filter("s > 100").count() == 0


def test_bounds_never_exceed_the_optimum():
    def optimum(sizes, capacity, bins=()):
        if not sizes:
            return len(bins)
        best = len(bins) + len(sizes)
        for i, b in enumerate(bins):
            if b + sizes[0] <= capacity:
                best = min(best, optimum(sizes[1:], capacity, (*bins[:i], b + sizes[0], *bins[i + 1 :])))
        return min(best, optimum(sizes[1:], capacity, (*bins, sizes[0])))

    r = random.Random(2)
    for _ in range(60):
        sizes = [r.randint(1, 10) for _ in range(7)]
        assert packing.lower_bound(np.array(sizes), 10) <= optimum(sizes, 10) <= packing.best_fit(np.array(sizes), 10)[2]


# 4 ------------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    for i, t in rows:
        v = t.split("\n")
        gone = set()
        for p in range(len(v) - 2):
            if (w := tuple(v[p : p + 3])) in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out.append((i, "\n".join(x for p, x in enumerate(v) if p not in gone), len(v), len(gone)))
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(1, 12)))) for i in range(80)] + [(90, "a\n" * 3000), (91, "")]
    got = lines.remove_repeated_lines(docs(spark, rows))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == sorted(brute_lines(rows))


def test_lines_odd(spark, odd):
    clash = odd.withColumn("n_lines", F.lit(5))
    got = lines.remove_repeated_lines(clash)
    assert got.columns == [*clash.columns, "n_lines_", "n_removed"] and got.count() == odd.count()
    assert got.filter("doc_id = 1").first().text is None
    assert lines.remove_repeated_lines(odd.limit(0)).count() == 0
    same = docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])
    assert sorted((r.doc_id is None, r.text) for r in lines.remove_repeated_lines(same).collect()) == [(False, ""), (False, ""), (True, "a\nb\nc")]


# 5 ------------------------------------------------------------------------------------------------


def brute_tiles(item, doc, least):
    item_free, doc_free, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item_free[p + n] and doc_free[t + n] and item[p + n] == doc[t + n]:
                    n += 1
                if n > best[2]:
                    best = (p, t, n)
        if best[2] < least:
            return out
        out.append(best)
        for i in range(best[2]):
            item_free[best[0] + i] = doc_free[best[1] + i] = False


def test_tiles_equal_brute_force():
    r = random.Random(11)
    for _ in range(120):
        item, doc = ([r.randint(1, 3) for _ in range(r.randint(0, 40))] for _ in range(2))
        assert tiling.tiles(item, doc, 3) == brute_tiles(item, doc, 3)


def test_contamination_equals_brute_force(spark):
    items = [(i, prose(i, 30)) for i in range(6)] + [(6, "too short"), (7, None), (8, prose(1, 30))]
    cut = items[2][1].split()
    rows = [(i, prose(100 + i, 80)) for i in range(20)]
    rows += [(50, prose(7, 20) + " " + items[0][1].upper() + ", " + prose(8, 20)), (51, " ".join(cut[15:] + ["x", "y"] + cut[:15])), (52, " ".join(cut[:12])), (53, items[1][1]), (53, items[1][1]), (None, None)]
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, key string")
    data = docs(spark, rows)
    got = tiling.contaminated(data, bench)
    expected = []
    for d, t in rows:
        for i, own in items:
            a, b = (re.findall(r"\w+", (x or "").lower()) for x in (own, t))
            covered = sum(x[2] for x in brute_tiles(a, b, 5))
            if covered and covered >= 0.5 * len(a):
                expected.append((d, i, covered))
    assert sorted((r.key, r.item, r.covered) for r in got.collect()) == sorted(expected)
    assert {e[0] for e in expected} == {50, 51, 53}
    assert sorted(r.doc_id for r in tiling.remove_contaminated(data, got).collect() if r.doc_id is not None) == [*range(20), 52]
    assert tiling.contaminated(data.limit(0), bench).count() == tiling.contaminated(data, bench.limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def brute_secrets(text):
    text = text or ""
    spans = []
    for rank, (kind, (pattern, group, least)) in enumerate(secret_scan.BASE_KINDS.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    base = sorted(spans)
    w = secret_scan.WINDOW
    for rank, (kind, (letters, bits)) in enumerate(secret_scan.ENTROPY_KINDS.items(), len(secret_scan.BASE_KINDS)):
        for m in re.finditer(f"[{letters}]{{{w},}}", text):
            value = m[0]
            if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
                continue
            hits = [h.span() for p in secret_scan.ALLOWED for h in re.finditer(p, value)]
            high = [i for i in range(len(value) - w + 1) if not any(i < b and i + w > a for a, b in hits) and sum(map(secret_scan.weight, Counter(value[i : i + w]).values())) <= secret_scan.limit(bits, w)]
            for i, p in enumerate(high):
                if i == 0 or p > high[i - 1] + w:
                    end = next(q for q, n in zip(high[i:], [*high[i + 1 :], 10**9]) if n > q + w)
                    spans.append((m.start() + p, rank, m.start() + end + w, kind))
    write = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))
    return write(base), write(spans)


def test_secrets_equal_brute_force(spark):
    r = random.Random(9)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    b64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = [
        None, "", "é😀 password = \"hunter22\" and token:abc; Secret='x.y-z_1'", "secret=token:abcdefgh token=short", "api_key=" + pick(b64, 40), "AKIA" + pick("ABC123", 16) + " AKIA123",
        pick("0123456789abcdef", 40) + " " + pick("0123456789abcdef", 23), "550e8400-e29b-41d4-a716-446655440000", "aaaaaaaaaaaaaaaaaaaaaaaaa1", pick(b64, 3000),
        "x" * 30 + pick(b64, 30) + "x" * 40 + pick(b64, 25), "EXAMPLE" + pick(b64, 30), " ".join(pick("0123456789abcdef", 30) for _ in range(700)),
    ] + [" ".join(r.choice(["token=", "é", pick(b64, r.randint(5, 60)), "passwd: ", "AKIA" + pick("AB1", 18), pick("abcdef012", r.randint(10, 40))]) for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, "token=abcdefgh"), (3, texts[3])]
    got = sorted(((r.key is None, r.key or 0, r.base, r.spans) for r in secret_scan.find_secrets(docs(spark, rows)).collect()))
    assert got == sorted((i is None, i or 0, *brute_secrets(t)) for i, t in rows)
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0


# 8 ------------------------------------------------------------------------------------------------


def test_models_sum_to_one():
    models = language.build_models([("a", g, n) for g, n in (("\x02\x02ab", 3), ("\x02\x02ba", 1), ("\x02aba", 2), ("abab", 1), ("\x02ab\x03", 2))] + [("b", "\x02\x02cc", 2), ("b", "\x02ccc", 0 + 1)], 4)
    letters = ["a", "b", "c", "\x03"]
    # every known character and one share for unknown ones, after a seen, a half seen and an unseen context
    for head in ("\x02\x02", "b", "zz"):
        for lang in range(2):
            total = 0.0
            for c in [*letters, "?"]:
                text = ("\x02\x02\x02" + head + c)[-4:]
                total += np.exp(gram_score(models, text, lang))
            assert abs(total - 1) < 1e-9


def gram_score(models, gram, lang):
    score = 0.0
    for size in range(len(gram), 0, -1):
        own = language._codes(gram[-size:])
        keys, values = models.grams[size - 1]
        found, value = language._look_up(keys, values, language._keys(own, size))
        if found[0]:
            return score + value[0][lang]
        if size > 1:
            known, weight = language._look_up(*models.contexts[size - 1], language._keys(own[:-1], size - 1))
            score += weight[0][lang] if known[0] else 0.0
    return score + models.base[lang]


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    told = language.identify(table.filter(held), language.train(table.filter(~held)))
    right, n, kept = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg(F.col("accepted").cast("int"))).first()
    assert n > 200 and right > 0.97 and kept > 0.99


def test_language_odd(spark, odd):
    rows = odd.withColumns({"lang": F.lit("en"), "score": F.lit("mine")})
    models = language.train(rows)
    got = language.identify(rows, models)
    assert got.columns == [*rows.columns, "lang_pred", "score_", "cross_entropy", "accepted"] and got.count() == odd.count()
    assert {(r.doc_id, r.lang_pred, r.accepted) for r in got.collect() if r.doc_id in (1, 2, 5)} == {(i, "und", False) for i in (1, 2, 5)}
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = spark.createDataFrame([(0, " ".join("qxzjvkwqz" for _ in range(300)))], "doc_id long, text string")
    assert not language.identify(noise, language.train(table)).first().accepted
    empty = language.train(rows.limit(0))
    assert language.identify(rows, empty).filter("lang_pred <> 'und' OR accepted").count() == 0


def test_small_language_is_kept(spark):
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπωρστυζςχθϊ")
    rows = [(i, prose(5000 + i, 150), "big") for i in range(400)] + [(9000 + i, prose(7000 + i, 150).translate(greek), "small") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for chars in (60_000, language.TRAIN_CHARS):
        models = language.train(table, train_chars=chars)
        got = language.identify(table, models)
        assert {(r.doc_id, r.lang_pred, r.accepted) for r in got.filter("lang = 'small'").collect()} == {(9000 + i, "small", True) for i in range(3)}
        assert got.filter("lang = 'big' AND NOT (accepted AND lang_pred = 'big')").count() == 0
    assert language._equal_share([10, 500, 300], 210) == 100 and language._equal_share([1, 2], 9) == float("inf")


# 9 ------------------------------------------------------------------------------------------------


def test_chains_equal_brute_force():
    def best(anchors, seed, gap):
        order = sorted(set(anchors))
        score = []
        for t, s in order:
            score.append(seed + max([0.0] + [score[j] - gap * (t - u + s - v) for j, (u, v) in enumerate(order[: len(score)]) if u < t and v < s]))
        return max(score)

    r = random.Random(4)
    for _ in range(100):
        anchors = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.randint(1, 25))]
        found = chaining.chains(anchors, 8, 0.1)
        assert sorted(a for c in found for a in c) == sorted(set(anchors))
        first = found[0]
        value = 8 * len(first) - 0.1 * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(first, first[1:]))
        assert abs(value - best(anchors, 8, 0.1)) < 1e-9


def test_planted_passages(spark):
    passage = prose(900, 70)
    fuzzy = passage.split()
    fuzzy[20] = "changed"
    fuzzy[45:46] = ["two", "more"]
    rows = [(i, prose(i, 200)) for i in range(30)]
    rows[3] = (3, prose(3, 90) + " " + passage + " " + prose(33, 90))
    rows[8] = (8, prose(8, 40) + " " + passage.upper() + ". " + prose(38, 10))
    rows[9] = (9, prose(9, 40) + " " + " ".join(fuzzy) + " " + prose(39, 10))
    rows[10] = (10, prose(10, 40) + " " + " ".join(passage.split()[:30]))  # too short to report
    rows[20] = (20, rows[5][1])
    rows += [(40, None), (41, ""), (None, prose(77, 10)), (30, prose(80, 5000))]
    table = docs(spark, rows)
    found = chaining.repeated_passages(table)
    got = {(r.key, r.source): r for r in found.collect()}
    assert set(got) == {(8, 3), (9, 3), (20, 5)}
    assert (got[8, 3].start, got[8, 3].end, got[8, 3].source_start, got[8, 3].matched) == (40, 110, 90, 70)
    # one word before it equals the source's by chance
    assert (got[9, 3].start, got[9, 3].end) == (39, 111) and got[9, 3].matched == 69
    cut = {r.doc_id: r for r in chaining.remove_passages(table, found).collect()}
    assert cut[8].text.split() == (prose(8, 40) + " " + prose(38, 10)).split() and cut[8].n_removed == 70
    assert cut[20].text == "" and cut[0].text == rows[0][1] and cut[40].text is None
    assert chaining.repeated_passages(table.limit(0)).count() == 0


def test_repeats_in_many_documents_stay_linear(spark):
    passage = prose(901, 80)
    table = docs(spark, [(i, prose(2000 + i, 60) + " " + passage) for i in range(120)] + [(500 + i, passage) for i in range(40)])
    found = chaining.repeated_passages(table).collect()
    assert {r.key for r in found} == set(range(1, 120)) | set(range(500, 540)) and len(found) < 2 * 160


def test_passages_apart_and_inserted_paragraph(spark):
    one, two, copy = prose(910, 100), prose(911, 100), prose(912, 160)
    half = copy.split()
    foreign = lambda seed, n: " ".join(f"{w}{seed}" for w in prose(seed, n).split())
    rows = [
        (1, f"{one} {foreign(1, 150)} {two}"), (2, f"{one} {foreign(2, 150)} {two}"),
        (3, copy), (4, " ".join(half[:80]) + f" {foreign(3, 300)} " + " ".join(half[80:])),
    ]
    got = sorted((r.key, r.start, r.end, r.source, r.matched) for r in chaining.repeated_passages(docs(spark, rows)).collect())
    assert got == [(2, 0, 100, 1, 100), (2, 250, 350, 1, 100), (4, 0, 80, 3, 80), (4, 380, 460, 3, 80)]


def test_parts_reach_the_identity():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_next(row, x, b)]
        return row[-1]

    def _next(row, x, b):
        last, out = 0, []
        for j, y in enumerate(b):
            last = row[j] + 1 if x == y else max(row[j + 1], last)
            out.append(last)
        return out

    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(90))] for _ in range(2))
        assert chaining._common(a, b) == common(a, b)
    for _ in range(200):
        pieces, at = [], 0
        for n in range(r.randrange(1, 12)):
            if n:
                gap = r.randrange(30)
                pieces.append((at, at + gap, at, at + gap, r.randint(0, gap)))
                at += gap
            pieces.append((at, at + 8, at, at + 8, 8))
            at += 8
        parts = chaining._parts(pieces, 0.8)
        assert all(chaining._over(p, 0.8) >= 0 for p in parts) and sum(p[1] - p[0] for p in parts) >= 8
        held = {w for p in parts for w in range(p[0], p[1])}
        assert all(w in held for p in pieces[::2] for w in range(p[0], p[1]))  # no seed is lost
        assert not any(chaining._over(chaining._merged([x, (x[1], y[0], x[3], y[2], sum(g[4] for g in pieces if x[1] <= g[0] and g[1] <= y[0])), y]), 0.8) >= 0 for x, y in zip(parts, parts[1:]))


# 10 -----------------------------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                part[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_near_duplicates_equal_brute_force(spark, odd):
    base = prose(60, 400).split()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(60):
        own = list(base)
        own[i * 3] = "edit"
        rows.append((100 + i, " ".join(own)))
    rows += [(200 + i, prose(300 + i, 50)) for i in range(60)]
    fps = [brute_fingerprint(t) for _, t in rows]
    parts = brute_components(sorted(set(fps)))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[parts[f]] = min(i, least.get(parts[f], i))
    expected = sorted((str(i), f, str(least.get(parts[f]))) for (i, _), f in zip(rows, fps))
    table = docs(spark, rows)
    got = simhash.near_duplicates(table).collect()
    assert sorted((str(r.key), r.fingerprint % 2**64, str(r.component_id)) for r in got) == expected
    kept = simhash.keep_first(table).collect()
    assert len(kept) == len(set(parts.values()))
    assert simhash.near_duplicates(table.limit(0)).count() == simhash.keep_first(table.limit(0)).count() == 0


def test_blocks_follow_from_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**7, 10**9, 10**10, 10**30)] == [4, 4, 5, 5, 6, 8]
    assert simhash.blocks_for(10**30, 1) == 4


@pytest.mark.parametrize("block, blocks", [(16, None), (4096, 4), (4096, 5), (64, 6)])
def test_links_in_hot_cells(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for f in fps[:100]]
    fps += [fps[0] ^ 1 << a ^ 1 << b for a in range(14) for b in range(a)]
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node % 2**64: r.part % 2**64 for r in connected_components(simhash.links(table, blocks=blocks)).collect()}
    expected = brute_components(fps)
    groups = lambda p: sorted(sorted(f for f in fps if p(f) == x) for x in {p(f) for f in fps})
    assert groups(lambda f: got.get(f, f)) == groups(lambda f: expected[f])


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.node: r.part for r in connected_components(path).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}
