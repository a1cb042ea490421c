"""The operators of this package on the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, content_sort, language, lines, packing, perspectives, secret_scan, simhash, tiling, token_files, vector_codes, voronoi, whitening
from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEQUENCE_TOKENS = 2048


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_path() -> str:
    """The vocabulary that the queries of operators 3 and 6 use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_voronoi_top_k", """
    WITH q AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    data = load(spark, folder, "embeddings").select("vec_id", "embedding")
    best = voronoi.nearest(data, data.filter("vec_id % 20 = 0"), 20)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op2_perspective_rotation", f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '{perspectives.UNNAMED}') AS name, coalesce(text, '') AS text FROM conversations
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, text) AS n,
        coalesce(sum(length(text) + length(name) + {len(perspectives.OTHER_OPEN.format("")) + len(perspectives.CLOSE)}) OVER (
          PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM t
    ), s AS (
      SELECT o.conv_id, p.speaker, CAST(before // {perspectives.PART_CHARS} AS BIGINT) AS part, n, o.name = p.speaker AS own,
        CASE WHEN o.name = p.speaker THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || o.name END || chr(10) AS head,
        head || o.text || '<|im_end|>' || chr(10) AS whole
      FROM o JOIN (SELECT DISTINCT conv_id AS c, name AS speaker FROM t) p ON o.conv_id IS NOT DISTINCT FROM p.c
    ), a AS (
      SELECT *, sum(length(whole)) OVER (PARTITION BY conv_id, speaker, part ORDER BY n) AS ends FROM s
    ), g AS (
      SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(whole, '' ORDER BY n) AS text,
        coalesce(string_agg((ends - length(whole) + length(head)) || ':' || (ends - 1), ',' ORDER BY n) FILTER (own), '') AS spans
      FROM a GROUP BY ALL
    )
    SELECT conv_id, speaker, part, n_turns, spans, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars,
      CAST(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part) - length(text) AS BIGINT) AS start
    FROM g
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    views = perspectives.rotate(load(spark, folder, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return views.select(
        "conv_id", "speaker", "part", "start", "n_turns", spans.alias("spans"), F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("n_chars"),
    )


@query("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(load(spark, folder, "documents"), tokenizer_path(), end_id=1)
    return token_files.read_token_files(files).withColumnRenamed("key", "doc_id")


@query("op4_line_windows", """
    WITH l AS (
      SELECT doc_id, text, md5(text) AS print, string_split(text, chr(10)) AS v FROM documents
    ), w AS (
      SELECT doc_id, print, i AS pos, v[i] || chr(10) || v[i + 1] || chr(10) || v[i + 2] AS lines
      FROM l, unnest(generate_series(1, len(v) - 2)) AS u(i)
    ), later AS (
      SELECT doc_id, print, pos FROM w
      QUALIFY row_number() OVER (PARTITION BY lines ORDER BY doc_id, print, pos) > 1
    ), gone AS (
      SELECT DISTINCT doc_id, print, pos + j AS pos FROM later, unnest([0, 1, 2]) AS u(j)
    ), kept AS (
      SELECT doc_id, print, i, v[i] AS line FROM l, unnest(generate_series(1, len(v))) AS u(i)
    ), joined AS (
      SELECT kept.doc_id, kept.print, count(*) AS n_lines, count(gone.pos) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.pos IS NULL), '') AS text
      FROM kept LEFT JOIN gone ON gone.doc_id = kept.doc_id AND gone.print = kept.print AND gone.pos = kept.i GROUP BY ALL
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE j.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
    FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id AND md5(d.text) = j.print
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return lines.remove_repeated_lines(load(spark, folder, "documents").select("doc_id", "text"))


@query("op5_string_tiling")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = tiling.contaminated(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "covered", "n_tiles", "coverage")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut(load(spark, folder, "documents"), tokenizer_path(), 0, SEQUENCE_TOKENS)
    return packing.pack(pieces, SEQUENCE_TOKENS).withColumnRenamed("key", "doc_id")


_KINDS = "".join(f" WHEN '{kind}' THEN {i}" for i, kind in enumerate([*secret_scan.BASE_KINDS, *secret_scan.ENTROPY_KINDS]))


def _sql_matches(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, t, '{kind}' AS kind, i, m[i] AS value, g[i] AS part,
        list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS pos
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g,
        regexp_split_to_array(t, '{p}') AS s FROM d) x, unnest(generate_series(1, len(m))) AS u(i)
      WHERE length(g[i]) >= {least}"""


def _sql_entropy(kind: str, letters: str, bits: float) -> str:
    w = secret_scan.WINDOW

    def hits(p: str) -> str:
        found, gaps, size = f"regexp_extract_all(value, '{p}')", f"regexp_split_to_array(value, '{p}')", "lambda x: length(x)"
        start = f"(coalesce(list_sum(list_transform({gaps}[1:i], {size})), 0) + coalesce(list_sum(list_transform({found}[1:i - 1], {size})), 0))::BIGINT"
        return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': {start}, 'n': length({found}[i])::BIGINT}})"

    # runs of one character: RE2 has no references back, so eight equal ones from each place on
    equal = "list_transform(list_filter(range(1, length(value) - 6), lambda i: value[i:i + 7] = repeat(value[i], 8)), lambda i: {'s': (i - 1)::BIGINT, 'n': 8::BIGINT})"
    allowed = " || ".join([equal, *(hits(p) for p in secret_scan.ALLOWED if "\\1" not in p)])
    return f"""
      SELECT doc_id, kind, min(p) AS pos, max(p) + {w} AS stop FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id, kind, pos ORDER BY p) AS island FROM (
          SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, kind, pos ORDER BY p) <= {w} THEN 0 ELSE 1 END AS fresh FROM (
            SELECT doc_id, kind, pos, pos + k AS p, list_sum(list_transform(range(0, 128), lambda c:
              CASE WHEN w[c + 1] > 0 THEN CAST(round(w[c + 1] * log2(w[c + 1]) * {secret_scan.SCALE}) AS BIGINT) ELSE 0 END)) AS s
            FROM (
              SELECT doc_id, kind, pos, k, list_transform(range(0, 128), lambda c: {w} - length(replace(substr(value, k + 1, {w}), chr(CAST(c AS INT)), ''))) AS w
              FROM (SELECT *, {allowed} AS hits FROM ({_sql_matches(kind, f"[{letters}]{{{w},}}", 0, w)})) c, unnest(generate_series(0, length(value) - {w})) AS u(k)
              WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_filter(hits, lambda h: k < h.s + h.n AND k + {w} > h.s)) = 0
            )
          ) WHERE s <= {secret_scan.limit(bits, w)}
        )
      ) GROUP BY doc_id, kind, pos, island"""


@query("op7_secret_entropy", f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({" UNION ALL ".join(
        f"SELECT doc_id, kind, pos, pos + length(value) AS stop FROM ({_sql_matches(k, *v)})" for k, v in secret_scan.BASE_KINDS.items()
    )}),
    more AS ({" UNION ALL ".join(_sql_entropy(k, *v) for k, v in secret_scan.ENTROPY_KINDS.items())}),
    spans AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM more),
    told AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY pos, CASE kind{_KINDS} END, stop) FILTER (is_base) AS base,
        string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY pos, CASE kind{_KINDS} END, stop) AS spans
      FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN told ON d.doc_id = told.doc_id
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(load(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op8_language_models")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    models = language.train(docs.filter(F.col("doc_id").isNotNull() & ~held_out))
    told = language.identify(docs.select("doc_id", "text"), models)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


@query("op9_collinear_chains")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = chaining.repeated_passages(load(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "start", "end", F.col("source").alias("source_doc_id"), "source_start", "source_end", "matched"
    )


@query("op10_simhash_pivots")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _sql_codes() -> str:
    """Operator 11 by comparing every part with every entry."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [f"""
      k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
        list_transform(embedding, lambda x: floor({vector_codes.FACTOR} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_USABLE}),
      p AS MATERIALIZED (SELECT r, q AS part, v[q * (len(v) // {parts}) + 1:(q + 1) * (len(v) // {parts})] AS x FROM k, unnest(range({parts})) u(q)),
      b0 AS MATERIALIZED (SELECT part, r AS e, x FROM p WHERE r < {entries})"""]
    for n in range(vector_codes.ROUNDS + 1):
        away = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
        steps.append(f"""
      a{n} AS MATERIALIZED (SELECT p.r, p.part, min(CAST({away} AS HUGEINT) * {entries} + b.e) AS m FROM p JOIN b{n} b USING (part) GROUP BY ALL)""")
        if n < vector_codes.ROUNDS:
            steps.append(f"""
      b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(y.x, b.x) AS x FROM b{n} b LEFT JOIN (
        SELECT part, e, list(s ORDER BY i) AS x FROM (
          SELECT part, CAST(m % {entries} AS INT) AS e, i, floor(sum(x[i]) / count(*)) AS s
          FROM a{n} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL) GROUP BY ALL
      ) y ON y.part = b.part AND y.e = b.e)""")
    last = vector_codes.ROUNDS
    return f"""
    WITH {",".join(steps)},
    c AS (SELECT r, string_agg(lower(lpad(to_hex(CAST(m % {entries} AS BIGINT)), 2, '0')), '' ORDER BY part) AS code,
      CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{last} GROUP BY r),
    d AS (SELECT sha256(string_agg(CAST(x[i] AS BIGINT), ',' ORDER BY part, e, i)) AS digest FROM b{last}, unnest(range(1, len(x) + 1)) u(i))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
    FROM c JOIN k USING (r), d"""


@query("op11_equal_average_codes", _sql_codes())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(load(spark, folder, "embeddings"))
    code = F.lower(F.hex("code")).alias("code")
    return coded.select(F.col("id").alias("vec_id"), code, "error", "label_error", F.lit(books.digest if books else "").alias("codebooks_sha256"))


@query("op12_content_sort", f"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{content_sort.SPACE}', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
      row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
    FROM n
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    groups = content_sort.exact_groups(load(spark, folder, "documents"))
    return groups.select(F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", "text_sha256")


@query("op13_cholesky_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows, fitted = whitening.whiten(load(spark, folder, "embeddings"))
    share = F.element_at(F.array(*(F.lit(float(s)) for s in fitted.explained)), F.col("component")) if len(fitted.explained) else F.lit(0.0)
    return rows.select(
        F.col("id").alias("vec_id"), "component", F.lit(fitted.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        share.alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
