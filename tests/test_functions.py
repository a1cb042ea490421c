"""Column functions on literals with values worked out by hand."""

import math

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from scriptoria.functions import arrays as ar
from scriptoria.functions import fixed_values as fixed
from scriptoria.functions import ladders
from scriptoria.functions import text as tx
from scriptoria.functions import vectors as vx
from scriptoria.operators import ailike as ai
from scriptoria.operators import authorship as au
from scriptoria.operators import compliance as co
from scriptoria.operators import feeds as fd
from scriptoria.operators import profiles as pr
from scriptoria.operators import security as se
from scriptoria.operators import stylometry as st


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(expr.alias("r")).head().r


def test_clean_text(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="  “Hi” \n there* Übung  ‘x’ ") == "\"Hi\" there Übung 'x'"
    assert one(spark, tx.clean_text(F.lit(None).cast("string"))) == ""


def test_sanitize_keeps_escaped_tags(spark):
    safe = one(spark, tx.sanitize_text(F.col("t")), t="<script>x</script> javascript:go onclick = 1  a")
    assert safe == "&lt;script&gt;x&lt;/script&gt; go 1 a"


def test_repeat_patterns(spark):
    for text, hit in (("a" * 21 + " b", True), ("a" * 20 + " b", False), ("go " * 12, True), ("go " * 10, False)):
        checks = tx.content_checks(F.col("t"), tx.raw_words(F.col("t")))
        warnings = one(spark, checks["warnings"], t=text)
        assert any("{" in w for w in warnings) is hit


def test_masks(spark):
    assert one(spark, tx.mask_email(F.col("e")), e="person@x.org") == "p****n@x.org"
    assert one(spark, tx.mask_email(F.col("e")), e="ab@x.org") == "**@x.org"
    assert one(spark, tx.mask_email(F.col("e")), e="nobody") == "anonymous@example.com"
    assert one(spark, tx.mask_ip(F.col("i")), i="10.1.2.3") == "10.1.2.0"
    assert one(spark, tx.mask_ip(F.col("i")), i="2001:db8:1:2:3") == "2001:db8:1:2::0"
    assert one(spark, tx.mask_ip(F.col("i")), i="junk") == "0.0.0.0"
    assert one(spark, tx.browser_family(F.col("a")), a="") == "Unknown"
    assert one(spark, tx.normalize_path(F.col("p")), p="/a/12/b/123e4567-e89b-12d3-a456-426614174000") == "/a/{id}/b/{id}"


def test_cosine(spark):
    c = vx.cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[1.0, 0.0, 0.0, 0.0], b=[1.0, 0.0, 0.0, 0.0]) == 1.0
    assert math.isclose(one(spark, c, a=[1.0, 0.0, 0.0, 0.0], b=[0.9, 0.1, 0.0, 0.0]), 0.993884, abs_tol=1e-6)
    assert one(spark, c, a=[1.0, 0.0, 0.0, 0.0], b=[0.0, 0.0, 1.0, 0.0]) == 0.0
    assert one(spark, c, a=[1.0, 0.0, 0.0, 0.0], b=[0.0, 0.0, 0.0, 0.0]) == 0.0


def test_syllables(spark):
    for word, n in (("made", 1), ("idea", 2), ("table", 1), ("the", 1), ("banana", 3)):
        assert one(spark, st.syllables(F.col("w")), w=word) == n


def test_mtld_is_a_factor_count(spark):
    """Worked out by hand. "a b a": 2 of 3 words are new, under 0.72, so a factor closes at every third word."""
    words = ["a", "b", "a", "b"] * 20  # 80 words: 26 factors of three and a rest of two, in both directions
    pairs = ["a", "a"] * 30  # a factor at every second word, no rest
    distinct = [f"w{i}" for i in range(60)]  # never under the limit: the rest alone
    df = spark.createDataFrame([(words,), (pairs,), (distinct,), (["x"] * 49,), ([],), (None,)], "w array<string>")
    got = df.select(st.mtld(F.col("w")).alias("m"))
    assert [r.m for r in got.collect()] == [80 / 27, 2.0, 60.0, 0.0, 0.0, 0.0]
    assert "Python" not in got._jdf.queryExecution().toString()


def test_last_places(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b", "c", "a"],), ([],)], "w array<string>")
    assert [r.p for r in df.select(ar.last_places(F.col("w")).alias("p")).collect()] == [[-1, -1, 0, 2, -1, 1], []]


def test_ladders(spark):
    for score, label in ((0.98, "very_high"), (0.88, "high"), (0.75, "medium"), (0.55, "low"), (0.3, "very_low")):
        assert one(spark, ladders.similarity_confidence(F.col("s")), s=score) == label
    for score, kind in ((1.0, "EXACT"), (0.96, "NEAR_DUPLICATE"), (0.87, "SEMANTIC")):
        assert one(spark, ladders.match_type(F.col("s")), s=score) == kind
    for p, s in ((19.9, 0.8), (20.0, 0.5), (49.9, 0.5), (50.0, 0.2)):
        assert one(spark, ladders.perplexity_score(F.col("p")), p=p) == s


def ai_rows(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.asDict() for r in ai.features(docs).orderBy("doc_id").collect()]


def test_default_phrases(spark):
    formal, hedged, short = ai_rows(
        spark,
        "Furthermore we utilize and facilitate. In conclusion, moreover, therefore we implement it. Firstly done.",
        "It might be so and could perhaps be, maybe it seems generally true that it appears possible.",
        "few words",
    )
    assert formal["excessive_formality"] == 1.0 and formal["phrase_repetition"] == 1.0 and formal["overly_structured"] == 1.0
    assert hedged["hedging_language"] == 1.0 and formal["hedging_language"] == 0.0
    assert short["burstiness"] == 0.5


def test_assessment(spark):
    cols = "is_authentic boolean, uncertainty double, first_submission boolean, ai_probability double, ai_confidence double, top_similarity double, anomalous boolean"
    rows = [(True, 0.1, False, 0.1, 0.9, None, False), (False, 0.9, False, 0.9, 0.5, 0.95, True), (False, 0.4, True, 0.1, 0.9, None, False), (True, 0.1, False, 0.95, 0.9, None, False)]
    out = [r.result for r in au.assess(spark.createDataFrame(rows, cols)).collect()]
    assert out == ["PASS", "FAIL", "PASS", "REVIEW"]


def test_small_rules(spark):
    for agent, risk in (("GoogleBot/2", 30), ("short", 20), ("Mozilla/5.0 Firefox", 0), ("", 0)):
        assert one(spark, se.user_agent_risk(F.col("a")), a=agent) == risk
    assert one(spark, se.login_risk(F.col("n")), n=3) == 35
    assert one(spark, se.rapid_request_risk(F.col("n")), n=200) == 60
    assert one(spark, fd.grade(F.col("s"), F.col("a"), F.col("p")), s="REVIEW", a=60.0, p=50.0) == 30.0
    assert one(spark, pr.confidence_score(F.lit(5), F.lit(6000), F.lit(0.5))) == 100
    merged = one(spark, pr.merge_nested(F.create_map(F.lit("p"), F.create_map(F.lit("a"), F.lit(1.0))),
                                        F.create_map(F.lit("p"), F.create_map(F.lit("b"), F.lit(4.0))), F.lit(3), F.lit(1)))
    assert merged == {"p": {"a": 0.75, "b": 1.0}}


def test_stop_words_are_those_of_spark(spark):
    assert fixed.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_split_keeps_the_share_of_every_class(spark):
    from scriptoria.operators import ml

    rows = spark.createDataFrame([(i, i % 400 == 0, None if i % 1000 == 7 else i % 3) for i in range(2000)], "id long, rare boolean, label int")
    for label in ("rare", "label"):
        for buckets in (1, 16, 4096):
            got = ml.split(rows, "id", label, buckets=buckets).groupBy(label).agg(
                F.count("*").alias("n"), F.count_if("is_train").alias("k")).collect()
            assert sum(r.n for r in got) == 2000 and all(r.k == int(0.8 * r.n + 0.5) for r in got)
    assert ml.split(rows.limit(0), "id", "label").columns == ["id", "rare", "label", "is_train"]
    sides = {tuple(sorted(r.id for r in ml.split(rows, "id", "label", buckets=b).filter("is_train").collect())) for b in (1, 64)}
    assert len(sides) == 1


def test_attestation_table_keeps_records_without_an_outcome(spark):
    from scriptoria.streaming import monitors

    pending = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:00'), (null, timestamp'2024-01-01 00:00:00') AS t(k, ts)")
    updates = spark.sql("""SELECT * FROM VALUES (1, timestamp'2024-01-01 00:10:00', 'CONFIRMED'), (1, timestamp'2024-01-01 00:05:00', 'PENDING'),
        (2, timestamp'2024-01-01 00:10:01', 'FAILED') AS t(k, updated_at, status)""")
    got = monitors.attestation_table(pending, updates, "k", "ts").collect()
    assert sorted((str(r.k), r.status) for r in got) == [("1", "CONFIRMED"), ("2", None), ("None", None)]


def test_compliance_report_counts_requests_consents_and_policies(spark):
    queue = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, overdue boolean")
    consents = spark.createDataFrame([("a", True, None), ("a", False, "2020"), (None, None, None)], "kind string, given boolean, withdrawn_at string")
    policies = spark.createDataFrame([(True,), (False,), (None,)], "is_active boolean")
    want = {("requests", "pending"): 3, ("requests", "overdue"): 1, ("policies", "active"): 1, ("consents", "a:total"): 2, ("consents", "a:given"): 1,
            ("consents", "a:withdrawn"): 1, ("consents", "total"): 1, ("consents", "given"): 0, ("consents", "withdrawn"): 0}
    assert {(r.section, r.name): r.value for r in co.compliance_report(queue, consents, policies, "kind").collect()} == want
    empty = co.compliance_report(queue.limit(0), consents.limit(0), policies.limit(0), "kind")
    assert {(r.section, r.name, r.value) for r in empty.collect()} == {("requests", "pending", 0), ("requests", "overdue", 0), ("policies", "active", 0)}
