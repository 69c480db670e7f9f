"""Golden rows and properties of the corpus operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import jsonfix
from sparkloom.functions import text as T
from sparkloom.operators import agreement, dedup, enrich, incremental, kg, medical, metrics, quality, sampling
from sparkloom.sources import readers, writers
from sparkloom.streaming import continuous


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(col.alias("x")).first()["x"]


Q = "What is the best treatment for a high fever in adults?"
A = "Rest and drink water often. See a doctor if the fever stays above 39 degrees for three days or more."


@pytest.mark.parametrize(
    ("q", "a", "lang", "want"),
    [
        ("x" * 39, A, "en", "q_len=39"), (Q, "x" * 79, "en", "a_len=79"), (Q, "As an AI model I will not say. " + A, "en", "refusal_boilerplate"),
        ("Tell me about the treatment for fever in adults now.", A, "en", "not_a_question"), (Q, "y" * 159, "en", "answer_too_thin"), (Q, "fever " + "y" * 154, "en", "ok"),
        (Q, A, "ar", "arabic_ratio_low"), ("ما هو العلاج الأفضل للحمى عند الكبار في المنزل", A, "ar", "ok"), (Q, A, "es", "ok"), (None, A, "en", "q_len=0"),
        ("What is the best way to go from here to there today?", "Take the road. " + "z" * 90, "en", "no_medical_term"),
    ],
)
def test_reasons(spark, q, a, lang, want):
    assert one(spark, quality.reason(), question=q, answer=a, language=lang) == want


def test_text(spark):
    x = F.col("x")
    cases = [
        (T.dosages(x), "5 gouttes", ["5 g"]), (T.answer_dosages(x), "5 gélules", ["5 gélules"]), (T.looks_like_question(x), "أهو؟", True), (T.arabic_ratio(x), "123", 0.0),
        (T.shingles(x), "a b", ["a b"]), (T.shingles(x, 2), "a b a b", ["a b", "b a"]), (T.shingles(x), "", [""]), (T.extract_answer(x), "<answer> x\n</answer>", "x"),
        (T.format_reward(x), "<answer>x</answer>", 0.5), (T.shorten(x, 3), " a\nbcd ", "a b..."), (T.chunks(x, 7), "Aa. Bb. Cccccccccc. D.", ["Aa. Bb.", "Cccccccccc.", "D."]),
        (T.chunks(x, 4, hard=True), "abcdefghij.", ["abcd", "efgh", "ij."]), (T.strip_opener(x), "Hello, welcome to iCliniq. I see", "I see"), (T.sentence_count(x), "A. B! ", 2),
        (T.backoff(F.lit("auth"), F.lit(1)), "", 90.0), (medical.pathology(x), "migraine stroke", "neurological"), (medical.pathology(x), "zz", "other"),
        (T.provider_chain(x), "a:b, c:d:e,x", [("a", "b"), ("c", "d:e")]),
    ]
    for col, value, want in cases:
        got = one(spark, col, x=value)
        assert ([tuple(g) if not isinstance(g, str) else g for g in got] if isinstance(got, list) else got) == want


def test_diagnoses(spark):
    hit = lambda p, r: one(spark, medical.hit_at_k("p", "r"), p=p, r=r)
    assert hit("Possible: 1. Asthma 2. Bronchitis 3. Pneumonia", "pneumonia") == 0
    assert hit("Diagnosis: 1. Asthma 2. Pneumonia", "pneumonia") == 1 and hit("flu or angina", "angina") == 1 and hit("", "x") is None


def test_entities(spark):
    df = spark.createDataFrame([("fever and 5 mg of doliprane", "nothing here")], "p string, r string").withColumns({"pe": medical.entities("p", ["Doliprane"]), "re": medical.entities("r")})
    row = df.select(medical.recall("pe", "re").alias("a"), medical.hallucination("pe", "re").alias("b"), medical.recall("re", "pe").alias("c"), "pe").first()
    assert row.a.macro == 0.0 and row.a.drugs is None and row.b.macro == 0.75 and row.c.macro == 0.0 and row.pe.drugs == ["doliprane"] and row.pe.dosages == ["5 mg"]


def test_kappa(spark):
    rows = [(r, i, "c", v) for r, vs in {"a": [1, 1, 0, 1], "b": [1, 0, 0, 1], "d": [1, 1, 1, 1], "e": [1, 1, 1, 1], "f": [1, None, None, None]}.items() for i, v in enumerate(vs)]
    got = {(r.rater_a, r.rater_b): r.kappa for r in agreement.pairwise(spark.createDataFrame(rows, "rater string, pair_id int, criterion string, value int")).collect()}
    assert got["a", "b"] == pytest.approx(0.5) and got["d", "e"] == 1.0 and ("a", "f") not in got


@pytest.mark.parametrize(("n", "real", "made", "want"), [(25, 3, 10, (3, 10)), (4, 10, 1, (3, 1)), (10, 20, 20, (5, 5))])
def test_half_real(spark, n, real, made, want):
    df = spark.createDataFrame([("s", i, i < real) for i in range(real + made)], "spec string, id int, real boolean")
    got = sampling.half_real(df, "spec", F.col("real"), "id", n).groupBy("real").count().collect()
    assert {r.real: r["count"] for r in got} == {True: want[0], False: want[1]}


def test_splits(spark):
    for n, sizes in ((12, (10, 1, 1)), (50, (40, 5, 5))):
        got = {r.split: r["count"] for r in sampling.three_way(spark.range(n), "id", n).groupBy("split").count().collect()}
        assert (got["train"], got["validation"], got["test"]) == sizes
    assert sampling.hold_out_size(10) == 50 and sampling.hold_out_size(10**6) == 1000
    assert sampling.hold_out(spark.range(200), "id", 200).where("held_out").count() == 50


def test_strata(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", ("en", "fr")[i % 2]) for i in range(300)], "id int, spec string, lang string")
    got = sampling.strata(df, "spec", ["spec", "lang"], "id", 60, 50)
    assert got.count() <= 50 and sampling.strata(df, "spec", ["spec"], "id", 60, 500).count() == 180


def test_dedup(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(["a b c d e f g h i", "A b c d e f g h i", "a b c d e f g h j", "zz"])], "spec string, id int, q string")
    assert [r.id for r in dedup.greedy(df, "spec", "id", "q").orderBy("id").collect()] == [0, 2, 3]
    assert [r.id for r in dedup.first_wins(df, T.prefix_key("q"), ["id"]).orderBy("id").collect()] == [0, 2, 3]
    assert [(r.left_id, r.right_id) for r in dedup.shingle_pairs(df, "spec", "id", "q").collect()] == [(0, 1)]
    again = dedup.greedy(dedup.greedy(df, "spec", "id", "q"), "spec", "id", "q")
    assert again.count() == 3


def test_increments(spark):
    df = spark.createDataFrame([(i, f"q{i % 4}", "s") for i in range(8)], "id int, q string, spec string")
    left = incremental.remaining(df, df.where("id = 0"), F.col("q"), F.col("q"))
    assert left.count() == 6 and incremental.remaining(left, left, F.col("q"), F.col("q")).count() == 0
    assert [r.batch for r in incremental.batches(df, "spec", "id", 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    x = spark.createDataFrame([(["a", "b"], ["x"]), (["a"], ["x", "y"])], "b array<string>, r array<string>").select(incremental.zip_block(F.col("b"), F.col("r"))).collect()
    assert x[0].item is None and len(x[1].item) == 1
    assert incremental.head(df, "spec", "id", 0).count() == 8
    done, todo = incremental.split_done(df.withColumn("d", F.when(F.col("id") > 5, "x")), "d")
    assert (done.count(), todo.count()) == (2, 6)


def test_graph(spark, tmp_path):
    text = "intro\nPARACETAMOL\n500 mg, voie orale. Indication: fièvre\nINDEX\nmore of it: diabète\nPARACETAMOL\n500 mg\nASPIRINE\nne pas utiliser en cas de goutte"
    pages = spark.createDataFrame([("p", text)], "file_name string, value string")
    blocks = kg.segments(pages)
    assert [(r.drug, "INDEX" in r.block) for r in blocks.orderBy("ord").collect()] == [("PARACETAMOL", True), ("PARACETAMOL", False), ("ASPIRINE", False)]
    found = kg.emissions(blocks)
    counts = {r.relation: (r.emitted, r.distinct_edges) for r in kg.edge_counts(found).collect()}
    assert counts["has_dosage"] == (2, 1) and counts["treats"] == (1, 1) and counts["contraindication"] == (1, 1)
    nodes, edges = kg.nodes(blocks, found), kg.edges(found)
    assert {r.drug for r in kg.drug_vocabulary(nodes).collect()} == {"paracetamol", "aspirine"}
    assert kg.graphml(nodes, edges).count() == kg.node_link_json(nodes, edges).count() == nodes.count() + edges.count()


@pytest.mark.parametrize(
    ("raw", "want"),
    [('```json\n{"think":"x",}\n```', ("x", "")), ('{"think":"abc', ("abc", "")), ('{"foo":"bar"}', (None, "empty_think")), ("hello", (None, "json_parse_failed")), ("{'think': 'y'}", ("y", "")), (None, (None, "json_parse_failed")), ('so: {"reasoning": "r", "a": [1, 2', ("r", ""))],
)
def test_think(raw, want):
    assert jsonfix.extract_think(raw) == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.integers() | st.text(max_size=8) | st.lists(st.booleans(), max_size=3), max_size=4))
def test_json_round_trip(d):
    assert jsonfix.loads_robust(json.dumps(d)) == d
    assert jsonfix.loads_robust("```json\n" + json.dumps(d) + "\n```") == d


def test_arrays():
    assert jsonfix.parse_array('{"translations": [{"a": 1}]}') == [{"a": 1}] and jsonfix.parse_array('{"a": 1}') == [{"a": 1}]
    assert jsonfix.parse_array('x [{"a": 1,}, {"b": 2}, {"c": ') == [{"a": 1}, {"b": 2}] and jsonfix.parse_array("none") is None


def test_metrics():
    assert metrics.bleu4("a b c d e", "a b c d e") == pytest.approx(1.0) and metrics.bleu4("", "a") == 0 == metrics.gleu("x", "y")
    assert metrics.rouge_l("the cat sat", "the cat") == pytest.approx(0.8) and metrics.rouge_n("cats", "cat", 1) == 1.0
    assert 0 < metrics.meteor("a c b", "a b c") < metrics.meteor("a b c", "a b c") <= 1


def test_enrichment(spark):
    df = spark.createDataFrame([(1, "the x"), (2, "y"), (3, None)], "id int, t string")
    tries = enrich.attempts(df, "id", "t", [lambda: enrich.Echo("one", "1:", fail="the"), lambda: enrich.Echo("two", "2:")])
    assert {r.request_id: r.content for r in enrich.first_success(tries).collect()} == {1: "2:the x", 2: "1:y", 3: "1:"}
    waits = []
    limit = enrich.Limiter(60, clock=lambda: 0.0, sleep=waits.append)
    for _ in range(3):
        limit.wait()
    assert waits == [1.0, 2.0]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/cardio.json").write_text('[{"question": "a", "answer": "b"}, {"question": "c"}]')
    (tmp_path / "in/_meta.json").write_text("[]")
    (tmp_path / "in/broken.json").write_text("[{")
    assert [(r.specialty_id, r.question) for r in readers.json_arrays(spark, str(tmp_path / "in")).orderBy("question").collect()] == [("cardio", "a"), ("cardio", "c")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.json").write_text('{"pairs": [{"question": "a"}]}')
    (tmp_path / "w/y.json").write_text('[{"question": "b"}]')
    assert sorted(r.question for r in readers.wrapped_arrays(spark, str(tmp_path / "w")).collect()) == ["a", "b"]
    (tmp_path / "r.csv").write_text("﻿pair_id,C1_plausibility,C2,C3,C4,comment\np,1,0, ,x,hi\np,0,1,1,1,bye\n,1,1,1,1,no\n")
    assert [(r.rater, r.pair_id, r.c1, r.comment) for r in readers.annotations(spark, str(tmp_path / "r.csv")).collect()] == [("r", "p", 0, "bye")]
    assert readers.previous(spark, str(tmp_path / "none"), "a string").count() == 0
    writers.packet(spark.createDataFrame([("p", "q")], "pair_id string, question string"), str(tmp_path / "out"), ["pair_id", "question"])
    assert next((tmp_path / "out").glob("part-*")).read_text().startswith("﻿pair_id,question,C1_plausibility")
    writers.markdown(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "md"), "Report")
    assert next((tmp_path / "md").glob("part-*")).read_text().splitlines()[0] == "# Report"


def test_stream(spark, tmp_path):
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    for rows in ([(1, "a"), (2, "bad"), (1, "a")], [(1, "again"), (3, "c")]):
        spark.createDataFrame(rows, "id int, t string").coalesce(1).write.mode("append").parquet(src)
        continuous.resume(spark, src, "id int, t string", sink, str(tmp_path / "cp"), "id", lambda d: d.withColumn("u", F.upper("t")), F.col("t") != "bad").awaitTermination()
    assert sorted((r.id, r.u) for r in spark.read.parquet(sink + "/accepted").collect()) == [(1, "A"), (3, "C")]
    assert [r.id for r in spark.read.parquet(sink + "/rejected").collect()] == [2]


def test_plans(spark):
    from sparkloom.plans import catalog

    for name in ("qc_reason_histogram", "recall_hallu", "kg_edges", "resume_anti_prefix"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan


def test_made_pair_lengths(spark):
    rows = [("q" * 40, "a" * 80), ("q" * 39, "a" * 80), ("q" * 40, "a" * 79), (" " + "q" * 39 + " ", "a" * 80), (None, "a" * 80), ("", "")]
    df = spark.createDataFrame(rows, "question string, answer string")
    assert [r.ok for r in df.select(quality.valid_made("question", "answer").alias("ok")).collect()] == [True, False, False, False, False, False]


def test_greedy_is_one_pass_over_batches(spark):
    """Groups that span Arrow batches, null and empty texts, ties and a null group against a plain pass."""
    rows = [(s, i, None if i % 11 == 0 else "" if i % 13 == 0 else " ".join(f"w{(i * 7 + j) % (9 + i % 5)}" for j in range(12))) for i in range(90) for s in ("a", "b", None)]
    df = spark.createDataFrame([(s, k, t) for k, (s, _, t) in enumerate(rows)], "spec string, id long, q string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(r.id for r in dedup.greedy(df, "spec", "id", "q", memory=4).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for g in ("a", "b", None):
        last = []
        for k, (s, _, t) in enumerate(rows):
            if s == g:
                w = (t or "").lower().split()
                x = {" ".join(w[i : i + 8]) for i in range(max(len(w) - 7, 1))}
                if not any(len(x & y) >= 0.9 * len(x | y) for y in last[-4:]):
                    last.append(x)
                    want.append(k)
    assert got == sorted(want)
    assert dedup.greedy(df.limit(0), "spec", "id", "q").count() == 0


def test_letter_shares_and_terms(spark):
    texts = ["aé1 Zß", "سلام abc ١٢", "", None, "12 ?!", "𝒜x", "Side Effect"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    r = df.select("id", T.ascii_ratio("t").alias("a"), T.arabic_ratio("t").alias("b"), T.contains_any("t", ["zß", "side effect", "a.c"]).alias("c"), T.groups_in("t", {"x": ["effect"], "y": ["سلام"]}).alias("g")).orderBy("id").collect()
    assert [x.a for x in r] == [0.5, 3 / 7, 0, 0, 0, 0.5, 1]
    assert [x.b for x in r] == [0, 4 / 7, 0, 0, 0, 0, 0]
    assert [x.c for x in r] == [True, False, False, False, False, False, True]
    assert [x.g for x in r] == [[], ["y"], [], [], [], [], ["x"]]
