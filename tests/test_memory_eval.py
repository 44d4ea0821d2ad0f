import datetime as dt
import statistics

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions import text as X
from tarnwell.functions import vector as V
from tarnwell.operators import align, evaluate, memory, metrics
from tarnwell.sources import files


def one(spark, col, text, typ="string"):
    return spark.createDataFrame([(text,)], f"t {typ}").select(col(F.col("t")).alias("x")).collect()[0].x


def test_terms_differ_as_stated(spark):
    t = "The Diabetes. of été, x1"
    assert one(spark, X.query_terms, t) == ["the", "diabetes"]
    assert one(spark, X.document_terms, t) == ["the", "diabetes.", "été,"]
    assert one(spark, X.rerank_terms, t) == ["the", "diabetes", "été"]
    assert one(spark, X.judge_terms, t) == ["the", "diabetes"]
    assert one(spark, X.word_set, " a  A b ") == ["a", "b"]
    assert one(spark, X.token_count, None) == 0 and one(spark, X.query_terms, None) == []


def test_text_functions(spark):
    assert one(spark, X.slug, " Héllo, World! ") == "h_llo_world"
    assert one(spark, X.without_citations, "a\n\n**Sources:** x\n\nSource: y") == "a\n\n**Sources:** x"
    assert one(spark, X.sub_questions, "What is asthma treatment today and how is gout treated at home?") == ["What is asthma treatment today?", "is gout treated at home?"]
    assert one(spark, X.sub_questions, "Short and sweet?") == ["Short and sweet?"]
    assert one(spark, X.is_excluded_heading, "References: all") and not one(spark, X.is_excluded_heading, "Referencing")
    facts = one(spark, X.extracted_facts, "I'm 42, allergic to nuts. I have asthma")
    assert [(f.key, f.value) for f in facts] == [("age", "42"), ("allergy", "nuts"), ("condition", "asthma")]
    assert one(spark, lambda c: X.json_object(c, "a int")["a"], 'noise {"a": 3} more') == 3
    assert one(spark, lambda c: X.json_object(c, "a int"), "none") is None
    assert one(spark, X.cross_references, "See Table 2.1 and chapter 3, table 2.1") == ["chapter_3", "table_2_1"]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("l"), V.cosine(F.col("a"), F.col("b"), strict=True).alias("s")).collect()
    assert got[0].s == 0.0 and got[1].l == 0.0 and got[2].l == 0.0 and got[3].l is None


def test_upserts(spark):
    old = spark.createDataFrame([("k", "old", 0.9), ("j", "x", 0.1)], "key string, v string, conf double")
    new = spark.createDataFrame([("k", "new", 0.5), ("j", "y", 0.1)], "key string, v string, conf double")
    assert {(r.key, r.v) for r in memory.upsert(old, new, ["key"]).collect()} == {("k", "new"), ("j", "y")}
    assert {(r.key, r.v) for r in memory.upsert(old, new, ["key"], F.desc("conf")).collect()} == {("k", "old"), ("j", "y")}
    assert one(spark, lambda c: memory.bounded_append(F.array(F.lit("a"), F.lit("b")), c, 2), "c") == ["b", "c"]
    assert one(spark, lambda c: memory.bounded_append(F.array(F.lit("a")), c, 0), "c") == []
    s = one(spark, memory.summary_fields, "Session goal: rest\nKey findings: a; b ;\nOpen questions:")
    assert (s.goal, s.findings, s.questions) == ("rest", ["a", "b"], [])


def test_ranking_metrics_by_hand(spark):
    ids = spark.createDataFrame([("q", ["a", "b"], ["c"], ["d"]), ("none", [], [], [])], "id string, required array<string>, supporting array<string>, negatives array<string>")
    ranked = spark.createDataFrame([("q", "x", "s", 1), ("q", "a", "s", 2), ("q", "c", "t", 3), ("q", "d", None, 4)], "id string, chunk_id string, section string, rank int")
    r = {x.id: x for x in evaluate.ranking_metrics(ranked, ids, 5).collect()}
    q = r["q"]
    assert (q.hit, q.recall, q.precision, q.max_precision, q.mrr, q.section_diversity) == (1.0, 0.5, 0.4, 0.6, 0.5, 0.4)
    assert abs(q.map - (1 / 2 + 2 / 3) / 2) < 1e-12 and 0 < q.ndcg < 1
    assert r["none"].ndcg == 0 and r["none"].hit == 0


def test_exclusive_p95_against_statistics(spark):
    values = [float((i * 37) % 101) for i in range(83)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 3.0), ("h", 1.0), ("h", None)], "k string, v double")
    got = {r.k: r.p95 for r in evaluate.exclusive_p95(df, "k", "v").collect()}
    assert abs(got["g"] - statistics.quantiles(values, n=20)[18]) < 1e-9 and got["h"] == 3.0


def test_near_duplicates_find_all(spark):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), " ".join(reversed(base)), " ".join([*base[:-1], "zz"]), " ".join([*base, "yy"]), "other words", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {i: set((t or "").split()) for i, t in enumerate(texts)}
    got = {r.id: (r.class_size, r.links) for r in evaluate.links_per_text(df).collect()}
    jac = lambda a, b: len(a & b) / len(a | b)
    for i in got:
        others = {frozenset(s) for j, s in sets.items() if s and s != sets[i] and jac(s, sets[i]) >= 0.92}
        assert got[i] == (sum(s == sets[i] for s in sets.values()), len(others))
    assert set(got) == {0, 1, 2, 3, 4}


def test_windows_and_alignment(spark):
    pages = spark.createDataFrame([(1, 1, "A", "alpha beta"), (1, 2, None, "gamma"), (1, 3, "B", "delta"), (1, 4, "B", ""), (1, 5, "B", "eps")], "doc_id long, page int, title string, body string")
    w = align.windows(pages).orderBy("window").collect()
    assert [(x.title, x.page_start, x.page_end) for x in w] == [("A", 1, 2), ("B", 3, 3), ("B", 5, 5)]
    chunks = spark.createDataFrame([(1, 2, "c2", "gamma alpha", "s"), (1, 3, "c3", "none", "s"), (1, 9, "c9", "x", "s")], "doc_id long, page int, chunk_id string, content string, section string")
    got = {(r.window, r.chunk_id): r.score for r in align.aligned(align.windows(pages), chunks).collect()}
    assert got[(1, "c2")] == 7 and got[(1, "c3")] == 2 and (1, "c9") not in got


def test_sampling_is_stable_and_nested(spark):
    df = spark.range(2000)
    a, b = ({r.id for r in metrics.sampled(df, F.col("id"), x).collect()} for x in (0.1, 0.4))
    assert a < b and 100 < len(a) < 300 and metrics.sampled(df, F.col("id"), 1.0).count() == 2000


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())])).collect()
    assert sorted((r.a or 0, r._corrupt_record is not None) for r in rows) == [(0, True), (1, False), (2, False)]
    p = files.pages_of(spark.createDataFrame([(1, "a\fb")], "doc_id long, text string")).collect()
    assert [(r.page, r.text) for r in p] == [(1, "a"), (2, "b")]
    run = spark.createDataFrame([("r1", dt.datetime(2024, 1, 1))], "run_id string, created_at timestamp")
    m = spark.createDataFrame([("r1", "ndcg", 0.5), ("lost", "ndcg", 0.1)], "run_id string, metric_name string, metric_value double")
    files.record_run(run, m, m, str(tmp_path))
    assert [r.run_id for r in files.recorded(spark, str(tmp_path), "eval_run_metrics").collect()] == ["r1"]


def test_alignment_prefers_chunks_under_the_headings_of_the_window(spark):
    pages = spark.createDataFrame([(1, 1, "Gout", "alpha beta", ["First Aid", "?"]), (1, 2, "Rash", "gamma", [])], "doc_id long, page int, title string, body string, headings array<string>")
    rows = [(1, 2, f"a{i}", "none", f"other {i}") for i in range(9)] + [(1, 2, "z1", "none", "First-Aid "), (1, 1, "z2", "none", "first aid!"), (1, 2, "z3", "none", None), (1, 2, "z4", "none", "??"), (1, 1, "z5", "none", "?")]
    chunks = spark.createDataFrame(rows, "doc_id long, page int, chunk_id string, content string, section string")
    got = {r.chunk_id: (r.score, r["rank"]) for r in align.aligned(align.windows(pages), chunks).where("window = 1").collect()}
    assert len(got) == 8 and got["z2"] == (9, 1) and got["z5"] == (6, 2) and got["z1"] == (5, 3) and got["a0"] == (2, 4)
