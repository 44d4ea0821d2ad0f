"""Operators whose results no SQL states: brute force, round trips and cases by hand."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell import engine
from tarnwell.functions import articles as A
from tarnwell.functions import text as X
from tarnwell.operators import chunking, context, evaluate, memory, metrics, search
from tarnwell.sources import files
from tarnwell.streaming import live


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"t {typ}").select(col(F.col("t")).alias("x")).collect()[0].x


def test_greedy_acceptance_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(16)]
    text = lambda: " ".join(rng.sample(words, 13)) if rng.random() < 0.9 else rng.choice(["", None, "lone"])
    new, old = [(f"{i:03d}", text()) for i in range(60)], [(text(),) for _ in range(4)]
    sets = lambda t: frozenset((t or "").lower().split())
    kept, texts = [], [sets(t) for (t,) in old]
    for i, t in new:
        s = sets(t)
        if not any(s and x and len(s & x) / len(s | x) >= 0.7 for x in texts):
            kept.append(i)
            texts.append(s)
    got = evaluate.accepted(spark.createDataFrame(new, "id string, text string"), spark.createDataFrame(old, "text string"), 0.7)
    assert sorted(r.id for r in got.collect()) == kept and 3 < len(kept) < 60
    assert evaluate.accepted(spark.createDataFrame([], "id string, text string"), spark.createDataFrame(old, "text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 5000])
def test_order_statistics_are_exact(spark, n):
    rng = random.Random(n)
    rows = [("a", float(rng.choice([1, 1, 1, rng.randint(0, 10**6)]))) for _ in range(n)] + [("a", None), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = sorted(v for g, v in rows if g == "a" and v is not None)
    ranks = {"least": F.lit(1), "mid": F.ceil(F.col("n") / 2), "most": F.col("n"), "p95": F.ceil(F.lit(0.95) * F.col("n"))}
    r = {x.g: x for x in metrics.order_statistics(df, "g", "v", ranks).collect()}
    assert r["b"].mid == 5.0 and (r["a"].least, r["a"].most, r["a"].mid) == (want[0], want[-1], want[-(-n // 2) - 1]) and r["a"].p95 == want[-(-95 * n // 100) - 1]


def test_packing_splits_at_the_coarsest_boundary():
    part = "\n\n### Head\n" + "a b c. " * 60
    assert [x.split("\n")[0] for x in chunking.split_long(part * 3, 200)] == ["### Head"] * 3
    assert chunking.split_long("x " * 30 + "\n" + "y " * 30, 40) == [("x " * 30).strip(), ("y " * 30).strip()]
    assert chunking.split_long("One two three. Four five six. Seven.", 4) == ["One two three.", "Four five six. Seven."]
    assert chunking.split_long("a b\nc", 5) == ["a b\nc"] and [len(x.split()) for x in chunking.split_long("z " * 25, 10)] == [10, 10, 5]
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["w ", "w. ", "w\n", "w\n\n", "w\n\n### "]) for _ in range(200))
        pieces = chunking.split_long(text, 17)
        assert " ".join(pieces).split() == text.split() and all(len(p.split()) <= 17 for p in pieces)
    out = chunking.pack([("a " * 90, 1), ("b " * 5, 2), ("c " * 300, 3), ("d " * 90, 4)], 100, 10)
    assert [(len(t.split()), f, last) for t, f, last in out] == [(95, 1, 2), (100, 3, 3), (100, 3, 3), (100, 3, 3), (90, 4, 4)]


def test_table_rules():
    assert chunking.table_rows("| a |\n| b |") == ([], []) and chunking.table_rows("|---|\n| a |") == ([], [])
    assert chunking.table_rows("| a | b |\n|---|---|\n| 1 |\n| 1 | 2 | 3 |") == (["a", "b"], [["1", ""], ["1", "2"]])
    md = chunking.html_to_markdown("<table><tr><th>a</th></tr><tr><td>x|y</td></tr></table>")
    assert chunking.table_rows(md) == (["a"], [["x\\|y"]])
    assert chunking.table_payload("| a |\n|---|", "<b>", "raw")[2:] == ("good", "markdown")
    shown, embedded, *rest = chunking.table_payload("| a |", "<table><tr><td>1</td></tr></table>", "raw", "Doses", "of x")
    assert shown.startswith("<table>") and embedded.startswith("Doses | of x\n| 1 |") and rest == ["good", "html"]
    assert chunking.table_payload(None, "", None) == ("[Empty table]", "[Empty table]", "degraded", "text")


def test_article_lines(spark):
    page = "12\nASTHMA\nDefinition\nAsthma  is a\n disease.\nTreatment\nRest.\n\fBOOKS\nSome book\nGALE ENCYCLOPEDIA OF MEDICINE 2\nAtaxia"
    lines = one(spark, A.clean_lines, page)
    assert lines == ["12", "ASTHMA", "Definition", "Asthma is a", "disease.", "Treatment", "Rest.", "BOOKS", "Some book", "GALE ENCYCLOPEDIA OF MEDICINE 2", "Ataxia"]
    f = lambda g: one(spark, g, lines, "array<string>")
    assert f(A.start_title) == "ASTHMA" and f(A.footer_title) == "Ataxia" and f(A.headings) == ["Definition", "Treatment"]
    assert f(lambda c: A.body_text(c, F.lit("ASTHMA"))) == "Asthma is a\ndisease.\nRest."
    assert f(lambda c: A.body_text(c, F.lit("Asthma is a"), after_title=True)) == "disease.\nRest."
    assert one(spark, A.clean_lines, None) == [] and one(spark, A.start_title, [], "array<string>") is None and one(spark, A.footer_title, ["x"], "array<string>") is None
    titles = {t: one(spark, A.is_title, t) for t in ("ASTHMA", "Heart attack", "a small thing", "It ends.", "x" * 91, "12", "Diagnosis", "ÉTÉ 2")}
    assert [k for k, v in titles.items() if v] == ["ASTHMA", "Heart attack", "ÉTÉ 2"]


def test_replies_of_judges(spark):
    j = one(spark, X.judgement, '```{"has_hallucinations": "TRUE", "confidence": 7, "grounding_score": "x"} ```')
    assert (j.failure_category, j.confidence, j.grounding_score, j.suggested_focus) == ("hallucination", 1.0, 1.0, "")
    assert one(spark, X.judgement, "no json").failure_category == "none" and one(spark, X.judgement, None).confidence == 0.0
    arr = lambda t: [x.q for x in one(spark, lambda c: X.json_array(c, "struct<q:string>"), t)]
    assert arr('```json\n[{"q": "a"}]\n```') == ["a"] and arr('see [{"q": "b"}] there') == ["b"] and arr('{"q": "c"}') == ["c"] and arr("none") == [] and arr(None) == []
    p = spark.createDataFrame([(1, "gout pain", "gout pain", ["gout", None]), (2, "a1b", "zzz", []), (3, None, None, None), (4, "gout pain", "gout", ["gout"])], "id long, question string, answer string, contexts array<string>")
    reply = lambda df: df.select("id", F.when(F.col("id") == 4, '{"answer_relevance": 2, "groundedness": "0.5", "context_precision": 0, "context_coverage": 1}').otherwise('{"groundedness": 1}').alias("reply"))
    got = {r.id: r for r in evaluate.judged(p, reply).collect()}
    assert got[1].answer_relevance == 1.0 and got[1].context_precision == 0.5 and got[2].groundedness == got[3].context_coverage == 0.0
    assert (got[4].answer_relevance, got[4].groundedness, got[4].context_precision) == (1.0, 0.5, 0.0)


def test_match_score(spark):
    s = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(evaluate.match_score(F.col("a"), F.col("b")).alias("x")).first().x
    assert s("Take 5 mg, daily!", "5 MG daily") == 1.0 and s(None, "a") == 0.0 and s("!", "a") == 0.0 and s("a b c d", "b a x") == pytest.approx(2 / 3)
    assert s("¡Dolor de estómago!", "estómago") == 1.0 and s("боль", "гриппe") == 0.0 and s("été", "ete x") == 0.0


def test_budgets_and_blocks(spark):
    p = spark.createDataFrame([(1, 1, None, "A", "sum", None, " x "), (1, 2, None, "B", None, "parent", "y"), (1, 3, "A", "Z", None, None, "z"), (2, 1, None, None, None, None, None)], "qid long, place int, context_key string, header string, summary string, parent string, content string")
    got = {(r.qid, r.block): r.text for r in context.blocks(p).collect()}
    assert got[1, 1] == "### A\n\n[Context: sum]\n<chunk>\nx\n</chunk>\n\n<chunk>\nz\n</chunk>" and got[1, 2] == "### B\n\n<chunk>\nparent\n</chunk>" and got[2, 1].startswith("### Retrieved evidence")
    t = spark.createDataFrame([(1, i, "w " * n) for i, n in enumerate([3, 9, 1])], "qid long, block int, text string")
    assert [r.block for r in context.within_tokens(t, 10, 2).collect()] == [0]
    assert context.within_tokens(t.limit(0)).count() == context.snippets(spark.createDataFrame([], "qid long, rank int, section string, content string")).count() == 0


def test_summaries_round_trip(spark):
    df = spark.createDataFrame([(["a", " "], ["x"], None)], "c array<string>, d array<string>, f array<string>")
    t = df.select(memory.summary_text(F.lit("rest"), {"conditions": F.col("c"), "drugs": F.col("d")}, F.col("f"), F.lit(None).cast("array<string>"), F.lit("on")).alias("t")).first().t
    assert t == "Session goal: rest\nMedical context: conditions: a; drugs: x\nTrajectory: on"
    assert one(spark, memory.summary_context, t) == {"conditions": ["a"], "drugs": ["x"]} and one(spark, memory.summary_context, "none") == {}


def test_files(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("q", T.StringType())])
    rows = [{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]
    (tmp_path / "a.json").write_text("[" + ",\n".join(map(json.dumps, rows)) + "]")
    (tmp_path / "b.json").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    for name in ("a.json", "b.json"):
        assert [tuple(r) for r in files.json_cases(spark, str(tmp_path / name), schema).collect()] == [(1, "a"), (2, "b")]
    assert files.json_cases(spark, None, schema, [(9, "z")]).first().id == 9
    (tmp_path / "s.json").write_text(json.dumps({"x": [{"query": "q", "embedding": [1.0, 2.0]}, {"query": "r", "embedding": []}], "y": []}))
    assert [(r.label, r.query, r.embedding) for r in files.seeds(spark, str(tmp_path / "s.json")).collect()] == [("x", "q", [1.0, 2.0])]
    chunk = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("section", T.StringType()), T.StructField("page", T.StringType()), T.StructField("metadata", T.StructType([T.StructField("section", T.StringType())]))])
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "page": "3", "metadata": {"section": "S"}}\nnot json\n{"chunk_id": "b", "section": "T"}\n{"chunk_id": "b", "section": "U"}\n')
    assert sorted((r.chunk_id, r.section, r.page) for r in files.chunk_fixture(spark, str(tmp_path / "c.jsonl"), chunk).collect()) == [("a", "S", 3), ("b", "U", None)]
    bad = files.json_lines(spark, str(tmp_path / "c.jsonl"), chunk).where("_corrupt_record is not null").collect()
    assert [r._corrupt_record for r in bad] == ["not json"]
    d = str(tmp_path / "snap")
    files.save_snapshot(spark.createDataFrame([(1,)], "m int"), d, "base")
    assert files.load_snapshot(spark, d, "base", "pipeline").first().m == 1 and files.load_snapshot(spark, d, "other") is None
    files.save_snapshot(spark.createDataFrame([(2,)], "m int"), d, "base", "pipeline")
    assert files.load_snapshot(spark, d, "base", "pipeline").first().m == 2
    h = {r.path.rsplit("/", 1)[-1]: r.digest for r in files.file_hashes(spark, [str(tmp_path / "a.json"), str(tmp_path / "no")]).collect()}
    assert len(h["a.json"]) == 64 and h["no"] == "missing"
    w = spark.createDataFrame([("d", 1, "T", 1, 2, "b" * 500)], "doc_id string, window int, title string, page_start int, page_end int, body string")
    a = spark.createDataFrame([("d", 1, "c2", 2), ("d", 1, "c1", 1)], "doc_id string, window int, chunk_id string, rank int")
    files.authoring_index(w, a, str(tmp_path / "ix"))
    r = spark.read.json(str(tmp_path / "ix")).first()
    assert len(r.body_preview) == 400 and r.chunk_ids == ["c1", "c2"]
    files.append_json(spark.createDataFrame([(1,)], "m int"), str(tmp_path / "app"))
    files.append_json(spark.createDataFrame([(2,)], "m int"), str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 2
    v = spark.createDataFrame([(0, "x"), (1, None)], "position int, chunk_id string")
    e = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "position int, embedding array<double>")
    assert sorted(r.chunk_id for r in files.index_batch(v, e).collect()) == ["chunk-1", "x"]
    with pytest.raises(ValueError):
        files.index_batch(v, e.limit(1))
    pages = files.pages_of(spark.createDataFrame([("d", "a\fb")], "doc_id string, text string"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "a"), (2, "b")]


def test_engine(spark):
    m = spark.createDataFrame([("s", 1, "user", "hello"), ("s", 2, "assistant", "hi"), ("t", 3, "user", "x")], "session_id string, id long, role string, content string").withColumn("created_at", F.timestamp_seconds("id"))
    s = m.select("session_id", "created_at", F.col("created_at").alias("last_active")).dropDuplicates(["session_id"])
    c = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.0, 1.0])], "id long, content string, embedding array<float>")
    e = engine.Engine(spark, {"messages": m, "sessions": s, "document_chunks": c, "long_term": m}, embed=lambda t: pd.Series([[1.0, 0.0] if "apple" in x else [0.0, 1.0] for x in t]))
    assert [r.id for r in e.history("s").collect()] == [1, 2] and [r.session_id for r in e.sessions().collect()] == ["t", "s"]
    less = e.delete(spark.createDataFrame([("s",)], "session_id string"))
    assert [r.session_id for r in less.sessions().collect()] == ["t"] and less.tables["long_term"].count() == 3 and less.history("s").count() == 0
    q = spark.createDataFrame([(-1, "apple")], "qid long, text string")
    assert e.search(q, 1, 2).first().id == 1
    with pytest.raises(ValueError):
        engine.Engine(spark).embedded(q)
    engine.register(spark)
    assert [(r.chunk_index, r.content) for r in spark.sql("select * from chunk_text('a b\n\nc')").collect()] == [(0, "a b\n\nc")]


def test_streams_of_facts_and_cursor(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("s", 1, "age", "40"), ("s", 2, "allergy", "nuts"), ("s", 3, "Allergy ", "nuts"), ("s", 4, "age", "41"), ("s", 5, "condition", " "), ("s", 6, None, "x")]
    kinds = "session_id string, id long, key string, value string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(src)
    q = live.core_states(spark.readStream.schema(kinds).parquet(src)).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("states").collect()
    assert [(r.session_id, r.age, r.allergies, r.conditions) for r in got] == [("s", "41", ["nuts"], [])]
    out = str(tmp_path / "out")
    for n in range(2):
        if n:
            spark.createDataFrame([("t", 9, "age", "1")], kinds).coalesce(1).write.mode("append").parquet(src)
        live.to_table(spark.readStream.schema(kinds).parquet(src), out, str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert live.since(spark, out, -1).count() == 7 and [r.session_id for r in live.since(spark, out, 0).collect()] == ["t"]
    assert live.ring(spark.createDataFrame(rows, kinds), "session_id", 2, F.desc("id")).count() == 2


def test_numbering_and_windows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = evaluate.numbered(df, "k").collect()
    assert len(got) == 1000 and all(r.place == r.k + 1 for r in got)
    ids = evaluate.next_ids(spark.createDataFrame([("b",), ("a",)], "x string"), spark.createDataFrame([("T-0007",), ("U-9",), (None,)], "id string"), "T-", "x")
    assert sorted((r.x, r.new_id) for r in ids.collect()) == [("a", "T-0008"), ("b", "T-0009")]
    w = spark.createDataFrame([("d", 1, 1, 2, ["c9"]), ("d", 2, 1, 2, []), ("d", 3, None, None, None), ("d", 4, 1, 1, ["no"])], "doc_id string, window int, page_start int, page_end int, chunk_ids array<string>")
    c = spark.createDataFrame([("d", "c1", 1), ("d", "c2", 2), ("d", "c9", 9)], "doc_id string, chunk_id string, page int")
    out = {}
    for r in search.candidates_by_window(w, c).collect():
        out.setdefault(r.window, set()).add((r.chunk_id, r.aligned))
    assert out == {1: {("c9", True)}, 2: {("c1", False), ("c2", False)}, 3: {("c1", False), ("c2", False), ("c9", False)}, 4: {("c1", False)}}


def test_histogram_quantile(spark):
    b = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 10), ("a", float("inf"), 10), ("b", 1.0, 0), ("b", float("inf"), 4), ("c", 1.0, 0)], "label string, le double, count long")
    assert {r.label: r.quantile for r in metrics.histogram_quantile(b, 0.6).collect()} == {"a": 1.5, "b": 1.0, "c": None}
