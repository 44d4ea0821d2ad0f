from tarnwell.llm import overlap

SCHEMA = "id string, question string, ground_truth string, split string, provenance struct<source_type:string>, words string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, q, g, s, ("human_seed",), "x", "y") for i, q, g, s in rows], SCHEMA)


def test_pairs(spark):
    rows = [
        ("t1", "is aspirin the right medicine for gout at the age of 49?", "aspirin gout", "train"),
        ("t2", "Is aspirin the right medicine for gout at the age of 49?", None, " TRAIN "),
        ("e1", "HELP is aspirin the right medication 4 gout at the age of forty-nine??! thanks", "aspirin", "test"),
        ("e2", "is aspirin the right medicine for gout at the age of 48?", "aspirin", "dev"),
        ("e3", "is aspirin the right medicine for asthma at the age of 49?", "asthma", "dev"),
        ("e4", "is aspirol the right medicine for gout at the age of 49?", "aspirol aspirol", "dev"),
        ("e5", "is ａｓｐｉｒｉｎ the ri​ght medicine for gout at the age of 49", "x", "Dev "),
        ("n1", "is aspirin the right medicine for gout at the age of 49?", "x", None),
        ("n2", None, "x", "test"), ("n3", "", "x", "test"), ("n4", "???", "x", "train"),
    ] + [(f"f{i}", f"is aspirol the right medicine for asthma at the age of {i}?", "aspirol asthma gout", "train") for i in range(10, 20)]
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(table(spark, rows)).collect()}
    assert got == {("e1", "t1"), ("e1", "t2"), ("e5", "t1"), ("e5", "t2")}
    report = {(r.split, r.source_type): (r.records, r.overlapping) for r in overlap.overlap_report(table(spark, rows), overlap.cross_split_pairs(table(spark, rows))).collect()}
    assert report == {("test", "human_seed"): (3, 1), ("dev", "human_seed"): (4, 1)}


def test_lone_digits_are_words_only_away_from_ages():
    assert overlap.respelled("safe 2 take 4 gout at 4 or aged 2") == "safe to take for gout at 4 or aged 2".split()
    assert overlap.respelled("a 4 year old, twenty-one") == "a 4 year old 21".split()


def test_empty_and_long(spark):
    assert overlap.cross_split_pairs(table(spark, [])).count() == 0
    long = " ".join(f"word{i}" for i in range(4000))
    assert overlap.cross_split_pairs(table(spark, [("a", long, None, "train"), ("b", long + "!", None, "dev")])).count() == 1


def test_uncorrected_slips_between_short_spans(spark):
    clean = "combivarol flumezine nausea fever cramps itching rash cough swelling fatigue dizziness insomnia"
    rows = [
        # spans of 3, 3 and 2 words of 10: 0.8 together, none 0.4 alone
        ("t1", "nausea fever cramps combivarol itching rash cough flumezine swelling fatigue", clean, "train"),
        ("e1", "nausea fever cramps combivarul itching rash cough flumezyne swelling fatigue", clean, "dev"),
        ("e2", "nausea fever cramps insomnia itching rash cough dizziness swelling fatigue", clean, "dev"),
        # no span of 3 words
        ("t2", "rash cough combivarol nausea insomnia", clean, "train"),
        ("e3", "rash cough combivarul nausea insomnia", clean, "test"),
        ("e4", "nausea insomnia combivarul rash cough", clean, "test"),
        ("t3", "swelling flumezine cramps", clean, "train"),
        ("e5", "swelling flumezyne cramps", clean, "test"),
        ("t4", "flumezine dizziness", clean, "train"),
        ("e6", "flumezyne dizziness", clean, "test"),
    ]
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(table(spark, rows)).collect()}
    assert got == {("e1", "t1"), ("e3", "t2"), ("e5", "t3"), ("e6", "t4")}


def test_span_of_records_of_unequal_size_is_found_in_either_order():
    import pandas as pd

    for sizes in ([7, 8], [8, 7]):
        words = [["a", "b", "c", "x"], ["a", "b", "c", "y"]]
        pdf = pd.DataFrame({"head": ["a b c"] * 2, "cls": [1, 2], "place": [0, 0], "suffix": words, "size": sizes, "train": [True, False], "held": [False, True]})
        assert [tuple(r) for d in overlap._shared(iter([pdf])) for r in d.itertuples(index=False)] == [(1, 2, 0, 0, 3)]


def test_long_runs_in_blocks_find_the_same_pairs(spark, monkeypatch):
    rows = [(f"{'te'[i % 2]}{i:03d}", f"Can the new tablets {w} cause itching at age {40 + i // 2}?", "x", ("train", "test")[i % 2]) for i, w in enumerate(["zorvex", "zorvex", "balmex", "balmex"] * 20)]
    rows += [(f"d{i}", f"Can the new tablets zorvex cause itching at age {40 + i}?", "x", "dev") for i in range(6)]
    df = spark.createDataFrame(rows, "id string, question string, ground_truth string, split string")
    whole = sorted(tuple(r) for r in overlap.cross_split_pairs(df).collect())
    monkeypatch.setattr(overlap, "RUN", 7)
    assert sorted(tuple(r) for r in overlap.cross_split_pairs(df).collect()) == whole and len(whole) >= 40


def test_no_table_of_words_is_broadcast_by_estimate(spark, tmp_path, monkeypatch):
    rows = [(f"r{i}", f"can tablet{i % 7} cause itching at age {i % 50} {'so ' * 50}?", "tablets cause itching", "train", ("human_seed",), "x", "y") for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t.parquet"))
    plans, cut = [], overlap.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(overlap, "cut", seen)
    plans.append(overlap.cross_split_pairs(spark.read.parquet(str(tmp_path / "t.parquet")))._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) == 4 and sum(p.count("SortMergeJoin") for p in plans) >= 5
    # of one row only: the most slips of a question
    assert all("BroadcastHashJoin" not in p for p in plans)


def test_spans_and_rare_words_are_compared_only_between_equal_numbers(spark, monkeypatch):
    rows = [(f"{'te'[i % 2]}{i}", f"nausea fever cramps itching rash at age {50 + i // 2 % 5}", "nausea fever cramps itching rash", ("train", "dev")[i % 2]) for i in range(20)]
    rows += [("t90", "nausea fever cramps itching rash 51 52", None, "train"), ("e90", "nausea fever cramps 52 itching rash 51", None, "test"), ("e91", "nausea fever cramps 52 itching rash 52", None, "test")]
    compared, same = spark.sparkContext.accumulator(0), overlap.same_question

    def counted(a, b, *slips):
        compared.add(1)
        return same(a, b, *slips)

    monkeypatch.setattr(overlap, "same_question", counted)
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, "id string, question string, ground_truth string, split string")).collect()}
    assert got == {tuple(sorted((f"t{2 * i}", f"e{2 * j + 1}"))) for i in range(10) for j in range(10) if i % 5 == j % 5} | {("e90", "t90")}
    assert compared.value == 1
