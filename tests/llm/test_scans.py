from tarnwell.llm import scans

CHUNK = "chunk_id string, content string, noise string"
RAG = "id string, reference_contexts array<string>, text string"
PROSE = "The patient should measure the temperature every morning and report any change to the clinic. "


def tables(spark, contents, contexts=()):
    filler = [(f"f{i}", PROSE * 3 + "Follow-up self-care advice is given after treatment within three percent of cases.", "x") for i in range(12)]
    a = spark.createDataFrame([(f"c{i}", t, "x") for i, t in enumerate(contents)] + filler, CHUNK)
    return scans.texts_of(a, spark.createDataFrame([(f"r{i}", c, "x") for i, c in enumerate(contexts)], RAG))


def found(spark, contents, contexts=()):
    out = {}
    for r in scans.noise_found(tables(spark, contents, contexts)).collect():
        out.setdefault(r.rec_id, set()).add(r.noise)
    return out


def test_each_kind_and_its_look_alike(spark):
    got = found(
        spark,
        [
            "The patient should measure the temp-\nerature every morning and report any change.",
            "The patient is given advice on self-\ncare goals and on the treatment that follows.",
            "The patient should rneasure the temp¬\n- 12 -\nerature every morning and report.",
            "The patient should measure the temperature every\nPage 7 of 90\nmorning and report any change to the clinic.",
            "Dose (mg)\n2825\n1725\nTaken\ntwice daily\nat bedtime",
            "The patient should measure the temperature every\nNorthern Guide to Home Care\nmorning and report any change to the clinic.",
            "Signs of change\nThe patient should measure the temperature every morning.",
            "The pati3nt should report any change to the clinic and rnorning treatment.",
            "", "   ", None, "x" * 50_000, "12", "\n\n",
        ],
        [["The patient should measure the temperature every\nChapter 3  Home care\nmorning and report any change.", None, ""], None, []],
    )
    assert got == {"c0": {"hyphenation"}, "c2": {"hyphenation", "misread", "page_number"}, "c3": {"page_number"}, "c5": {"header"}, "c7": {"misread"}, "r0": {"header"}, **({"c12": {"page_number"}} if "c12" in got else {})}


def test_repair_reads_as_paragraphs(spark):
    text = "The patient should rneasure the temp-\n- 12 -\nerature every\nNorthern Guide to Home Care\nmorning and give self-\ncare advice.\n\nReport any change to\nthe clinic."
    rows = {r.rec_id: r.text for r in scans.repaired(tables(spark, [text, "", "Dose (mg)\n2825\n1725"])).collect()}
    assert rows["c0"] == "The patient should measure the temperature every morning and give self-care advice.\n\nReport any change to the clinic."
    assert rows["c1"] == "" and rows["c2"] == "Dose (mg)\n2825\n1725" and rows["f1"] == (PROSE * 3 + "Follow-up self-care advice is given after treatment within three percent of cases.").strip()


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], CHUNK), spark.createDataFrame([], RAG)
    assert scans.noise_found(scans.texts_of(a, b)).count() == 0 and scans.repaired(scans.texts_of(a, b)).count() == 0


def test_repair_removes_just_the_lines_that_are_reported(spark):
    table = PROSE + "\nDose\n250\n300\nTaken daily"
    rows = tables(spark, [table, "- 12 -", PROSE + "\n- 13 -\nand more is reported to the clinic."])
    noise = {(r.rec_id, r.noise) for r in scans.noise_found(rows).collect()}
    text = {r.rec_id: r.text for r in scans.repaired(rows).collect()}
    assert noise == {("c1", "page_number"), ("c2", "page_number")}
    assert "250" in text["c0"] and "300" in text["c0"] and text["c1"] == "" and "13" not in text["c2"]
    assert all(t.split() == o.split() for t, o in ((text[f"f{i}"], PROSE * 3 + "Follow-up self-care advice is given after treatment within three percent of cases.") for i in range(12)))


def test_many_symbols_and_long_words_are_restored(spark):
    long = "dichlorodiphenyltrichloroethaneadministration"
    got = found(spark, ["The " + "patient takes " + long + ". " for _ in range(70)] + ["The patient takes dichl0rodiphenyltr1chl0roethaneadm1nistrat1on.", "The patient takes dichlorodiphenyltrichloroethaneadrninistration."])
    assert got == {"c70": {"misread"}, "c71": {"misread"}}


def test_bare_numbers_against_the_sequence_of_their_document_stay(spark):
    page = lambda i, n: (f"c{i}", f"The patient should measure the temperature every\n{n}\nmorning and report any change.", "x", "book", i)
    a = spark.createDataFrame([page(i, i + 2) for i in range(1, 7)] + [page(7, 250)], CHUNK + ", doc_id string, page int")
    texts = scans.texts_of(a, spark.createDataFrame([], RAG))
    assert {r.rec_id for r in scans.noise_found(texts).collect()} == {f"c{i}" for i in range(1, 7)}


def test_titles_repeat_with_a_slip(spark):
    lines = ["Guide to Home Care"] * 4 + ["Guide to Homes Care"]
    texts = [f"{PROSE.strip()}\n{t}\n{PROSE}" for t in lines] + ["The patient should measure the temperature every\nGuide to Home Care\nmorning and report any change to the clinic."]
    assert {k for k, v in found(spark, texts).items() if "header" in v} == {f"c{i}" for i in range(6)}
