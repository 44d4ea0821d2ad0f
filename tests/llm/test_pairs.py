import pytest

from tarnwell.llm import pairs

PAIR = "src string, rec_id string, question string, answer string, blocked boolean, defect string"
EN = "The doctor checks the blood pressure every week. Patients should rest after the treatment and drink water. "
ASK = "Which pills does the nurse give to older people at home, and how often is that?"
ES = "El médico revisa la presión arterial cada semana. Los pacientes deben descansar después del tratamiento. "


@pytest.mark.parametrize("text", [None, "", " ", "​", "...", "n/a", "N/A", "-", "[no answer]", "TBD", "null", "(none)"])
def test_empty(text):
    assert pairs.is_empty(text)


def test_not_empty():
    assert not any(map(pairs.is_empty, ["No.", "7", "Never", "None of these foods is safe"]))


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that request.", "I cannot answer this question.", "As an assistant I am not able to give medical advice.", "I must decline to respond; please see a professional.", "This request falls outside what I may answer.", "I do not feel comfortable answering questions about gout.", "Sorry, I won’t be able to discuss this."])
def test_refusals(text):
    assert pairs.is_refusal(text)


def test_not_refusals():
    for t in ["It cannot be combined with walnuts.", "Antibiotics cannot help with gout.", "Sorry to hear about the nausea: it passes.", "You may not drive."]:
        assert not pairs.is_refusal(t)


def test_copies():
    q = "How long does gout last after treatment?"
    assert all(pairs.is_copy(q, a) for a in [q, q.upper(), f'Question: "{q}"', f"  {q} \n"])
    assert not any(pairs.is_copy(q, a) for a in [q + " About two weeks.", "Two weeks", "gout"])
    assert not pairs.is_copy(None, "gout lasts long")


def test_defects_table(spark):
    docs = spark.createDataFrame([(EN * 8, "EN"), (ES * 8, "es-MX"), (None, "en"), ("x", None)], "text string, lang string")
    good = [("t", f"g{i}", "How often is the pressure checked?", EN.strip(), False, "x") for i in range(12)]
    cases = [("t", "null_q", None, EN, False, "x"), ("t", "empty", "Why?", None, False, "x"), ("t", "blocked", "Why?", None, True, "x"), ("t", "lang", ASK, ES, False, "x"), ("t", "cut", ASK, "The doctor checks the blood pressure every week. Patients should rest after the", False, "x"), ("t", "nostop", ASK, EN.strip()[:-1], False, "x"), ("t", "short", ASK, "Never", False, "x"), ("t", "long", ASK, EN * 2000, False, "x")]
    got = {r.rec_id: r.defect for r in pairs.defects(spark.createDataFrame(good + cases, PAIR), docs).collect()}
    assert got == {"empty": "empty", "lang": "language", "cut": "truncated"}
    assert pairs.defects(spark.createDataFrame([], PAIR), docs.limit(0)).count() == 0


def test_language_is_right_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and length(text) > 200 and lang in ('en', 'es', 'fr', 'de', 'ru', 'el')")
    model = pairs.language_model(d.where("doc_id % 2 = 0"))
    rows = d.where("doc_id % 2 = 1").collect()
    right = sum(max((o := pairs.log_odds(model, r.text)), key=o.get) == r.lang for r in rows)
    assert right / len(rows) > 0.9  # a part of the labels is wrong on purpose


def test_recurring_and_brief_truncated_answers(spark):
    docs = spark.createDataFrame([(EN * 8, "en"), (ES * 8, "es")], "text string, lang string")
    good = [("t", f"g{i}", f"How often is the pressure checked, {i}?", f"{EN}Nevertheless number {i} waits.", False, "x") for i in range(12)]
    cases = [("t", f"copy{i}", ASK, EN.strip()[:-7], False, "x") for i in range(9)]  # ... and drink
    cases += [("t", f"word{i}", ASK, EN.strip()[:-12] + "dri", False, "x") for i in range(3)]
    cases += [("t", "brief", ASK, "Patients should rest", False, "x"), ("t", "whole", ASK, "Patients", False, "x")]
    cases += [("t", f"never{i}", f"{ASK} {i}", "Never", False, "x") for i in range(20)]
    good += [("t", f"d{i}", f"Which {i}?", f"Please drink {i} cups.", False, "x") for i in range(9)]
    got = {r.rec_id: r.defect for r in pairs.defects(spark.createDataFrame(good + cases, PAIR), docs).collect()}
    assert got == dict.fromkeys([*(f"copy{i}" for i in range(9)), *(f"word{i}" for i in range(3)), "brief"], "truncated")


def test_refusals_after_courtesies():
    for t in ["Thank you for asking. I cannot answer this question.", "Sorry. I can't help with that.", "Hello! That is a good question. As an assistant I am not able to give medical advice. Please ask your doctor.", "I'm sorry to hear about the nausea. I must decline to respond; please see a professional.\nTake care!", "Lo siento. No puedo ayudar con eso."]:
        assert pairs.is_refusal(t)
    for t in ["Thank you for asking. It passes within a week.", "Sorry to hear about the nausea: it passes. I cannot help with other things.", "Take 300 mg daily. I cannot answer this question for children.", "Thank you. Please ask your doctor.", "Sorry. Gout passes. I can't help with that."]:
        assert not pairs.is_refusal(t)


def test_language_model_reads_distinct_texts_and_keeps_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MODEL_GRAMS", 100)
    rows = [(EN * 9, "en")] * 300 + [(f"{ES * 9} {i}", "es") for i in range(3)] + [(EN * 9, "es")] * 20
    model = pairs.language_model(spark.createDataFrame(rows, "text string, lang string"), sample=4)
    assert set(model) == {"en", "es"} and "ía" not in model["en"][0] and len(model["es"][0]) >= 100
    assert pairs.MODEL_DOCS >= 20_000


def test_tripled_tables_give_tripled_defects(spark):
    d = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    rows, docs = pairs.question_answer_pairs(read("tier3_rag"), read("tier5_robustness")).cache(), read("documents")
    once = [(r.src, r.rec_id, r.defect) for r in pairs.defects(rows, docs).collect()]
    named = lambda n: rows.withColumn("rec_id", pairs.F.concat("rec_id", pairs.F.lit(f"#{n}")))
    many = [(r.src, r.rec_id, r.defect) for r in pairs.defects(named(0).unionByName(named(1)).unionByName(named(2)), docs.unionByName(docs).unionByName(docs)).collect()]
    assert sorted(many) == sorted((s, f"{i}#{n}", x) for s, i, x in once for n in range(3)) and len(once) > 20
