"""Encoding, leaks and character forms."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import encode, forms, leaks

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


ALPHABET = ["a", "b", "'", "s", "'ll", " ", "  ", "\n", "\t", "\xa0", " ", "　", "​", "é", "ß", "я", "中", "😀", "1", "²", ".", "!!", "<|endoftext|>", "re", "́", "the", "\x85", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=["Cs"])), max_size=25).map("".join))
def test_ids_equal_the_public_library(text):
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    assert encode.encode_text(text) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> Hello  world", "x"), (3, "again", "x"), (4, "ab'c " * 30_000, "x"), (5, "q" * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode_corpus(df).collect())
    assert got == sorted((i, reference.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows)
    assert encode.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("a,b", [("ｆｉｎｅ", "fine"), ("ﬁne", "fine"), ("café", "café"), ("so­ft", "soft"), ("a b\n\n c", "a b c"), ("сар", "cap"), ("Αlpha", "Alpha"), ("non‑stop", "non-stop"), ("µg", "μg"), ("z​w⁠j﻿", "zwj")])
def test_same_look(a, b):
    assert forms.one_form(a) == forms.one_form(b)


@pytest.mark.parametrize("a,b", [("x²", "x2"), ("Case", "case"), ("résumé", "resume"), ("ab", "a b"), ("1", "2"), ("ſ", "s")])
def test_other_look(a, b):
    assert forms.one_form(a) != forms.one_form(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    assert forms.one_form(forms.one_form(text)) == forms.one_form(text)


def test_short_items_leak_when_copied_whole():
    ix = leaks.ItemIndex([(1, "aspirin eases sudden knee pain"), (2, "drink water"), (3, "gout")])
    assert [k for k, _ in ix.leaks("They say: Aspirin eases, sudden knee-pain. Then rest.")] == [1]
    assert {k for k, _ in ix.leaks("Gout patients should drink water")} == {2, 3}
    assert ix.leaks("aspirin eases the knee and water is fine") == [] and ix.leaks(None) == [] and ix.leaks("") == []


def test_tiles_equal_brute_force():
    def brute(a, b, least):
        free_a, free_b, out = [True] * len(a), [x >= 0 for x in b], []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for d in range(len(b)):
                    k = 0
                    while i + k < len(a) and d + k < len(b) and free_a[i + k] and free_b[d + k] and a[i + k] == b[d + k]:
                        k += 1
                    best = max(best, (k, -i, -d))
            if best[0] < least:
                return sum(k for k, _, _ in out)
            k, i, d = best[0], -best[1], -best[2]
            free_a[i : i + k], free_b[d : d + k] = [False] * k, [False] * k
            out.append(best)

    rng = random.Random(2)
    for _ in range(150):
        a, b = ([rng.randint(-1 * t, 6) for _ in range(rng.randint(0, 14))] for t in (0, 1))
        got = leaks.tiles(a, b)
        assert sum(k for _, _, k in got) == brute(a, b, leaks.LEAST_TILE)
        assert all(a[i : i + k] == b[d : d + k] for i, d, k in got)


def test_pairs(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "a b"), (4, "c"), (4, "c"), (5, None), (6, " "), (7, "​"), (8, "а b"), (None, "a b ")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, form binary")
    assert sorted((r.doc_a, r.doc_b) for r in forms.same_looking_pairs(df).collect()) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert forms.same_looking_pairs(df.limit(0)).count() == 0
    assert forms.with_form(df).where("doc_id = 2").collect()[0].form == "a b" and forms.one_form(None) is None


def item(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lma", "rno", "stu", "vex")]


def test_leaks(spark):
    rng = random.Random(4)
    items = [item(rng) for _ in range(20)]
    other = lambda n: " ".join(f"filler{rng.randint(0, 9999)}" for _ in range(n))
    w = items[0].split()
    slipped = " ".join(x[:2] + x[3:] if i % 9 == 4 else x for i, x in enumerate(w))
    docs = [
        (1, other(200) + " " + items[0].upper().replace(" ", ",  \n") + other(50)), (2, slipped), (3, " ".join(w[:20]) + other(80) + " ".join(w[35:55])), (4, " ".join(w[:20])),
        (5, " ".join(w[35:55]) + " " + other(80) + " " + " ".join(w[:20])), (6, items[3] + " " + items[4]), (7, None), (8, ""), (9, other(5000)), (6, items[3] + " " + items[4]),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, t, "dev") for i, t in enumerate(items)] + [(77, None, "dev"), (78, "", "dev")], "item_id long, passage string, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked(d, it).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (6, 3), (6, 3), (6, 4), (6, 4)]
    assert leaks.leaked(d, it.limit(0)).count() == 0 and leaks.leaked(d.limit(0), it).count() == 0


def test_leaks_in_blocks_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [item(rng) for _ in range(12)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, passage string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 900)
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaked(d, it).collect()) == [(i, i) for i in range(12)]
