from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import splitting as sp


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word ", "abc. ", "x\n", "y\n\n", "z\r\n\r\n", "long" * 12, " ", " ", "é? "]), max_size=120), st.integers(40, 90))
def test_pieces_cover_the_text_within_the_limit(parts, limit):
    text = "".join(parts)
    level, pieces = sp.split_text(text, limit, 15)
    bare = text.strip()
    assert all(0 < len(p[4]) <= limit and bare[p[1] : p[2]] == p[4] for p in pieces)
    end = 0
    for i, (_, start, stop, overlap, _) in enumerate(pieces):
        assert overlap <= 15 and (i or start == 0) and bare[end : start + overlap].strip() == "" and start + overlap >= end
        end = stop
    assert end == len(bare) and (level is None) == (len(bare) <= limit)


def test_level_is_the_coarsest_that_suffices():
    a = "a" * 30
    assert sp.boundary_level(f"{a}\n\n{a}", 30) == "paragraph"
    assert sp.boundary_level(f"{a}\r\n{a}", 30) == "line"  # one line break, not two
    assert sp.boundary_level(f"{a[:-1]}. {a}", 30) == "sentence"
    assert sp.boundary_level(f"{a} {a}", 30) == "word"
    assert sp.boundary_level("a" * 31, 30) == "none"


def test_column_with_clashing_names(spark):
    long = ("One sentence here. " * 200).strip()
    df = spark.createDataFrame([("a", "S", long, "x", "y"), ("b", None, None, "x", "y"), ("c", "", "  ", "x", "y"), ("d", "S", "x" * 1800 + "  ", "x", "y"), ("a", "S", long, "x", "y")], "chunk_id string, section string, content string, level string, pieces string")
    got = sp.oversized_chunks(df).collect()
    assert [(r.chunk_id, r.section, r.level) for r in got] == [("a", "S", "sentence")] * 2
    assert all(p.text.endswith(".") for p in got[0].pieces) and sp.oversized_chunks(df.limit(0)).count() == 0


def test_very_long_texts():
    for text in ("x" * 300_000, "word " * 60_000, "\n" * 200_000 + "a", "a.\n\n" * 50_000):
        level, pieces = sp.split_text(text)
        assert all(len(p[4]) <= sp.LIMIT for p in pieces)


def test_the_limit_leaves_room_for_the_whole_overlap():
    words = lambda n: ("abcdefghi " * (n // 10 + 1))[: n - 1] + "."
    for text in ["\n\n".join(["x" * 800] * 2 + ["y" * 123] + ["x" * 800] * 2), "\n\n".join(["z" * 574] * 6), "\n\n".join(["v" * 250, "w" * 1640] + ["u" * 90] * 30)]:
        level, pieces = sp.split_text(text)
        starts = [c[1] for c in sp.cut_points(text)]
        assert level == "paragraph"
        for a, b in zip(pieces, pieces[1:], strict=False):
            whole = sp._overlap_start(text, b[1] + b[3], starts, sp.OVERLAP)
            assert b[1] == max(whole, a[1] + a[3]) and len(b[4]) <= sp.LIMIT
    for text in ["\n\n".join([words(1724)] * 2), "\n\n".join([words(1700), words(300), words(1790)])]:
        _, pieces = sp.split_text(text)  # only a segment without room makes the overlap shrink
        starts = [c[1] for c in sp.cut_points(text)]
        for b in pieces[1:]:
            assert b[1] == sp._overlap_start(text, b[1] + b[3], starts, sp.OVERLAP) or len(b[4]) == sp.LIMIT and "\n\n" not in text[b[1] + b[3] : b[2]]
