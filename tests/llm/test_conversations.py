import datetime as dt
import random
from collections import defaultdict

from tarnwell.llm import conversations as c
from tarnwell.llm import queries

SCHEMA = "id long, session_id string, role string, content string, source string, created_at timestamp, bucket string, turn int"


def at(s):
    return None if s is None else dt.datetime(2024, 1, 1, 5, 50) + dt.timedelta(seconds=s)


def table(spark, rows):
    return spark.createDataFrame([(i, s, r, t, "x", at(a), "clash", 1) for i, (s, r, t, a) in enumerate(rows)], SCHEMA)


def brute(rows):
    """The rule restated over plain lists; returns the sessions that are left out."""
    by = defaultdict(list)
    for i, (s, r, t, a) in enumerate(rows):
        r = (r or "").strip().lower()
        sp = "user" if r in ("user", "human") else "assistant" if r in ("assistant", "ai", "bot") else None if r in ("system", "tool") else "?"
        if s is not None:
            by[s].append((a, i, sp, t, not (t or "").replace("​", "").strip()))
    out = set()
    for s, ms in by.items():
        bad = any((sp == "?" or sp and a is None) and not b for a, _, sp, _, b in ms)
        kept, turns = {}, []
        for a, _, sp, t, b in sorted((m for m in ms if m[0] is not None and m[2] in ("user", "assistant")), key=lambda m: m[:2]):
            if b and sp == "user" or not b and (sp, t) in kept and a - kept[sp, t] <= 600:
                continue
            if not b:
                kept[sp, t] = a
            ok = not b and t != "Error 503: model unavailable"
            if turns and turns[-1][0] == sp:
                turns[-1][1] |= ok
            else:
                turns.append([sp, ok])
        if bad or not turns or turns[0][0] == "assistant" or turns[-1][0] == "user" or any(x == "assistant" and not ok for x, ok in turns):
            out.add(s)
    return out


def test_verdicts_match_brute_force_across_buckets(spark):
    rng = random.Random(3)
    rows = []
    for s in range(150):
        now = 0
        for _ in range(rng.randint(1, 9)):
            now += rng.choice([0, 0, 60, 500, 601, 7000, 30000])
            rows.append((f"s{s}", rng.choice(["user", "User ", "assistant", "AI", "bot", "human", "tool"] * 6 + [None, "??"]), rng.choice(["a", "b", "hello", "x"] * 6 + [None, "​", " \n", "Error 503: model unavailable"]), rng.choice([now] * 40 + [None])))
    rows += [(None, "user", "no session", 5), ("lone", "tool", "x", 1)]
    got = {r.session_id for r in c.session_verdicts(table(spark, rows)).where("reason is not null").collect()}
    assert got == brute(rows) and "lone" in got


def test_copies_fold_on_the_last_kept_one(spark):
    rows = [("s", "user", "q", t) for t in (0, 300, 600, 601, 1100, 1202)] + [("s", "assistant", "a", 2000)]
    kept = c.conversation_messages(table(spark, rows)).orderBy("created_at").collect()
    assert [r.id for r in kept] == [0, 3, 5, 6]


def test_links_trees_and_order(spark):
    rows = [("s", "user", "question about aspirin dosage", 590), ("s", "assistant", "aspirin dosage is low", 600 + 3), ("s", "user", "unrelated weather", 90000), ("s", "assistant", "weather fine", 90010)]
    got = c.conversation_messages(table(spark, rows)).orderBy("created_at", "id").collect()
    assert [r.parent_id for r in got] == [None, 0, None, 2] and [r.tree_id for r in got] == [0, 0, 2, 2]  # the first pair spans two buckets


def test_notices():
    import re

    for t in ("[generation_error: upstream timeout]", "error 503: model unavailable", "internal error, request id 17", "(response could not be generated)", "something went wrong, please try again"):
        assert re.search(c.NOTICE, t)
    for t in ("heart failure needs care", "an error of judgement is common.\nask again", "the response to treatment is good", "service dogs help"):
        assert not re.search(c.NOTICE, t)


def test_empty_table(spark):
    assert c.session_verdicts(table(spark, [])).count() == 0 and c.conversation_messages(table(spark, [])).count() == 0


def brute_links(rows):
    """{id: (parent, tree)} of one session, every earlier message within REACH_S scored."""
    out = {}
    for i, (_, sp, t, a) in enumerate(rows):
        own = c._features(t)
        scores = [(c.link_score(a - b, sp, other, own, c._features(text)), j) for j, (_, other, text, b) in enumerate(rows[:i]) if a - b <= c.REACH_S]
        score, parent = max(scores, default=(0, None))
        out[i] = (parent, out[parent][1]) if score >= c.LEAST_SCORE else (None, i)
    return out


def test_links_reach_over_many_messages_and_buckets(spark):
    rng = random.Random(5)
    words = "aspirin dosage weather headache 250 metformin kidney sleeping".split()
    rows, now = [("s", "user", "metoprolol with grapefruit juice?", 0), ("s", "assistant", "rain", 0)], 0
    rows += [("s", ("user", "assistant")[i % 2], f"chat{i} idle", 100 + i) for i in range(20)] + [("s", "user", "ok", 180), ("s", "assistant", "metoprolol grapefruit juice never", 181)]
    for i in range(400):
        now += rng.choice([0, 5, 20, 60]) if i else 300
        rows.append(("s", ("user", "assistant")[i % 2], " ".join(rng.sample(words, rng.randint(0, 3))) + f" x{i}", 200 + now))
    got = {r.id: (r.parent_id, r.tree_id) for r in c.conversation_messages(table(spark, rows)).collect()}
    want = brute_links(rows)
    assert want[23][0] == 0 and sum(p is not None and i - p > 8 for i, (p, _) in want.items()) > 9
    assert got == want


def test_p1_found_goes_by_the_linked_messages(spark, tmp_path, monkeypatch):
    rows = [("sound", "user", "aspirin dosage?", 0), ("sound", "assistant", "low", 5), ("open", "user", "aspirin?", 0), ("open", "assistant", "yes", 5), ("open", "user", "why?", 9), ("lone", "tool", "x", 1)]
    table(spark, rows).write.parquet(str(tmp_path / "messages.parquet"))
    linked, seen = c.linked_messages, []

    def kept(messages, **options):
        seen.append(linked(messages, **options))
        return seen[-1]

    monkeypatch.setattr(c, "linked_messages", kept)
    assert {r.session_id for r in queries.p1_found(spark, str(tmp_path)).collect()} == {"open", "lone"}
    assert [(r.parent_id, r.tree_id, r.content) for r in seen[0].orderBy("id").collect()] == [(None, 0, None), (0, 0, None), (None, 2, None), (2, 2, None), (3, 2, None)]
    monkeypatch.setattr(c, "linked_messages", lambda messages, **options: linked(messages, **options).where("session_id <> 'sound'"))
    assert {r.session_id for r in queries.p1_found(spark, str(tmp_path)).collect()} == {"open", "lone", "sound"}
