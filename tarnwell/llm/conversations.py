"""Rebuild conversations from message rows.

Each session becomes one ordered conversation. Reply links are found by disentangling: every message
scores the messages of the half hour before it in its session by time, mentions and lexical overlap, attaches to
the likeliest one, and the links form trees. A session that is broken, empty or lacks a reply is flagged.

Scale: no step gathers a whole session. Copies are folded per (session, speaker, content) and ten-minute
slice, the ordered scan runs on (session, six-hour bucket) with the messages of the half hour before carried in
as context, and per-session verdicts combine one small summary per bucket, made without the texts.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import cut

# Role spellings.
USER_ROLES = ["user", "human"]
ASSISTANT_ROLES = ["assistant", "ai", "bot"]
IGNORED_ROLES = ["system", "tool"]

#: Characters that leave no mark on the page, besides \s and \p{Z}.
INVISIBLE = r"\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵᠋-᠏⠀ㅤ︀-️ﾠ"

#: A text that is nothing but a notice of a technical failure.
_TECH = r"(?:error|fail(?:ed|ure)?|abort(?:ed)?|time[d ]?-?out|unavailable|interrupted|exception|overloaded|rate limit|quota|disconnected|could not be (?:generated|loaded|reached|completed)|no response|crash(?:ed)?|not respond(?:ing)?|cancell?ed)"
NOTICE = "|".join(
    [
        rf"^[\[(<{{*]+[^\n]*\b{_TECH}[^\n]*[\])>}}*]+\.?$",
        rf"^[\[(<{{*]+\w*_(?:error|failure|timeout)\b[^\n]*[\])>}}*]+\.?$",
        r"^(?:an? )?(?:internal|server|upstream|network|model|generation|system|unexpected|unknown|backend|api|http|connection|gateway)?[ _-]*(?:error|failure|exception)\b(?! (?:of|in the|bars?)\b)[^\n]{0,120}$",
        r"^(?:sorry, )?(?:the |your )?(?:model|server|service|response|answer|reply|generation|request|connection|stream|backend|upstream)\b[^.\n]{0,40}\b(?:unavailable|timed out|time-?out|failed|aborted|interrupted|overloaded|could not be|was lost|cancell?ed)\b[^\n]{0,80}$",
        r"^(?:sorry, |oops[,!]? )?something went wrong\b[^\n]{0,100}$",
        r"^(?:time-?out|timed out|service unavailable|bad gateway|gateway timeout|too many requests|rate limit(?:ed| exceeded| reached)?)\b[^\n]{0,80}$",
        r"^(?:http )?5\d\d\b[^\n]{0,60}$",
    ]
)

COPY_S = 600  # a copy follows its original by at most this many seconds
BUCKET_S = 6 * 3600  # length of one scan bucket
REACH_S = 1800  # a reply link reaches back at most this far

TURNS_SCHEMA = "session_id string, bucket long, runs int, first_speaker string, first_answered boolean, last_speaker string, last_answered boolean, inner_unanswered int"
LINK_SCHEMA = "session_id string, id bigint, at bigint, speaker string, kind string, turn int, parent_id bigint, score double, tree_id bigint, content string"


def speaker_of(role: Column) -> Column:
    """user, assistant, ignored or unknown, whatever the case and outer white space of ``role``."""
    r = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(r.isin(USER_ROLES), "user").when(r.isin(ASSISTANT_ROLES), "assistant").when(r.isin(IGNORED_ROLES), "ignored").otherwise("unknown")


def is_blank(text: Column) -> Column:
    """True for null and for text without a visible character."""
    return ~F.coalesce(text.rlike(f"[^{INVISIBLE}]"), F.lit(False))


def is_notice(text: Column) -> Column:
    """True for a text that only says that a reply failed for technical reasons."""
    bare = F.lower(F.regexp_replace(text, f"^[{INVISIBLE}]+|[{INVISIBLE}]+$", ""))
    return F.coalesce((F.length(text) <= 300) & bare.rlike(NOTICE), F.lit(False))


def classified(messages: DataFrame) -> DataFrame:
    """session_id, id, at (microseconds), speaker, kind (blank, notice or text), content."""
    m = messages.select("session_id", "id", "role", "content", "created_at").where(F.col("session_id").isNotNull())
    kind = F.when(is_blank(F.col("content")), "blank").when(is_notice(F.col("content")), "notice").otherwise("text")
    return m.select("session_id", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), speaker_of(F.col("role")).alias("speaker"), kind.alias("kind"), "content")


def without_copies(rows: DataFrame, content: bool = True) -> DataFrame:
    """Drop each non-blank message that repeats a kept one of its session and speaker within COPY_S.

    Contents are compared by two hashes; with ``content`` false they don't leave the scan.

    Whether a message is kept depends on the last kept one before it, so the rule is a fold in order of
    time. Rows of a key are first gathered per slice of COPY_S; slices that follow each other without a
    gap form an island, and only an island is folded. A hot session or phrase is thereby cut in time.
    """
    step = COPY_S * 1_000_000
    key = ["session_id", "speaker", "h1", "h2"]
    text = F.first("content").alias("content") if content else F.lit(None).cast("string").alias("content")
    slices = (
        rows.withColumns({"h1": F.xxhash64("content"), "h2": F.xxhash64(F.lit(7), "content"), "slice": F.floor(F.col("at") / step)})
        .repartition(*key)  # serves slices and islands, so that contents move once
        .groupBy(*key, "slice")
        .agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("times"), F.first("kind").alias("kind"), text)
    )
    order = W.partitionBy(*key).orderBy("slice")
    fresh = F.coalesce((F.col("slice") - F.lag("slice").over(order) > 1).cast("int"), F.lit(1))
    islands = (
        slices.withColumn("fresh", fresh)
        .withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*key, "island")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slice", "times"))), lambda x: x["times"])).alias("times"), F.first("kind").alias("kind"), text)
    )
    kept = F.aggregate(
        F.slice("times", 2, F.greatest(F.size("times") - 1, F.lit(1))),
        F.slice("times", 1, 1),
        lambda acc, x: F.when(x["at"] - F.element_at(acc, -1)["at"] > step, F.concat(acc, F.array(x))).otherwise(acc),
    )
    return islands.select("session_id", "speaker", "kind", "content", F.explode(kept).alias("x")).select("session_id", "x.id", "x.at", "speaker", "kind", "content")


_WORD = re.compile(r"\w+")


def _features(text: str | None) -> tuple[frozenset, frozenset]:
    words = _WORD.findall((text or "").lower())
    return frozenset(w for w in words if len(w) > 3), frozenset(w for w in words if len(w) > 7 or w.isdigit())


def link_score(gap_s: float, speaker: str, other: str, own: tuple, theirs: tuple) -> float:
    """How likely a message answers an earlier one: nearness in time, shared mentions, lexical overlap, change of speaker."""
    near = math.exp(-gap_s / 300)
    mention = 1.0 if own[1] & theirs[1] else 0.0
    small = min(len(own[0]), len(theirs[0]))
    overlap = len(own[0] & theirs[0]) / small if small else 0.0
    return 0.35 * near + 0.2 * mention + 0.25 * overlap + (0.2 if speaker != other else 0.0)


LEAST_SCORE = 0.15


def _parent(at: int, speaker: str, own: tuple, window: deque) -> tuple | None:
    """(score, id, tree) of the likeliest message of ``window``, the later one of equals; None below LEAST_SCORE.

    Going back in time, nearness only falls. The search ends where even a message of another speaker with all words
    and a mention shared would score less than the best so far, so no message within REACH_S is passed over.
    """
    most = 0.2 + (0.2 if own[1] else 0.0) + (0.25 if own[0] else 0.0) + 1e-9
    best, found = LEAST_SCORE, None
    for pid, pat, pspeaker, theirs, ptree in reversed(window):
        gap = (at - pat) / 1e6
        if gap > REACH_S or 0.35 * math.exp(-gap / 300) + most < best:
            break
        score = link_score(gap, speaker, pspeaker, own, theirs)
        if score > best or found is None and score == best:
            best, found = score, (score, pid, ptree)
    return found


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (session, bucket) in order of time → one row a message with its reply link."""
    key, window, turn, talks = None, deque(), -1, None
    for pdf in batches:
        out = []
        for sid, bucket, mid, at, speaker, kind, content, context in zip(
            pdf.session_id, pdf.bucket.tolist(), pdf.id.tolist(), pdf["at"].tolist(), pdf.speaker, pdf.kind, pdf.content, pdf.context.tolist(), strict=True
        ):
            if key != (sid, bucket):
                key, turn, talks = (sid, bucket), -1, None
                window.clear()
            own = _features(content)
            while window and at - window[0][1] > REACH_S * 1_000_000:
                window.popleft()
            # a context message stands for its own tree, which its own bucket knows
            score, parent, tree = (None if context else _parent(at, speaker, own, window)) or (None, None, mid)
            window.append((mid, at, speaker, own, tree))
            if context:
                continue
            turn, talks = turn + (speaker != talks), speaker
            out.append((sid, mid, at, speaker, kind, turn, parent, score, tree, content))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINK_SCHEMA.split(", ")])


def _linked_bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_linked`` without the texts."""
    for pdf in _linked(batches):
        yield pdf.assign(content=None)


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (session, bucket) in order of time → one row a bucket: the summary of its turns."""
    names = [c.split()[0] for c in TURNS_SCHEMA.split(", ")]
    key, runs = None, []

    def closed():
        return (*key, len(runs), *runs[0], *runs[-1], sum(1 for sp, ok in runs[1:-1] if sp == "assistant" and not ok))

    for pdf in batches:
        out = []
        for sid, bucket, speaker, kind in zip(pdf.session_id, pdf.bucket.tolist(), pdf.speaker, pdf.kind, strict=True):
            if key != (sid, bucket):
                if runs:
                    out.append(closed())
                key, runs = (sid, bucket), []
            if runs and runs[-1][0] == speaker:
                runs[-1] = (speaker, runs[-1][1] or kind == "text")
            else:
                runs.append((speaker, kind == "text"))
        if out:
            yield pd.DataFrame(out, columns=names)
    if runs:
        yield pd.DataFrame([closed()], columns=names)


def _placed(messages: DataFrame, content: bool) -> DataFrame:
    """The kept messages with the six-hour bucket of their session."""
    rows = classified(messages).where(F.col("at").isNotNull() & F.col("speaker").isin("user", "assistant"))
    text = without_copies(rows.where(F.col("kind") != "blank"), content)
    blank = rows.where((F.col("kind") == "blank") & (F.col("speaker") == "assistant")).select(*text.columns)
    return text.unionByName(blank).withColumn("bucket", F.floor(F.col("at") / (BUCKET_S * 1_000_000)))


def turn_buckets(messages: DataFrame) -> DataFrame:
    """One row for each (session, six-hour bucket) with the summary of its turns; no text is shuffled."""
    flat = _placed(messages, content=False).select("session_id", "bucket", "id", "at", "speaker", "kind")
    return flat.repartition("session_id", "bucket").sortWithinPartitions("session_id", "bucket", "at", "id").mapInPandas(_turns, TURNS_SCHEMA)


def linked_messages(messages: DataFrame, content: bool = True) -> DataFrame:
    """One row for each kept message with its reply link; a message near the end of its bucket is context for the next.

    With ``content`` false the scan reads the texts for its scores and gives null for them.
    """
    span = BUCKET_S * 1_000_000
    late = F.col("at") - F.col("bucket") * span >= span - REACH_S * 1_000_000
    place = lambda b, context: F.struct(b.alias("bucket"), F.lit(context).alias("context"))
    here, next_too = place(F.col("bucket"), False), place(F.col("bucket") + 1, True)
    placed = _placed(messages, content=True).withColumn("place", F.explode(F.when(late, F.array(here, next_too)).otherwise(F.array(here))))
    flat = placed.select("session_id", "place.bucket", "id", "at", "speaker", "kind", "content", "place.context")
    return flat.repartition("session_id", "bucket").sortWithinPartitions("session_id", "bucket", "at", "id").mapInPandas(_linked if content else _linked_bare, LINK_SCHEMA)


def turns_of(linked: DataFrame) -> DataFrame:
    """What ``turn_buckets`` has, from rows of ``linked_messages``."""
    turns = linked.withColumn("bucket", F.floor(F.col("at") / (BUCKET_S * 1_000_000))).groupBy("session_id", "bucket", "turn").agg(F.first("speaker").alias("speaker"), F.max(F.col("kind") == "text").alias("answered"))
    bad = ((F.col("speaker") == "assistant") & ~F.col("answered")).cast("int")
    ends = [f(c, "turn").alias(n) for n, f, c in (("first_speaker", F.min_by, "speaker"), ("first_answered", F.min_by, "answered"), ("last_speaker", F.max_by, "speaker"), ("last_answered", F.max_by, "answered"), ("first_bad", F.min_by, "bad"), ("last_bad", F.max_by, "bad"))]
    g = turns.withColumn("bad", bad).groupBy("session_id", "bucket").agg((F.max("turn") + 1).alias("runs"), *ends, F.sum("bad").alias("bad"))
    inner = (F.col("bad") - F.col("first_bad") - F.when(F.col("runs") > 1, F.col("last_bad")).otherwise(0)).cast("int")
    return g.select("session_id", "bucket", "runs", "first_speaker", "first_answered", "last_speaker", "last_answered", inner.alias("inner_unanswered"))


def session_verdicts(messages: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """session_id, turns, reason; reason is null for a sound conversation.

    One row for each session with at least one row (a null session_id is no session). Reasons in order of
    precedence: unknown_speaker, no_time, empty, starts_with_assistant, ends_with_user, no_answer. Nulls in
    role, content and created_at are handled as such, repeated deliveries count once, other columns are ignored.
    """
    flags = classified(messages).groupBy("session_id").agg(
        F.max((F.col("speaker") == "unknown") & (F.col("kind") != "blank")).alias("unknown"),
        F.max((F.col("speaker") != "ignored") & (F.col("kind") != "blank") & F.col("at").isNull()).alias("timeless"),
    )
    parts = F.sort_array(F.collect_list(F.struct("bucket", "runs", "first_speaker", "first_answered", "last_speaker", "last_answered", "inner_unanswered")))

    def is_bad(speaker, answered):
        return F.when((speaker == "assistant") & ~answered, 1).otherwise(0)

    def step(acc, x):
        joins = acc["speaker"] == x["first_speaker"]  # the open turn goes on in this bucket
        open_first = F.when(joins, acc["answered"] | x["first_answered"]).otherwise(x["first_answered"])
        single = x["runs"] == 1
        closed = F.when(joins, 0).otherwise(is_bad(acc["speaker"], acc["answered"])) + F.when(single, 0).otherwise(is_bad(x["first_speaker"], open_first)) + x["inner_unanswered"]
        return F.struct(
            x["last_speaker"].alias("speaker"),
            F.when(single, open_first).otherwise(x["last_answered"]).alias("answered"),
            (acc["bad"] + closed).cast("int").alias("bad"),
            (acc["turns"] + x["runs"] - F.when(joins, 1).otherwise(0)).cast("int").alias("turns"),
        )

    start = F.struct(F.lit("").alias("speaker"), F.lit(True).alias("answered"), F.lit(0).alias("bad"), F.lit(0).alias("turns"))
    turns = (
        (turn_buckets(messages) if buckets is None else buckets)
        .groupBy("session_id")
        .agg(parts.alias("parts"))
        .select("session_id", F.element_at("parts", 1)["first_speaker"].alias("opens"), F.aggregate("parts", start, step, lambda s: F.struct(s["turns"].alias("turns"), s["speaker"].alias("closes"), (s["bad"] + is_bad(s["speaker"], s["answered"])).alias("bad"))).alias("s"))
        .select("session_id", "opens", "s.*")
    )
    reason = (
        F.when(F.col("unknown"), "unknown_speaker")
        .when(F.col("timeless"), "no_time")
        .when(F.col("turns").isNull(), "empty")
        .when(F.col("opens") == "assistant", "starts_with_assistant")
        .when(F.col("closes") == "user", "ends_with_user")
        .when(F.col("bad") > 0, "no_answer")
    )
    return flags.join(turns, "session_id", "left").select("session_id", F.coalesce("turns", F.lit(0)).alias("turns"), reason.alias("reason"))


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Resolve tree ids that name a message of the bucket before, oldest first."""
    final: dict[int, int] = {}
    for hint, tree in zip(pdf.id.tolist(), pdf.tree_id.tolist(), strict=True):
        final[hint] = final.get(tree, tree)
    return pd.DataFrame({"session_id": pdf.session_id.iloc[0], "hint": list(final), "root": list(final.values())})


def conversation_messages(messages: DataFrame) -> DataFrame:
    """The kept messages of sound sessions: session_id, id, at, speaker, content, parent_id, score, tree_id.

    tree_id is the id of the first message of the link tree. Order within a session is (at, id). Blank
    assistant messages and notices stay as rows of their turn (kind tells them).
    """
    linked = cut(linked_messages(messages))
    rows = linked.join(session_verdicts(messages, turns_of(linked)).where("reason is null").select("session_id"), "session_id", "left_semi")
    # a tree id that isn't the id of a root is a context message, of the last REACH_S of the bucket before
    hints = rows.where(F.col("tree_id") != F.col("id")).select("session_id", F.col("tree_id").alias("id")).distinct().join(rows.where(F.col("tree_id") != F.col("id")).select("session_id", "id", "at", "tree_id"), ["session_id", "id"])
    roots = hints.groupBy("session_id").applyInPandas(lambda pdf: _stitch(pdf.sort_values(["at", "id"])), "session_id string, hint long, root long")
    return (
        rows.join(roots.withColumnRenamed("hint", "tree_id"), ["session_id", "tree_id"], "left")
        .select("session_id", "id", F.timestamp_micros("at").alias("created_at"), "speaker", "kind", "content", "parent_id", "score", F.coalesce("root", "tree_id").alias("tree_id"))
    )
