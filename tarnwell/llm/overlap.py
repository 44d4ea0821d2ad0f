"""Find questions of evaluation splits that are also asked in the training split.

Questions are brought to a canonical word sequence: one character form, abbreviations and number words spelled
out, slips corrected by the corpus's own vocabulary, synonyms mapped to one word, greetings and function words
removed. A suffix array over the concatenated sequences, partitioned by the first words of a suffix and the numbers of
its sequence (questions with other numbers never hold as the same), shows spans that records of both sides share; the spans are merged into the coverage of each pair of records, and a pair
holds if nothing outside the coverage makes a difference: no number and no known word, only slips.

Equal sequences are one class from the start, so that copies are compared once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.llm.forms import one_form
from tarnwell.session import cut

# Language knowledge of the canonical form.
ABBREVIATIONS = {
    "shud": "should", "shd": "should", "cud": "could", "wud": "would", "wat": "what", "wut": "what", "wot": "what", "pls": "please", "plz": "please",
    "u": "you", "ur": "your", "r": "are", "n": "and", "w": "with", "yrs": "years", "yr": "year", "y": "why", "im": "i am", "ive": "i have", "id": "i would",
    "dont": "do not", "cant": "can not", "wont": "will not", "isnt": "is not", "doesnt": "does not", "abt": "about", "bc": "because", "cuz": "because",
    "coz": "because", "b4": "before", "gr8": "great", "l8r": "later", "thx": "thanks", "tks": "thanks", "ty": "thanks", "gonna": "going to", "wanna": "want to",
    "gimme": "give me", "med": "medicine", "meds": "medicine", "doc": "doctor", "dr": "doctor", "rx": "prescription", "bp": "blood pressure", "tho": "though",
}
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SYNONYMS = {
    "all at once": "suddenly", "abruptly": "suddenly", "at once": "suddenly", "overnight": "suddenly", "cold turkey": "suddenly", "once more": "again", "anew": "again",
    "each day": "daily", "every day": "daily", "everyday": "daily", "a person": "someone", "somebody": "someone", "anybody": "someone", "will happen": "happens",
    "would happen": "happens", "occurs": "happens", "medication": "medicine", "drug": "medicine", "remedy": "medicine", "physician": "doctor", "gp": "doctor",
    "okay": "safe", "ok": "safe", "fine": "safe", "secure": "safe", "harmless": "safe", "usual": "normal", "ordinary": "normal", "typical": "common", "frequent": "common",
    "widespread": "common", "quit": "stop", "cease": "stop", "discontinue": "stop", "halt": "stop", "correct": "right", "proper": "right", "suitable": "right",
    "appropriate": "right", "aggravate": "make worse", "worsen": "make worse", "adverse": "side", "reactions": "effects", "begin": "start", "resume": "start again",
    "restart": "start again", "prescribed": "gave", "gave to": "gave", "given": "gave", "skips": "misses", "forgets": "misses", "omits": "misses", "tablet": "dose", "foods": "food",
    "meals": "food", "steer clear of": "avoid", "stay away from": "avoid", "keep away from": "avoid", "leave out": "avoid", "peligroso": "dangerous", "risky": "dangerous",
    "mucho dolor": "much pain", "dolor": "pain", "takes effect": "works", "helps": "works", "kicks in": "works", "excessive": "too much", "an overdose": "too much", "before": "until", "till": "until",
    "began": "started", "seems": "feels", "odd": "different", "strange": "different", "has returned": "is back", "came back": "is back", "returned": "back", "permitted": "can", "may": "can",
    "which foods": "which food", "what food": "which food", "what foods": "which food", "just turned": "turned", "became": "turned",
}
COURTESIES = [
    "i would be grateful for advice", "i would be grateful for any advice", "the internet says many things", "not sure whom to ask", "not sure who to ask", "please answer soon",
    "please answer", "please help", "please", "help me", "help", "quick question", "so basically", "basically", "good evening", "good morning", "good afternoon", "good day", "hello doctor",
    "hi doctor", "dear doctor", "hello there", "hello", "hi there", "hi", "hey", "sorry to ask but", "sorry to bother you but", "sorry to ask", "i am worried", "thank you", "many thanks",
    "thanks in advance", "thanks", "cheers", "anyone", "any advice", "any ideas", "urgent", "asap",
]
FUNCTION_WORDS = "a an the i am is are be been was were do does did my me mine your you it its this that these those of to for with at in on and or if when while as by from so but then there will would should can could have has had someone person age aged year years old how which what whom who doctor gave".split()

AGE_BEFORE = "aged am are of at turned a being is"
COMMON = 5  # a word this frequent is never taken for a slip on frequency alone
RATIO = 10  # a slip is corrected to a word at least this many times as frequent
LEAST_WORDS = 3  # words of the shortest span of the suffix array
LEAST_SPAN = 0.4  # of the shorter sequence's words, by all shared spans together
FEW, MANY, MOST = 3, 16, 32  # words without slips: keys of one word up to FEW and above MANY, keys of two words up to MOST
SPAN_ROWS = 100_000  # spans that leave a task at once
RUN = 2_000  # suffixes of one head that a task compares; longer runs are compared in blocks, two at a time
WINDOW = 16  # words of a suffix that are compared; longer spans are merged from overlapping windows


def _numbers() -> dict[str, str]:
    n = {w: str(i) for i, w in enumerate(UNITS)}
    for t, ten in enumerate(TENS, 2):
        n[ten] = str(10 * t)
        n |= {f"{ten} {UNITS[u]}": str(10 * t + u) for u in range(1, 10)}
    return n


def _phrases(table: dict[str, str]) -> re.Pattern:
    """One alternation of all keys as whole words, longer ones first."""
    return re.compile(r"(?<!\S)(?:" + "|".join(map(re.escape, sorted(table, key=len, reverse=True))) + r")(?!\S)")


_NUMBERS = _numbers()
_ABBREVIATED, _NUMBERED, _SYNONYM = _phrases(ABBREVIATIONS), _phrases(_NUMBERS), _phrases(SYNONYMS)
_COURTESY = _phrases(dict.fromkeys(COURTESIES, ""))
#: A lone 2 or 4 is a number only beside words that go with ages, else short for to and for.
_AGE_LIKE = r"(?<!\S)(?<!" + r" )(?<!".join(w for w in AGE_BEFORE.split()) + r" )({})(?!\S)(?! years?(?!\S))"
_TO, _FOR = re.compile(_AGE_LIKE.format(2)), re.compile(_AGE_LIKE.format(4))
_MARKS, _APART = re.compile("['’`´]"), re.compile(r"[\W_]+")


def plain_words(text: str | None) -> list[str]:
    """Words of the text in one form, apostrophes dropped."""
    return _APART.sub(" ", _MARKS.sub("", one_form(text, fold_case=True) or "")).split()


def respelled(text: str | None) -> list[str]:
    """Words with abbreviations and number words spelled out."""
    t = _ABBREVIATED.sub(lambda m: ABBREVIATIONS[m[0]], " ".join(plain_words(text)))
    t = _FOR.sub("for", _TO.sub("to", t))
    return _NUMBERED.sub(lambda m: _NUMBERS[m[0]], t).split()


def settled(words: list[str]) -> list[str]:
    """Corrected words with synonyms mapped and courtesies and function words removed."""
    t = _COURTESY.sub(" ", _SYNONYM.sub(lambda m: SYNONYMS[m[0]], " ".join(words)))
    return [w for w in t.split() if w not in _FUNCTION]


WORDS = T.ArrayType(T.StringType())
_FUNCTION = frozenset(FUNCTION_WORDS)
_COURTEOUS = frozenset(w for c in COURTESIES for w in c.split())


@F.pandas_udf(WORDS)
def _respelled(text: pd.Series) -> pd.Series:
    return text.map(respelled)


@F.pandas_udf(WORDS)
def _plain(text: pd.Series) -> pd.Series:
    return text.map(plain_words)


@F.pandas_udf(WORDS)
def _settled(words: pd.Series) -> pd.Series:
    return words.map(lambda w: settled(list(w)))


def _damaged(a: Column, b: Column) -> Column:
    """One slip apart: a letter more, less or other, or two neighbours swapped."""
    d = F.levenshtein(a, b)
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (d == 1) | swapped


def _shortened(word: Column) -> Column:
    """The word and all it becomes by loss of one letter."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cuts))


def vocabulary(words: DataFrame, clean: DataFrame) -> DataFrame:
    """word, fixed, known of each word of ``words(word)``.

    fixed is the word it is a slip of, or itself; known tells that it is a word of its own. ``clean(word)`` holds
    words of texts without slips; what is about as frequent there is never corrected. Counts cover all rows. Sizes
    estimated from the files know nothing of the words a text explodes into, so its joins are merge joins: by estimate
    Spark would send one side, which grows with the corpus, through the driver.
    """
    counts = (
        words.groupBy("word").agg(F.count("*").alias("n"))
        .join(clean.groupBy("word").agg(F.count("*").alias("c")).hint("merge"), "word", "left")
        .select("word", "n", F.coalesce("c", F.lit(0)).alias("c"))
        .withColumn("sure", (F.col("c") >= 2) & (2 * F.col("c") >= F.col("n")))
    )
    counts = cut(counts)
    slips = counts.where(~F.col("sure") & (F.length("word") >= 3) & ~F.col("word").rlike(r"\d")).select("word", "n", F.explode(_shortened(F.col("word"))).alias("key"))
    good = counts.where((F.col("n") >= COMMON) & (F.length("word") >= 3) & ~F.col("word").rlike(r"\d")).select(F.col("word").alias("fixed"), F.col("n").alias("m"), F.explode(_shortened(F.col("word"))).alias("key"))
    found = (
        slips.join(good.hint("merge"), "key").where((F.col("word") != F.col("fixed")) & (F.col("m") >= RATIO * F.col("n")) & _damaged(F.col("word"), F.col("fixed")))
        .groupBy("word").agg(F.max_by("fixed", F.struct("m", "fixed")).alias("fixed"))
    )
    known = F.col("sure") | (F.col("n") >= COMMON)
    return counts.join(found.hint("merge"), "word", "left").select("word", F.coalesce("fixed", "word").alias("fixed"), (known | F.col("fixed").isNotNull()).alias("known"))


def canonical(questions: DataFrame, clean_texts: DataFrame) -> DataFrame:
    """key, words, slips: the canonical sequence of each row of ``questions(key, text)`` and its (raw, corrected) slips.

    ``clean_texts(text)`` is the source of words that are no slips. Rows without a word are left out.
    """
    tokens = cut(questions.select("key", F.posexplode(_respelled("text")).alias("pos", "word")))
    vocab = vocabulary(tokens.select("word"), clean_texts.select(F.explode(_plain("text")).alias("word")))
    fixed = tokens.join(vocab.hint("merge"), "word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "fixed", "known"))).alias("t"))
    slips = F.array_distinct(F.transform(F.filter("t", lambda x: ~x["known"] | (x["word"] != x["fixed"])), lambda x: F.struct(x["word"].alias("raw"), x["fixed"].alias("fixed"))))
    return fixed.select("key", _settled(F.transform("t", lambda x: x["fixed"])).alias("words"), slips.alias("slips")).where(F.size("words") > 0)


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= (1 if min(len(a), len(b)) < 4 else 2)


def same_question(a: list[str], b: list[str], slips_a: dict[str, str], slips_b: dict[str, str]) -> bool:
    """Whether what isn't shared by two sequences is only slips: equal numbers, equal known words.

    slips map a word of the sequence to the raw word it was corrected from (unknown words to themselves). A word of
    one side only is excused if the other side holds a slip that resembles it, if it is itself a slip of a word of
    the other side or of a function word, or if it belongs to a greeting.
    """
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)

    def excused(w, own, other, rest):
        if w.isdigit():
            return False
        if w in _COURTEOUS or any(_alike(w, s) for s in other.values()):
            return True
        return w in own and (any(_alike(own[w], v) for v in rest) or any(len(f) > 2 and _alike(own[w], f) for f in FUNCTION_WORDS))

    return all(excused(w, slips_a, slips_b, right) for w in left) and all(excused(w, slips_b, slips_a, left) for w in right)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition of the suffix array, in order → (train class, evaluation class, places and length of a span).

    ``before`` is the word before a suffix, null at the start of a sequence or if not known. Suffixes with the same first words stand together, so any two of such a run share a span; its length is the
    least common prefix of neighbours between them. Two suffixes after the same word go on with a longer span, which is
    told where it begins; of a span over WINDOW words every next window is told too. How much of a pair the spans
    cover is asked of all together. Of a run of two blocks only pairs across them are told.
    """
    step = WINDOW - LEAST_WORDS

    def common(u, v):
        k = 0
        for x, y in zip(u, v, strict=False):
            if x != y:
                break
            k += 1
        return k

    def spans(run):
        heads, cls, place, suffixes, train, held, before, block = zip(*run, strict=True)
        across, block = heads[0][1] != heads[0][2], np.array(block)
        train, held, place = np.array(train), np.array(held), np.array(place)
        if not train.any() or not held.any():
            return
        name = np.unique(np.array(cls), return_inverse=True)[1]
        left = np.unique(np.array([w or f"\0{i}" for i, w in enumerate(before)]), return_inverse=True)[1]
        steps = np.array([common(u, v) for u, v in zip(suffixes, suffixes[1:], strict=False)])
        for x in range(len(run) - 1):
            y = slice(x + 1, len(run))
            begins = (left[y] != left[x]) | (place[x] % step == 0) | (place[y] % step == 0)
            told = begins & (name[y] != name[x]) & ((train[x] & held[y]) | (held[x] & train[y]))
            if across:
                told &= block[y] != block[x]
            if not told.any():
                continue
            lcp = np.minimum(np.minimum.accumulate(steps[x:]), WINDOW)
            for z in np.flatnonzero(told).tolist():
                o = x + 1 + z
                if train[x] and held[o]:
                    yield cls[x], cls[o], int(place[x]), int(place[o]), int(lcp[z])
                if train[o] and held[x]:
                    yield cls[o], cls[x], int(place[o]), int(place[x]), int(lcp[z])

    def all_spans():
        head, run = None, []
        for pdf in batches:
            none = [0] * len(pdf)
            heads = zip(pdf["head"], pdf.get("low", none), pdf.get("high", none), strict=True)
            for row in zip(heads, pdf["cls"], pdf["place"].tolist(), map(list, pdf["suffix"]), pdf["train"].tolist(), pdf["held"].tolist(), pdf.get("before", [None] * len(pdf)), pdf.get("block", none), strict=True):
                if row[0] != head:
                    if len(run) > 1:
                        yield from spans(run)
                    head, run = row[0], []
                run.append(row)
        if len(run) > 1:
            yield from spans(run)

    found = all_spans()
    while out := list(islice(found, SPAN_ROWS)):
        yield pd.DataFrame(out, columns=["a", "b", "pa", "pb", "n"])


def _apart(classes: DataFrame) -> DataFrame:
    """a, b of training and evaluation classes that slips may keep from sharing any span of LEAST_WORDS words.

    Of the words of a class that are no slips, only as many as the other class has slips may be missing there. With
    all words in one order, from rare to frequent, the two rarest shared ones therefore are among the first 2 + slips
    of each, which a join of such pairs of words finds; with one shared word it is among the first 1 + slips. Mismatches
    at d places leave spans of 2 words or less only in sequences of at most 3 d + 2 words.
    """
    c = classes.select("cls", "train", "held", "numbers", F.size("words").alias("size"), F.size("slips").alias("u"), F.array_except("words", F.transform("slips", lambda x: x["fixed"])).alias("clean"))
    w = c.select("cls", F.explode("clean").alias("word"))
    rank = w.join(w.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("r"))
    most = c.agg(F.coalesce(F.max("u"), F.lit(0)).alias("most"))
    keys = c.drop("clean").join(rank, "cls").crossJoin(F.broadcast(most)).withColumns({
        "ones": F.expr(f"if(size(r) <= {FEW} or size(r) > {MANY}, transform(slice(r, 1, 1 + most), (x, i) -> struct(x as key, 1 as m, i + 1 as at)), array())"),
        "twos": F.expr(f"if(size(r) between 2 and {MOST}, flatten(transform(slice(r, 2, 1 + most), (y, j) -> transform(slice(r, 1, j + 1), x -> struct(concat(x, ' ', y) as key, 2 as m, j + 2 as at)))), array())"),
    })
    keys = keys.select("cls", "train", "held", "numbers", "size", "u", F.explode(F.concat("ones", "twos")).alias("k")).select("cls", "train", "held", "numbers", "size", "u", "k.*")
    a, b = (keys.where(side).select("key", "m", "numbers", *(F.col(x).alias(x + y) for x in ("cls", "size", "u", "at"))) for side, y in (("train", "_a"), ("held", "_b")))
    may = "cls_a <> cls_b and u_a + u_b > 0 and at_a <= m + u_b and at_b <= m + u_a and least(size_a, size_b) <= 3 * (u_a + u_b) + 2"
    return a.join(b, ["key", "m", "numbers"]).where(may).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def in_order(a: list[str], b: list[str]) -> bool:
    """The words that two sequences share stand in one order and are LEAST_SPAN of the shorter one or more."""
    shared = Counter(a) & Counter(b)
    n = sum(shared.values())
    if n < LEAST_SPAN * min(len(a), len(b)):
        return False
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] == n


def split_of(split: Column) -> Column:
    """train, dev or test whatever the case and outer white space; null for anything else."""
    s = F.lower(F.regexp_replace(split, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s.isin("train", "dev", "test"), s)


def cross_split_pairs(records: DataFrame, id_col: str = "id", text_col: str = "question", clean_col: str = "ground_truth", split_col: str = "split") -> DataFrame:
    """id_a < id_b of each pair of a training and an evaluation record that ask the same.

    Records with null split, null id or a question without a word take no part. Repeated questions pair each.
    """
    r = records.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(clean_col).alias("clean"), split_of(F.col(split_col)).alias("split"))
    taking = r.where("key is not null and split is not null and text is not null")
    canon = canonical(taking.select("key", "text"), r.where("clean is not null").select(F.col("clean").alias("text")))
    members = canon.join(taking.select("key", (F.col("split") == "train").alias("is_train")).hint("merge"), "key").withColumn("cls", F.md5(F.array_join("words", " ")))
    members = cut(members)
    classes = members.groupBy("cls").agg(F.first("words").alias("words"), F.first("slips").alias("slips"), F.max("is_train").alias("train"), F.max(~F.col("is_train")).alias("held"))
    # same_question excuses no number, so all are equal in a pair that holds
    classes = classes.withColumn("numbers", F.array_join(F.array_sort(F.filter("words", lambda w: w.rlike("^[0-9]+$"))), " "))
    suffixes = classes.where(F.size("words") >= LEAST_WORDS).select(
        "cls", "train", "held", "numbers", F.size("words").alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - LEAST_WORDS + 1), lambda i: F.struct(F.slice("words", i, WINDOW).alias("suffix"), F.when(i > 1, F.element_at("words", F.greatest(i - 1, F.lit(1)))).alias("before")))).alias("place", "x")
    ).select("cls", "train", "held", "numbers", "size", "place", "x.suffix", "x.before")
    headed = suffixes.withColumn("head", F.concat_ws(" | ", "numbers", F.array_join(F.slice("suffix", 1, LEAST_WORDS), " ")))
    # a head with more suffixes than RUN is cut into blocks by class, and every two blocks are a run of their own
    hot = headed.groupBy("head").agg(F.ceil(F.count("*") / RUN).cast("int").alias("blocks")).where("blocks > 1")
    placed = headed.join(hot, "head", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    array = paired.repartition("head", "low", "high").sortWithinPartitions("head", "low", "high", "suffix", "cls", "place")
    spans = array.select("head", "low", "high", "block", "cls", "place", "suffix", "train", "held", "before").mapInPandas(_shared, "a string, b string, pa int, pb int, n int")
    cover = spans.groupBy("a", "b").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pa"), F.col("pa") + F.col("n") - 1))))).alias("covered"))

    @F.pandas_udf("boolean")
    def same(wa: pd.Series, wb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        as_map = lambda slips: {x["fixed"]: x["raw"] for x in slips}
        return pd.Series([same_question(list(a), list(b), as_map(x), as_map(y)) for a, b, x, y in zip(wa, wb, sa, sb, strict=True)], dtype=bool)

    ca, cb = classes.select(F.col("cls").alias("a"), F.col("words").alias("wa"), F.col("slips").alias("sa")), classes.select(F.col("cls").alias("b"), F.col("words").alias("wb"), F.col("slips").alias("sb"))
    @F.pandas_udf("boolean")
    def ordered(wa: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([in_order(list(a), list(b)) for a, b in zip(wa, wb, strict=True)], dtype=bool)

    near = cover.join(ca, "a").join(cb, "b").where((F.col("covered") >= LEAST_SPAN * F.least(F.size("wa"), F.size("wb"))) & same("wa", "wb", "sa", "sb")).select("a", "b")
    both = classes.where("train and held").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    apart = _apart(classes).join(ca, "a").join(cb, "b").where(same("wa", "wb", "sa", "sb") & ordered("wa", "wb")).select("a", "b")
    pairs = near.unionByName(apart).unionByName(both)
    train, held = members.where("is_train").select(F.col("cls").alias("a"), F.col("key").alias("ka")), members.where(~F.col("is_train")).select(F.col("cls").alias("b"), F.col("key").alias("kb"))
    return pairs.join(train, "a").join(held, "b").select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def overlap_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """split, source_type, records, overlapping: how many evaluation records of each split and source are also in training."""
    r = records.select("id", split_of(F.col("split")).alias("split"), F.col("provenance.source_type").alias("source_type")).where("split in ('dev', 'test')")
    hit = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("hit", F.lit(1))
    return r.join(hit, "id", "left").groupBy("split", "source_type").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
