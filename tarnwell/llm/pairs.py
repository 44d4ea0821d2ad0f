"""Flag prompt and response pairs that cannot serve as a question with its answer.

Each defective pair gets one defect: empty, refusal, copy, language or truncated, in this order. Language
compares the posteriors of prompt and response under a character n-gram naive Bayes model; truncation is a low
likelihood that the text ends after its last words, under word n-gram counts of sentence ends in all responses,
interpolated from the last word alone to longer contexts. Each distinct response counts once, so copies neither
add to the evidence nor take from it, and only shares and ratios decide, so the size of the tables doesn't.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.forms import one_form
from tarnwell.operators.search import topk
from tarnwell.session import cut

# Stand-ins for an answer, labels before a copied question, and ways to decline.
STAND_IN_TEXTS = {"n/a", "n.a.", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "todo", "unknown", "undefined", "missing", "empty", "blank", "placeholder", "pending", "no answer", "no response", "not available", "not applicable", "to be determined", "no answer provided", "no answer available", "answer missing", "keine antwort", "sin respuesta", "pas de réponse", "xxx", "lorem ipsum"}
COPY_LABELS = {"question", "q", "answer", "a", "user", "prompt", "query", "frage", "pregunta", "asked", "you", "the", "is", "your", "re"}

_ACT = r"(?:help|assist|answer|respond|reply|discuss|give|provide|offer|comment|advise|advice|support|complete|comply|continue|do (?:that|this)|talk|speak|share|address|engage|tell|say|recommend)"
REFUSAL = re.compile(
    "|".join(
        [
            rf"\b(?:i|we)(?: am|'m| are|'re)? (?:really |very |afraid i |afraid we )?(?:sorry,? but i |sorry,? i )?(?:can ?not|can't|could not|couldn't|will not|won't|would not|may not|must not|am unable to|'m unable to|am not able to|'m not able to|won't be able to|will not be able to|am not allowed to|am not permitted to|am not in a position to)\b[^.!?]{{0,25}}\b{_ACT}",
            rf"\b(?:i|we)(?:'m| am|'re| are) (?:unable|not able|not allowed|not permitted|not authori[sz]ed|not comfortable|not qualified|not in a position)\b[^.!?]{{0,40}}\b{_ACT}",
            r"\b(?:i|we) (?:must|have to|need to|would rather|prefer to) (?:decline|refuse|abstain)",
            r"\b(?:i|we) (?:respectfully )?(?:decline|refuse) to\b",
            r"\b(?:i|we) do(?: not|n't) feel comfortable\b",
            r"\bfalls? outside (?:of )?(?:what|the scope|my)\b|\bis (?:outside|beyond) (?:of )?(?:what i|my (?:scope|remit|abilities|competence))\b",
            r"^as an? (?:ai|assistant|language model|ai assistant|ai language model|chatbot)\b[^.!?]{0,60}\b(?:not|cannot|can't|unable|never)\b",
            r"^(?:i'm |i am )?sorry,? (?:but )?(?:i|we|this|that)\b[^.!?]{0,30}\b(?:can ?not|can't|won't|unable|not able|not allowed|declin)",
            r"\b(?:against|violates?) (?:my|our|the) (?:guidelines|policy|policies|rules)\b",
            r"^(?:lo siento|lamento)[^.!?]{0,20}\bno puedo\b|\bno puedo (?:ayudar|responder|contestar)|^(?:désolé|je suis désolé)[^.!?]{0,30}\bne (?:peux|puis)|\bje ne (?:peux|puis) pas (?:vous )?(?:aider|répondre)|^(?:es )?tut mir leid\b[^.!?]{0,40}\bnicht|\bich kann (?:ihnen |dir )?(?:dabei |hierbei )?(?:leider )?nicht (?:helfen|antworten)|dabei kann ich (?:leider )?nicht helfen",
        ]
    )
)

#: Whole sentences that only greet, thank, regret or refer to someone else.
COURTESY = re.compile(
    "|".join(
        [
            r"(?:hello|hi|hey|dear|good (?:morning|afternoon|evening|day))(?: [^\W\d_]+){0,3}",
            r"(?:many )?(?:thanks|thank you)(?: (?:so|very) much)?(?:,? (?:for|in advance)\b[^.!?:;]{0,80})?(?:,? but)?",
            r"(?:(?:i am|i'm|we are|we're) )?(?:so |very |really |terribly )?sorry(?:,? (?:to hear|about|for|that you)\b[^.!?:;]{0,80})?",
            r"(?:my |our |please accept (?:my|our) )?(?:sincere )?apologies(?: for\b[^.!?:;]{0,60})?|i apologi[sz]e(?: for\b[^.!?:;]{0,60})?|unfortunately|regrettably|i regret (?:this|that)",
            r"(?:(?:that|this)(?: is|'s) )?(?:an? )?(?:very |really )?(?:good|great|interesting|important|excellent|fair) question",
            r"(?:i|we) (?:fully |completely |do )?(?:understand|appreciate|hear)(?: (?:that|how|why|your?|this|the)\b[^.!?:;]{0,80})?",
            r"(?:i|we) (?:hope|wish)\b[^.!?:;]{0,60}|(?:please )?take care(?: of yourself)?|get well soon|all the best|(?:kind|best) regards|i hope you understand|thank you for (?:your )?understanding",
            r"(?:so |instead,? |therefore,? )?(?:please|kindly|you (?:should|may|can|could|might)|i (?:suggest|recommend|advise)(?: that)?(?: you)?)(?: instead| rather)? (?:to )?(?:see(?:k|ing)?|consult(?:ing)?|ask(?:ing)?|contact(?:ing)?|speak(?:ing)?|talk(?:ing)?|turn(?:ing)?|call(?:ing)?|visit(?:ing)?|check(?:ing)?)\b[^.!?:;]{0,30}\b(?:doctor|physician|gp|professional|pharmacist|nurse|specialist|provider|clinic|expert|team|emergency (?:services|number)|medical advice|someone (?:else|qualified))\b[^.!?:;]{0,40}",
            r"(?:a|an|your|the) (?:[^\W\d_]+ )?(?:doctor|physician|gp|professional|pharmacist|nurse|specialist|provider|expert) (?:can|could|will|may|might|would) (?:be able to )?(?:help|advise|assist|answer)\b[^.!?:;]{0,40}",
            r"(?:is there anything else|can i help you with|let me know if|feel free to ask)\b[^.!?:;]{0,60}",
            r"(?:muchas )?gracias(?: por\b[^.!?:;]{0,60})?|lo siento(?: mucho)?|(?:por favor,? )?consulte\b[^.!?:;]{0,60}|hola|buenos días|merci(?: beaucoup)?(?: (?:pour|de)\b[^.!?:;]{0,60})?|(?:je suis )?désolée?|bonjour|veuillez consulter\b[^.!?:;]{0,60}|(?:vielen )?dank(?:e)?(?: für\b[^.!?:;]{0,60})?|(?:es )?tut mir leid|guten tag|hallo|bitte (?:fragen|wenden)\b[^.!?:;]{0,60}",
        ]
    )
)

#: Words that never end a phrase, for bare phrases, whose ends no sentence shows.
OPEN_WORDS = frozenset(
    "a an the and or but nor of to for with from at by into onto than that which who whose whom because so if when while although unless until since as such is are was were be been being has have had may might must can could shall should will would "
    "do does did not very more most their your his her its my our this these those every each some any between about both either neither before after during under over "
    "el la los las un una de del y o que con por para sin sobre su sus se al en como si cuando porque le les des du au aux et ou qui avec pour sans sur son sa ses dans par comme quand ne pas très "
    "der die das den dem des ein eine einen einem einer und oder aber dass wenn weil mit von für ohne über unter zwischen nach vor bei ist sind wird werden hat haben sehr и или что с в на по для из от к у о ο η το και με σε για από".split()
)
OPEN_MARKS = frozenset(",;:…")  # marks that announce that the text goes on
SHORT = 7  # words up to which an answer of one clause may be a bare phrase
HEAD = 3  # words that tell how a sentence begins
OPENING = 0.9  # words open a sentence if this share of their places are beginnings of sentences longer than SHORT
FRAGMENT = 3  # a cut word is rarer at ends than the word it begins by this factor
RARE = 10  # and inside of sentences by this factor

END_SHARE = 0.03  # a text is truncated if it is less likely than this to end after its last words
PRIOR = 6  # places that the likelihood under a shorter context counts as
ORDER = 4  # words of the longest context
MODEL_DOCS = 20_000  # labelled documents the language model is fitted on, at most
MODEL_GRAMS = 30_000  # of each language, the most frequent
MARGIN_ANSWER, MARGIN_QUESTION = 6.0, 3.0  # log odds that the two languages must differ by

_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[.,;:!?…]")


def is_empty(answer: str | None) -> bool:
    """No answer: null, nothing visible, only marks, or a stand-in."""
    t = (one_form(answer, fold_case=True) or "").strip()
    bare = t.strip("[](){}<>\"'*_ .…-–—")
    return not re.search(r"[^\W_]", t) or t in STAND_IN_TEXTS or bare in STAND_IN_TEXTS


def is_refusal(answer: str) -> bool:
    """The first sentence declines to answer, or a later one does and all others are courtesy or referral."""
    t = (one_form(answer, fold_case=True) or "").replace("’", "'").strip()
    sentences = _SENTENCE.split(t)
    if REFUSAL.search(sentences[0]):
        return True
    declines = False
    for s in sentences:
        if COURTESY.fullmatch(s.strip(" .,!?…-")):
            continue
        if not REFUSAL.search(s):
            return False
        declines = True
    return declines


def is_copy(question: str | None, answer: str) -> bool:
    """The words of the answer, without labels, are those of the question and most of them."""
    # the micro sign in capitals looks like an M
    words = lambda s: re.findall(r"[^\W_]+", (one_form(s, fold_case=True) or "").replace("μ", "m"))
    q, a = words(question or ""), words(answer)
    if len(q) < 3 or not a:
        return False
    have, extra = Counter(q), 0
    rest = [w for w in a]
    shared = 0
    for w in rest:
        if w in have:
            shared += 1
        elif w not in COPY_LABELS:
            extra += 1
    return extra == 0 and len(set(a) & set(q)) >= 0.7 * len(set(q)) and shared >= 3


def _grams(text: str) -> list[str]:
    t = re.sub(r"[\W\d_]+", " ", f" {one_form(text, fold_case=True) or ''} ")
    return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]


def language_model(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = MODEL_DOCS) -> dict:
    """Naive Bayes over character n-grams: {language: (log prior, {gram: log probability}, log probability unseen)}.

    Fitted on at most ``sample`` distinct labelled texts, those of the smallest hashes, with the label most copies have;
    labels are folded and their suffix dropped. Counts are formed in Spark; the grams that are among the ``MODEL_GRAMS``
    most frequent of any language come to the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            for t, lang in zip(pdf["text"], pdf["lang"], strict=True):
                total[lang].update(_grams(t))
        rows = [(lang, g, n) for lang, c in total.items() for g, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    lang = F.lower(F.regexp_extract(F.col(lang_col), r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1))
    labelled = documents.select(F.col(text_col).alias("text"), lang.alias("lang")).where("text is not null and lang <> ''").withColumn("h", F.xxhash64("text"))
    last = labelled.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("last"))
    rows = labelled.join(F.broadcast(last), F.col("h") <= F.col("last")).groupBy("h").agg(F.first("text").alias("text"), F.mode("lang", True).alias("lang"))
    counted = cut(rows.repartition(12, "text").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    keep = topk(counted, "lang", MODEL_GRAMS, F.desc("n"), F.asc("gram")).select("gram").distinct()
    model: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted.join(keep, "gram").toLocalIterator():
        model[r.lang][r.gram] = r.n
    model = {k: v for k, v in model.items() if sum(v.values()) >= 1000}
    size = len({g for v in model.values() for g in v}) or 1
    out = {}
    for k, v in model.items():
        total = sum(v.values()) + 0.5 * size
        out[k] = ({g: log((n + 0.5) / total) for g, n in v.items()}, log(0.5 / total))
    return out


def log_odds(model: dict, text: str | None) -> dict[str, float]:
    """Log posterior of each language, shifted so that the best is 0; n-grams overlap, so a third of the sum counts."""
    grams = _grams(text) if text else []
    scores = {k: sum(table.get(g, unseen) for g in grams) / 3 for k, (table, unseen) in model.items()}
    best = max(scores.values(), default=0.0)
    return {k: s - best for k, s in scores.items()}


def other_language(model: dict, question: str | None, answer: str | None) -> bool:
    """Both texts speak clearly for different languages."""
    if len(model) < 2 or not question or not answer:
        return False
    q, a = log_odds(model, question), log_odds(model, answer)
    lq, la = max(q, key=q.get), max(a, key=a.get)
    return lq != la and -q[la] >= MARGIN_QUESTION and -a[lq] >= MARGIN_ANSWER


def _tokens(text: str) -> list[str]:
    t = (one_form(text, fold_case=True) or "").rstrip("\"'”’)] ").replace("...", "…")
    return ["#" if w[0].isdigit() else w for w in _TOKEN.findall(t)]


def contexts(text: str) -> tuple[list[tuple[str, int]], list[str], list[str]]:
    """((context, ends) of every place before the last), contexts of an open end, and of the place before it.

    A context is the last one to ORDER tokens of a sentence so far, with its start as a token. The end is open
    if no mark of a sentence end closes the text, else both are empty. Places where a text simply stops are no
    evidence of an end.
    """
    seen: list[tuple[str, int]] = []
    sentence = ["<s>"]
    tokens = _tokens(text)
    for i, w in enumerate(tokens):
        if w in ".!?":
            sentence = ["<s>"]
            continue
        sentence.append(w)
        if i + 1 < len(tokens):
            end = tokens[i + 1] in ".!?"
            seen += [(c, int(end)) for c in _context(sentence)]
    seen += [(h, 0) for s in _sentences(tokens) if len(s) > SHORT for h in _heads(s)]
    return seen, _context(sentence) if len(sentence) > 1 else [], _context(sentence[:-1]) if len(sentence) > 2 else []


def _context(sentence: list[str]) -> list[str]:
    """The contexts of a place, from weak to strong: the last word, what precedes any last word, then longer ones."""
    wild = [" ".join([*sentence[-n:-1], "*"]) for n in (2, 3) if len(sentence) >= n]
    exact = [" ".join(sentence[-n:]) for n in range(2, min(ORDER, len(sentence)) + 1)]
    return [sentence[-1], *wild, *exact]


def _sentences(tokens: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in tokens:
        if w in ".!?":
            out.append([])
        else:
            out[-1].append(w)
    return out


def _heads(sentence: list[str]) -> list[str]:
    """The first 2 to HEAD words of a sentence, marked as its beginning."""
    return ["^ " + " ".join(sentence[:n]) for n in range(2, min(HEAD, len(sentence)) + 1)]


BASE = "src string, rec_id string, defect string, pair long, head string, seen array<struct<context:string,ends:int>>, last array<string>, before array<string>, open boolean, brief boolean"


def defects(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """src, rec_id, defect of the defective rows of ``pairs(src, rec_id, question, answer, blocked)``.

    ``documents(text, lang)`` is labelled text for the language model. Where ``blocked`` a missing answer and a
    refusal are in order. A null question only rules out copy and language. Repeated pairs are flagged each.
    """
    spark = pairs.sparkSession
    model = spark.sparkContext.broadcast(language_model(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for src, rid, q, a, blocked, first, pair in zip(pdf["src"], pdf["rec_id"], pdf["question"], pdf["answer"], pdf["blocked"], pdf["first"].tolist(), pdf["pair"].tolist(), strict=True):
                q, a = (x if isinstance(x, str) else None for x in (q, a))
                defect, head, seen, last, before, opened, brief = None, None, [], [], [], False, False
                if is_empty(a):
                    defect = "sound" if blocked else "empty"
                elif is_refusal(a):
                    defect = "sound" if blocked else "refusal"
                elif is_copy(q, a):
                    defect = "copy"
                elif other_language(model.value, q, a):
                    defect = "language"
                if defect in (None, "language"):
                    seen, last, before = contexts(a)
                    tokens = _tokens(a)
                    brief = len(tokens) <= SHORT and not any(t in ".!?" for t in tokens)
                    opened = bool(tokens) and (tokens[-1] in OPEN_MARKS or brief and tokens[-1] in OPEN_WORDS)
                    head = (_heads(tokens) or [None])[-1] if brief else None
                if defect is not None:
                    last, before = [], []
                if not first:
                    seen = []
                rows.append((src, rid, defect, pair, head, seen, last, before, opened and defect is None, brief))
            yield pd.DataFrame(rows, columns=["src", "rec_id", "defect", "pair", "head", "seen", "last", "before", "open", "brief"])

    # one row stands for all rows that answer the same; only keys are grouped, with a partial aggregation before the shuffle
    key = ["src", "rec_id"]
    once = pairs.groupBy(F.xxhash64(F.lower(F.trim("answer")))).agg(F.min(F.struct(*key)).alias("k")).select("k.*", F.lit(True).alias("first"))
    pair = F.xxhash64(F.lower(F.trim("question")), F.lower(F.trim("answer"))).alias("pair")
    flagged = pairs.select(*key, "question", "answer", "blocked", pair).join(once, key, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    base = cut(flagged.mapInPandas(run, BASE))
    counts = cut(base.select(F.explode("seen").alias("x")).groupBy("x.context").agg(F.count("*").alias("n"), F.sum("x.ends").alias("e")))
    single = ~F.col("context").contains(" ")
    anywhere = counts.where(single).agg((F.coalesce(F.sum("e"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("p0"))

    open_end = base.where(F.col("defect").isNull() & (F.size("last") > 0)).select(*key, "pair", "head", "last", "before", "brief")
    places = open_end.select(*key, "pair", F.lit(1).alias("kind"), F.posexplode("last").alias("order", "context")).unionByName(open_end.select(*key, "pair", F.lit(0).alias("kind"), F.posexplode("before").alias("order", "context")))
    scored = places.join(counts, "context", "left").fillna(0, ["n", "e"])
    steps = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("order", "n", "e"))))
    likely = lambda c: F.aggregate(c, F.col("p0"), lambda p, x: (x["e"] + PRIOR * p) / (x["n"] + PRIOR))
    ends = (
        scored.groupBy(*key).agg(steps(1).alias("s1"), steps(0).alias("s0"), F.max(F.when((F.col("kind") == 1) & (F.col("order") == 0), F.col("n"))).alias("last_seen"))
        .crossJoin(F.broadcast(anywhere)).select(*key, likely(F.col("s1")).alias("p"), likely(F.col("s0")).alias("p_before"), "last_seen")
    )
    # a last word that is rare beside a word that it begins is itself cut, unless too many different pairs end in it
    odd = scored.where((F.col("kind") == 1) & (F.col("order") == 0) & (F.length("context") >= 3)).select(*key, "pair", "context", "n")
    ending = odd.groupBy("context").agg(F.countDistinct("pair").alias("pairs"), F.max("n").alias("inside"))
    lengths = F.sequence(F.lit(3), F.length("context") - 2)
    begun = counts.where(single & (F.length("context") >= 5)).select(F.explode(F.transform(lengths, lambda i: F.substring(F.col("context"), F.lit(1), i))).alias("context"), "n").groupBy("context").agg(F.max("n").alias("known"))
    fragments = ending.join(begun, "context").where((F.col("known") >= FRAGMENT * F.col("pairs")) & (F.col("known") >= RARE * F.col("inside")) & (F.col("known") > FRAGMENT - 1)).select("context")
    cut_word = odd.join(fragments, "context", "left_semi").select(*key, F.lit(True).alias("cut_word"))
    # a brief answer is a bare phrase, unless its first words are found where longer sentences begin and hardly elsewhere
    heads = open_end.where("head is not null").select("head").distinct()
    starts = heads.join(counts.select(F.col("context").alias("head"), F.col("n").alias("starts")), "head").withColumn("phrase", F.expr("substring(head, 3)"))
    opening = starts.join(counts.select(F.col("context").alias("phrase"), F.col("n").alias("anywhere")), "phrase").where(F.col("starts") >= OPENING * (F.col("anywhere") + 1)).select("head", F.lit(True).alias("opening"))
    unlikely = (F.col("p") < END_SHARE) | ((F.col("last_seen") == 0) & (F.coalesce("p_before", F.lit(0.0)) < END_SHARE))
    broken = (
        open_end.join(ends, key, "left").join(cut_word, key, "left").join(opening, "head", "left")
        .where(F.col("cut_word").isNotNull() | ((~F.col("brief") | F.col("opening").isNotNull()) & unlikely))
        .select(*key)
    )
    broken = broken.unionByName(base.where("open").select(*key)).distinct().select(*key, F.lit("truncated").alias("defect"))
    return base.where("defect is not null and defect <> 'sound'").select(*key, "defect").unionByName(broken)


def question_answer_pairs(rag: DataFrame, robustness: DataFrame) -> DataFrame:
    """src, rec_id, question, answer, blocked of both tables; rows without an id are left out."""
    blocked = F.coalesce(F.lower(F.trim("expected_behavior")) == "block", F.lit(False)).alias("blocked")
    a = rag.select(F.lit("tier3_rag").alias("src"), F.col("id").alias("rec_id"), F.col("user_input").alias("question"), F.col("reference").alias("answer"), blocked)
    b = robustness.select(F.lit("tier5_robustness").alias("src"), F.col("id").alias("rec_id"), "question", F.col("ground_truth").alias("answer"), blocked)
    return a.unionByName(b).where("rec_id is not null")
