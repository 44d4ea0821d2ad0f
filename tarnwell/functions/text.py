"""Column expressions over text: tokenisers, predicates, prefixes and lexical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the guardrail, heading and question predicates.
BLOCK_PHRASES = ["synthesize meth", "make bomb", "illicit drug synthesis", "how to kill", "suicide method", "fatal dose"]
HIGH_RISK_PHRASES = ["dosage adjustment", "insulin dose", "warfarin dose", "stop medication"]
EXCLUDED_HEADINGS = ["references", "bibliography", "table of contents", "contents", "index", "glossary", "glossary of terms", "abbreviations", "acknowledgements", "acknowledgments", "appendix", "list of figures", "list of tables", "works cited", "literature cited"]
EXCLUDED_PREFIXES = ["references", "further reading", "bibliography", "table of contents", "glossary", "abbreviations", "acknowledgements", "acknowledgments", "appendix", "list of figures", "list of tables"]
COMPOUND_PATTERNS = [
    r"\band\b.*\b(?:what|how|why|when|which|compare|explain|describe)\b",
    r"\b(?:compare|contrast|difference between)\b",
    r"\b(?:also|additionally|furthermore)\b",
    r"(?:1\.|2\.|a\)|b\))",
    r"^(?:what|how|why|when|which)\b.*\band\b",
]
SPLIT_CONJUNCTIONS = r"\b(?:and also|and what|and how|and explain|and describe|and compare)\b"
CROSS_REFERENCES = {
    "chapter": r"\bchapter\s+([\d]+(?:\.\d+)*)",
    "section": r"\bsection\s+([\d]+(?:\.\d+)*)",
    "table": r"\btable\s+([\d]+(?:\.\d+)*)",
    "figure": r"\bfigure\s+([\d]+(?:\.\d+)*)",
    "appendix": r"\bappendix\s+([a-zA-Z\d]+(?:\.\d+)*)",
}
FACT_PATTERNS = {  # key: (pattern, group of the value, confidence)
    "age": (r"\b(i am|i'm)\s+(\d{1,3})\b", 2, 0.9),
    "allergy": (r"allerg(y|ic)\s+to\s+([a-z\s-]+)", 2, 0.85),
    "condition": (r"i have\s+([a-z0-9\s-]{3,40})", 1, 0.65),
}
LABELS = ["warning", "note", "caution", "important", "tip", "example", "dosage note"]
CAVEATS = {
    "hallucination": "\n\n⚠️ *Note: parts of this answer may not be fully supported by the retrieved medical sources. Please verify with a qualified healthcare professional.*",
    "unsafe": "\n\n⚠️ *Warning: this answer may contain unsupported or potentially unsafe medical information. Please consult a qualified healthcare professional before acting on it.*",
}
TRUE_WORDS = ["true", "1", "yes"]
FAILURES = ["none", "irrelevant", "hallucination", "incomplete", "unsafe"]
CITATION_MARKERS = ["\n\nSource:", "\n\n**Sources:**", "\n\n[Source:"]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def query_terms(text: Column) -> Column:
    """Terms of a keyword query: lower case, ASCII letters and digits only, longer than two characters."""
    return F.filter(F.transform(_words(F.lower(text)), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) > 2)


def document_terms(text: Column) -> Column:
    """Terms of a document in keyword search: lower case, punctuation kept, longer than two characters."""
    return F.filter(_words(F.lower(text)), lambda w: F.length(w) > 2)


def rerank_terms(text: Column) -> Column:
    """Terms of reranking: punctuation becomes white space; letters of every script count."""
    return F.filter(_words(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", " "))), lambda w: F.length(w) > 2)


def judge_terms(text: Column) -> Column:
    """Set of ASCII letter and digit runs longer than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 2))


def word_set(text: Column) -> Column:
    return F.array_distinct(_words(F.lower(text)))


def topic_terms(text: Column) -> Column:
    """Set of runs of ASCII letters and digits of at least three characters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 3))


def token_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(_words(text))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(s, 1, 50)


def heading_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def is_excluded_heading(text: Column) -> Column:
    k = heading_key(text)
    return k.isin(EXCLUDED_HEADINGS) | k.rlike("^(?:" + "|".join(EXCLUDED_PREFIXES) + ") ")


def is_multi_part(question: Column) -> Column:
    """At least one sign of a compound question and at least eight words."""
    hits = sum((question.rlike("(?i)" + p).cast("int") for p in COMPOUND_PATTERNS), F.lit(0))
    return F.coalesce((hits >= 1) & (token_count(question) >= 8), F.lit(False))


def sub_questions(question: Column) -> Column:
    """Parts of a compound question, each with one question mark; anything else stays whole."""
    parts = F.filter(F.transform(F.split(question, "(?i)" + SPLIT_CONJUNCTIONS), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\?+$", ""))), lambda p: p != "")
    whole = F.array(question)
    return F.when(~is_multi_part(question) | (F.size(parts) <= 1), whole).otherwise(F.transform(parts, lambda p: F.concat(p, F.lit("?"))))


def guardrail(text: Column) -> tuple[Column, Column]:
    """(blocked, risk level)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    blocked = t.rlike("|".join(BLOCK_PHRASES))
    return blocked, F.when(blocked | t.rlike("|".join(HIGH_RISK_PHRASES)), "high").otherwise("low")


def cross_references(text: Column) -> Column:
    """Distinct type_number strings of references to chapters, sections, tables, figures and appendices."""
    low = F.lower(text)

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(low, F.lit(pattern), 1), lambda m: F.concat(F.lit(f"{kind}_"), F.replace(m, F.lit("."), F.lit("_"))))

    return F.array_distinct(F.concat(*[found(kind, rx) for kind, rx in CROSS_REFERENCES.items()]))


def context_prefix(page: Column, title: Column, section: Column, caption: Column | None = None) -> Column:
    """``[p.N] title > section | caption`` of the parts that are there."""
    path = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    head = F.concat_ws(" ", F.when(page.isNotNull(), F.concat(F.lit("[p."), page.cast("string"), F.lit("]"))), F.nullif(path, F.lit("")))
    return head if caption is None else F.concat_ws(" | ", F.nullif(head, F.lit("")), F.nullif(caption, F.lit("")))


def without_citations(text: Column) -> Column:
    """The text before the first marker, in the order of the markers, that occurs in it."""
    out = text
    for m in reversed(CITATION_MARKERS):
        out = F.when(F.contains(text, F.lit(m)), F.substring_index(text, m, 1)).otherwise(out)
    return out


def preview(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def recall(left: Column, right: Column) -> Column:
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(0.0)


def f1(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    return F.when(both > 0, 2.0 * both / (F.size(left) + F.size(right))).otherwise(0.0)


def extracted_facts(text: Column) -> Column:
    """array<struct<key, value, confidence>> of age, allergy and condition that a message states."""
    t = F.lower(text)

    def fact(key: str, pattern: str, group: int, confidence: float) -> Column:
        value = F.trim(F.regexp_extract(t, pattern, group))
        return F.when(value != "", F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(confidence).alias("confidence")))

    return F.array_compact(F.array(*[fact(key, *rule) for key, rule in FACT_PATTERNS.items()]))


def json_object(text: Column, schema: str) -> Column:
    """The text parsed as JSON, else its outermost braces; null if neither parses."""
    whole = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), schema)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(whole, F.from_json(F.when(F.try_parse_json(inner).isNotNull(), inner), schema))


def json_array(text: Column, element: str) -> Column:
    """The text, without a code fence, parsed as a JSON array, else its outermost brackets; one object makes an array of one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"```\s*$", ""))

    def parsed(c: Column) -> Column:
        ok = F.when(F.try_parse_json(c).isNotNull(), F.trim(c))
        many = F.from_json(F.when(F.startswith(ok, F.lit("[")), ok), f"array<{element}>")
        return F.coalesce(many, F.when(F.startswith(ok, F.lit("{")), F.array(F.from_json(ok, element))))

    return F.coalesce(parsed(bare), parsed(F.regexp_extract(bare, r"(?s)(\[.*\])", 1)), F.array().cast(f"array<{element}>"))


def clamped(value: Column, default: float) -> Column:
    """A number, also as text, within 0 and 1; what is no number becomes ``default``."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(F.lit(default))


def truthy(value: Column) -> Column:
    """true, 1 and yes, whatever the case and outer white space."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def blank_to_empty(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def judgement(raw: Column) -> Column:
    """struct<failure_category, confidence, grounding_score, suggested_focus> of a judge's JSON reply.

    A reply without a category has one by its flags: hallucination before irrelevant. An unknown category is none.
    """
    r = json_object(raw, "failure_category string, is_relevant string, has_hallucinations string, confidence string, grounding_score string, suggested_focus string")
    flagged = F.when(truthy(r["has_hallucinations"]), "hallucination").when(~truthy(F.coalesce(r["is_relevant"], F.lit("true"))), "irrelevant").otherwise("none")
    named = F.lower(F.trim(r["failure_category"]))
    category = F.when(r["failure_category"].isNull(), flagged).when(named.isin(FAILURES), named).otherwise("none")
    return F.struct(category.alias("failure_category"), clamped(r["confidence"], 0.0).alias("confidence"), clamped(r["grounding_score"], 1.0).alias("grounding_score"), blank_to_empty(r["suggested_focus"]).alias("suggested_focus"))


def with_caveat(answer: Column, failure: Column) -> Column:
    """The answer with the note that belongs to a failure, once; other failures leave it as it is."""
    out = answer
    for kind, note in CAVEATS.items():
        out = F.when((failure == kind) & ~F.contains(answer, F.lit(note)), F.concat(answer, F.lit(note))).otherwise(out)
    return out


def is_fake_heading(text: Column) -> Column:
    """Over 150 characters, ending like a sentence, or a label such as ``Note:``."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    label = F.lower(t).rlike("^(?:" + "|".join(LABELS) + ") ?:")
    return F.coalesce((t != "") & ((F.length(t) > 150) | t.rlike("[.;]$") | label), F.lit(False))


def path_template(path: Column) -> Column:
    """A request path with the session id replaced, so that paths can be counted."""
    return F.regexp_replace(path, r"/api/session/[^/]+", "/api/session/{id}")


def embedding_prefix(section: Column, caption: Column | None = None) -> Column:
    """``section | caption``: a section that only says Document is left out, the caption cut to 120 characters."""
    part = F.when((section != "Document") & (section != ""), section)
    return F.concat_ws(" | ", part) if caption is None else F.concat_ws(" | ", part, F.nullif(F.trim(F.substring(caption, 1, 120)), F.lit("")))


def embedding_text(explicit: Column, prefix: Column, raw: Column, summary: Column | None = None) -> Column:
    """The explicit text if there is one, else prefix and raw text; a summary goes before either as its context."""
    base = F.coalesce(F.nullif(explicit, F.lit("")), F.concat_ws("\n", F.nullif(prefix, F.lit("")), raw))
    return base if summary is None else F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("[Context: "), summary, F.lit("]\n"), base)).otherwise(base)


def overlap_ratio(query: Column, document: Column) -> Column:
    return F.size(F.array_intersect(query, document)) / F.greatest(F.size(query), F.lit(1))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``b``, of more than two characters, that ``a`` has; 0 without such words."""
    wa, wb = (F.array_distinct(document_terms(c)) for c in (a, b))
    return F.when(F.size(wb) > 0, F.size(F.array_intersect(wa, wb)) / F.size(wb)).otherwise(0.0)


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that stand in the answer, whatever the case; 0 without keywords."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(0.0)


def context_precision(question: Column, answer: Column, contexts: Column) -> Column:
    """Share of the contexts with a word of question or answer; 0 without contexts."""
    wanted = F.array_union(judge_terms(question), judge_terms(answer))
    # null members count as empty contexts
    hits = F.size(F.filter(contexts, lambda c: F.arrays_overlap(judge_terms(c), wanted)))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, hits / F.size(contexts)).otherwise(0.0)


def order_kept(first: Column, more: Column) -> Column:
    """Both arrays as one, each element where it comes first."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))))


def iso_time(ts: Column) -> Column:
    """ISO 8601 with microseconds if there are any."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def turn_summary(question: Column, facts: Column, answer: Column) -> Column:
    """What an episode keeps of a turn: 200 characters of the question, the facts as key=value, 300 of the answer."""
    listed = F.array_join(F.transform(facts, lambda f: F.concat(f["key"], F.lit("="), f["value"])), ", ")
    return F.concat(F.lit("User asked: "), F.substring(question, 1, 200), F.lit("\nKey facts mentioned: "), listed, F.lit("\nAnswer summary: "), F.substring(answer, 1, 300))


def contexts_of(*candidates: Column) -> Column:
    """The first of the arrays that has a text, its texts trimmed and blank ones left out; an empty array if none has."""
    clean = [F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "") for c in candidates]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in clean], F.array().cast("array<string>"))
