"""Find and repair the traces that scanning leaves in text.

Running titles and chapter lines are recognised by fuzzy repetition over the corpus and by standing inside a
sentence, page numbers by their shape between lines of prose and by the sequence of numbers in their document.
Words cut at a line end are joined if the corpus vocabulary prefers the joined spelling to the hyphenated one, and
a misread word is one that becomes a much more frequent word when letters are put back that scanners confuse. All
counts cover the whole corpus. One decision a line serves both the report and the repair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.session import cut

# What scanners read (left) for what is printed (right).
SYMBOLS = {"0": "o", "1": "li", "!": "il", "@": "a", "5": "s", "6": "b", "9": "g", "$": "s", "3": "e", "8": "b", "|": "li", "7": "t", "4": "a", "£": "e", "€": "e"}
LETTERS = {
    "c": "e", "ri": "n", "l": "i", "f": "t", "cl": "d", "ii": "u", "rn": "m", "b": "h", "vv": "w", "nn": "m", "li": "h", "e": "c", "n": "u", "u": "n", "i": "l", "t": "f",
    "h": "b", "m": "rn", "d": "cl", "q": "g", "g": "q", "o": "c", "a": "o", "v": "y", "y": "v", "in": "m", "ni": "m", "lc": "k", "tl": "d", "fi": "h", "j": "i", "z": "2",
}
PLAUSIBLE = "c ri l f cl ii rn b vv".split()  # the usual ones; the rest need a higher ratio
CUT_MARKS = "-‐‑¬­"
SMALL_WORDS = "of to and in on the for a an with at by from de la le des du der die und y el".split()

SYMBOL_RATIO, USUAL_RATIO, RARE_RATIO = 2, 15, 60
LEAST_REPEATS = 3
LONGEST_WORD = 200  # letters; no longer string is a word of a language
LEAST_SEQUENCE = 3  # page numbers of a document that show how they follow its pages
BROADCAST_WORDS = 200_000  # misread words of some 40 letters that are broadcast at most, some 20 MB

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_PAGE = re.compile(r"^[\s\-–—\[\](){}|*~·•.:=<>_]*(?:(?:page|pages|pag|pg|p|seite|s|página|стр|σελ)\b\.?\s*)?(\d{1,4})(?:\s*(?:of|/|von|de|sur|из)\s*\d{1,4})?[\s\-–—\[\](){}|*~·•.:=<>_]*$", re.I)
_BARE = re.compile(r"^\s*\d{1,4}\s*$")
_CHAPTER = re.compile(r"^(?:\d{1,4}\s*[|·–—-]?\s*)?(?:chapter|chap\.|part|kapitel|chapitre|capítulo)\s+(?:\d{1,3}|[ivxlc]+)\b(?!.*[.;:?!]$)", re.I)
_EDITION = re.compile(r"\b\d{1,2}(?:st|nd|rd|th)\s+(?:revised\s+)?edition\b|\b(?:first|second|third|fourth|fifth)\s+edition\b", re.I)
_TOKEN = re.compile(r"[^\W_](?:[\w!@$|]*[\w@$|])?|[!@][^\W_][\w!@$|]*|[!@]", re.UNICODE)
_COMPOUND = re.compile(r"(?<![^\W_])[^\W_]++(?:[-‑][^\W_]++)++")
_WORD_START = re.compile(r"\s*([^\W_A-Z][\w!@$|]*)")

SCAN = (
    "src string, rec_id string, part int, doc string, at int, numbers array<struct<line:int,value:int,bare:boolean>>, heads array<struct<line:int,key:string,inside:boolean,sure:boolean>>, "
    "cuts array<struct<joined:string,spelled:string,first:string,rest:string,hyphen:boolean>>, words array<string>"
)


def head_key(line: str) -> str:
    """A line's letters in a form in which case, numbers, marks and confused letters don't count."""
    t = re.sub(r"\b\d{1,2}(?:st|nd|rd|th)\s+(?:revised\s+)?edition\b", " ", line.lower())
    t = re.sub(r"(?<=[a-z])[!|](?=[a-z])", "i", t).replace("@", "a")
    t = re.sub(r"(?<=[a-z])\d|\d(?=[a-z])", lambda m: SYMBOLS.get(m[0], m[0])[0], t)
    t = re.sub(r"[\W\d_]+", " ", t).strip()
    t = t.replace("vv", "w").replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("ri", "n")
    return t.translate(str.maketrans("cflb", "etih"))


def _cut_word(line: str) -> tuple[int, int, str] | None:
    """(start, end, mark) of the word that a mark at the line's end cuts."""
    bare = line.rstrip()
    if not bare or bare[-1] not in CUT_MARKS:
        return None
    end = len(bare) - 1
    if end and bare[end - 1].isspace():
        return None
    start = end
    while start and (bare[start - 1].isalnum() or bare[start - 1] in "_!@$|-‑"):
        start -= 1
    while start < end and bare[start] in "-‑":
        start += 1
    return (start, end, bare[-1]) if start < end else None


def _is_prose(line: str) -> bool:
    return len(line.split()) >= 4


def _ends(line: str) -> bool:
    return line.rstrip()[-1:] in ".!?:;|"


def _title_like(line: str) -> bool:
    """Short, without an end mark, every word but small ones capitalised."""
    bare = re.sub(r"^\s*\d{1,4}\s*[|·–—-]?\s+|[\s·|–—-]*\d{1,4}\s*$", "", line).strip()
    bare = re.sub(r"[·|,–—-]\s*\d{1,2}(?:st|nd|rd|th)?\s*edition\s*$", "", bare, flags=re.I).strip()
    words = bare.split()
    return 2 <= len(words) <= 9 and bare[-1:] not in ".,;:?!-" and "|" not in bare and all(w[0].isupper() or (w.lower() in SMALL_WORDS and i) for i, w in enumerate(words)) and any(len(w) > 3 and w.isalpha() for w in words)


def _shape(lines: list[str]) -> tuple[list[str], list[int]]:
    """Kind of every line (blank, page, bare, head or text) and the places that are neither blank nor furniture."""
    kinds = []
    for line in lines:
        s = line.strip()
        if not s:
            kinds.append("blank")
        elif len(s) > 120:
            kinds.append("text")
        elif s[-1] in ".,;:?!" and not s[0].isdigit() and len(s) > 24:
            kinds.append("text")
        elif _BARE.match(s):
            kinds.append("bare")
        elif len(s) <= 40 and _PAGE.match(s):
            kinds.append("page")
        elif (_CHAPTER.match(s) or _EDITION.search(s) and _title_like(s) or _title_like(s)):
            kinds.append("head")
        else:
            kinds.append("text")
    return kinds, [i for i, k in enumerate(kinds) if k == "text"]


def examine(text: str) -> dict:
    """What one text shows: numbers that may be those of pages and candidate titles by line, cut words, and its whole words."""
    lines = _LINE.split(text)
    kinds, body = _shape(lines)
    prose = [i for i in body if _is_prose(lines[i])]
    before, after, last = {}, {}, None
    for i in range(len(lines)):
        before[i] = last
        if kinds[i] == "text":
            last = i
    last = None
    for i in range(len(lines) - 1, -1, -1):
        after[i] = last
        if kinds[i] == "text":
            last = i
    numbers, heads, furniture = [], [], set()
    for i, line in enumerate(lines):
        b, a = before[i], after[i]
        near_prose = (b is not None and _is_prose(lines[b])) or (a is not None and _is_prose(lines[a]))
        if kinds[i] == "page" and (prose or not body):
            numbers.append((i, int(_PAGE.match(line.strip())[1]), False))
            furniture.add(i)
        elif kinds[i] == "bare":
            beside = [kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            if near_prose and "bare" not in beside:
                numbers.append((i, int(line.strip()), True))
                furniture.add(i)
        elif kinds[i] == "head":
            s = line.strip()
            inside = b is not None and a is not None and near_prose and not _ends(lines[b]) and lines[a].lstrip()[:1].islower()
            sure = bool(prose) and bool(_CHAPTER.match(s) or _EDITION.search(s) or (inside and len(s.split()) >= 3))
            heads.append((i, head_key(s), inside, sure))
            furniture.add(i)
    cuts, spoiled = [], {}
    content = [i for i, k in enumerate(kinds) if k != "blank" and i not in furniture]
    for x, i in enumerate(content[:-1]):
        m = _cut_word(lines[i])
        if not m or not lines[i][m[1] - 1].isalpha():
            continue
        n = _WORD_START.match(lines[content[x + 1]])
        if n:
            first, rest = lines[i][m[0] : m[1]], n[1]
            cuts.append(((first + rest).lower(), f"{first}-{rest}".lower(), first.lower().split("-")[-1], rest.lower(), m[2] == "-"))
            spoiled[i] = (m[0], spoiled.get(i, (None, None))[1])
            spoiled[content[x + 1]] = (spoiled.get(content[x + 1], (None, None))[0], n.end(1))
    words = []
    for i, line in enumerate(lines):
        if i in furniture:
            continue
        if i in spoiled:
            start, end = spoiled[i]
            line = line[end or 0 : len(line) if start is None else max(start, end or 0)]
        low = line.lower()
        words += [w for w in _TOKEN.findall(low) if len(w) > 1 or w in "!@"]
        if "-" in low or "‑" in low:
            words += _COMPOUND.findall(low)
    return {"numbers": numbers, "heads": heads, "cuts": cuts, "words": words}


def _examined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = [examine(t) for t in pdf["text"]]
        yield pdf[["src", "rec_id", "part", "doc", "at"]].assign(**{k: [s[k] for s in seen] for k in ("numbers", "heads", "cuts", "words")})


def _restored(word: str) -> list[tuple[str, int]]:
    """(word with confused letters put back, how many times more frequent it must be) for a word of letters."""
    if not 3 <= len(word) <= LONGEST_WORD or any(c in SYMBOLS for c in word):
        return []
    out: dict[str, int] = {}
    for read, printed in LETTERS.items():
        ratio = USUAL_RATIO if read in PLAUSIBLE else RARE_RATIO
        at = word.find(read)
        while at >= 0:
            form = word[:at] + printed + word[at + len(read) :]
            out[form] = min(out.get(form, ratio), ratio)
            at = word.find(read, at + 1)
    return [(f, r) for f, r in out.items() if f != word]


def _restorations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(w, n, f, r) for w, n in zip(pdf["word"], pdf["n"], strict=True) for f, r in _restored(w)]
        yield pd.DataFrame(rows, columns=["word", "n", "printed", "ratio"])


_LONE_SYMBOL = r"^[a-z]{2,}[!@0156|][a-z]{2,}$"
_SYMBOL_CLASS = "[" + re.escape("".join(SYMBOLS)) + "]"


def _skeleton(word: Column) -> Column:
    """The word with one letter for each symbol and for all letters that a symbol may stand for."""
    return F.translate(word, "".join(SYMBOLS) + "l", "".join("i" if "i" in v else v for v in SYMBOLS.values()) + "i")


def _symbols_restored(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, printed, m of the words with symbols that have the letters of a more frequent word, however many symbols."""
    n_symbols = F.length(F.regexp_replace("word", f"[^{_SYMBOL_CLASS[1:-1]}]", ""))
    digits = F.length(F.regexp_replace("word", "[^0-9]", ""))
    odd = words.where(F.col("word").rlike(_SYMBOL_CLASS) & F.col("word").rlike(r"\p{L}") & (F.length("word") >= 3) & (digits <= F.floor(F.length("word") / 2))).select("word", "n", n_symbols.alias("symbols"), _skeleton(F.col("word")).alias("s"))
    whole = vocabulary.where(~F.col("printed").rlike(_SYMBOL_CLASS)).select("printed", "m", _skeleton(F.col("printed")).alias("s"))
    # letters that aren't symbols must agree, which makes the distance the number of symbols
    return odd.join(whole, "s").where((F.col("m") >= SYMBOL_RATIO * F.col("n")) & (F.col("m") >= LEAST_REPEATS) & (F.levenshtein("word", "printed") == F.col("symbols"))).select("word", "printed", "m")


def texts_of(chunks: DataFrame, rag: DataFrame) -> DataFrame:
    """src, rec_id, part, text, doc, at (its page) of every content and every context; nulls are left out."""
    place = [F.col("doc_id").cast("string").alias("doc"), F.col("page").cast("int").alias("at")] if {"doc_id", "page"} <= set(chunks.columns) else [F.lit(None).cast("string").alias("doc"), F.lit(None).cast("int").alias("at")]
    a = chunks.select(F.lit("document_chunks").alias("src"), F.col("chunk_id").alias("rec_id"), F.lit(0).alias("part"), F.col("content").alias("text"), *place)
    b = rag.select(F.lit("tier3_rag").alias("src"), F.col("id").alias("rec_id"), F.posexplode("reference_contexts").alias("part", "text")).withColumns({"doc": F.lit(None).cast("string"), "at": F.lit(None).cast("int")})
    return a.unionByName(b).where("rec_id is not null and text is not null")


def _in_sequence(numbers: DataFrame) -> DataFrame:
    """The rows of ``numbers(.., doc, at, value, bare)`` that aren't bare numbers against their document's sequence.

    Page numbers follow the pages at one distance. Where LEAST_SEQUENCE numbers of a document, and most of them, show
    it, a bare number at another distance is a value of the text.
    """
    gap = F.col("value") - F.col("at")
    by_gap = numbers.where("doc is not null and at is not null").groupBy("doc", gap.alias("gap")).agg(F.count("*").alias("n"))
    shown = by_gap.groupBy("doc").agg(F.max_by("gap", F.struct("n", "gap")).alias("gap"), F.max("n").alias("most"), F.sum("n").alias("all")).where((F.col("most") >= LEAST_SEQUENCE) & (2 * F.col("most") > F.col("all"))).select("doc", "gap")
    bare = numbers.where("bare and doc is not null and at is not null")
    kept = bare.join(shown, "doc", "left").where(F.col("gap").isNull() | (gap == F.col("gap"))).select(*numbers.columns)
    return numbers.where("not bare or doc is null or at is null").unionByName(kept)


def _repeated(heads: DataFrame) -> DataFrame:
    """key of the titles that repeat, also with one letter more, less or other than one that does."""
    count = heads.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("inside").cast("int")).alias("inside_n"), F.max("sure").alias("any_sure"))
    often = (F.col("n") >= LEAST_REPEATS) & ((F.col("inside_n") >= 2) | F.col("any_sure"))
    word = F.col("key")
    shorter = F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))
    forms = count.where(F.length("key") >= 8).select("key", often.alias("often"), F.explode(shorter).alias("form"))
    near = forms.where("not often").select(F.col("key").alias("rare"), "form").join(forms.where("often").select("key", "form"), "form").where(F.levenshtein("rare", "key") <= 1).select(F.col("rare").alias("key"))
    return count.where(often).select("key").unionByName(near).distinct()


def evidence(texts: DataFrame) -> dict[str, DataFrame]:
    """The decisions over the corpus, one table a kind: number lines, title lines, cuts and misread words of every text."""
    seen = cut(texts.select("src", "rec_id", "part", "text", "doc", "at").mapInPandas(_examined, SCAN))
    key = ["src", "rec_id", "part"]
    plain = cut(seen.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    cuts = seen.select(*key, F.explode("cuts").alias("c")).select(*key, "c.*")
    # words of cut lines count as words to be examined, but not as evidence of a spelling
    words = plain.unionByName(cuts.select(F.col("joined").alias("word")).distinct().join(plain, "word", "left_anti").withColumn("n", F.lit(1).cast("long")))
    vocabulary = plain.select(F.col("word").alias("printed"), F.col("n").alias("m"))
    fixes = (
        words.mapInPandas(_restorations, "word string, n long, printed string, ratio int")
        .join(vocabulary, "printed")
        .where((F.col("m") >= F.col("ratio") * F.col("n")) & (F.col("m") >= LEAST_REPEATS)).select("word", "printed", "m")
        .unionByName(_symbols_restored(words, vocabulary))
        .groupBy("word").agg(F.max_by("printed", F.struct("m", "printed")).alias("printed"))
    )
    lone = words.where(F.col("word").rlike(_LONE_SYMBOL)).select("word").join(fixes, "word", "left_anti").select("word", F.lit(None).cast("string").alias("printed"))
    fixes = cut(fixes.unionByName(lone))
    if fixes.count() <= BROADCAST_WORDS:  # else the words are joined by shuffle, where AQE splits the frequent ones
        fixes = F.broadcast(fixes)
    used = seen.select(*key, F.explode(F.array_distinct(F.concat("words", F.transform("cuts", lambda c: c["joined"])))).alias("word"))
    misread = used.join(fixes, "word")

    known = lambda c, out: plain.select(F.col("word").alias(c), F.col("n").alias(out))
    judged = (
        cuts.join(known("joined", "nj"), "joined", "left").join(known("spelled", "ns"), "spelled", "left")
        .join(known("first", "nf"), "first", "left").join(known("rest", "nr"), "rest", "left")
        .fillna(0, ["nj", "ns", "nf", "nr"])
    )
    own = F.col("hyphen") & (((F.col("ns") > 0) & (F.col("ns") >= F.col("nj"))) | ((F.col("ns") == 0) & (F.col("nj") == 0) & (F.col("nf") >= 5) & (F.col("nr") >= 5)))
    numbers = _in_sequence(seen.select(*key, "doc", "at", F.inline("numbers")))
    heads = seen.select(*key, F.inline("heads"))
    titles = heads.join(_repeated(heads).withColumn("repeated", F.lit(True)), "key", "left").where(F.col("sure") | F.col("repeated"))
    return {"page_number": numbers.select(*key, "line"), "header": titles.select(*key, "line"), "hyphenation": judged.where(~own).select(*key, "joined", "spelled"), "misread": misread.select(*key, "word", "printed")}


def noise_found(texts: DataFrame) -> DataFrame:
    """src, rec_id, noise: one row for each record and kind of noise in any of its texts."""
    found = None
    for kind, rows in evidence(texts).items():
        part = rows.select("src", "rec_id", F.lit(kind).alias("noise"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def repair(text: str, furniture: set[int], joins: set[str], fixes: dict[str, str]) -> str:
    """The text as paragraphs: the lines of ``furniture`` dropped, cut words joined, misread words restored, lines of a paragraph joined.

    Lines of tables (short lines without prose around them, lines with bars) keep their breaks.
    """
    kept = [line.rstrip() for i, line in enumerate(_LINE.split(text)) if i not in furniture]
    out: list[str] = []
    for line in kept:
        if not line.strip():
            out.append("")
            continue
        if out and out[-1] and "|" not in line and "|" not in out[-1]:
            m, n = _cut_word(out[-1]), _WORD_START.match(line)
            if m and n and (out[-1][m[0] : m[1]] + n[1]).lower() in joins:
                out[-1] = out[-1][: m[1]] + line.lstrip()
                continue
            if m and n and m[2] == "-":
                out[-1] = out[-1].rstrip() + line.lstrip()
                continue
            if _is_prose(out[-1]) and (not _ends(out[-1]) or _is_prose(line)):
                out[-1] += " " + line.lstrip()
                continue
        out.append(line)
    joined = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
    if not fixes:
        return joined

    def put(m: re.Match) -> str:
        w = fixes.get(m[0].lower())
        return m[0] if not w else w.upper() if m[0].isupper() and len(m[0]) > 1 else w.capitalize() if m[0][0].isupper() else w

    return _TOKEN.sub(put, joined)


def repaired(texts: DataFrame) -> DataFrame:
    """src, rec_id, part, text of every text, repaired by the corpus's decisions. Blank texts stay as they are."""
    e = evidence(texts)
    key = ["src", "rec_id", "part"]
    lines = e["header"].unionByName(e["page_number"]).groupBy(*key).agg(F.collect_set("line").alias("lines"))
    joins = e["hyphenation"].groupBy(*key).agg(F.collect_set("joined").alias("joins"))
    fixes = e["misread"].where("printed is not null").groupBy(*key).agg(F.collect_set(F.struct("word", "printed")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_list = lambda x: [] if x is None else list(x)
        for pdf in batches:
            done = [repair(t, set(as_list(n)), set(as_list(j)), {f["word"]: f["printed"] for f in as_list(x)}) for t, n, j, x in zip(pdf["text"], pdf["lines"], pdf["joins"], pdf["fixes"], strict=True)]
            yield pdf[key].assign(text=done)

    return texts.select(*key, "text").join(lines, key, "left").join(joins, key, "left").join(fixes, key, "left").mapInPandas(run, "src string, rec_id string, part int, text string")
