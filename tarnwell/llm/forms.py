"""Bring text to one form of characters, so that texts that look the same are equal.

Compatibility forms that look like the plain letter (wide, narrow, ligature, font and no-break forms) are
decomposed, look-alike letters of other scripts mapped to Latin, default-ignorable characters removed, white
space mapped to single spaces, and the result composed. Superscripts, fractions and circled forms look
different from plain digits and stay. Full case folding is an option for search keys: letter case looks
different, so the form for comparison keeps it. Each distinct value of a batch is normalised once.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters drawn like Latin ones, the look-alike below the letter.
CYRILLIC_UPPER = "АВЕЅІЈКМНОРСТХҮԚԜӀҺ"
CYRILLIC_UPPER_AS = "ABESIJKMHOPCTXYQWIh"
CYRILLIC_LOWER = "аеѕіјорсухһԁԛԝӏүу"
CYRILLIC_LOWER_AS = "aesijopcyxhdqwlyy"
GREEK_UPPER = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ"
GREEK_UPPER_AS = "ABEZHIKMNOPTYXCM"
GREEK_LOWER = "ονϲϳρι"
GREEK_LOWER_AS = "ovcjpi"
HYPHENS = "‐‑﹣－"

#: Default-ignorable characters outside category Cf.
IGNORABLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
COMPATIBLE = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>"}
DIFFERENT = {0x017F, 0x03D0, 0x03D1, 0x03D5, 0x03D6}  # long s and Greek symbol letters are drawn differently

_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1)
def _decomposing() -> dict[int, str | None]:
    """What one character becomes before decomposition: its compatible plain form, nothing, or a space."""
    table: dict[int, str | None] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch == " ":
            continue
        if ch.isspace() or kind in ("Zs", "Zl", "Zp"):
            table[cp] = " "
        elif kind in ("Cf", "Cc"):
            table[cp] = None
        elif kind not in ("Cn", "Cs", "Co") and (d := unicodedata.decomposition(ch)) and d.split()[0] in COMPATIBLE and cp not in DIFFERENT:
            plain = unicodedata.normalize("NFKC", ch)
            if not plain.startswith(" "):  # spacing accents stay
                table[cp] = plain
    table |= dict.fromkeys(IGNORABLE)
    table[0x2800] = " "  # a blank Braille cell
    return table


@lru_cache(maxsize=1)
def _look_alikes() -> dict[int, str]:
    table = {ord(h): "-" for h in HYPHENS}
    for letters, drawn in ((CYRILLIC_UPPER, CYRILLIC_UPPER_AS), (CYRILLIC_LOWER, CYRILLIC_LOWER_AS), (GREEK_UPPER, GREEK_UPPER_AS), (GREEK_LOWER, GREEK_LOWER_AS)):
        table |= {ord(a): b for a, b in zip(letters, drawn, strict=True)}
    table[0x00B5] = "μ"  # the micro sign
    return table


def _mapped(text: str, table: dict[int, str | None]) -> str:
    """``str.translate``, by the few distinct characters that change. What a table gives is never changed by it again."""
    for c in set(text):
        if (cp := ord(c)) in table:
            text = text.replace(c, table[cp] or "")
    return text


def one_form(text: str | None, fold_case: bool = False) -> str | None:
    """The form of a text; null stays null, a text without a visible character becomes empty."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFD", _mapped(text, _decomposing()))
        text = unicodedata.normalize("NFC", _mapped(text, _look_alikes()))
    elif not text.isprintable():
        text = _mapped(text, _decomposing())
    text = _SPACE.sub(" ", text).strip()
    return unicodedata.normalize("NFC", text.casefold()) if fold_case else text


def with_form(df: DataFrame, text_col: str = "text", fold_case: bool = False, out: str = "form") -> DataFrame:
    """``df`` with the form of ``text_col``; an existing column ``out`` is replaced."""

    @F.pandas_udf("string")
    def formed(column: pd.Series) -> pd.Series:
        codes, values = pd.factorize(column)
        done = [one_form(v, fold_case) for v in values]
        return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

    return df.withColumn(out, formed(F.col(text_col)))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def h(s: str) -> bytes:
        return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    for pdf in batches:
        codes, values = pd.factorize(pdf["text"])
        done = [(h(f), h(v)) if (f := one_form(v)) else (None, None) for v in values]
        picked = [done[c] if c >= 0 else (None, None) for c in codes]
        out = pd.DataFrame({"id": pdf["id"], "form": [p[0] for p in picked], "exact": [p[1] for p in picked]})
        yield out[out["form"].notna()]


def same_looking_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_a < doc_b of each pair whose texts look the same but aren't the same string.

    Null and blank texts and null ids take no part. Only 128-bit digests are shuffled; classes with a single
    string, however many copies it has, are dropped by a pre-aggregation, so that no copies are paired.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    d = rows.mapInPandas(_digests, "id long, form binary, exact binary")
    varied = d.groupBy("form").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("form")
    d = d.join(varied, "form", "left_semi")
    a, b = d.select("form", F.col("id").alias("doc_a"), F.col("exact").alias("ea")), d.select("form", F.col("id").alias("doc_b"), F.col("exact").alias("eb"))
    return a.join(b, "form").where((F.col("doc_a") < F.col("doc_b")) & (F.col("ea") != F.col("eb"))).select("doc_a", "doc_b")
