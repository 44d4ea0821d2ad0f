"""Lines of article pages: titles, headings and body text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section headings, markers of back matter and the printed footer of the article collection.
STANDARD_HEADINGS = [
    "Definition", "Description", "Causes and symptoms", "Causes", "Symptoms", "Diagnosis",
    "Treatment", "Prognosis", "Prevention", "Resources", "KEY TERMS", "Key terms", "Demographics", "Genetic profile", "Signs and symptoms", "When to call the doctor", "Questions to ask the doctor",
]
BACK_MATTER = ["BOOKS", "PERIODICALS", "ORGANIZATIONS", "OTHER"]
FOOTER = "GALE ENCYCLOPEDIA OF MEDICINE"
TITLE_LINES = 40  # lines of a page whose start may hold a title


def clean_lines(text: Column) -> Column:
    """The lines of a text with single blanks, empty ones left out; a form feed ends a line."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\f"), F.lit("\n")), r"\r\n|[\n\r]")
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def is_heading(line: Column) -> Column:
    return line.isin(STANDARD_HEADINGS)


def is_footer(line: Column) -> Column:
    """A page number or the printed footer."""
    return line.rlike(r"^\p{Nd}+$") | F.startswith(line, F.lit(FOOTER))


def is_title(line: Column) -> Column:
    """At most 90 characters with letters, mostly capitals or beginning with one and without a final full stop."""
    letters, capitals = F.length(F.regexp_replace(line, r"\P{L}", "")), F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    shaped = (capitals / F.greatest(letters, F.lit(1)) > 0.6) | (line.rlike(r"^\p{Lu}") & ~F.endswith(line, F.lit(".")))
    return F.coalesce((line != "") & ~is_heading(line) & ~is_footer(line) & (F.length(line) <= 90) & (letters > 0) & shaped, F.lit(False))


def start_title(lines: Column) -> Column:
    """The first title among the first lines that stands right before a standard heading; null without one."""
    at = F.filter(F.sequence(F.lit(1), F.least(F.size(lines) - 1, F.lit(TITLE_LINES))), lambda i: is_title(F.get(lines, i - 1)) & is_heading(F.get(lines, i)))
    return F.when(F.size(lines) > 1, F.get(lines, F.get(at, F.lit(0)) - 1))


def footer_title(lines: Column) -> Column:
    """The last line, if it is a title and a page number or the footer stands in the two lines before it."""
    marked = F.exists(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.least(F.size(lines) - 1, F.lit(2))), is_footer)
    last = F.get(lines, F.size(lines) - 1)
    return F.when((F.size(lines) >= 2) & marked & is_title(last), last)


def headings(lines: Column) -> Column:
    return F.array_distinct(F.filter(lines, is_heading))


def body_text(lines: Column, title: Column, after_title: bool = False) -> Column:
    """The lines up to the back matter without title, headings, page numbers and footers, joined by line breaks.

    ``after_title`` begins after the title's first line, where it has one.
    """
    at = F.coalesce(F.array_position(lines, title), F.lit(0)) if after_title else F.lit(0)
    own = F.filter(F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: ~x.eqNullSafe(title))
    end = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: F.coalesce(F.get(own, i - 1).isin(BACK_MATTER), F.lit(False)))
    before = F.slice(own, 1, F.coalesce(F.get(end, F.lit(0)) - 1, F.size(own)))
    return F.array_join(F.filter(before, lambda x: ~is_heading(x) & ~is_footer(x)), "\n")
