"""Text functions as columns: words, numbers, offsets and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the tokens of lexical search.
TOKEN = r"[a-z]+\d[\w.]*|\d[\d,]*(?:\.\d+)?|[a-z]+"


def tokens(text: Column) -> Column:
    """Lower-case words, words with digits, and figures with their thousands marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """White-space words, for any Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    """No-break spaces become spaces, runs of blanks one blank, blank lines go."""
    text = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n+", "\n"))


def tidy_numbers(text: Column) -> Column:
    """Closes up each bracket by itself, and a currency sign or bracket with the number behind it."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\(\s+", "("), r"(?U)\s+\)", ")")
    return F.regexp_replace(text, r"(?U)([$(])\s+(?=[0-9.,])", "$1")


def is_heading(line: Column) -> Column:
    """One to eight words, no table mark, no closing stop, and a capital or bracket first; white space around the line doesn't count."""
    line = F.regexp_replace(line, r"(?U)\A\s+|\s+\z", "")
    n = F.size(words(line))
    shape = line.rlike(r"\A[A-Z(]") & ~line.rlike(r"[.:;,]\z") & ~line.contains("|")
    return n.between(1, 8) & shape


def lines(text: Column) -> Column:
    return F.split(text, "\n")
