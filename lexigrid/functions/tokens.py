"""Column rules that make tokens of plain text. The tables at hand have no morphology, so lemma and tags are derived from shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: One suffix rule stands for a lemmatiser.
LEMMA = r"^(\p{L}{3,}?)(?:ing|ed|es|s)$"
MARKS = {".": "<sent>", "!": "<sent>", "?": "<sent>", ",": "<cm>", '"': "<quot>", "(": "<lpar>", ")": "<rpar>", "*": "<asterisk>", "|": "<vline>", "'": "<apos>"}
#: Tag sets that cut segments.
PUNCTUATION = ("<sent>", "<cm>", "<apos>", "<quot>", "<rquot>", "<lquot>", "<rpar>", "<lpar>", "<asterisk>", "<vline>", "<invquest>", "<punct>")


def lemma(word: Column) -> Column:
    return F.regexp_replace(word, LEMMA, "$1")


def tags(surface: Column, lang: Column) -> Column:
    out = F.when(surface.rlike(r"^\p{N}+$"), "<num>").when(surface.rlike(r"^\p{Lu}"), F.concat(F.lit("<"), lang, F.lit(">,<np>"))).when(surface.rlike(r"^[\p{L}\p{N}]"), F.concat(F.lit("<"), lang, F.lit(">,<n>")))
    for mark, tag in MARKS.items():
        out = out.when(surface == mark, tag)
    return out.otherwise("<sym>")


def sort_tags(tags: Column) -> Column:
    """Comma list in code-point order; repeats stay."""
    return F.array_join(F.array_sort(F.split(tags, ",")), ",")
