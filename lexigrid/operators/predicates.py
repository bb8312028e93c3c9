"""Conditions on token types and on sources, as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.patterns import anchored, glob_to_like, tags_to_like, to_java
from lexigrid.operators.dictionary import SOURCE_FIELDS
from lexigrid.plans.query import CorpusQuery, Slot


def compiled(expression: str) -> str:
    """The expression, if Java takes it: a bad one is an error here and not in a task."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(expression)
        except (IllegalArgumentException, Py4JJavaError) as e:
            raise ValueError(f"bad regular expression {expression!r}: {e}") from None
    return expression


def pattern(column: Column, text: str, regex: bool, anchor: bool = True) -> Column:
    if regex:
        return column.rlike(compiled(to_java(anchored(text) if anchor else text)))
    return column.like(glob_to_like(text))


def slot_column(slot: Slot, regex: bool = False, anchor: bool = True, of: Callable[[str], Column] = F.col) -> Column:
    """All of a slot's conditions, over columns word_case, word, lemma, tags (as ``of`` gives them); true for an empty slot. ``anchor``: regular
    expressions must match the whole string (concordance) or any part of it (n-grams)."""
    form = of("word_case" if slot.case else "word")
    parts = []
    if slot.word:
        parts.append(form == slot.word)
    if slot.lemma:
        parts.append(of("lemma") == slot.lemma)
    if (tags := tags_to_like(slot.tags)) is not None:
        parts.append(of("tags").like(tags))
    if slot.wildmatch:
        parts.append(pattern(form, slot.wildmatch, regex, anchor))
    if slot.wildmatch_lemma:
        parts.append(pattern(of("lemma"), slot.wildmatch_lemma, regex, anchor))
    return reduce(and_, parts, F.lit(True))


def matching_sources(sources: DataFrame, query: CorpusQuery) -> DataFrame | None:
    """Ids of the sources in the subcorpus; None for all."""
    if not query.source:
        return None
    if query.source_field not in SOURCE_FIELDS:
        raise ValueError(f"source_field must be one of {', '.join(SOURCE_FIELDS)}")
    column = F.col(query.source_field)
    test = column.rlike(compiled(to_java(anchored(query.source), ignore_case=True))) if query.regex else column.like(glob_to_like(query.source))
    return sources.where(test).select(F.col("id").alias("source"))
