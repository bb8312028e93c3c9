"""The corpus pipeline: STAGES applied to ``documents`` in turn, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the columns of
documents, whatever other columns there are and whatever their names; the last returns training sequences. An empty table passes through all stages: the
first four return an empty one with the same columns, the last no sequence. Order of rows and partitions don't matter to any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import decontaminate, language_id, line_templates, ngram_join, packing
from lexigrid.llm.shared import discard, save, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest go.

    A null or empty text, and one without letters, has no language and goes. Rows without ``lang`` aren't fitted on, but are judged; if no row has one, every row goes.
    A row without doc_id is judged as any other. Repeated rows are each judged, alike; of equal shares the alphabetically first language wins."""
    return language_id.keep_identified(docs)


def strip_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; n_chars is counted again.

    No row goes: a document that consists of such lines alone keeps an empty text. Null texts stay null, rows without doc_id stay as they are. A repeated row is a document of
    the same family, which doesn't make its lines recur; of equally similar templates the older one wins."""
    return line_templates.clean_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id, and all others.

    Null texts, texts without words and rows without doc_id match nothing and stay. Rows that repeat a doc_id stay or go together; of their texts the smallest is compared."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items in them.

    Null or empty texts and rows without doc_id stay; rows that repeat a doc_id go together if any of them has an item; null, empty and very short items are in no document; with an
    empty benchmark all documents stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of documents and pieces of them.

    Null texts and rows without doc_id are left out, an empty text takes its end mark; a repeated row is packed as often as it comes; among equal lengths the smallest doc_id goes first."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify),
    ("line_templates", strip_lines),
    ("ngram_join", drop_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: SQL can't express the bit-sliced filters, the template tree, latent retrieval and packing: tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of all stages over ``documents`` of the folder. Tables between stages go once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    behind: list[str] = []
    for name, stage in STAGES[:-1]:
        now: list[str] = []
        docs = save(stage(spark, docs, sf_dir), name, now)
        discard(spark, behind)
        behind = now
    return STAGES[-1][1](spark, docs, sf_dir)
