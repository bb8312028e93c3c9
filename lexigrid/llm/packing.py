"""Operator 1, best-fit packing by minimum bin slack.

Documents are packed into training sequences of CAPACITY tokens; a document takes its tokens and one end mark. Longer ones are cut into
full sequences and a rest. For each bin, the longest piece left is fixed, and a subset-sum over the lengths left, on a bit set of
reachable sums, finds the fullest combination beside it, which is then removed.

Shards of about SHARD_DOCS documents, by a hash of doc_id, are packed apart; each leaves at most one bin or so ill filled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import save, small_batches, table, texts
from .tokenizer import RANKS, ids_of

CAPACITY = 2048
SHARD_DOCS = 20_000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, at most counts of each, with the largest sum up to room. ``lengths``: those of counts, descending."""
    reach, full, steps = 1, 1 << room, (1 << (room + 1)) - 1
    history: list[tuple[int, int]] = []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length) & steps
            if more == reach:
                break
            history.append((length, reach))
            reach = more
            if reach & full:
                break
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(history):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def pack(ids: list[int], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (doc_id, start, length)."""
    bins: list[list[tuple[int, int, int]]] = []
    pieces: dict[int, list[tuple[int, int]]] = {}
    for doc, size in sorted(zip(ids, sizes)):
        whole = size // capacity * capacity
        bins += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if size > whole:
            pieces.setdefault(size - whole, []).append((doc, whole))
    for stack in pieces.values():
        stack.reverse()  # the smallest doc_id goes first
    counts = {k: len(v) for k, v in pieces.items()}
    lengths = sorted(pieces, reverse=True)
    while lengths:
        counts[lengths[0]] -= 1
        chosen = [lengths[0], *fullest(counts, lengths, capacity - lengths[0])]
        for length in chosen[1:]:
            counts[length] -= 1
        bins.append([(*pieces[length].pop(), length) for length in chosen])
        for length in {*chosen}:
            if not counts[length]:
                lengths.remove(length)
    return bins


def _count(batches, ranks):
    encode = ids_of(ranks)
    for b in tk.slices(batches):
        sizes = [len(encode(x)) + 1 for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "size"])


def _pack_shard(capacity):
    def run(t: pa.Table) -> pa.Table:
        bins = pack(t.column("doc_id").to_pylist(), t.column("size").to_pylist(), capacity)
        part = lambda i: pa.array([[x[i] for x in b] for b in bins], pa.list_(pa.int64()))
        return pa.table({
            "shard": pa.array([t.column("shard")[0].as_py()] * len(bins), pa.int64()),
            "bin": pa.array(range(len(bins)), pa.int64()),
            "doc_ids": part(0),
            "starts": part(1),
            "lengths": part(2),
            "used": pa.array([sum(x[2] for x in b) for b in bins], pa.int64()),
        })

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, ranks: str = RANKS) -> DataFrame:
    """shard, bin, doc_ids, starts, lengths, used of each sequence; the three lists run in parallel.

    Null texts and rows without doc_id are left out; an empty text takes its end mark alone; among equal lengths the smallest doc_id goes
    first; a repeated row is packed as often as it comes; other columns are ignored; an empty table gives no sequence."""
    spark = docs.sparkSession
    small_batches(spark)
    sizes = save(texts(docs).mapInArrow(lambda it: _count(it, ranks), "doc_id bigint, size bigint"), "sizes")
    shards = max(1, math.ceil(sizes.count() / shard_docs))
    return sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInArrow(_pack_shard(capacity), "shard bigint, bin bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, used bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
