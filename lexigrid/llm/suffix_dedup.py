"""Operator 8, passages that repeat across documents, by a hash-compared suffix sort.

A passage of LEAST words repeats if it is also in another document. Suffixes that can share LEAST words are brought together by their
minimiser: the least hash among the runs of SEED words within the suffix's first LEAST words, which depends on those words alone.
Consecutive suffixes with one minimiser travel as one stretch of words, and only if the minimiser is found in two documents.

Within a partition, suffixes of equal minimiser and equal distance to it are sorted by a merge sort. Two suffixes are compared in a logarithmic number of steps: prefix
polynomial hashes and binary search give their common extension, and the next word decides. Neighbours with
a common extension of LEAST words are verified word by word (32-bit words), so a collision of the sums can't join them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import partitions, save, small_batches, table, texts

LEAST = 50
SEED = 20
PLACE_BITS = 28
#: Groups of minimisers, each sorted at once, for each partition.
PARTS = 4


class Stretches:
    """Runs of suffixes of the rows of a string column that have one minimiser."""

    def __init__(self, column: pa.Array, least: int, seed: int):
        w = tk.Words(column)
        self.words, total = (w.hashes >> np.uint64(32)).astype(np.uint32), len(w.hashes)
        none = np.zeros(0, np.int64)
        self.first = self.count = self.place = self.row = none
        self.hashes = np.zeros(0, np.uint64)
        self.bounds = w.bounds
        starts = total - least + 1
        if starts <= 0:
            return
        size = total - seed + 1
        grams = np.zeros(size, np.uint64)
        for i in range(seed):
            grams = grams * np.uint64(tk.BASE) + self.words[i : i + size]
        grams = tk.mix(grams)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        low = (grams & ~mask) | np.arange(size, dtype=np.uint64)
        window, width = least - seed + 1, 1
        while 2 * width <= window:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[:starts], low[window - width : window - width + starts])
        whole = w.rows[:starts] == w.rows[least - 1 : least - 1 + starts]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        place = (low[at] & mask).astype(np.int64)
        new = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]
        heads = np.flatnonzero(new)
        self.first, self.count, self.place = at[heads], np.diff(np.r_[heads, len(at)]), place[heads]
        self.row, self.hashes = w.rows[self.first], grams[self.place]


def _minimisers(batches, least, seed):
    for b in tk.slices(batches):
        x = Stretches(b.column("text"), least, seed)
        order = np.lexsort((x.hashes, x.row))
        h, row = x.hashes[order], x.row[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[keep])), pa.array(h[keep].view(np.int64))], ["doc_id", "h"])


def _stretches(batches, least, seed, parts):
    for b in tk.slices(batches):
        x = Stretches(b.column("text"), least, seed)
        lists = b.column("hs")
        wanted = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        some = np.flatnonzero(np.isin(x.hashes.view(np.int64), wanted))
        first, count = x.first[some], x.count[some]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((tk.mix(x.hashes[some], 4) % np.uint64(parts)).astype(np.int32)),
                pa.array(x.hashes[some].view(np.int64)),
                b.column("doc_id").take(pa.array(x.row[some])),
                pa.array(first - x.bounds[x.row[some]]),
                pa.array((x.place[some] - first).astype(np.int32)),
                pa.array([x.words[f : f + c + least - 1].tobytes() for f, c in zip(first, count)], pa.binary()),
            ],
            ["part", "h", "doc_id", "start", "lead", "words"],
        )


class Suffixes:
    """Suffixes of a list of words, compared on their first ``depth`` words."""

    def __init__(self, words: np.ndarray, depth: int):
        self.words, self.depth = words, depth
        self.power, _ = tk.powers(len(words) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum((words.astype(np.uint64) + np.uint64(1)) * self.power[: len(words)])]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from a and from b on, depth at most, by binary search on hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.depth)
        pa_, pb = self.power[a], self.power[b]
        sa, sb = self.sums[a], self.sums[b]
        for _ in range(int(self.depth).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[a + mid] - sa) * pb == (self.sums[b + mid] - sb) * pa_
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def below(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether a's suffix comes before b's; ``ties``: or is equal."""
        n = self.extension(a, b)
        end = n == self.depth
        n = np.where(end, 0, n)
        return np.where(end, ties, self.words[a + n] < self.words[b + n])

    def sort(self, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sort each group starts[bounds[i]:bounds[i + 1]], all groups at once, by a bottom-up merge sort: an element's place in a merged run
        is its place in its own run and the number of the other run's elements before it, found by binary search."""
        starts = starts.copy()
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        begin, end = bounds[:-1][group], bounds[1:][group]
        at = np.arange(len(starts))
        width = 1
        while len(at):
            at = at[(end - begin)[at] > width]
            if not len(at):
                break
            local = at - begin[at]
            run = local // width
            left = run % 2 == 0
            own = begin[at] + run * width
            other = np.where(left, own + width, own - width)
            other_end = np.minimum(other + width, end[at])
            lo, hi = np.minimum(other, other_end), other_end.copy()
            key = starts[at]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                before = self.below(starts[mid], key[open_], False)
                tied = np.flatnonzero(~before & ~left[open_])  # equal elements of the left run come first
                if len(tied):
                    before[tied] = self.below(starts[mid[tied]], key[open_[tied]], True)
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            place = np.minimum(own, np.where(left, own, other)) + (at - own) + (lo - np.minimum(other, other_end))
            moved = np.empty_like(key)
            moved[:] = key
            starts[place] = moved
            width *= 2
        return starts


def _repeats(least):
    def run(t: pa.Table) -> pa.Table:
        h, ids = t.column("h").to_numpy(), t.column("doc_id").to_numpy()
        start, lead = t.column("start").to_numpy(), t.column("lead").to_numpy().astype(np.int64)
        blobs = [x.as_py() for x in t.column("words")]
        words = np.frombuffer(b"".join(blobs), np.uint32)
        sizes = np.array([len(x) // 4 for x in blobs], np.int64)
        offsets = np.cumsum(sizes) - sizes
        counts = sizes - least + 1
        owner = np.repeat(np.arange(len(h)), counts)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        distance = lead[owner] - index
        order = np.lexsort((distance, h[owner]))
        owner, index, distance = owner[order], index[order], distance[order]
        hh = h[owner]
        new = np.r_[True, (hh[1:] != hh[:-1]) | (distance[1:] != distance[:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        owner, index, group = owner[several], index[several], group[several]
        if not len(owner):
            return pa.table({"doc_id": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        bounds = np.r_[begins, len(group)]
        places = offsets[owner] + index
        found = Suffixes(words, least)
        ordered = found.sort(places, bounds)
        stretch = np.searchsorted(offsets, ordered, side="right") - 1
        a, b = ordered[:-1], ordered[1:]
        near = np.flatnonzero(group[1:] == group[:-1])
        near = near[found.extension(a[near], b[near]) >= least]
        same = np.zeros(len(ordered), bool)
        for k in range(0, len(near), 1 << 16):  # verified word by word
            own = near[k : k + (1 << 16)]
            at = np.arange(least)
            same[own + 1] = (words[a[own][:, None] + at] == words[b[own][:, None] + at]).all(1)
        heads = np.flatnonzero(~same)
        docs = ids[stretch]
        lengths = np.diff(np.r_[heads, len(ordered)])
        across = np.repeat(np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads), lengths)
        stretch, ordered = stretch[across], ordered[across]
        at = np.sort(ordered)  # places ascend within stretches
        stretch = np.searchsorted(offsets, at, side="right") - 1
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (stretch[1:] != stretch[:-1])]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else new
        s = stretch[new]
        return pa.table({"doc_id": pa.array(ids[s]), "start": pa.array(start[s] + at[new] - offsets[s]), "end": pa.array(start[s] + at[last] - offsets[s] + least)})

    return run


def _merge(batches):
    """Join overlapping and touching spans of each document."""
    for b in batches:
        out = {"doc_id": [], "start_word": [], "end_word": []}
        for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()):
            lo = hi = None
            for span in [*sorted((s["start"], s["end"]) for s in spans), (float("inf"), 0)]:
                if hi is not None and span[0] <= hi:
                    hi = max(hi, span[1])
                    continue
                if hi is not None:
                    for k, v in zip(out, (doc, lo, hi)):
                        out[k].append(v)
                lo, hi = span
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, start_word, end_word of each stretch of a document that is covered by passages of ``least`` words which another
    document has too (words counted from 0, the end not included; stretches that overlap or touch are one).

    Null or empty texts, texts of fewer words and rows without doc_id give nothing; rows that repeat a doc_id count as one document;
    equal suffixes need no order; other columns are ignored; an empty table gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs)
    pairs = save(rows.mapInArrow(lambda it: _minimisers(it, least, seed), "doc_id bigint, h bigint"), "minimisers")
    shared = pairs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
    lists = pairs.join(shared, "h", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("h").alias("hs"))
    parts = PARTS * partitions(spark)
    moved = rows.join(lists, F.col("doc_id") == F.col("id")).select("doc_id", "text", "hs")
    stretches = moved.mapInArrow(lambda it: _stretches(it, least, seed, parts), "part int, h bigint, doc_id bigint, start bigint, lead int, words binary")
    spans = stretches.groupBy("part").applyInArrow(_repeats(least), "doc_id bigint, start bigint, end bigint")
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return by_doc.mapInArrow(_merge, "doc_id bigint, start_word bigint, end_word bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
passages AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {LEAST}], ' ')) AS p FROM words, LATERAL (SELECT unnest(range(0, len(w) - {LEAST} + 1)) AS i)),
shared AS (SELECT p FROM passages GROUP BY p HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT DISTINCT doc_id, i FROM passages JOIN shared USING (p)),
breaks AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LEAST} THEN 0 ELSE 1 END AS b FROM marked),
islands AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM breaks)
SELECT doc_id, min(i) AS start_word, max(i) + {LEAST} AS end_word FROM islands GROUP BY doc_id, k
"""
