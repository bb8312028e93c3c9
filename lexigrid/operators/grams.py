"""N-grams in sorted order: one exchange of windows, from which all levels and their numbers come.

A window is the ids of a token and the five after it within its segment, two ids to a 64-bit number (0 where there is none). Windows are cut into
ranges of their first two ids and sorted. There, the n-grams of each level lie together in the order of their ids; a stream over them counts them, and
gives each its place among those of its level and frequency. Places become numbers by the sums over ranges, a small table. Batches of rows are NumPy
arrays, and nothing is kept between batches but the n-grams that are still open.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
GRAMS = [f"g{i + 1}" for i in range(LEVELS)]
HALF = 32


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and of each the row that it is of."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(lengths)), lengths)


def windows(ids: DataFrame, depth: int, marks: list[int] | None = None) -> DataFrame:
    """p1, p2.. of each token of ``ids`` (an array of ids a sentence). ``marks``: ids that cut segments and are in none."""
    width = (depth + 1) // 2
    cut = np.array(sorted(marks or []), dtype=np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, segment = _flat(batch.column(0))
            v = v.astype(np.int64)
            if marks is not None:
                mark = np.isin(v, cut)
                segment = (segment + np.cumsum(mark))[~mark]
                v = v[~mark]
            out = [np.zeros(len(v), dtype=np.int64) for _ in range(width)]
            for j in range(depth):
                n = max(0, len(v) - j)
                there = np.where(segment[j:] == segment[:n], v[j:] + 1, 0) if n else v[:0]
                out[j // 2][:n] |= there << HALF if j % 2 == 0 else there
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[f"p{i + 1}" for i in range(width)])

    return ids.select("ids").mapInArrow(make, ", ".join(f"p{i + 1} bigint" for i in range(width)))


def in_order(found: DataFrame) -> DataFrame:
    """Windows by ranges of their first two ids, sorted. The number of ranges is given, so that it isn't changed where the exchange is read."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(n, "p1").sortWithinPartitions(*found.columns)


class _Stream:
    """The n-grams of sorted windows, batch by batch. Of each level, ``last`` is open: later windows may be of it."""

    def __init__(self, depth: int, levels: list[int]):
        self.depth, self.levels = depth, levels
        self.last = np.full(depth, -1, dtype=np.int64)
        self.open = dict.fromkeys(levels, 0)
        self.seen: dict[int, dict[int, int]] = {j: {} for j in levels}
        self.part: int | None = None

    def batch(self, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, ids, frequencies) of the n-grams that end in this batch."""
        if not len(columns[0]):
            return
        if self.part is None:
            self.part = int(columns[0][0])
        g = _unpacked(columns, self.depth)
        above = np.vstack([self.last[None, :], g[:-1]])
        new = np.logical_or.accumulate(g != above, axis=1)
        for j in self.levels:
            at = np.flatnonzero(new[:, j - 1])
            if not len(at):
                self.open[j] += len(g)
                continue
            ids = np.vstack([self.last[None, :j], g[at[:-1], :j]])
            freq = np.concatenate([[self.open[j] + at[0]], np.diff(at)])
            self.open[j] = len(g) - at[-1]
            there = ids[:, j - 1] > 0
            yield j, ids[there], freq[there]
        self.last = g[-1].copy()

    def end(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for j in self.levels:
            if self.last[j - 1] > 0:
                yield j, self.last[None, :j], np.array([self.open[j]])

    def places(self, level: int, freq: np.ndarray) -> np.ndarray:
        """Of each, how many n-grams of its level and frequency this stream had before."""
        seen = self.seen[level]
        values, which, n = np.unique(freq, return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        out = np.empty(len(freq), dtype=np.int64)
        out[order] = np.arange(len(freq)) - np.repeat(np.cumsum(n) - n, n)
        out += np.array([seen.get(f, 0) for f in values.tolist()], dtype=np.int64)[which]
        for f, k in zip(values.tolist(), n.tolist()):
            seen[f] = seen.get(f, 0) + k
        return out


def _unpacked(columns: list[np.ndarray], depth: int = LEVELS) -> np.ndarray:
    """A row of ids, plus one, for each window."""
    g = np.empty((len(columns[0]), depth), dtype=np.int64)
    for j in range(depth):
        g[:, j] = columns[j // 2] >> HALF if j % 2 == 0 else columns[j // 2] & ((1 << HALF) - 1)
    return g


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(c) for c in batch.columns]


def bitmap(rows: DataFrame, size: int) -> np.ndarray:
    """Bits, packed, of which ids from 0 are among ``rows``; 4 KB for each 32,768 ids reach the driver."""
    at = F.col("id") + 1
    found = rows.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((size // 32768 + 1, 4096), dtype=np.uint8)
    for r in found:
        out[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.reshape(-1)


def _among(ids: np.ndarray, wanted: list[np.ndarray | None]) -> np.ndarray:
    keep = np.ones(len(ids), dtype=bool)
    for j, bits in enumerate(wanted):
        if bits is not None:
            own = ids[:, j] - 1
            keep &= (bits[own >> 3] >> (own & 7).astype(np.uint8) & 1).astype(bool)
    return keep


def _starts(ordered: DataFrame, depth: int, levels: list[int]) -> DataFrame:
    """__r, __l, __f, __start: how many n-grams of a level come before those of a range and frequency. A row for each range, level and frequency that there is."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(depth, levels)
        for batch in batches:
            for j, _, freq in stream.batch(_columns(batch)):
                stream.places(j, freq)
        for j, _, freq in stream.end():
            stream.places(j, freq)
        found = [(stream.part, j, f, n) for j in levels for f, n in stream.seen[j].items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["__r", "__l", "__f", "__n"])

    before = Window.partitionBy("__l").orderBy(F.desc("__f"), "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.mapInArrow(sums, "__r bigint, __l bigint, __f bigint, __n bigint").select("__r", "__l", "__f", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))


def counted(ordered: DataFrame, depth: int, levels: list[int], numbers: bool, wanted: list[np.ndarray | None] | None = None) -> DataFrame:
    """level, g1..g6, freq of the n-grams, and node with ``numbers``: from 0 at each level, by descending frequency, then ids. ``wanted``: bits of the ids that
    each place may have; all n-grams are numbered, those that fit are returned."""
    spark = ordered.sparkSession
    sent = spark.sparkContext.broadcast(wanted) if wanted else None

    def made(stream: _Stream, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for j, ids, freq in found:
            place = stream.places(j, freq) if numbers else np.zeros(len(freq), dtype=np.int64)
            if sent is not None:
                keep = _among(ids, sent.value)
                ids, freq, place = ids[keep], freq[keep], place[keep]
            n = len(freq)
            if n:
                own = [pa.array(ids[:, i] - 1) if i < j else pa.nulls(n, pa.int64()) for i in range(LEVELS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, j, dtype=np.int64)), *own, pa.array(freq.astype(np.int64)), pa.array(place), pa.array(np.full(n, stream.part, dtype=np.int64))], names=["level", *GRAMS, "freq", "__place", "__part"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(depth, levels)
        for batch in batches:
            yield from made(stream, stream.batch(_columns(batch)))
        yield from made(stream, stream.end())

    out = ordered.mapInArrow(rows, "level bigint, " + ", ".join(f"{g} bigint" for g in GRAMS) + ", freq bigint, __place bigint, __part bigint")
    if not numbers:
        return out.select("level", *GRAMS, "freq")
    starts = _starts(ordered, depth, levels)
    out = out.join(F.broadcast(starts), (F.col("__part") == F.col("__r")) & (F.col("level") == F.col("__l")) & (F.col("freq") == F.col("__f")))
    return out.select("level", (F.col("__start") + F.col("__place")).alias("node"), *GRAMS, "freq")




class _Walk:
    """Sorted windows row by row: where n-grams of each level begin, and their places in the order of the tree (those of one type apart), from 0 in a range."""

    def __init__(self):
        self.last = np.full(LEVELS, -1, dtype=np.int64)
        self.made = 0  # n-grams of two types or more
        self.ordinal = dict.fromkeys(range(1, LEVELS + 1), -1)
        self.at = dict.fromkeys(range(1, LEVELS + 1), -1)

    def chunk(self, columns: list[np.ndarray]) -> None:
        g = _unpacked(columns)
        new = np.logical_or.accumulate(g != np.vstack([self.last[None, :], g[:-1]]), axis=1)
        self.g, self.begins = g, new & (g > 0)
        longer = self.begins[:, 1:].astype(np.int64)
        inside = np.cumsum(longer, axis=1) - longer
        each = longer.sum(axis=1)
        above = self.made + np.cumsum(each) - each
        #: by level, at each row: the place of the n-gram that the row is of, and its number among those of its level
        self.place, self.nth = {}, {}
        for j in range(1, LEVELS + 1):
            own = above if j == 1 else above + inside[:, j - 2]
            since = np.maximum.accumulate(np.where(self.begins[:, j - 1], np.arange(len(g)), -1))
            self.place[j] = np.where(since >= 0, own[since], self.at[j])
            self.nth[j] = self.ordinal[j] + np.cumsum(self.begins[:, j - 1])
            self.at[j], self.ordinal[j] = int(self.place[j][-1]), int(self.nth[j][-1])
        self.made += int(each.sum())
        self.last = g[-1].copy()


def _mapped(file, shape) -> np.ndarray:
    file.flush()
    return np.memmap(file, dtype=np.int64, mode="r", shape=shape) if np.prod(shape) else np.zeros(shape, dtype=np.int64)


def _walked(batches: Iterator[pa.RecordBatch], places: bool, step: int = 1 << 16):
    """(walk, frequencies by level, places by level, the rows' next ones) for each chunk of a range. An n-gram's frequency is known at its end and wanted
    at its beginning, so the range lies in a file of the task meanwhile."""
    stream, rows = _Stream(LEVELS, list(range(1, LEVELS + 1))), 0
    with ExitStack() as held:
        new = lambda: held.enter_context(tempfile.TemporaryFile())
        kept, freqs, at = new(), {j: new() for j in stream.levels}, {j: new() for j in stream.levels}

        def write(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
            for j, _, freq in found:
                freqs[j].write(freq.astype(np.int64).tobytes())
                if places:
                    at[j].write(stream.places(j, freq).tobytes())

        for batch in batches:
            columns = _columns(batch)
            kept.write(np.column_stack(columns).tobytes())
            rows += len(columns[0])
            write(stream.batch(columns))
        write(stream.end())
        if not rows:
            return
        windows = _mapped(kept, (rows, (LEVELS + 1) // 2))
        sizes = {j: freqs[j].tell() // 8 for j in stream.levels}
        f = {j: _mapped(freqs[j], (sizes[j],)) for j in stream.levels}
        p = {j: _mapped(at[j], (sizes[j],)) for j in stream.levels} if places else None
        walk, first, final = _Walk(), int(windows[0, 0] >> HALF), int(windows[-1, 0] >> HALF)
        for i in range(0, rows, step):
            walk.chunk([np.array(windows[i : i + step, c]) for c in range(windows.shape[1])])
            after = np.array(windows[i + step : i + step + 1])
            yield walk, f, p, after, (first, final), int(windows[0, 0])


def _batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns[k], pa.Array | pa.ChunkedArray) else pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def _ends(ordered: DataFrame) -> DataFrame:
    """A row a range: __part, n (n-grams of two types or more), the first and the last type, and the place at which the last type's begin."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, part, first = _Walk(), None, None
        for batch in batches:
            if batch.num_rows:
                columns = _columns(batch)
                if part is None:
                    part, first = int(columns[0][0]), int(columns[0][0] >> HALF) - 1
                walk.chunk(columns)
        if part is not None:
            names = ["__part", "n", "first", "last", "begin"]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, walk.made, first, int(walk.last[0]) - 1, walk.at[1])], names=names)

    return ordered.mapInArrow(make, "__part bigint, n bigint, first bigint, last bigint, begin bigint")


def _at_ends(ordered: DataFrame, types: DataFrame) -> DataFrame:
    """__g, __f: the frequencies of the types that ranges begin or end with; two rows a range at most."""
    ends = _ends(ordered).select(F.explode(F.array("first", "last")).alias("id")).distinct()
    return F.broadcast(types.select("id", "freq").join(F.broadcast(ends), "id").select(F.col("id").alias("__g"), F.col("freq").alias("__f")))


def tree(ordered: DataFrame, types: DataFrame) -> DataFrame:
    """node, parent, word, amount: tables.tree_rows() of all n-grams. Numbers are places in sorted order, and each type is an n-gram by itself: one exchange is enough."""
    schema = {c: pa.int64() for c in ("level", "g1", "word", "amount", "own", "above", "__part")}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for walk, f, _, _, ends, part in _walked(batches, False):
            for j in range(1, LEVELS + 1):
                at = np.flatnonzero(walk.begins[:, j - 1])
                g1 = walk.g[at, 0]
                edge = np.isin(g1, ends)
                amount = pa.array(f[j][walk.nth[j][at]], mask=edge if j == 1 else None)
                # the n-grams of a range's first type may have begun in an earlier one
                above = pa.array(walk.place[max(1, j - 1)][at], mask=g1 == ends[0] if j <= 2 else None)
                yield _batch(schema, level=np.full(len(at), j), g1=g1 - 1, word=walk.g[at, j - 1] - 1, amount=amount, own=walk.place[j][at], above=above, __part=np.full(len(at), part))

    found = ordered.mapInArrow(make, ", ".join(f"{c} bigint" for c in schema))
    order = Window.orderBy("__part")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # a row a range
    ends = _ends(ordered).withColumn("s", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("on", F.coalesce(F.lag("last").over(order) == F.col("first"), F.lit(False)))
    ends = ends.withColumn("mine", F.when(~F.col("on") | (F.col("first") != F.col("last")), F.col("s") + F.col("begin")))
    ends = ends.select(F.col("__part").alias("__r"), "s", "on", F.when(F.col("on"), F.last("mine", ignorenulls=True).over(upto)).otherwise(F.col("s")).alias("c0"))
    out = found.join(F.broadcast(ends), F.col("__part") == F.col("__r")).join(_at_ends(ordered, types), F.col("g1") == F.col("__g"), "left")
    # above is null for a range's first type: if that began before, its row is there
    out = out.where(~((F.col("level") == 1) & F.col("above").isNull() & F.col("on")))
    begin = F.coalesce(F.col("s") + F.col("above"), F.col("c0"))
    base = F.col("g1") + 1
    node = F.when(F.col("level") == 1, base + begin).otherwise(base + F.col("s") + F.col("own") + 1)
    parent = F.when(F.col("level") == 1, F.lit(0).cast("bigint")).when(F.col("level") == 2, base + begin).otherwise(base + F.col("s") + F.col("above") + 1)
    return out.select(node.alias("node"), parent.alias("parent"), "word", F.coalesce("amount", "__f").alias("amount"))


def leaf_paths(ordered: DataFrame, types: DataFrame) -> DataFrame:
    """tables.leaf_paths() of all n-grams: the last window of an n-gram tells if a longer one continues it."""
    schema = {"g1": pa.int64(), "f1": pa.int64(), "rest": pa.string()}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for walk, f, _, after, ends, _ in _walked(batches, False):
            g = walk.g
            depth = (g > 0).sum(axis=1)
            follow = np.vstack([g[1:], _unpacked(list(after.T)) if len(after) else np.full((1, LEVELS), -1)])
            differ = np.logical_or.accumulate(g != follow, axis=1)
            leaf = differ[np.arange(len(g)), depth - 1] & (depth > 1)
            for k in range(2, LEVELS + 1):
                at = np.flatnonzero(leaf & (depth == k))
                if not len(at):
                    continue
                cells = [[" ", pc.cast(pa.array(g[at, j - 1] - 1), pa.string()), "(", pc.cast(pa.array(f[j][walk.nth[j][at]]), pa.string()), ")"] for j in range(2, k + 1)]
                rest = pc.binary_join_element_wise(*[x for c in cells for x in c], "")
                yield _batch(schema, g1=g[at, 0] - 1, f1=pa.array(f[1][walk.nth[1][at]], mask=np.isin(g[at, 0], ends)), rest=rest)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1 = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(p1[p1 & ((1 << HALF) - 1) > 0] >> HALF) - 1)], names=["id"])

    found = ordered.mapInArrow(make, "g1 bigint, f1 bigint, rest string").join(_at_ends(ordered, types), F.col("g1") == F.col("__g"), "left")
    longer = found.select(F.concat(F.col("g1").cast("string"), F.lit("("), F.coalesce("f1", "__f").cast("string"), F.lit(")"), F.col("rest")).alias("value"))
    alone = types.select("id", "freq").join(ordered.mapInArrow(heads, "id bigint").distinct(), "id", "left_anti")
    return longer.unionByName(alone.select(F.concat(F.col("id").cast("string"), F.lit("("), F.col("freq").cast("string"), F.lit(")")).alias("value")))


def trie(ordered: DataFrame, unigrams: DataFrame) -> DataFrame:
    """level, node, parentnode, united, freq: ngrams.trie() of all n-grams. unigrams: g1, node, freq of the types."""
    schema = {c: pa.int64() for c in ("level", "united", "freq", "place", "over", "above", "__part")}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for walk, f, p, _, _, part in _walked(batches, True):
            for j in range(2, LEVELS + 1):
                at = np.flatnonzero(walk.begins[:, j - 1])
                own, up = walk.nth[j][at], walk.nth[j - 1][at]
                # a type's frequency and number are known elsewhere
                over, above = (np.zeros(len(at), dtype=np.int64), walk.g[at, 0] - 1) if j == 2 else (f[j - 1][up], p[j - 1][up])
                yield _batch(schema, level=np.full(len(at), j), united=walk.g[at, j - 1] - 1, freq=f[j][own], place=p[j][own], over=over, above=above, __part=np.full(len(at), part))

    found = ordered.mapInArrow(make, ", ".join(f"{c} bigint" for c in schema))
    starts = _starts(ordered, LEVELS, list(range(2, LEVELS + 1)))
    out = found.join(F.broadcast(starts), (F.col("__part") == F.col("__r")) & (F.col("level") == F.col("__l")) & (F.col("freq") == F.col("__f")))
    up = starts.select(F.col("__r").alias("__r2"), (F.col("__l") + 1).alias("__l2"), F.col("__f").alias("__f2"), F.col("__start").alias("__start2"))
    out = out.select("level", (F.col("__start") + F.col("place")).alias("node"), "united", "freq", "over", "above", "__part")
    longer = out.where("level > 2").join(F.broadcast(up), (F.col("__part") == F.col("__r2")) & (F.col("level") == F.col("__l2")) & (F.col("over") == F.col("__f2")))
    longer = longer.select("level", "node", (F.col("__start2") + F.col("above")).alias("parentnode"), "united", "freq")
    second = out.where("level = 2").join(unigrams.select(F.col("g1").alias("above"), F.col("node").alias("parentnode")), "above").select("level", "node", "parentnode", "united", "freq")
    first = unigrams.select(F.lit(1).cast("bigint").alias("level"), "node", F.lit(None).cast("bigint").alias("parentnode"), F.col("g1").alias("united"), "freq")
    return first.unionByName(second).unionByName(longer)
