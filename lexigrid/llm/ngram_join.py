"""Operator 3, n-gram Jaccard self-join with set relations.

A document is the set of its runs of N words, hashed to 32 bits; a document of fewer words is one run of them all. Two documents match
if the Jaccard similarity of their sets is THRESHOLD at least. The result has each document that matches another, with the number of documents
that it matches and its class, the connected component. Nothing is estimated: every match is counted.

1. Equal sets are one, found by 128-bit digests. Highly similar sets meet by a minhash and a size class, those left alone by further minhashes: a set whose
   similarity to a leader is (1 + THRESHOLD) / 2 at least follows it. Jaccard distance is a metric, so any two sets of such a class match: these answers
   are derived. In a dense crowd, whose classes would all be each other's pairs, a set follows a leader that it matches: such a loose class is connected,
   and its members are compared. From then on a follower is its difference from the leader.
2. Exact frequencies of all n-grams (of leaders, and of followers' differences) give one global order, rarest first. Each block of sets sends its
   distinct n-grams once and gets a code for each back. Only prefixes are indexed, without n-grams that a single set has: such an n-gram makes no pair.
3. Inverted lists hold classes, sorted by size and cut into blocks that know their smallest size and the most n-grams that are left behind
   a position. A block is skipped as a whole if these leave too few n-grams for the threshold, then entries are.
4. A pair of classes is answered from the overlap of its leaders and from the differences: if the largest differences can't turn the answer, it holds for all
   members. Only otherwise are members compared, in chunks, on leaders and differences.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .graph import components
from .shared import BROADCAST_ROWS, discard, partitions, save, small, small_batches, table, texts, without

N = 3
THRESHOLD = 0.5
#: Sets that a set is compared with to find its leader. It affects speed alone.
LEADERS = 8
#: Sets of one minhash that one task looks at; larger groups are split, and their leaders meet in the index.
CROWD = 4096
#: Minhashes of a set; sets of one from which on a crowd is dense; followers that a leader may have. They affect speed alone.
KEYS = ["key1", "key2", "key3", "key4"]
DENSE = 16
FANS = 4095
#: N-grams, about, that one task counts at a time.
PART_GRAMS = 3 << 20
#: Entries of a list that are skipped together, members of a class that are compared together.
LIST_BLOCK = 8
CHUNK_SETS = 128
CHUNK_GRAMS = 250_000
#: Classes on each side of a unit of work (four followers count as one).
UNIT_SETS = 256


def doc_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit n-grams of each row, and the row bounds."""
    w = tk.Words(column)
    found = [w.grams(n)]
    for k in range(1, n):
        rows = np.flatnonzero(w.counts == k)
        h = np.zeros(len(rows), np.uint64)
        for i in range(k):
            h = h * np.uint64(tk.BASE) + w.hashes[w.bounds[rows] + i]
        found.append((tk.mix(h, k), rows))
    grams, rows = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    keys = np.unique((rows.astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32)))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys, np.arange(len(column) + 1).astype(np.uint64) << np.uint64(32))


def least(threshold: float, a, b):
    """Common n-grams that sets of these sizes need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def prefix(threshold: float, n):
    """The n-grams, rarest first, of which a set shares one with each match."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _digests(batches, n):
    for b in tk.slices(batches):
        grams, bounds = doc_sets(b.column("text"), n)
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        g, at = grams.astype(np.uint64), bounds[some]
        # similar sets have about the same size: with it in the key, documents that merely share a frequent n-gram spread over many keys
        kind = np.floor(np.log(sizes[some]) / np.log(1.5)).astype(np.uint64)
        keys = [tk.mix(np.minimum.reduceat(tk.mix(g, seed), at) + kind, 6).view(np.int64) for seed in range(5, 5 + len(KEYS))]
        sums = [np.add.reduceat(tk.mix(g, seed), at).view(np.int64) for seed in (31, 32)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array(sizes[some].astype(np.int64)), *map(pa.array, [*sums, *keys])], ["doc_id", "n", "h1", "h2", *KEYS])


#: A slice of sets in one row, so that a block's n-grams stay together: for each set its class, own size, smallest and largest size in the class, most n-grams that
#: a follower adds and lacks, n-grams to index, followers (-1: it is one itself), n-grams listed; then the lists, end to end.
FIELDS = {"cls": np.int64, "n": np.int64, "lo": np.int64, "hi": np.int64, "added": np.int64, "lacks": np.int64, "pre": np.int64, "fans": np.int64, "m": np.int64}
SETS = "block bigint, " + ", ".join(f"{k} binary" for k in FIELDS) + ", grams binary"
MEMBERS = "doc_id bigint, leader bigint, size bigint, more binary, less binary"


def _block(number: int) -> int:
    return (TaskContext.get().partitionId() << 28) + number


def _slice(block: int, rows: dict[str, np.ndarray], grams: bytes) -> dict[str, list]:
    return {"block": [block], **{k: [np.ascontiguousarray(rows[k], kind).tobytes()] for k, kind in FIELDS.items()}, "grams": [grams]}


def _types() -> dict[str, pa.DataType]:
    return {"block": pa.int64(), **{k: pa.binary() for k in FIELDS}, "grams": pa.binary(), "doc_id": pa.int64(), "leader": pa.int64(), "size": pa.int64(), "more": pa.binary(), "less": pa.binary()}


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = _types()
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], list(columns))


def _alone(batches, n, threshold):
    """Sets that share no minhash with others: one row of SETS a slice."""
    number = 0
    for b in tk.slices(batches, most=8 * tk.CHUNK):
        grams, bounds = doc_sets(b.column("text"), n)
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        size, none = sizes[some], np.zeros(len(some), np.int64)
        ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[some]
        yield _batch(_slice(_block(2 * number), {"cls": ids, "n": size, "lo": size, "hi": size, "added": none, "lacks": none, "pre": prefix(threshold, size), "fans": none, "m": size}, grams.tobytes()))
        number += 1


def _sets(batches, n):
    """Sets in rows of their own, for _lead()."""
    for b in tk.slices(batches):
        grams, bounds = doc_sets(b.column("text"), n)
        sizes = np.diff(bounds)
        some = pa.array(np.flatnonzero(sizes))
        blobs = [grams[bounds[i] : bounds[i + 1]].tobytes() for i in some.to_numpy()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(some), b.column("key").take(some), b.column("salt").take(some), b.column("dense").take(some), pa.array(sizes[some.to_numpy()].astype(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "key", "salt", "dense", "n", "grams"])


class _Leader:
    def __init__(self, doc: int, grams: np.ndarray, threshold: float):
        n = len(grams)
        self.doc, self.grams, self.n = doc, grams, n
        self.lo = self.hi = n
        self.added = self.lacks = self.fans = 0
        self.pre = int(prefix(threshold, np.int64(n)))

    def follow(self, size: int, added: int, lacks: int, threshold: float) -> None:
        self.lo, self.hi, self.fans = min(self.lo, size), max(self.hi, size), self.fans + 1
        self.added, self.lacks = max(self.added, added), max(self.lacks, lacks)
        # an n-gram of a follower's prefix is at most ``lacks`` places further back in the leader
        self.pre = max(self.pre, int(prefix(threshold, np.int64(size))) + lacks)


def _lead(batches, threshold, most):
    """Rows sorted by key, salt, n, doc_id -> SETS of leaders (with so many followers at most) and of followers' differences, and MEMBERS of followers."""
    near = (1 + threshold) / 2
    key, leaders, number = None, [], 0
    held: dict[str, list] = {k: [] for k in FIELDS}
    grams: list[bytes] = []
    size_held = 0
    members: dict[str, list] = {k: [] for k in ("doc_id", "leader", "size", "more", "less")}

    def put(blob, **values):
        nonlocal size_held
        for k, v in values.items():
            held[k].append(v)
        grams.append(blob)
        size_held += len(blob)

    def evict(x: _Leader):
        put(x.grams.tobytes(), cls=x.doc, n=x.n, lo=x.lo, hi=x.hi, added=x.added, lacks=x.lacks, pre=x.pre, fans=x.fans, m=x.n)

    def flush():
        nonlocal number, size_held
        if grams:
            rows = _slice(_block(2 * number + 1), {k: np.array(v, np.int64) for k, v in held.items()}, b"".join(grams))
            yield _batch({**rows, **{k: [None] for k in members}})
            number += 1
        if members["doc_id"]:
            blank = [None] * len(members["doc_id"])
            yield _batch({**{k: blank for k in rows_of}, **members})
        for x in (*held.values(), grams, *members.values()):
            x.clear()
        size_held = 0

    rows_of = ("block", *FIELDS, "grams")
    for b in batches:
        keys = zip(b.column("key").to_pylist(), b.column("salt").to_pylist())
        for k, doc, dense, size, blob in zip(keys, b.column("doc_id").to_pylist(), b.column("dense").to_pylist(), b.column("n").to_pylist(), b.column("grams")):
            if k != key:
                for x in leaders:
                    evict(x)
                key, leaders = k, []
            x = np.frombuffer(blob.as_buffer(), np.uint32)
            reach = threshold if dense else near
            # in a dense crowd the nearest leaders come first, so that sets gather around few of them
            for leader in sorted(leaders, key=lambda y: overlap(y.grams, x), reverse=True) if dense else reversed(leaders):
                if leader.n >= reach * size - 1e-9 and overlap(leader.grams, x) >= least(reach, leader.n, size):
                    more, less = np.setdiff1d(x, leader.grams, assume_unique=True), np.setdiff1d(leader.grams, x, assume_unique=True)
                    leader.follow(size, len(more), len(less), threshold)
                    put(more.tobytes(), cls=leader.doc, n=size, lo=size, hi=size, added=0, lacks=0, pre=int(prefix(threshold, np.int64(size))), fans=-1, m=len(more))
                    for c, v in zip(members, (doc, leader.doc, size, more.tobytes(), less.tobytes())):
                        members[c].append(v)
                    if leader.fans == most:
                        leaders.remove(leader)
                        evict(leader)
                    break
            else:
                if len(leaders) == LEADERS:
                    # in a dense crowd those stay that many follow
                    evict(leaders.pop(min(range(LEADERS), key=lambda i: leaders[i].fans) if dense else 0))
                leaders.append(_Leader(doc, x.copy(), threshold))
            if size_held > 8 * tk.CHUNK:
                yield from flush()
    for x in leaders:
        evict(x)
    yield from flush()


def _gaps(sorted_: np.ndarray) -> bytes:
    """Ascending 32-bit numbers: a byte 1, the first, and 16-bit gaps (65535: and more), or a byte 0 and the numbers, whichever is shorter."""
    gaps = np.diff(sorted_.astype(np.int64))
    more = gaps // 65535
    if 2 * (len(gaps) + more.sum()) >= 4 * len(gaps):
        return b"\0" + sorted_.astype(np.uint32).tobytes()
    out = np.full(len(gaps) + more.sum(), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = gaps - 65535 * more
    return b"\1" + sorted_[:1].astype(np.uint32).tobytes() + out.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, np.uint32, offset=1)
    gaps = np.frombuffer(data, np.uint16, offset=5)
    return np.frombuffer(data, np.uint32, 1, 1) + np.r_[np.uint32(0), np.cumsum(gaps, dtype=np.uint32)[gaps != 65535]]


def _spread(batches, parts):
    """The distinct n-grams of each block, and how many of its sets have them, by range."""
    edges = (np.arange(1, parts, dtype=np.int64) << 32) // parts
    for b in batches:
        for block, blob in zip(b.column("block").to_pylist(), b.column("grams")):
            grams, counts = np.unique(np.frombuffer(blob.as_buffer(), np.uint32), return_counts=True)
            cuts = np.r_[0, np.searchsorted(grams.astype(np.int64), edges), len(grams)]
            some = np.flatnonzero(np.diff(cuts))
            counts = np.minimum(counts, 255).astype(np.uint8)
            for at in range(0, len(some), 256):
                own = some[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([block] * len(own), pa.int64()), pa.array([_gaps(grams[cuts[p] : cuts[p + 1]]) for p in own], pa.binary()), pa.array([counts[cuts[p] : cuts[p + 1]].tobytes() for p in own], pa.binary())], ["part", "block", "grams", "counts"])


def _codes(t: pa.Table) -> pa.Table:
    """For each block its n-grams' codes: 0 for those of a single set, else 1 and eight times the logarithm of their number."""
    grams = [_from_gaps(x.as_py()) for x in t.column("grams")]
    ends = np.cumsum([len(x) for x in grams])
    grams = np.concatenate(grams)
    order = np.argsort(grams, kind="stable")
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("counts")])[order].astype(np.int64)
    grams = grams[order]
    begins = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    number = np.add.reduceat(counts, begins)
    code = np.where(number > 1, np.minimum(255, 1 + (8 * np.log2(number)).astype(np.int64)), 0).astype(np.uint8)
    codes = np.empty(len(grams), np.uint8)
    codes[order] = np.repeat(code, np.diff(np.r_[begins, len(grams)]))
    return pa.table({"block": t.column("block"), "part": t.column("part"), "codes": pa.array([x.tobytes() for x in np.split(codes, ends[:-1])], pa.binary())})


INDEX = "part int, grams binary, row binary, room binary, set_cls binary, set_lo binary, set_hi binary"
CORES = "cls bigint, n bigint, lo bigint, hi bigint, added bigint, lacks bigint, fans bigint, core binary"


def _index(parts, threshold):
    """A block and its codes -> INDEX rows of prefix entries, CORES of leaders: their n-grams that other sets have too, all of them where a class may be loose."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = {"part": pa.int32(), **{c: pa.binary() for c in ("grams", "row", "room", "set_cls", "set_lo", "set_hi")}, **{c: pa.int64() for c in ("cls", "n", "lo", "hi", "added", "lacks", "fans")}, "core": pa.binary()}
        out: dict[str, list] = {k: [] for k in names}
        if left.num_rows:
            x = {k: np.frombuffer(left.column(k)[0].as_py(), kind) for k, kind in FIELDS.items()}
            grams = np.frombuffer(left.column("grams")[0].as_py(), np.uint32)
            by = np.argsort(right.column("part").to_numpy())
            blobs = right.column("codes").to_pylist()
            codes = np.frombuffer(b"".join(blobs[i] for i in by), np.uint8)
            distinct, inverse = np.unique(grams, return_inverse=True)
            if len(distinct) != len(codes):
                raise ValueError("a block of sets and its codes don't agree")
            rank = codes[inverse].astype(np.uint64)
            bounds = np.r_[0, np.cumsum(x["m"])]
            shared = rank > 0
            before = np.r_[0, np.cumsum(shared)]
            loose = x["n"] - x["lacks"] < (1 + threshold) / 2 * (x["n"] + x["added"]) + 1e-9  # followers have n-grams of the leader that no other class has
            for i in np.flatnonzero(x["fans"] >= 0):
                own = slice(bounds[i], bounds[i + 1])
                if before[bounds[i + 1]] > before[bounds[i]] or x["fans"][i]:
                    for k in ("cls", "n", "lo", "hi", "added", "lacks", "fans"):
                        out[k].append(int(x[k][i]))
                    out["core"].append(grams[own][shared[own] | loose[i]].tobytes())
            for k in ("part", "grams", "row", "room", "set_cls", "set_lo", "set_hi"):
                out[k] += [None] * len(out["cls"])
            rows = np.repeat(np.arange(len(x["m"]), dtype=np.uint64), x["m"])
            keys = np.sort((rows << np.uint64(40)) | (rank << np.uint64(32)) | grams)
            place = np.arange(len(keys)) - np.repeat(bounds[:-1], x["m"])
            rows = (keys >> np.uint64(40)).astype(np.int64)
            keep = ((keys >> np.uint64(32)) & np.uint64(255) > 0) & (place < x["pre"][rows])
            rows, place, grams = rows[keep], place[keep], (keys[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            room = x["n"][rows] - place + np.where(x["fans"][rows] > 0, x["added"][rows], 0)
            part = (tk.mix(grams.astype(np.uint64), 9) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((x["cls"][rows], grams, part))
            rows, room, grams, part = rows[order], room[order], grams[order], part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(ends)):
                at = slice(ends[p], ends[p + 1])
                own, inner = np.unique(rows[at], return_inverse=True)
                for k, v in (("part", int(p)), ("grams", _gaps(grams[at])), ("row", inner.astype(np.uint32).tobytes()), ("room", room[at].astype(np.uint32).tobytes()), ("set_cls", x["cls"][own].tobytes()), ("set_lo", x["lo"][own].astype(np.uint32).tobytes()), ("set_hi", x["hi"][own].astype(np.uint32).tobytes())):
                    out[k].append(v)
                for k in ("cls", "n", "lo", "hi", "added", "lacks", "fans", "core"):
                    out[k].append(None)
        return pa.table({k: pa.array(v, names[k]) for k, v in out.items()})

    return run


def candidates(grams, cls, lo, hi, room, threshold):
    """Pairs of entries, as places in the arrays, of lists' different classes that sizes and positions allow. Entries are sorted by n-gram."""
    order = np.lexsort((lo, grams))
    g, c = grams[order], cls[order]
    if not len(g):
        return
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    lengths = np.diff(np.r_[starts, len(g)])
    mixed = (np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)) & (lengths > 1)  # a list of one class has no pair
    order, lengths = order[np.repeat(mixed, lengths)], lengths[mixed]
    if not len(order):
        return
    c, lo, hi, room = cls[order], lo[order].astype(np.int64), hi[order].astype(np.int64), room[order].astype(np.int64)
    first = np.cumsum(lengths) - lengths
    end = np.repeat(first + lengths, lengths)
    blocks = -(-lengths // LIST_BLOCK)
    heads = np.repeat(first, blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * LIST_BLOCK
    block = np.searchsorted(heads, np.arange(len(c)), side="right") - 1
    last_block = np.repeat(np.cumsum(blocks), lengths)
    least_lo, most_hi, most_room = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads), np.maximum.reduceat(room, heads)

    def fits(i, other_lo, other_hi, other_room):
        return (hi[i] >= threshold * other_lo - 1e-9) & (other_hi >= threshold * lo[i] - 1e-9) & (np.minimum(room[i], other_room) >= least(threshold, lo[i], other_lo))

    def pairs(i, j):
        hit = (c[i] != c[j]) & fits(i, lo[j], hi[j], room[j])
        return order[i[hit]], order[j[hit]]

    at = np.arange(len(c))
    block_end = np.minimum(np.r_[heads[1:], len(c)][block], end)
    for shift in range(1, LIST_BLOCK):  # within a block
        at = at[at + shift < block_end[at]]
        if not len(at):
            break
        yield pairs(at, at + shift)
    at, shift = np.arange(len(c)), 1
    while True:  # with whole blocks further on
        at = at[block[at] + shift < last_block[at]]
        if not len(at):
            return
        other = block[at] + shift
        # sizes ascend: once a block is too large, so are all behind it
        small = hi[at] >= threshold * least_lo[other] - 1e-9
        at, other = at[small], other[small]
        open_ = fits(at, least_lo[other], most_hi[other], most_room[other])
        i, b = at[open_], other[open_]
        for k in range(LIST_BLOCK):
            j = heads[b] + k
            inside = j < end[i]
            i, b, j = i[inside], b[inside], j[inside]
            if len(i):
                yield pairs(i, j)
        shift += 1


def _meet(threshold):
    def run(t: pa.Table) -> pa.Table:
        grams, row, room, cls, lo, hi, before = [], [], [], [], [], [], 0
        for r in t.select(["grams", "row", "room", "set_cls", "set_lo", "set_hi"]).to_pylist():
            grams.append(_from_gaps(r["grams"]))
            row.append(np.frombuffer(r["row"], np.uint32).astype(np.int64) + before)
            room.append(np.frombuffer(r["room"], np.uint32))
            cls.append(np.frombuffer(r["set_cls"], np.int64))
            lo.append(np.frombuffer(r["set_lo"], np.uint32))
            hi.append(np.frombuffer(r["set_hi"], np.uint32))
            before += len(cls[-1])
        grams, row, room, cls, lo, hi = map(np.concatenate, (grams, row, room, cls, lo, hi))
        names, code = np.unique(cls, return_inverse=True)
        code, lo, hi = code[row], lo[row], hi[row]
        # a class's entries in one list are one
        order = np.lexsort((code, grams))
        g, c = grams[order], code[order]
        begins = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        grams, code = g[begins], c[begins]
        lo, hi, room = np.minimum.reduceat(lo[order], begins), np.maximum.reduceat(hi[order], begins), np.maximum.reduceat(room[order], begins)
        seen, held = [np.zeros(0, np.uint64)], 0
        for i, j in candidates(grams, code, lo, hi, room, threshold):
            for k in range(0, len(i), 1 << 20):
                x, y = code[i[k : k + (1 << 20)]], code[j[k : k + (1 << 20)]]
                seen.append(np.unique((np.minimum(x, y).astype(np.uint64) << np.uint64(32)) | np.maximum(x, y).astype(np.uint64)))
                held += len(seen[-1])
                if held > 1 << 21:
                    seen, held = [np.unique(np.concatenate(seen))], 0
        keys = np.unique(np.concatenate(seen))
        return pa.table({"a": pa.array(names[(keys >> np.uint64(32)).astype(np.int64)]), "b": pa.array(names[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)])})

    return run


class _Class:
    """A class as a unit of work has it: its leader's shared n-grams, the bounds of its members, and the members."""

    def __init__(self, row: dict):
        self.row, self.core = row, np.frombuffer(row["core"], np.uint32)
        self.held: list[tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]] | None = None

    def chunks(self):
        """((n-grams in order, their rows, distinct n-grams, where each begins), doc_ids, sizes, documents with the set) of some members at a time; the leader is a member."""
        if self.held is None:
            r = self.row
            rows = [{"doc_id": r["cls"], "size": r["n"], "more": b"", "less": b"", "docs": r["docs"]}, *(r["members"] or [])]
            step = max(1, min(CHUNK_SETS, CHUNK_GRAMS // r["n"]))
            self.held = []
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                sets = [np.concatenate([np.setdiff1d(self.core, np.frombuffer(m["less"], np.uint32), assume_unique=True), np.frombuffer(m["more"], np.uint32)]) for m in part]
                grams, rows_of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                order = np.argsort(grams, kind="stable")
                names, begins = np.unique(grams[order], return_index=True)
                self.held.append(((grams[order], rows_of[order], names, np.r_[begins, len(grams)]), *(np.array([m[k] for m in part], np.int64) for k in ("doc_id", "size", "docs"))))
        return self.held


def _overlaps(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], sets_a: int, sets_b: int) -> np.ndarray:
    """Common n-grams of each set of one chunk with each of the other's."""
    if sets_b < sets_a:
        return _overlaps(b, a, sets_b, sets_a).T
    (grams_a, rows_a, names_a, _), (_, rows_b, names_b, begins_b) = a, b
    if sets_a <= 2:  # a set alone against many: its n-grams' rows are counted
        out = np.zeros((sets_a, sets_b), np.int64)
        for i in range(sets_a if len(names_b) else 0):
            x = grams_a[rows_a == i]
            at = np.searchsorted(names_b, x)
            at[at == len(names_b)] = 0
            at = at[names_b[at] == x]
            length = begins_b[at + 1] - begins_b[at]
            out[i] = np.bincount(rows_b[np.repeat(begins_b[at] - np.cumsum(length) + length, length) + np.arange(length.sum())], minlength=sets_b)
        return out
    names = np.intersect1d(names_a, names_b, assume_unique=True)  # an n-gram of one side alone is in no overlap
    return _matrix(a, names, sets_a) @ _matrix(b, names, sets_b).T


def _matrix(chunk: tuple[np.ndarray, ...], names: np.ndarray, sets: int) -> np.ndarray:
    """Which sets (rows) have which of the sorted names."""
    grams, rows = chunk[:2]
    out = np.zeros((sets, len(names)), np.float32)
    if len(names):
        at = np.searchsorted(names, grams)
        at[at == len(names)] = 0
        hit = names[at] == grams
        out[rows[hit], at[hit]] = 1
    return out


def _compare(a: _Class, b: _Class, threshold: float) -> dict[int, int]:
    """For each member that matches members of the other class, how many documents these are; for a class and itself, other members."""
    links: dict[int, int] = {}
    for i, (sets_a, ids_a, n_a, docs_a) in enumerate(a.chunks()):
        for j, (sets_b, ids_b, n_b, docs_b) in enumerate(b.chunks()):
            if a is b and j < i:
                continue
            hit = _overlaps(sets_a, sets_b, len(ids_a), len(ids_b)) >= least(threshold, n_a[:, None], n_b[None, :])
            found = [(ids_a, hit @ docs_b), (ids_b, hit.T @ docs_a)]
            if a is b and i == j:
                np.fill_diagonal(hit, False)
                found = [(ids_a, hit @ docs_b)]
            for ids, counts in found:
                for d, n in zip(ids[counts > 0].tolist(), counts[counts > 0].tolist()):
                    links[d] = links.get(d, 0) + n
    return links


def _answer(threshold):
    """Pairs of classes and the classes -> (a, b) alone if all members match, and (a, b, doc_id, links) of members where only some do."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        classes = {r["cls"]: _Class(r) for r in right.to_pylist()}
        out: dict[str, list] = {"a": [], "b": [], "doc_id": [], "links": []}
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = classes[a], classes[b]
            common, p, q = overlap(x.core, y.core), x.row, y.row
            if a == b:
                found = list(_compare(x, x, threshold).items())
            elif common - p["lacks"] - q["lacks"] >= least(threshold, p["hi"], q["hi"]):
                found = [(None, None)]
            elif common + p["added"] + q["added"] < least(threshold, p["lo"], q["lo"]):
                continue
            else:
                found = list(_compare(x, y, threshold).items())
            for k, v in zip(out, ([a] * len(found), [b] * len(found), [d for d, _ in found], [n for _, n in found])):
                out[k] += v
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def one_text_each(docs: DataFrame, scratch: list[str]) -> DataFrame:
    """doc_id and text; of rows that repeat a doc_id, the smallest text counts."""
    rows = texts(docs)
    again = save(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "again", scratch)
    if again.isEmpty():
        return rows
    of = F.col("doc_id") == F.col("again")
    return rows.join(small(again), of, "left_anti").unionByName(rows.join(small(again), of, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links of each document that matches another: the smallest doc_id of its connected component, and how many documents it matches.

    Rows without doc_id or text and texts without words match nothing; of rows that repeat a doc_id the one with the smallest text counts; ties need no rule;
    other columns are ignored; an empty table gives none. The result is a saved table."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch: list[str] = []
    rows = one_text_each(docs, scratch)
    digests = save(rows.mapInArrow(lambda it: _digests(it, n), "doc_id bigint, n bigint, h1 bigint, h2 bigint, " + ", ".join(f"{k} bigint" for k in KEYS)), "digests", scratch)
    distinct = save(digests.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), F.min("n").alias("n"), *[F.min(k).alias(k) for k in KEYS]), "distinct", scratch)
    equal = distinct.where("docs > 1").select("h1", "h2", "rep")
    copies = save(digests.join(equal, ["h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies", scratch)
    crowds: list[DataFrame] = []
    for k in KEYS:  # those left alone by one minhash may meet by the next, in dense crowds only
        left = distinct.select("rep", F.col(k).alias("key"))
        for before in crowds:
            left = left.join(small(before.select(F.col("crowd_id").alias("met"))), F.col("rep") == F.col("met"), "left_anti")
        shared = left.groupBy("key").agg(F.count("*").alias("c")).where(f"c >= {DENSE if crowds else 2}")
        crowds.append(save(left.join(shared, "key").select(F.col("rep").alias("crowd_id"), "key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / CROWD)).alias("salt"), (F.col("c") >= DENSE).alias("dense")), "crowd", scratch))
    crowd = functools.reduce(DataFrame.unionByName, crowds)
    rows = without(rows, copies.select("doc_id"))
    alone = without(rows, crowd.select("crowd_id"))
    alone = save(alone.mapInArrow(lambda it: _alone(it, n, threshold), SETS), "alone", scratch)
    crowded = rows.join(small(crowd, BROADCAST_ROWS // 2), F.col("doc_id") == F.col("crowd_id")).select("doc_id", "text", "key", "salt", "dense")
    crowded = crowded.mapInArrow(lambda it: _sets(it, n), "doc_id bigint, key bigint, salt bigint, dense boolean, n bigint, grams binary")
    crowded = crowded.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "n", "doc_id")
    most = FANS
    led = save(crowded.mapInArrow(lambda it: _lead(it, threshold, most), f"{SETS}, {MEMBERS}"), "led", scratch)
    members = led.where("doc_id IS NOT NULL").select("doc_id", "leader", "size", "more", "less")
    sets = alone.unionByName(led.where("block IS NOT NULL").select(*alone.columns))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    parts = max(8, partitions(spark) // 2, math.ceil(total / PART_GRAMS))
    counted = sets.select("block", "grams").mapInArrow(lambda it: _spread(it, parts), "part int, block bigint, grams binary, counts binary")
    codes = counted.groupBy("part").applyInArrow(_codes, "block bigint, part int, codes binary")
    index = sets.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_index(parts, threshold), f"{INDEX}, {CORES}")
    index = save(index, "index", scratch)
    entries = index.where("part IS NOT NULL").select("part", "grams", "row", "room", "set_cls", "set_lo", "set_hi")
    cores = index.where("cls IS NOT NULL").select("cls", "n", "lo", "hi", "added", "lacks", "fans", "core")
    # members of a loose class needn't match each other: it is a pair with itself
    same, both = F.col("size") - F.octet_length("more") / 4, F.col("size") + F.octet_length("less") / 4
    loose = save(members.where(same < (1 + threshold) / 2 * both + 1e-9).select(F.col("leader").alias("loose")).distinct(), "loose", scratch)
    met_pairs = entries.groupBy("part").applyInArrow(_meet(threshold), "a bigint, b bigint").distinct()
    pairs = save(met_pairs.unionByName(loose.select(F.col("loose").alias("a"), F.col("loose").alias("b"))), "pairs", scratch)
    weights = distinct.select("rep", "docs").join(members.select(F.col("doc_id").alias("rep"), "leader"), "rep", "left").select("rep", "docs", F.coalesce("leader", "rep").alias("cls"))
    weights = save(weights, "weights", scratch)
    classes = save(weights.groupBy("cls").agg(F.sum("docs").alias("cls_docs")), "classes", scratch)
    # what the units of work need of each class: its leader and its members (a salted crowd bounds their number)
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", scratch)
    several = distinct.where("docs > 1").select(F.col("rep").alias("several"), "docs")
    docs_of = lambda rows, key: rows.join(small(several), F.col(key) == F.col("several"), "left").withColumn("docs", F.coalesce("docs", F.lit(1)).cast("bigint")).drop("several")
    own = docs_of(members.join(small(wanted), F.col("leader") == F.col("id"), "left_semi"), "doc_id").groupBy("leader").agg(F.collect_list(F.struct("doc_id", "size", "more", "less", "docs")).alias("members"))
    cores = docs_of(cores.join(small(wanted), F.col("cls") == F.col("id"), "left_semi"), "cls").join(own, F.col("cls") == F.col("leader"), "left").drop("leader")
    cores = save(cores, "cores", scratch)
    # a unit has the pairs of a neighbourhood, so that a class is moved to few units; large neighbourhoods are cut into blocks on both sides
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select("of", F.least("of", "m").alias("unit"))
    placed = pairs.join(near, F.col("a") == F.col("of")).select("a", "b", "unit")
    sizes = cores.select(F.col("cls").alias("id"), (1 + F.col("fans") / 4).alias("w"))
    blocks = lambda c: placed.select("unit", F.col(c).alias("id")).distinct().join(sizes, "id").groupBy("unit").agg(F.ceil(F.sum("w") / UNIT_SETS).alias(f"n{c}"))
    placed = placed.join(blocks("a"), "unit").join(blocks("b"), "unit")
    placed = save(placed.select("a", "b", "unit", F.pmod(F.xxhash64("a"), "na").alias("i"), F.pmod(F.xxhash64("b"), "nb").alias("j")), "units", scratch)
    moved = placed.select(F.explode(F.array("a", "b")).alias("cls"), F.col("unit").alias("u"), F.col("i").alias("iu"), F.col("j").alias("ju")).distinct().join(cores, "cls")
    # as many tasks as there are partitions: their work doesn't follow their bytes
    placed, moved = placed.repartition(partitions(spark), "unit", "i", "j"), moved.repartition(partitions(spark), "u", "iu", "ju")
    answered = placed.groupBy("unit", "i", "j").cogroup(moved.groupBy("u", "iu", "ju")).applyInArrow(_answer(threshold), "a bigint, b bigint, doc_id bigint, links bigint")
    answered = save(answered, "answered", scratch)
    partial = answered.where("doc_id IS NOT NULL")

    full = answered.where("doc_id IS NULL").select("a", "b")
    both = full.unionByName(full.select(F.col("b").alias("a"), F.col("a").alias("b")))
    from_classes = both.join(classes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("cls_docs").alias("more"))
    from_sets = partial.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("own"))
    found = components(full.unionByName(partial.select("a", "b").distinct()), "groups")
    out = weights.join(classes, "cls").join(from_classes, "cls", "left").join(from_sets, "rep", "left").join(small(loose), F.col("cls") == F.col("loose"), "left").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    out = out.select("rep", F.coalesce("root", "cls").alias("root"), (F.when(F.col("loose").isNull(), F.col("cls_docs")).otherwise(F.col("docs")) - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links")).where("n_links > 0")
    out = save(out, "linked", scratch)
    out = out.join(out.groupBy("root").agg(F.min("rep").alias("class_id")), "root")
    mine = out.select(F.col("rep").alias("doc_id"), "class_id", "n_links").unionByName(copies.join(out, "rep").select("doc_id", "class_id", "n_links"))
    out = save(mine, "links")
    discard(spark, scratch)
    return out


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of a class other than its smallest doc_id; rows without doc_id stay. Nulls, repeats, ties and empty tables as in links();
    all columns are returned, whatever their names."""
    return without(docs, links(docs, n, threshold).where("doc_id <> class_id").select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
matches AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= ceil({THRESHOLD} / (1 + {THRESHOLD}) * (x.n + y.n) - 1e-9)),
edges AS (SELECT a, b FROM matches UNION SELECT b, a FROM matches),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a)
SELECT node AS doc_id, root AS class_id, n_links FROM roots JOIN degrees ON a = node
"""
