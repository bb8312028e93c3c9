"""Operator 7, benchmark decontamination by latent semantic retrieval.

1. Document frequencies of terms over all passages (PASSAGE words each) give TF-IDF weights; terms in more than
   STOP of the passages weigh nothing. Each word of the benchmark is a term of its own, so its frequency is exact; all other words share 2**TERM_BITS terms.
2. Randomised SVD: every task adds up its part of A'(A Omega) for the passage-by-term matrix A; a Nystrom step on the sum gives RANK right
   singular vectors.
3. Candidate search: windows that begin every STEP words of all documents are folded into the latent space and compared by
   cosine with all benchmark segments (items of more than SEGMENT words are cut into equal ones); short segments have shorter windows.
4. A candidate's surroundings are compared with the segment by the longest common subsequence of words: a share of VERBATIM is a
   leak, and a share of PARAPHRASE is one if ANSWER of the segment's last words, its answer, is matched too. Surroundings that have too few of the segment's
   words for any subsequence of that share are left out beforehand, which loses nothing.

What is broadcast depends on the benchmark and on the constants here, not on the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, partitions, save, small_batches, table, texts, without

TERM_BITS = 15
PASSAGE = 64
STOP = 0.05
RANK = 24
#: Leading components that are left out of the cosine: they hold language and style, which all passages of a language share.
COMMON = 6
STEP = 8
COSINE = 0.4
VERBATIM = 0.8
PARAPHRASE = 0.65
ANSWER = 0.75
ANSWER_WORDS = 8
#: Items of fewer words are too short to tell a leak from chance.
LEAST_WORDS = 5
SEGMENT = 64
#: Windows, in steps, for segments of up to so many words.
WINDOWS = ((12, 2), (24, 3), (SEGMENT, 4))
BLOCKS = 64
#: Groups of tasks whose parts of the matrix are added up first.
FAN = 32
TOKENS = 1 << 16


def tokens_of(column: pa.Array) -> np.ndarray:
    return (tk.Words(column).hashes >> np.uint64(32)).astype(np.uint32)


class Terms:
    """The terms of words: one for each of these, and 2**TERM_BITS for all others."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words.astype(np.uint32))
        self.size = len(self.words) + (1 << TERM_BITS)
        self.bits = max(1, (self.size - 1).bit_length())
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.words >> np.uint32(16)] = True

    def known(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are among the words, and their places there."""
        at = np.flatnonzero(self.maybe[tokens >> np.uint32(16)])
        if not len(self.words):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.words, tokens[at]), len(self.words) - 1)
        same = self.words[place] == tokens[at]
        return at[same], place[same]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = len(self.words) + (tokens >> np.uint32(32 - TERM_BITS)).astype(np.int64)
        at, place = self.known(tokens)
        out[at] = place
        return out


def _tokenise(batches):
    for b in tk.slices(batches):
        w = tk.Words(b.column("text"))
        tokens = (w.hashes >> np.uint64(32)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([tokens[a:z].tobytes() for a, z in zip(w.bounds, w.bounds[1:])], pa.binary())], ["doc_id", "tokens"])


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = b.column("tokens")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32) if offsets[-1] > offsets[0] else np.zeros(0, np.uint32)
    return data, (offsets - offsets[0]) // 4


def _runs(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words within rows: the run of each word, the number of runs before each row."""
    counts = np.diff(bounds)
    runs = -(-counts // size)
    before = np.r_[0, np.cumsum(runs)]
    return np.repeat(before[:-1], counts) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)) // size, before


def _frequencies(batches, terms):
    """Passages that each term is in, and in the last row the number of passages."""
    total = np.zeros(terms.size + 1, np.int64)
    for b in tk.slices(batches, "tokens", 4 * TOKENS):
        tokens, bounds = _flat(b)
        run, before = _runs(bounds, PASSAGE)
        pairs = (run << terms.bits) | terms.of(tokens)
        pairs = np.unique(pairs.astype(np.uint32) if before[-1] < 1 << (32 - terms.bits) else pairs)
        total += np.bincount(pairs & ((1 << terms.bits) - 1), minlength=terms.size + 1)
        total[-1] += before[-1]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])


def _gram_part(batches, terms, weights, omega):
    """This task's part of A'(A Omega), in blocks of rows."""
    out, weighted = np.zeros_like(omega), omega * weights[:, None]
    narrow = np.uint16 if terms.size <= 1 << 16 else np.uint32  # sorts faster
    for b in tk.slices(batches, "tokens", 4 * TOKENS):
        tokens, bounds = _flat(b)
        runs, _ = _runs(bounds, PASSAGE)
        for at in range(0, len(tokens), 4 * TOKENS):  # a long text is cut between passages
            cut = slice(at, min(at + 4 * TOKENS, len(tokens)))
            own, run = terms.of(tokens[cut]), runs[cut]
            some = weights[own] > 0
            own, run = own[some], run[some]
            if not len(own):
                continue
            begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            local = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(run)]))
            y = np.add.reduceat(weighted[own], begins)
            order = np.argsort(own.astype(narrow), kind="stable")
            sorted_terms = own[order]
            heads = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]])
            out[sorted_terms[heads]] += np.add.reduceat(y[local[order]], heads)
    out *= weights[:, None]
    if out.any():
        slot = TaskContext.get().partitionId() % FAN
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([slot] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in np.array_split(out, BLOCKS)], pa.binary())], ["block", "slot", "part"])


def _add_up(kind):
    """Sums of the parts of each block, one part after another: a task holds a sum a block."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part in zip(b.column("block").to_pylist(), b.column("part")):
                x = np.frombuffer(part.as_buffer(), kind)
                if block in total:
                    total[block] += x
                else:
                    total[block] = x.astype(np.float64)
        for block, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "part"])

    return run


def singular_vectors(gram_omega: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors of A, each over its singular value, from A'A Omega (Nystrom): what folds a text into the latent space."""
    shift = 1e-6 * np.linalg.norm(gram_omega) + 1e-12
    y = gram_omega + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, values.max() * 1e-10 + 1e-30)
    u, root, _ = np.linalg.svd(y @ (vectors / np.sqrt(values)), full_matrices=False)
    # the factor's singular values are A's
    return (u / np.maximum(root, 1e-6 * root.max() + 1e-30)).astype(np.float32)[:, min(COMMON, u.shape[1] // 4) :]


class Segments:
    """Benchmark segments, folded in, with bit masks of each word's places for the common subsequence."""

    def __init__(self, items: list[tuple[int, np.ndarray]], terms: Terms, weights: np.ndarray, basis: np.ndarray):
        self.terms, self.vocabulary = terms, terms.words
        words = [part for _, tokens in items if len(tokens) >= LEAST_WORDS for part in np.array_split(tokens, -(-len(tokens) // SEGMENT))]
        self.items = np.array([item for item, tokens in items if len(tokens) >= LEAST_WORDS for _ in range(-(-len(tokens) // SEGMENT))], np.int64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.places = np.concatenate([terms.of(w) for w in words]) if words else np.zeros(0, np.int64)
        vectors = [(basis[terms.of(w)] * weights[terms.of(w)][:, None]).sum(0) for w in words]
        self.vectors = np.array(vectors, np.float32).reshape(len(words), basis.shape[1])
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        # places of each segment's words that aren't stop words, as bits, and how many of them its surroundings must have for a leak, if all stop words are there
        self.content = np.array([sum(1 << int(j) for j in np.flatnonzero(weights[terms.of(w)] > 0)) for w in words], np.uint64)
        self.needed = np.maximum(0, np.ceil(PARAPHRASE * self.lengths - 1e-9).astype(np.int64) - (self.lengths - np.bitwise_count(self.content)))
        self.reach = -(-self.lengths // STEP)

    def members(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the vocabulary (and other words), the segments (by place in ``some``) that have it as content: bounds and list."""
        pairs = []
        begins = np.cumsum(self.lengths) - self.lengths
        for i, s in enumerate(some):
            pairs += [(self.places[begins[s] + j], i) for j in range(self.lengths[s]) if int(self.content[s]) >> j & 1]
        pairs = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        return np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 2)), pairs[:, 1]

    def masks(self, some: np.ndarray) -> np.ndarray:
        """A row for each of these segments; the last column, of other words, is zero."""
        out = np.zeros((len(some), len(self.vocabulary) + 1), np.uint64)
        begins = np.cumsum(self.lengths) - self.lengths
        for i, s in enumerate(some):
            for j in range(self.lengths[s]):
                out[i, self.places[begins[s] + j]] |= np.uint64(1 << j)
        return out


def common(masks: np.ndarray, which: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of the longest common subsequence of a segment and words[start:end], for many pairs at once: a zero bit
    for each word of it, in such a way that each prefix of the segment has its own length."""
    v = np.full(len(which), ~np.uint64(0))
    order = np.argsort(starts - ends, kind="stable")  # longest first
    which, starts, ends = which[order], starts[order], ends[order]
    live = len(which)
    for j in range(int((ends - starts).max()) if len(which) else 0):
        live = int(np.searchsorted(starts - ends, -j, side="left"))
        u = v[:live] & masks[which[:live], ids[starts[:live] + j]]
        v[:live] = (v[:live] + u) | (v[:live] - u)
    out = np.empty_like(v)
    out[order] = v
    return out


def _search(batches, segments, weights, basis, cosine):
    n_seg, terms = len(segments.items), segments.terms
    per_group = max(1, min(256, (32 << 20) // (8 * (len(segments.vocabulary) + 1))))
    groups = [np.arange(a, min(a + per_group, n_seg)) for a in range(0, n_seg, per_group)]
    masks = [segments.masks(g) for g in groups]
    contents = [segments.members(g) for g in groups]
    folded = basis * weights[:, None]
    size_of = np.array([next(size for most, size in WINDOWS if n <= most) for n in segments.lengths], np.int64)
    for b in tk.slices(batches, "tokens", 4 * TOKENS):
        tokens, bounds = _flat(b)
        if not len(tokens) or not n_seg:
            continue
        run, before = _runs(bounds, STEP)
        begins = np.searchsorted(run, np.arange(before[-1]))
        ids = np.full(len(tokens), len(segments.vocabulary))
        at, place = terms.known(tokens)
        ids[at] = place
        own = np.where(ids < len(segments.vocabulary), ids, len(segments.vocabulary) + (tokens >> np.uint32(32 - TERM_BITS)).astype(np.int64))
        parts = []
        for at in range(0, before[-1], 4096):
            heads = begins[at : at + 4096]
            end = begins[at + 4096] if at + 4096 < before[-1] else len(tokens)
            parts.append(np.add.reduceat(folded[own[heads[0] : end]], heads - heads[0]))
        sums = np.r_[np.zeros((1, basis.shape[1])), np.cumsum(np.concatenate(parts).astype(np.float64), axis=0)]
        blocks = np.arange(before[-1])
        rows = np.searchsorted(before, blocks, side="right") - 1
        first_of, end_of = before[rows], before[rows + 1]
        windows = {}
        for size in np.unique(size_of).tolist():
            # each block starts a window, but the last ones of a long row, which an earlier window holds
            first = np.flatnonzero((blocks + size <= end_of) | (blocks == first_of))
            last = np.minimum(first + size, end_of[first])
            w = (sums[last] - sums[first]).astype(np.float32)
            windows[size] = first, w / np.maximum(np.linalg.norm(w, axis=1), 1e-12)[:, None]
        found = []
        for group, (pointer, members) in zip(groups, contents):
            # content words that the blocks up to each have of each segment
            n, g = pointer[ids + 1] - pointer[ids], len(group)
            hit = np.repeat(pointer[ids] + n - np.cumsum(n), n) + np.arange(n.sum())
            so_far = np.zeros((before[-1] + 1, g), np.uint16)  # differences are right whatever the wrap: a stretch has fewer words
            np.cumsum(np.bincount(np.repeat(run, n) * g + members[hit], minlength=before[-1] * g).astype(np.uint16).reshape(-1, g), axis=0, dtype=np.uint16, out=so_far[1:])
            for size, (first, w) in windows.items():
                some = group[size_of[group] == size]
                if not len(some):
                    continue
                i, k = np.nonzero(w @ segments.vectors[some].T >= cosine)
                k, block = some[k], first[i]
                lo, hi = np.maximum(block - segments.reach[k], first_of[block]), np.minimum(block + size + segments.reach[k], end_of[block])
                enough = (so_far[hi, k - group[0]] - so_far[lo, k - group[0]]) >= segments.needed[k]
                found.append(np.stack([block[enough], k[enough]], 1))
        found = np.concatenate(found)
        if not len(found):
            continue
        block, s = found[:, 0], found[:, 1]
        row = rows[block]
        length = segments.lengths[s]
        lo = np.maximum(begins[block] - length, bounds[row])
        hi = np.minimum(begins[block] + STEP * size_of[s] + length, bounds[row + 1])
        # overlapping candidates of one row and segment are one: the whole stretch is searched
        order = np.lexsort((lo, s, row))
        s, row, lo, hi = s[order], row[order], lo[order], hi[order]
        same = np.r_[False, (s[1:] == s[:-1]) & (row[1:] == row[:-1]) & (lo[1:] <= lo[:-1] + STEP)]
        heads = np.flatnonzero(~same)
        s, row, lo, hi = s[heads], row[heads], lo[heads], np.maximum.reduceat(hi, heads)
        doc_ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for group, mask in zip(groups, masks):
            at = np.flatnonzero((s >= group[0]) & (s <= group[-1]))
            if not len(at):
                continue
            length = segments.lengths[s[at]]
            bits = ~common(mask, s[at] - group[0], ids, lo[at], hi[at])
            whole = np.where(length == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(length, 63).astype(np.uint64)) - np.uint64(1))
            matched = np.bitwise_count(bits & whole)
            tail = np.minimum(ANSWER_WORDS, length)
            head = length - tail
            before_answer = np.bitwise_count(bits & ((np.uint64(1) << head.astype(np.uint64)) - np.uint64(1)))
            share, answer = matched / length, (matched.astype(np.int64) - before_answer) / tail
            leak = (share >= VERBATIM) | ((share >= PARAPHRASE) & (answer >= ANSWER))
            if leak.any():
                at = at[leak]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[row[at]].astype(np.int64)), pa.array(segments.items[s[at]]), pa.array(share[leak]), pa.array(answer[leak])], ["doc_id", "item_id", "share", "answer_share"])


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, share, answer_share of each document and benchmark item that it has: the largest shares of the item's
    words (of a segment, if it is cut) found in order in one place.

    Null or empty texts and items, items of fewer than LEAST_WORDS words, and rows without an id match nothing. A repeated doc_id
    or item_id gives one row with the largest shares; other columns are ignored; an empty table on either side gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch: list[str] = []
    tokens = save(texts(docs).mapInArrow(_tokenise, "doc_id bigint, tokens binary"), "tokens", scratch)
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).collect()
    items = [(r["item_id"], tokens_of(pa.array([r["text"] or ""]))) for r in rows]
    terms = Terms(np.concatenate([np.zeros(0, np.uint32), *(t for _, t in items)]))
    words = spark.sparkContext.broadcast(terms)
    frequency = np.zeros(terms.size + 1)
    for r in tokens.mapInArrow(lambda it: _frequencies(it, words.value), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        frequency[r["term"]] = r["n"]
    passages, frequency = max(frequency[-1], 1), frequency[:-1]
    weights = np.where((frequency > 0) & (frequency <= max(STOP * passages, 3)), np.log((1 + passages) / (1 + frequency)), 0).astype(np.float32)
    omega = np.linalg.qr(np.random.default_rng(11).standard_normal((terms.size, rank)))[0].astype(np.float32)
    shared = spark.sparkContext.broadcast((terms, weights, omega))
    parts = tokens.mapInArrow(lambda it: _gram_part(it, *shared.value), "block int, slot int, part binary").repartition(partitions(spark), "block", "slot")
    parts = parts.select("block", "part").mapInArrow(_add_up(np.float32), "block int, part binary").repartition(min(BLOCKS, partitions(spark)), "block").mapInArrow(_add_up(np.float64), "block int, part binary")
    gram = [np.zeros(x.shape) for x in np.array_split(omega, BLOCKS)]
    for r in parts.collect():  # terms x rank numbers, whatever the input
        gram[r["block"]] = np.frombuffer(r["part"], np.float64).reshape(gram[r["block"]].shape)
    basis = singular_vectors(np.concatenate(gram), omega.astype(np.float64))
    plan = spark.sparkContext.broadcast((Segments(items, terms, weights, basis), weights, basis))
    found = tokens.mapInArrow(lambda it: _search(it, *plan.value, cosine), "doc_id bigint, item_id bigint, share double, answer_share double")
    found = save(found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("answer_share").alias("answer_share")), "leaks")
    discard(spark, scratch)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark item in them; rows without doc_id or text stay."""
    return without(docs, save(leaks(docs, benchmark).select("doc_id").distinct(), "leaking"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
