"""Operator 2, line dedup by a tree of line templates.

A line's tokens are its runs of other bytes than ASCII white space; a token with a digit is a variable field. The tree has a fixed depth: the
number of tokens, then the DEPTH leading tokens, then a leaf. In a leaf, a line joins the most similar template (share of equal
tokens, SIMILAR at least; where they differ the template gets a variable field) or founds one; lines come in descending
number of documents, so the result doesn't depend on partitions.

A template recurs if it is found in MIN_FAMILIES families of documents, however many documents have it. A family holds copies of a document,
which the near-duplicate join removes as a whole, so that they don't make its lines boilerplate. Documents are compared without the line at
hand, by minhashes of the word trigrams of their other lines, one in each of BUCKETS ranges: in ascending doc_id, a document that
shares less than ALIKE with the first document of each family so far founds one. All lines of recurring templates are dropped.
Lines of every length take part; short ones need more families, and one of variable fields alone recurs as it is.

Only lines of leaves with two different lines and MIN_FAMILIES documents need their tokens, few of all: up to BROADCAST_ROWS of such leaves are broadcast, so that
tokens of no other line are moved; more are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import BROADCAST_ROWS, discard, free_name, partitions, save, small_batches, table, texts

DEPTH = 4
SIMILAR = 0.8
MIN_FAMILIES = 5
#: Half of the near-duplicate join's threshold: two copies that each match a third document share about as much.
ALIKE = 0.25
BUCKETS = 16
NONE = np.uint16(0xFFFF)
#: Shorter lines, and lines with fewer fixed tokens, recur by chance sooner: each token that is missing doubles the families that they need.
MIN_TOKENS = 4
MIN_FIXED = 2
WILD = np.uint64(0xFFFFFFFF)


class Lines:
    """Lines of the rows of a string column: bytes, row, tokens (32-bit hashes, WILD for a variable field), hash and leaf."""

    def __init__(self, column: pa.Array):
        data, offsets = tk.raw(column)
        self.data, self.offsets = data, offsets
        n = len(data)
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        self.rows = np.repeat(np.arange(len(column)), 1 + np.diff(np.searchsorted(breaks, offsets)))
        inside = data > 32
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        token_starts = np.flatnonzero(inside & (edge[:n] | np.r_[True, ~inside[:-1]][:n]))
        token_ends = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True][:n])) + 1
        up, down = tk.powers(n + 1)
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])]
        tokens = tk.mix((sums[token_ends] - sums[token_starts]) * down[token_starts]) >> np.uint64(32)
        digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
        self.words = tokens
        self.tokens = np.where(digits[token_ends] > digits[token_starts], WILD, np.minimum(tokens, WILD - np.uint64(1)))
        self.first = np.searchsorted(token_starts, self.starts)
        self.counts = np.searchsorted(token_starts, self.ends) - self.first
        k = len(self.tokens)
        before = np.r_[0, np.cumsum(self.tokens != WILD)]
        self.fixed = before[self.first + self.counts] - before[self.first]
        # nothing of a line of variable fields alone would recur: its tokens count as they are
        plain = np.repeat(self.fixed == 0, self.counts)
        self.keys = np.where(plain, np.minimum(tokens, WILD - np.uint64(1)), self.tokens)
        sums = np.r_[np.uint64(0), np.cumsum((self.keys + np.uint64(1)) * up[:k])]
        self.hashes = tk.mix((sums[self.first + self.counts] - sums[self.first]) * down[self.first] + self.counts.astype(np.uint64), 1).view(np.int64)
        leaf = self.counts.astype(np.uint64)
        padded = np.r_[self.keys, np.zeros(DEPTH, np.uint64)]
        for i in range(DEPTH):
            leaf = tk.mix(leaf + np.where(self.counts > i, padded[self.first + i], np.uint64(0)), i)
        self.leaves = leaf.view(np.int64)

    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """One line for each different one of a row, by row, and the number among these of each line; -1 for lines without tokens."""
        some = np.flatnonzero(self.counts)
        order = some[np.lexsort((self.hashes[some], self.rows[some]))]
        keep = np.r_[True, (self.hashes[order][1:] != self.hashes[order][:-1]) | (self.rows[order][1:] != self.rows[order][:-1])][: len(order)]
        numbers = np.full(len(self.counts), -1)
        numbers[order] = np.cumsum(keep) - 1
        return order[keep], numbers

    def others(self, lines: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """For each of different(): minhashes by bucket of the word trigrams in the row's other lines, NONE for a bucket without.
        A shorter line is one gram."""
        counts = np.where(self.counts > 2, self.counts - 2, np.minimum(self.counts, 1))
        own = np.repeat(np.arange(len(counts)), counts)
        at = self.first[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        padded = np.r_[self.words, np.zeros(2, np.uint64)]
        grams = tk.mix(padded[at], 7)
        for i in (1, 2):
            grams = tk.mix(grams + np.where(self.counts[own] > i, padded[at + i], np.uint64(0)), 7 + i)
        least = np.full(len(lines) * BUCKETS, NONE)
        np.minimum.at(least, numbers[own] * BUCKETS + (grams % np.uint64(BUCKETS)).astype(np.int64), np.minimum(grams >> np.uint64(48), NONE - np.uint16(1)).astype(np.uint16))
        least = least.reshape(-1, BUCKETS)
        if not len(lines):
            return least
        rows = self.rows[lines]
        new = np.r_[True, rows[1:] != rows[:-1]]
        begins, row = np.flatnonzero(new), np.cumsum(new) - 1
        first = np.minimum.reduceat(least, begins)
        is_first = least == first[row]
        only = np.add.reduceat(is_first, begins, dtype=np.int64) == 1
        second = np.minimum.reduceat(np.where(is_first, NONE, least), begins)
        return np.where(is_first & only[row], second[row], first[row])


def _lines(batches):
    """leaf, line, document and minhashes of the document's other lines, of each different line of a row."""
    for b in tk.slices(batches):
        x = Lines(b.column("text"))
        order, numbers = x.different()
        others = x.others(order, numbers)
        doublings = np.maximum(np.maximum(MIN_TOKENS - x.counts[order], MIN_FIXED - x.fixed[order]), 0)
        packed = pa.Array.from_buffers(pa.binary(), len(order), [None, pa.py_buffer((np.arange(len(order) + 1) * 2 * BUCKETS).astype(np.int32)), pa.py_buffer(others.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(x.leaves[order]), pa.array(x.hashes[order]), b.column("doc_id").take(pa.array(x.rows[order])), pa.array(doublings.astype(np.int32)), packed], ["leaf", "line", "doc", "doublings", "others"])


def _tokens(batches, wanted):
    """leaf, line and tokens of the lines of these leaves (sorted; None: of all leaves)."""
    for b in tk.slices(batches):
        x = Lines(b.column("text"))
        at = np.flatnonzero(x.counts > DEPTH)
        if wanted is not None:
            leaves = wanted.value
            place = np.minimum(np.searchsorted(leaves, x.leaves[at]), max(len(leaves) - 1, 0))
            at = at[leaves[place] == x.leaves[at]] if len(leaves) else at[:0]
        _, own = np.unique(x.hashes[at], return_index=True)
        at = at[own]
        tokens = x.keys.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(x.leaves[at]), pa.array(x.hashes[at]), pa.array([tokens[f : f + c].tobytes() for f, c in zip(x.first[at], x.counts[at])], pa.binary())], ["leaf", "line", "tokens"])


class Leaf:
    """The templates of one leaf. A line with at most m differences equals a template on one of m + 1 blocks of positions at least, so
    templates are looked up by block."""

    def __init__(self, n: int, similar: float):
        self.least = int(np.ceil(similar * n - 1e-9))
        blocks = n - self.least + 1
        cuts = np.linspace(0, n, blocks + 1).astype(int)
        self.blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        self.index: dict[tuple[int, bytes], list[int]] = {}
        self.templates: list[np.ndarray] = []
        self.names: list[int] = []

    def add(self, name: int, line: np.ndarray) -> int:
        """The name of the line's template; the first line names it."""
        keys = [(i, line[s].tobytes()) for i, s in enumerate(self.blocks)]
        near = sorted({t for k in keys for t in self.index.get(k, ())})
        if near:
            common = [int((self.templates[t] == line).sum()) for t in near]
            best = int(np.argmax(common))
            if common[best] >= self.least:
                t = near[best]
                self.templates[t] = np.where(self.templates[t] == line, line, np.uint32(WILD))
                return self.names[t]
        for k in keys:
            self.index.setdefault(k, []).append(len(self.templates))
        self.templates.append(line)
        self.names.append(name)
        return name


def _grow(batches, similar):
    """Rows sorted by leaf, documents (descending), line -> line and its template, where they differ."""
    leaf, tree = None, None
    for b in batches:
        lines, templates = [], []
        for key, name, tokens in zip(b.column("leaf").to_pylist(), b.column("line").to_pylist(), b.column("tokens").to_pylist()):
            line = np.frombuffer(tokens, np.uint32)
            if key != leaf or len(line) != len(tree.templates[0]):
                leaf, tree = key, Leaf(len(line), similar)
            template = tree.add(name, line)
            if template != name:
                lines.append(name)
                templates.append(template)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(templates, pa.int64())], ["line", "template"])


def _alike(others: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which rows of minhashes share ALIKE with one at least; documents without other lines are alike."""
    return ((others == one) & (one != NONE)).sum(1) >= ALIKE * ((others != NONE) | (one != NONE)).sum(1)


def _recurring(batches):
    """Rows sorted by template and document -> the templates found in as many families as they need."""
    template, doc, families = None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        found = []
        names, docs, needs = (b.column(c).to_numpy(zero_copy_only=False) for c in ("template", "doc", "need"))
        others = np.frombuffer(b"".join(b.column("others").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        for start, end in zip(cuts, np.r_[cuts[1:], len(names)]):
            if names[start] != template:
                template, doc, families = names[start], None, []
            need = needs[start]
            if len(families) < need:
                # a document may have several lines of a template
                rest = others[start:end][np.r_[docs[start] != doc, docs[start + 1 : end] != docs[start : end - 1]]]
                for one in families:
                    rest = rest[~_alike(rest, one)]
                while len(rest) and len(families) < need:
                    families.append(rest[0])
                    rest = rest[~_alike(rest, rest[0])]
                if len(families) >= need:
                    found.append(template)
            doc = docs[end - 1]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["template"])


def recurring(docs: DataFrame, similar: float = SIMILAR, min_families: int = MIN_FAMILIES) -> DataFrame:
    """The lines to drop, as a saved table of the hashes of their tokens."""
    spark = docs.sparkSession
    scratch: list[str] = []
    small_batches(spark)
    rows = texts(docs)
    occurrences = save(rows.mapInArrow(_lines, "leaf bigint, line bigint, doc bigint, doublings int, others binary"), "lines", scratch)
    lines = save(occurrences.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("doublings").alias("doublings")), "leaves", scratch)
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("leaf_docs")).where((F.col("lines") > 1) & (F.col("leaf_docs") >= min_families)).select("leaf")
    leaves = save(leaves, "wide-leaves", scratch)
    wanted = spark.sparkContext.broadcast(np.sort(leaves.toArrow().column("leaf").to_numpy().astype(np.int64))) if leaves.count() <= BROADCAST_ROWS else None
    tokens = rows.select("text").mapInArrow(lambda it: _tokens(it, wanted), "leaf bigint, line bigint, tokens binary").groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    grown = tokens.join(lines.join(leaves, "leaf", "left_semi"), ["leaf", "line"]).repartition(partitions(spark), "leaf").sortWithinPartitions("leaf", F.desc("docs"), "line")
    templates = grown.select("leaf", "line", "tokens").mapInArrow(lambda it: _grow(it, similar), "line bigint, template bigint")
    named = save(templates, "templates", scratch)
    of = lines.join(named, "line", "left").select("line", "docs", "doublings", F.coalesce("template", "line").alias("template"))
    need = F.expr(f"CAST({min_families} * power(2, min(doublings)) AS bigint)")
    enough = of.groupBy("template").agg(F.sum("docs").alias("docs"), need.alias("need")).where("docs >= need").select("template", "need")
    wanted = save(of.select("line", "template").join(enough, "template"), "wanted", scratch)
    # few lines are in several documents: broadcast, they leave the others where they are
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS // 4 else wanted
    rows = occurrences.select("line", "doc", "others").join(wanted, "line").select("template", "doc", F.col("need").cast("smallint").alias("need"), "others")
    rows = rows.repartition(partitions(spark), "template").sortWithinPartitions("template", "doc", "others")
    found = rows.mapInArrow(_recurring, "template bigint")
    found = save(found, "recurring", scratch)
    drop = found.select(F.col("template").alias("line")).unionByName(named.join(found, "template", "left_semi").select("line"))
    drop = save(drop.distinct(), "dropped")
    discard(spark, scratch)
    return drop


def _cut(column: pa.Array, x: Lines, gone: np.ndarray) -> pa.Array:
    """The texts without their lines in ``gone``. A line goes with the break after it; if a row's last line goes, the break before what then is last goes too."""
    n_rows = len(column)
    delta = np.zeros(len(x.data) + 2, np.int64)
    last = np.r_[x.rows[1:] != x.rows[:-1], True]
    np.add.at(delta, x.starts[gone], 1)
    np.add.at(delta, np.where(last, x.ends, x.ends + 1)[gone], -1)
    keep = np.cumsum(delta)[: len(x.data)] == 0
    offsets = np.r_[0, np.cumsum(keep)][x.offsets]
    data = x.data[keep]
    ends = np.searchsorted(x.rows, np.arange(n_rows), side="right") - 1
    trim = np.flatnonzero(gone[ends] & (offsets[1:] > offsets[:-1]))
    trim = trim[data[offsets[trim + 1] - 1] == 10]
    if len(trim):
        stay = np.ones(len(data), bool)
        stay[offsets[trim + 1] - 1] = False
        data, offsets = data[stay], np.r_[0, np.cumsum(stay)][offsets]
    out = pa.StringArray.from_buffers(n_rows, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
    return pc.if_else(pa.array(column.is_valid().to_numpy(zero_copy_only=False)), out, None).cast(pa.string()) if column.null_count else out


def _strip(names, counted, wanted=None, drop_name=None):
    """names: the columns returned; counted: whether to add n_dropped. The lines to drop: wanted (broadcast, sorted hashes), or each row's list in drop_name."""

    def run(batches):
        for b in tk.slices(batches):
            column = b.column("text")
            x = Lines(pc.fill_null(column, ""))
            hashes = x.hashes
            if wanted is not None:
                lines = wanted.value
                at = np.minimum(np.searchsorted(lines, hashes), max(len(lines) - 1, 0))
                gone = lines[at] == hashes if len(lines) else np.zeros(len(hashes), bool)
            else:
                gone = np.zeros(len(hashes), bool)
                bounds = np.searchsorted(x.rows, np.arange(b.num_rows + 1))
                for i, lines in enumerate(b.column(drop_name).to_pylist()):
                    if lines:
                        gone[bounds[i] : bounds[i + 1]] = np.isin(hashes[bounds[i] : bounds[i + 1]], lines)
            # rows without doc_id stay as they are
            gone &= (x.counts > 0) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[x.rows]
            text = _cut(column, x, gone) if gone.any() else column.cast(pa.string())
            columns = [text if c == "text" else b.column(c) for c in names]
            if counted:
                columns.append(pa.array(np.bincount(x.rows[gone], minlength=b.num_rows).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_dropped"] if counted else names)

    return run


def _apply(docs: DataFrame, drop: DataFrame, counted: bool) -> DataFrame:
    """Up to BROADCAST_ROWS hashes of lines are broadcast; more are joined, by line and then by document."""
    spark, names, schema = docs.sparkSession, docs.columns, T.StructType(docs.schema.fields + [T.StructField("n_dropped", T.LongType())] * counted)
    if drop.count() <= BROADCAST_ROWS:
        wanted = spark.sparkContext.broadcast(np.sort(drop.toArrow().column("line").to_numpy().astype(np.int64)))
        return docs.mapInArrow(_strip(names, counted, wanted=wanted), schema)
    key, name = free_name(docs, "__doc"), free_name(docs, "__dropped_lines")
    lines = texts(docs).mapInArrow(_doc_lines, "doc_id bigint, line bigint").join(drop, "line", "left_semi")
    lists = lines.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(name))
    return docs.join(lists, F.col("doc_id") == F.col(key), "left").drop(key).mapInArrow(_strip(names, counted, drop_name=name), schema)


def _doc_lines(batches):
    for b in tk.slices(batches):
        x = Lines(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(x.rows)), pa.array(x.hashes)], ["doc_id", "line"])


def strip_lines(docs: DataFrame, similar: float = SIMILAR, min_families: int = MIN_FAMILIES) -> DataFrame:
    """doc_id, text without the lines of recurring templates, n_dropped, for every row.

    Null texts stay null, and empty lines and rows without doc_id stay as they are; equal similarity goes to the older template; a row
    that repeats counts again as a document of the same family; other columns are ignored; an empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(rows, recurring(rows, similar, min_families), True)


def clean_documents(docs: DataFrame) -> DataFrame:
    """All documents with all their columns, texts stripped as by strip_lines() and n_chars counted again."""
    out = _apply(docs, recurring(docs), False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_lines(table(spark, sf_dir, "documents"))
