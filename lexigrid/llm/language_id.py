"""Operator 4, language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in each slot; the AND of an n-gram's slots is the set of all languages
that contain it. A document's hits per language are population counts over its n-grams, corrected for each language's
false-positive rate; the best corrected share decides. N-grams are of NGRAM bytes of the lower-cased text, in which every
run of other characters than letters is one space.

The filters are fitted on a bounded sample: about TRAIN_DOCS labelled documents of each language, picked by a hash of doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import small_batches, table

NGRAM = 4
TRAIN_DOCS = 1000
MIN_COUNT = 3
SLOTS_LOG2 = 19
PROBES = 3
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any language.
RELATIVE = 0.05
MIN_SHARE = 0.35
NOT_LETTER = r"[^\p{L}]+"


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit n-grams and the row of each; a row of fewer than NGRAM letters has a single padded one, an empty row none."""
    text = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), NOT_LETTER, " ")
    text = pc.utf8_trim(text, " ")
    empty = pc.equal(text, "")
    text = pc.if_else(empty, "", pc.binary_join_element_wise("", text, "", " "))
    data, offsets = tk.raw(text)
    n = len(data) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = data[:n].astype(np.uint32)
    for i in range(1, NGRAM):
        grams |= data[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    counts = np.maximum(np.diff(offsets) - NGRAM + 1, 0)
    rows = np.repeat(np.arange(len(column)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][rows]
    return grams[at], rows


def probes(grams: np.ndarray):
    """Slots of each n-gram, one array a probe."""
    x = grams.astype(np.uint64)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    low, high = x >> np.uint64(64 - SLOTS_LOG2), (x >> np.uint64(8)) | np.uint64(1)
    for i in range(PROBES):
        yield ((low + np.uint64(i) * high) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64)


class Filters:
    """The bit-sliced filter: a bit a language in each slot, in as many mask words as the languages need."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.languages = sorted(profiles)
        self.kind = np.uint8 if len(self.languages) <= 8 else np.uint64
        self.bits = 8 * np.dtype(self.kind).itemsize
        self.words = [np.zeros(1 << SLOTS_LOG2, self.kind) for _ in range(-(-len(self.languages) // self.bits))]
        for i, language in enumerate(self.languages):
            word, bit = self.words[i // self.bits], self.kind(1 << (i % self.bits))
            for slot in probes(profiles[language].astype(np.uint32)):
                word[slot] |= bit
        fill = np.array([self._has(self.words, i).mean() for i in range(len(self.languages))])
        self.false_rate = fill**PROBES

    def _has(self, words: list[np.ndarray], i: int) -> np.ndarray:
        return (words[i // self.bits] >> self.kind(i % self.bits)) & self.kind(1)

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """The mask words of each n-gram: the languages that contain it."""
        out: list[np.ndarray] = []
        for slot in probes(grams):
            out = [w[slot] & o for w, o in zip(self.words, out)] if out else [w[slot] for w in self.words]
        return out

    def shares(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each row's n-grams that each language contains, and the number of n-grams."""
        grams, rows = ngrams(column)
        n = len(column)
        total = np.bincount(rows, minlength=n)
        out = np.zeros((n, len(self.languages)))
        if len(grams):
            masks = self.masks(grams)
            for i in range(len(self.languages)):
                hits = np.bincount(rows, weights=self._has(masks, i), minlength=n)
                rate = self.false_rate[i]
                out[:, i] = np.clip((hits / np.maximum(total, 1) - rate) / max(1 - rate, 1e-9), 0, 1)
        return out, total


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Filters | None:
    """Filters from about train_docs labelled documents of each language; None if nothing is labelled.

    The sample, and thus what reaches the driver, is bounded: its n-gram counts don't grow with the input."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    unit = 1 << 30
    # the share that gives train_docs of a language in expectation
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(unit, round(unit * train_docs / n)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(unit)) < limit[F.col("lang")])

    def count(batches):
        for b in tk.slices(batches):
            langs = b.column("lang").to_pylist()
            grams, rows = ngrams(b.column("text"))
            codes = {k: i for i, k in enumerate(sorted(set(langs)))}
            code = np.array([codes[x] for x in langs], np.uint64)
            keys, n = np.unique((code[rows] << np.uint64(32)) | grams.astype(np.uint64), return_counts=True)
            names = sorted(codes)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in (keys >> np.uint64(32)).astype(int)], pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT).toArrow()
    lang, gram, n = (counts.column(c).to_numpy() for c in ("lang", "gram", "n"))
    share = n.astype(float)
    for k in sizes:
        share[lang == k] /= max(1.0, share[lang == k].sum())
    order = np.argsort(gram, kind="stable")
    lang, gram, share = lang[order], gram[order], share[order]
    if not len(gram):
        return Filters({k: np.zeros(0, np.int64) for k in sizes})
    begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    best = np.repeat(np.maximum.reduceat(share, begins), np.diff(np.r_[begins, len(gram)]))
    keep = share >= RELATIVE * best
    return Filters({k: gram[keep & (lang == k)] for k in sizes})


def _decide(filters: Filters, column: pa.Array, min_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share, whether it is accepted, and the number of n-grams."""
    shares, total = filters.shares(column)
    best = shares.argmax(1)
    score = shares[np.arange(len(best)), best]
    return best, score, (score >= min_share) & (total > 0), total


def identify(docs: DataFrame, filters: Filters | None = None, min_share: float = MIN_SHARE, rejected: bool = False) -> DataFrame:
    """doc_id, language, share, n_ngrams of each accepted document (``rejected``: of each refused one, with language null).

    Null or empty texts and texts without letters have no n-gram and are refused; rows without doc_id are left out; equal
    shares go to the first language in alphabetical order; repeated rows give repeated results; other columns are ignored;
    an empty table gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    filters = filters or fit(docs) or Filters({})
    shared = spark.sparkContext.broadcast(filters)  # 2**SLOTS_LOG2 slots, whatever the input

    def run(batches):
        f = shared.value
        for b in tk.slices(batches):
            n = b.num_rows
            if f.languages:
                best, score, ok, grams = _decide(f, b.column("text"), min_share)
            else:
                best, score, ok, grams = np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.bincount(ngrams(b.column("text"))[1], minlength=n)
            keep = ~ok if rejected else ok
            names = pa.array([None if rejected else f.languages[i] for i in best[keep]], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(keep)), names, pa.array(score[keep]), pa.array(grams[keep].astype(np.int64))], ["doc_id", "language", "share", "n_ngrams"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, language string, share double, n_ngrams bigint")


def keep_identified(docs: DataFrame, filters: Filters | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that have a language, with all their columns; the rest go. Nulls, ties and empty texts as in identify(),
    but a row without doc_id is judged by its text as well."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(filters or fit(docs) or Filters({}))

    def run(batches):
        f = shared.value
        for b in tk.slices(batches):
            if f.languages:
                yield b.filter(pa.array(_decide(f, b.column("text"), min_share)[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
