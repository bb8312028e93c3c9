"""Operator 9, quality by hierarchical empirical Bayes.

Two naive Bayes classifiers, of quality and of toxicity, over the presence of hashed words (and of a few marks of form) give each
document's evidence, the log likelihood ratio of "good" (quality 1 and toxic 0) against the rest. With the global prior that makes a posterior for every document. These posteriors are added up by
host and by path; a path's rate is shrunk towards its host's, and the host's towards the global one, by as many pseudo-documents as the
spread between groups suggests (method of moments), so sparse sites stay near the prior. The path's rate is the prior of each of its
documents, and with the document's evidence decides.

Labels come from at most TRAIN_ROWS labelled rows, picked by a hash of doc_id; of rows that share a minhash of word trigrams one is kept, since
the words of a copied document would else look as if many documents agreed on them. Sums by host and path cover all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .shared import discard, save, small_batches, table

TRAIN_ROWS = 20_000
FEATURE_BITS = 18
FORMS = 16
#: Pseudo-documents, split by the global rate, that a feature's counts are shrunk by.
SMOOTH = 4.0
#: A feature has a weight only if chance gives its counts, or stranger ones, with a probability under about exp(-SURPRISE); most rare words have none.
SURPRISE = 25.0
#: Every HELD-th labelled document is held out to choose the posterior from which on documents are accepted, if there are FEWEST of both kinds (else BOUND).
HELD = 5
FEWEST = 20
BOUND = 0.5
#: Of bounds that are nearly as good as the best (sum of both kinds' shares that are judged right), the lowest is taken, so that documents in doubt stay.
NEARLY = 0.01
HASHES = 3
MOST_PSEUDO = 1000.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, and the row bounds: hashed words, then forms (shares of capitals, of marks, of repeated words, in steps)."""
    n = len(column)
    text = pc.fill_null(column, "")
    w = tk.Words(text)
    keys = (w.rows.astype(np.int64) << FEATURE_BITS) | (w.hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    keys = np.unique(keys)
    rows, ids = keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1)
    data, offsets = tk.raw(text)
    total = np.maximum(np.diff(offsets), 1)

    def share(mask):
        sums = np.r_[0, np.cumsum(mask)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / total

    capital = share((data >= 65) & (data <= 90))
    mark = share(((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126)))
    distinct = np.bincount(rows, minlength=n) / np.maximum(w.counts, 1)
    form = [np.minimum((x * 5 * s).astype(np.int64), 4) for x, s in ((capital, 2), (mark, 4), (1 - distinct, 1))]
    base = 1 << FEATURE_BITS
    rows = np.concatenate([rows, *[np.arange(n)] * 3])
    ids = np.concatenate([ids, *[base + 5 * i + f for i, f in enumerate(form)]])
    order = np.argsort(rows, kind="stable")
    return ids[order], np.searchsorted(rows[order], np.arange(n + 1))


SIZE = (1 << FEATURE_BITS) + FORMS


def _count(batches):
    for b in tk.slices(batches):
        ids, bounds = features(b.column("text"))
        kind = np.repeat(b.column("kind").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
        keys, n = np.unique(ids * 8 + kind, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 3), pa.array((keys & 7).astype(np.int32)), pa.array(n.astype(np.int64))], ["feature", "kind", "n"])


def _held_out(batches, evidence):
    for b in tk.slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(evidence.value.score(b.column("text"))), pa.array(b.column("kind").to_numpy(zero_copy_only=False) == 6)], ["score", "good"])


def _families(batches):
    """HASHES minhashes of each row's word trigrams; a row without any has its own id."""
    for b in tk.slices(batches):
        grams, rows = tk.Words(b.column("text")).grams(3)
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])
        out = []
        for seed in range(HASHES):
            least = tk.mix(b.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 50 + seed)
            if len(begins):
                least[rows[begins]] = np.minimum.reduceat(tk.mix(grams, 60 + seed), begins)
            out.append(least.view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, out)], ["id", *[f"f{i}" for i in range(HASHES)]])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Task:
    """Naive Bayes of one label: its rate and its features' weights."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        # rows: without the label, with it
        self.weights = np.zeros(SIZE)
        self.rate = float((docs[1] + 1) / (docs.sum() + 2))
        if docs.min() > 0:
            total = counts.sum(0)
            odds = (counts[1] + SMOOTH * self.rate) / (counts[0] + SMOOTH * (1 - self.rate))
            share = np.clip(counts[1] / np.maximum(total, 1), 1e-12, 1 - 1e-12)
            surprise = total * (share * np.log(share / self.rate) + (1 - share) * np.log((1 - share) / (1 - self.rate)))
            self.weights = np.where(surprise >= SURPRISE, np.log(odds * (1 - self.rate) / self.rate), 0.0)
        self.prior = math.log(self.rate / (1 - self.rate))


class Evidence:
    """Both tasks: that quality is 1, that toxic is 1. A document is good with the chance of the first times that of not the second."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        # rows: 2 * quality + toxic
        self.quality = Task(np.stack([counts[0] + counts[1], counts[2] + counts[3]]), np.array([docs[0] + docs[1], docs[2] + docs[3]]))
        self.toxic = Task(np.stack([counts[0] + counts[2], counts[1] + counts[3]]), np.array([docs[0] + docs[2], docs[1] + docs[3]]))
        self.rate = float((docs[2] + 1) / (docs.sum() + 2))
        self.bound = BOUND

    def score(self, column: pa.Array) -> np.ndarray:
        """Log odds of good, less those of a document without any weighty feature."""
        ids, bounds = features(column)
        p = []
        for task in (self.quality, self.toxic):
            sums = np.r_[0.0, np.cumsum(task.weights[ids])]
            p.append(_logistic(sums[bounds[1:]] - sums[bounds[:-1]] + task.prior))
        good = np.clip(p[0] * (1 - p[1]), 1e-12, 1 - 1e-12)
        usual = self.quality.rate * (1 - self.toxic.rate)
        return np.log(good / (1 - good)) - math.log(usual / (1 - usual))


def best_bound(posteriors: np.ndarray, good: np.ndarray) -> float:
    """The lowest bound that judges held-out documents nearly as well as the best one, in the middle of the gap where it lies."""
    if min(good.sum(), (~good).sum()) < FEWEST:
        return BOUND
    values = np.unique(posteriors)
    order = np.sort(posteriors[good]), np.sort(posteriors[~good])
    kept = 1 - np.searchsorted(order[0], values, side="left") / len(order[0])
    refused = np.searchsorted(order[1], values, side="left") / len(order[1])
    i = int(np.flatnonzero(kept + refused >= (kept + refused).max() - NEARLY)[0])
    return float((values[i - 1] + values[i]) / 2) if i else float(values[0])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Evidence:
    """Evidence from at most train_rows labelled rows. The sample's ids are broadcast: their number is bounded by that parameter.

    Of labels of one document that disagree, the stricter counts: quality 0, toxic 1; of texts with one doc_id the smallest counts."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), (F.col("quality") == 1).cast("int").alias("q"), (F.col("toxic") == 1).cast("int").alias("t"))
    known = known.groupBy("id").agg((2 * F.min("q") + F.max("t")).alias("kind"))
    sample = known.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(train_rows)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min(F.struct("text", "kind")).alias("x")).select("id", "x.text", "x.kind")
    scratch: list[str] = []
    rows = save(rows, "labelled", scratch)
    families = save(rows.select("id", "text").mapInArrow(_families, "id bigint, " + ", ".join(f"f{i} bigint" for i in range(HASHES))), "families", scratch)
    for i in range(HASHES):
        rows = rows.join(families.groupBy(f"f{i}").agg(F.min("id").alias("id")).select("id").distinct(), "id", "left_semi")
    # kinds from 4 on are those of held-out rows
    held = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(HELD)) == 0
    rows = save(rows.select("text", F.when(held, F.col("kind") + 4).otherwise(F.col("kind")).alias("kind")), "kinds", scratch)
    counts, sizes = np.zeros((8, SIZE)), np.zeros(8)
    for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect():
        sizes[r["kind"]] = r["n"]
    found = rows.mapInArrow(_count, "feature bigint, kind int, n bigint").groupBy("feature", "kind").agg(F.sum("n").alias("n")).toArrow()  # eight rows a feature at most
    np.add.at(counts, (found.column("kind").to_numpy(), found.column("feature").to_numpy()), found.column("n").to_numpy())
    first = spark.sparkContext.broadcast(Evidence(counts[:4], sizes[:4]))
    judged = rows.where("kind >= 4").mapInArrow(lambda it: _held_out(it, first), "score double, good boolean").toArrow()  # a share of train_rows
    posteriors = _logistic(judged.column("score").to_numpy() + math.log(first.value.rate / (1 - first.value.rate)))
    out = Evidence(counts[:4] + counts[4:], sizes[:4] + sizes[4:])
    out.bound = best_bound(posteriors, judged.column("good").to_numpy().astype(bool))
    discard(spark, scratch)
    return out


def pseudo(groups: DataFrame, rate: Column | float) -> float:
    """How many pseudo-documents the spread of the groups' rates is worth. groups: n, good (a sum of posteriors)."""
    r = groups.agg(F.sum(F.pow(F.col("good") - F.col("n") * rate, 2) / F.col("n")).alias("q"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(rate * (1 - rate) if isinstance(rate, Column) else F.lit(rate * (1 - rate))).alias("v")).first()
    if not r["k"] or r["k"] < 2 or not r["v"]:
        return MOST_PSEUDO
    within = r["v"] / r["k"]
    spread = (r["q"] - r["k"] * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return MOST_PSEUDO if spread <= 0 else min(MOST_PSEUDO, max(1.0, within / spread - 1))


def judge(docs: DataFrame, labels: DataFrame, evidence: Evidence | None = None, bound: float | None = None, rejected: bool = False) -> DataFrame:
    """doc_id, host, path, evidence, prior, posterior of each document whose posterior is ``bound`` at least (``rejected``: of the others); without one it is that of the evidence, chosen on held-out labels.

    A document's host is its source, its path source/lang; null counts as ''. Null texts count as empty, whose evidence comes from form alone; rows without
    doc_id are left out; a repeated row counts as often as it comes; a posterior of just ``bound`` is accepted; other columns are ignored; an empty table gives
    none, and without labels of both kinds there is no evidence, and every document has the prior."""
    spark = docs.sparkSession
    small_batches(spark)
    evidence = evidence or fit(docs, labels)
    bound = evidence.bound if bound is None else bound
    shared = spark.sparkContext.broadcast(evidence)
    prior = math.log(evidence.rate / (1 - evidence.rate))

    def score(batches):
        for b in tk.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("lang"), pa.array(shared.value.score(b.column("text")))], ["doc_id", "host", "lang", "evidence"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text("source").alias("host"), text("lang").alias("lang"), text("text").alias("text"))
    scored = rows.mapInArrow(score, "doc_id bigint, host string, lang string, evidence double")
    scored = save(scored.select("doc_id", "host", F.concat_ws("/", "host", "lang").alias("path"), "evidence", (1 / (1 + F.exp(-(F.col("evidence") + prior)))).alias("first")), "evidence")
    paths = save(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("first").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k = pseudo(hosts, evidence.rate)
    hosts = hosts.select("host", ((F.col("good") + k * evidence.rate) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = pseudo(paths, F.col("host_rate"))
    rates = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("good") + k * F.col("host_rate")) / (F.col("n") + k))).alias("prior"))
    out = scored.join(rates, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior"))))))
    out = out.select("doc_id", "host", "path", "evidence", "prior", posterior.alias("posterior"))
    return out.where(F.col("posterior") < bound - 1e-9 if rejected else F.col("posterior") >= bound - 1e-9)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
