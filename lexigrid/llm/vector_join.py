"""Operator 5, embedding near-dedup by an exact metric range join.

Vectors are scaled to length one; a pair matches if its cosine is COSINE at least, that is, if its distance is RANGE at most. Pivots, picked by
a hash, part the space: a vector lives in its nearest pivot's cell. If y lives in cell j and a vector within RANGE lives in
cell i, then d(y, pivot i) - d(y, pivot j) <= 2 RANGE by the triangle inequality, so y is copied to just those cells, and only to cells
of a smaller number, as the pair is then found in the smaller of its two cells. Of those cells, only the ones are kept whose bordering plane
(of points as far from one pivot as from the other) is within RANGE of y. Cells join independently and no pair is found twice. Where a cell has more than
MOST_CELL vectors of its own, or copies, these are cut into blocks, and each pair of blocks is a task of its own.

Equal vectors are one beforehand. A cell returns no pairs, whose number grows with the square of a group of copies, but for each vector how many it matches,
and its group within the cell; connected components of these are the classes. Each dimension is joined for itself.

Vectors without clusters lie near most borders: then most cells of a smaller number get a copy, and the work is that of comparing all pairs, in
independent parts. Only the pivots, of PIVOT_BYTES at most, and the numbers of blocks of oversize cells are broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import discard, save, small, small_batches, table

COSINE = 0.95
#: Vectors that a cell should hold; never fewer than LEAST_PIVOTS cells.
CELL = 2048
MOST_CELL = 16 * CELL
LEAST_PIVOTS = 16
PIVOT_BYTES = 32 << 20
BLOCK = 1024
UNIT = 1 << 30


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _homes(x: np.ndarray, p: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors x and pivots p: each vector's cell, and (vector, cell) of its copies."""
    d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
    cell = d.argmin(1)
    near = d[np.arange(len(x)), cell]
    apart = np.sqrt(np.maximum(2 - 2 * p[cell] @ p.T, 0))
    close = (d - near[:, None] <= 2 * span + 1e-9) & (d**2 - near[:, None] ** 2 <= 2 * span * apart + 1e-9)
    return cell, *np.nonzero(close & (np.arange(len(p)) < cell[:, None]))


def _placed(batches, pivots, span):
    """For each batch and dimension: columns, rows of the batch, and those of _homes()."""
    for b in batches:
        if not b.num_rows:
            continue
        vectors = b.column("vector")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for k in np.unique(sizes):
            rows = np.flatnonzero(sizes == k)
            raw = flat[starts[rows][:, None] + np.arange(k)]
            yield b, int(k), rows, raw, *_homes(_unit(raw), pivots[int(k)], span)


def _sizes(batches, pivots, span):
    for _, k, rows, _, cell, _, other in _placed(batches, pivots.value, span):
        own, copies = np.bincount(cell, minlength=len(pivots.value[k])), np.bincount(other, minlength=len(pivots.value[k]))
        some = np.flatnonzero(own + copies)
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(own[some].astype(np.int64)), pa.array(copies[some].astype(np.int64))], ["k", "cell", "own", "copies"])


def _assign(batches, plan, span):
    """Rows of tasks. Tasks of kind 0 have blocks i <= j of a cell's own vectors, and if i is j the first block of its copies; those of kind 1 have block i of its own and
    block j of its copies. Roles: 0 in block i, 1 in block j, 2 a copy."""
    pivots, cuts = plan.value
    for b, k, rows, raw, cell, copied, other in _placed(batches, pivots, span):
        ids, docs = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[rows] for c in ("vec_id", "docs"))
        out: list[tuple[int, int, int, int, int, int]] = []
        for r, c, copy in [*((r, c, False) for r, c in enumerate(cell.tolist())), *((r, c, True) for r, c in zip(copied.tolist(), other.tolist()))]:
            own, copies = cuts.get((k, c), (1, 1))
            mine = hash((int(ids[r]), c)) % (copies if copy else own)
            if copy:
                out += [(r, c, i, mine, 1, 2) if mine else (r, c, i, i, 0, 2) for i in range(own)]
            else:
                out += [(r, c, mine, j, 0, 0) for j in range(mine, own)] + [(r, c, i, mine, 0, 1) for i in range(mine)] + [(r, c, mine, j, 1, 0) for j in range(1, copies)]
        for at in range(0, len(out), 4096):
            r, c, i, j, kind, role = (np.array(x) for x in zip(*out[at : at + 4096]))
            blobs = [raw[x].tobytes() for x in r]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(r), pa.int32()), *[pa.array(x.astype(np.int32)) for x in (c, i, j, kind, role)], pa.array(ids[r]), pa.array(docs[r]), pa.array(blobs, pa.binary())], ["k", "cell", "i", "j", "kind", "role", "vec_id", "docs", "vector"])


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component of parent's and the edges a - b, by hooking and pointer jumping."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _join(cosine, kind):
    """Role 0 against the others, and against itself in a task of one block."""

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        order = np.lexsort((t.column("vec_id").to_numpy(), role))
        role, ids, docs = role[order], t.column("vec_id").to_numpy()[order], t.column("docs").to_numpy()[order]
        x = _unit(np.frombuffer(b"".join(v.as_py() for v in t.column("vector").take(pa.array(order))), kind).reshape(len(ids), -1))
        n = int(np.searchsorted(role, 1))
        whole = t.column("kind")[0].as_py() == 0 and t.column("i")[0].as_py() == t.column("j")[0].as_py()
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, n, BLOCK):
            for j in range(i if whole else n, len(ids), BLOCK):
                u, v = np.nonzero(x[i : min(i + BLOCK, n)] @ x[j : j + BLOCK].T >= cosine)
                u, v = u + i, v + j
                u, v = u[u < v], v[u < v]
                if len(u):
                    np.add.at(links, u, docs[v])
                    np.add.at(links, v, docs[u])
                    parent = _roots(parent, u, v)
        some = links > 0
        return pa.table({"vec_id": pa.array(ids[some]), "near": pa.array(ids[parent[some]]), "links": pa.array(links[some])})

    return run


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, class_id, n_links of each vector that another is near: the smallest vec_id of its connected component, and how many vectors are near.

    Rows without vec_id or embedding, with a null, NaN or infinite element, or of length zero match nothing; vectors of different dimensions don't match. Of rows
    that repeat a vec_id the smallest vector counts; ties at the bound count as matches; other columns are ignored; an empty table gives none. The result is a saved table."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch: list[str] = []
    given = vectors.schema["embedding"].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind, name = (np.float32, "float") if single else (np.float64, "double")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{name}>").alias("vector"))
    sound = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    again = save(sound.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("vec_id").alias("again")), "again", scratch)
    if not again.isEmpty():
        of = F.col("vec_id") == F.col("again")
        sound = sound.join(small(again), of, "left_anti").unionByName(sound.join(small(again), of, "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector")))
    # adding 0.0 makes one zero of both
    digests = save(sound.select("vec_id", F.size("vector").alias("k"), F.transform("vector", lambda v: v + F.lit(0.0).cast(name)).alias("v")).select("vec_id", "k", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(3)).alias("h2")), "digests", scratch)
    distinct = save(digests.groupBy("k", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("docs")), "distinct", scratch)
    several = distinct.where("docs > 1").select("k", "h1", "h2", "rep", "docs")
    copies = save(digests.join(several, ["k", "h1", "h2"]).select("vec_id", "rep", "docs"), "copies", scratch)
    # vectors without a copy, and one of each group of equal ones
    known = small(copies.select(F.col("vec_id").alias("own"), "rep", "docs"))
    sound = sound.join(known, F.col("vec_id") == F.col("own"), "left").where("own IS NULL OR rep = vec_id").select("vec_id", F.coalesce("docs", F.lit(1)).cast("bigint").alias("docs"), "vector")
    numbers = {r["k"]: r["n"] for r in distinct.groupBy("k").agg(F.count("*").alias("n")).collect()}  # a row a dimension
    if not numbers:
        discard(spark, scratch)
        return spark.createDataFrame([], "vec_id bigint, class_id bigint, n_links bigint")
    counts = {k: max(1, min(n, PIVOT_BYTES // (8 * k * len(numbers)), max(LEAST_PIVOTS, math.ceil(n / CELL)))) for k, n in numbers.items()}
    share = F.create_map(*[F.lit(x) for k, n in numbers.items() for x in (k, UNIT if n <= 4 * counts[k] + 64 else math.ceil(UNIT * (2 * counts[k] + 32) / n))])
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(UNIT))
    found: dict[int, list] = {k: [] for k in numbers}
    for r in sound.where(hashed < share[F.size("vector")]).select(hashed.alias("h"), "vec_id", "vector").collect():  # some more than the pivots
        found[len(r["vector"])].append((r["h"], r["vec_id"], r["vector"]))
    held = {k: _unit(np.array([v for _, _, v in sorted(rows)[: counts[k]]])) if rows else np.eye(1, k) for k, rows in found.items()}
    pivots, span = spark.sparkContext.broadcast(held), math.sqrt(max(2 - 2 * cosine, 0))
    sizes = sound.select("vector").mapInArrow(lambda it: _sizes(it, pivots, span), "k int, cell int, own bigint, copies bigint").groupBy("k", "cell").agg(F.sum("own").alias("own"), F.sum("copies").alias("copies"))
    cuts = {(r["k"], r["cell"]): (max(1, math.ceil(r["own"] / MOST_CELL)), max(1, math.ceil(r["copies"] / MOST_CELL))) for r in sizes.where(F.greatest("own", "copies") > MOST_CELL).collect()}  # no more than pivots
    plan = spark.sparkContext.broadcast((held, cuts))
    placed = sound.mapInArrow(lambda it: _assign(it, plan, span), "k int, cell int, i int, j int, kind int, role int, vec_id bigint, docs bigint, vector binary")
    near = save(placed.groupBy("k", "cell", "i", "j", "kind").applyInArrow(_join(cosine, kind), "vec_id bigint, near bigint, links bigint"), "near", scratch)
    roots = components(near.select(F.col("vec_id").alias("a"), F.col("near").alias("b")), "vector-groups")
    per = near.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("n"))
    per = save(per.join(roots, F.col("rep") == F.col("node")).select("rep", "n", "root"), "linked", scratch)
    mine = copies.join(per, "rep", "left").select("vec_id", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    alone = per.join(copies.select(F.col("vec_id").alias("rep")), "rep", "left_anti").select(F.col("rep").alias("vec_id"), F.col("root").alias("class_id"), F.col("n").alias("n_links"))
    out = save(mine.unionByName(alone), "links")
    discard(spark, scratch)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


#: A bound at which the small tables have pairs too.
WIDE = 0.42


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"), WIDE)


def sql(cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
matches AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= {cosine}),
edges AS MATERIALIZED (SELECT a, b FROM matches UNION ALL SELECT b, a FROM matches),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a)
SELECT node AS vec_id, root AS class_id, n_links FROM roots JOIN degrees ON a = node
"""


SQL = sql(COSINE)
SQL_WIDE = sql(WIDE)
