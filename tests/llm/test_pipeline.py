import duckdb
import pytest

import corpus_pipeline
from lexigrid.llm import packing, queries
from lexigrid.llm.shared import save, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([r[k] for k in names]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        assert now and now <= ids
        ids = now
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {d for r in packs for d in r["doc_ids"]} == ids
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("shard", "bin", "used").collect())) == sorted((r["shard"], r["bin"], r["used"]) for r in packs)


def test_components_of_the_pipeline_by_hand(spark, tmp_path):
    """Planted cases with a known end: junk, boilerplate lines, exact and near copies, leaks; and rows that hold nulls, with columns that clash."""
    import random

    from pyspark.sql import functions as F

    from lexigrid.llm.tokenizer import ids_of

    rng = random.Random(21)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(900)] for k, letters in (("aa", "abcdefghij"), ("zz", "pqrstuvwxyz"))}
    prose = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    items = [(i, prose("aa", 40)) for i in range(6)]
    notice = "Posted on {} by the staff of this fine site"
    rows, texts = [], {}
    for i in range(160):
        k = "aa" if i % 2 else "zz"
        texts[i] = "\n".join(prose(k, 12) for _ in range(6))
        lined = texts[i].split("\n")
        lined.insert(3, notice.format(2000 + i))
        rows.append((i, "\n".join(lined), k))
    leaks, copies, junk = range(200, 206), range(210, 230), range(240, 246)
    for i in leaks:
        rows.append((i, prose("aa", 60) + " " + items[i % 6][1] + " " + prose("aa", 30), "aa"))
    for i in copies:  # equal ones, and some with two words changed
        source = texts[i - 210].split(" ")
        for _ in range(2 * (i % 2)):
            source[rng.randrange(len(source))] = rng.choice(words["aa"])
        rows.append((i, " ".join(source), "aa"))
    for i in junk:
        rows.append((i, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200)), None))
    rows += [(300, None, "aa"), (301, "", "aa"), (302, " 12 !! 3", None), (None, prose("zz", 30), "zz"), (5, dict((r[0], r[1]) for r in rows)[5], "aa")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "cls", "rep", "root", "n", "line", "leaf", "block", "a", "b")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r["used"] == sum(r["lengths"]) <= packing.CAPACITY
        for d, n in zip(r["doc_ids"], r["lengths"]):
            sizes[d] = sizes.get(d, 0) + n
    encode = ids_of()
    assert sizes == {i: (len(encode(texts[i])) + 1) * (2 if i == 5 else 1) for i in range(160)}
    columns, empty = docs.columns, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = save(stage(spark, empty, str(tmp_path)), name)
        assert empty.columns == columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
