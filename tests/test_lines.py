"""Sentences as rows: what moves, what is made, and hard texts against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrid.plans.engine import Corpus
from lexigrid.plans.query import CorpusQuery, Slot
from lexigrid.sources import tables, tagged

Q = CorpusQuery.of


def made(spark, texts):
    return Corpus.from_documents(spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(["a", "b", "Cc", "the", "of", ",", "."]) for _ in range(rng.randrange(0, 12)))
    return ["\n".join(line() for _ in range(rng.randrange(1, 6))) for _ in range(60)]


@pytest.fixture(scope="module")
def corpus(spark, texts):
    return made(spark, texts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_and_text_move_no_token(corpus):
    query = Q(Slot(word="of"), Slot(wildmatch="*c*"), Slot(word="the"), distances=[(1, 4), (1, 9)])
    for found in (corpus.tuples(query), corpus.anchors(query), corpus.lines.plain_sentences(), corpus.tokens, corpus.tuples(Q(Slot(word="of"), Slot(word="the")))):
        assert not re.search(r"Exchange hash|Exchange range|Window|Sort", plan(found))


def test_only_what_is_asked_for_is_made(spark, texts):
    c = made(spark, texts)
    c.respond('{"word":["of","the"]}').collect()
    c.lines.rows.count()
    assert not {"types", "main", "united"} & set(vars(c.star)) and "ids" not in vars(c)
    assert c.star.tags.count() == 4 and "main" not in vars(c.star)


def test_pages_and_totals_by_blocks(corpus, texts):
    query, places, at = Q(Slot(word="the"), returned=3), [], 0
    for t in texts:
        for w in re.findall(r"[^\W_]+|[^\s\w]", t):
            places += [at] if w == "the" else []
            at += 1
    assert len(corpus.totals(query)) > 1 and sum(r["n"] for r in corpus.totals(query)) == len(places)
    seen, cursor = [], -1
    while rows := corpus.page(Q(Slot(word="the"), returned=3, cursor=cursor)).collect():
        seen += [r["z1"] for r in rows]
        cursor = seen[-1]
        s = corpus.summary(Q(Slot(word="the"), returned=3, cursor=seen[-len(rows)] - 1)).first()
        assert (s["found_all"], s["last_pos"], s["progress"]) == (len(places), cursor, len(seen))
        if len(seen) > 15:
            break
    assert seen == places[: len(seen)]


def test_lines_that_are_hard(spark):
    c = made(spark, ['"a" "b', " \t\r\n\x0b\n(x) y!", "", "9 " * 3000 + "z"])
    text = {r["sentence"]: r["sentence_text"] for r in c.lines.plain_sentences().collect()}
    assert text[0] == ' "a" "b' and text[1] == " (x) y!" and text[2] == " 9" * 3000 + " z"
    assert [tuple(r) for r in c.anchors(Q(Slot(word="9"), Slot(word="z"), distances=[(1, 2)])).select("z2", "n_tuples").collect()] == [(c.tokens.count() - 1, 1)] * 2


def test_repeated_ids_give_each_line_its_place(spark):
    docs = spark.createDataFrame([(1, "b\nd", "en", "s"), (1, "a\nc", "en", "s"), (0, "x y", "en", "s")], "doc_id bigint, text string, lang string, source string")
    rows = Corpus.from_documents(docs).tokens.orderBy("id").collect()
    assert [(r["id"], r["sentence"], r["word"]) for r in rows] == [(0, 0, "x"), (1, 0, "y"), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (5, 4, "d")]


def test_tagged_lines_are_placed_without_sorting_tokens(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(tagged, "BLOCK_BITS", 3)
    tables.write_tagged_lines(corpus.lines, str(tmp_path / "t"), str(tmp_path / "m"))
    lines, m = tagged.read_lines(spark, str(tmp_path / "t")), tagged.read_map(spark, str(tmp_path / "m"))
    got = sorted(map(tuple, tagged.placed(lines, m).collect()))
    assert got == sorted(map(tuple, tagged.with_ids(tagged.parse(lines), m).collect())) == sorted(map(tuple, corpus.tokens.collect()))


@pytest.mark.parametrize("punctuation", [True, False])
def test_ngrams_over_ranges_and_batches(spark, corpus, punctuation):
    """Open n-grams at the end of a batch, numbers over ranges, and searches that return some of what is numbered."""
    tokens = [r for r in corpus.tokens.join(corpus.star.types.select("word_case", "tags", F.col("id").alias("u")), ["word_case", "tags"]).orderBy("id").collect()]
    runs, last = [], None
    for r in tokens:
        if not punctuation and r["tags"] in ("<sent>", "<cm>"):
            last = None
            continue
        if r["sentence"] != last:
            runs.append([])
            last = r["sentence"]
        runs[-1].append(r["u"])
    freq = {}
    for us in runs:
        for i in range(len(us)):
            for k in range(1, min(6, len(us) - i) + 1):
                freq[tuple(us[i : i + k])] = freq.get(tuple(us[i : i + k]), 0) + 1
    want = {}
    for k in range(1, 7):
        for n, g in enumerate(sorted((g for g in freq if len(g) == k), key=lambda g: (-freq[g], g))):
            want[g] = (n, freq[g])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus.ngrams(punctuation).collect()
        the = Slot(word="the")
        found = corpus.search_ngrams(Q(the, Slot(wildmatch="*")), punctuation).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    gram = lambda r: tuple(r[f"g{i}"] for i in range(1, r["level"] + 1))
    assert len(rows) == len(want) and {gram(r): (r["node"], r["freq"]) for r in rows} == want
    first = {r["u"] for r in tokens if r["word"] == "the"}
    assert {gram(r): (r["node"], r["freq"]) for r in found} == {g: v for g, v in want.items() if len(g) == 2 and g[0] in first}


def test_a_search_moves_one_window_a_token(corpus):
    text = plan(corpus.search_ngrams(Q(Slot(word="the"), Slot(word="of"))))
    assert "p1" in text and "p2" not in text and not re.search(r"SortMergeJoin|g1#\d+L?[^\n]*Exchange hash", text)


@pytest.mark.parametrize("ranges", ["1", "5", "40"])
def test_links_and_paths_over_ranges(spark, corpus, ranges):
    """Tree, trie and leaf paths of one exchange are those of joins, also where a range cuts a type's n-grams."""
    from lexigrid.operators import ngrams

    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": ranges}
    old = {k: spark.conf.get(k) for k in conf}
    nodes = corpus.ngrams().persist()
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(a.columns).collect())))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert same(corpus.tree_rows(), tables.tree_rows(nodes))
        assert same(corpus.leaf_paths(), tables.leaf_paths(nodes))
        assert same(corpus.trie(), ngrams.trie(nodes))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        nodes.unpersist()
