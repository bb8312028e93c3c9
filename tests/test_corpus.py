"""An 18-token corpus with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import ngrams, paging, render, sequence
from lexigrid.operators.dictionary import SOURCE_FIELDS, build, longest, types_of
from lexigrid.operators.predicates import matching_sources
from lexigrid.operators.segments import without_punctuation
from lexigrid.plans.engine import Corpus
from lexigrid.plans.query import CorpusQuery, Slot
from lexigrid.sources import plain, tables, tagged
from lexigrid.sources.shared import stored

ROWS = """Мин|мин|мин|<nom>,<p1>,<prn>,<sg>
китап|китап|китап|<n>,<nom>,<sg>
укыдым|укыдым|укы|<ifi>,<p1>,<sg>,<tv>,<v>
.|.|.|<sent>
Китап|китап|китап|<n>,<nom>,<sg>
бик|бик|бик|<adv>
яхшы|яхшы|яхшы|<adj>
китап|китап|китап|<n>,<nom>,<sg>
!|!|!|<sent>
(|(|(|<lpar>
Яхшы|яхшы|яхшы|<adj>
кеше|кеше|кеше|<n>,<nom>,<sg>
)|)|)|<rpar>
килде|килде|кил|<ifi>,<iv>,<p3>,<sg>,<v>
,|,|,|<cm>
кеше|кеше|кеше|<n>,<nom>,<sg>
китте|китте|кит|<ifi>,<iv>,<p3>,<sg>,<v>
.|.|.|<sent>""".splitlines()
SENTENCES = [0] * 4 + [1] * 5 + [2] * 9
Q = CorpusQuery.of


@pytest.fixture(scope="module")
def corpus(spark):
    rows, before = [], {}
    for i, (line, s) in enumerate(zip(ROWS, SENTENCES)):
        before[s] = before.get(s, -1) + 1
        rows.append((i, s, before[s], 0 if s < 2 else 1, *line.split("|")))
    tokens = spark.createDataFrame(rows, "id bigint, sentence bigint, pos bigint, source bigint, word_case string, word string, lemma string, tags string").persist()
    sources = spark.createDataFrame([(i, *[a if c == "author" else "" for c in SOURCE_FIELDS]) for i, a in enumerate(("Г. Тукай", "Ф. Әмирхан"))], "id bigint, " + ", ".join(f"{c} string" for c in SOURCE_FIELDS))
    tokens = stored(tokens, "tokens")
    star = build(tokens, sources, stored(types_of(tokens), "types"))
    star.main = stored(star.main, "main")
    return Corpus(star, tokens)


def answer(corpus, query):
    page = [[v for k, v in r.asDict().items() if k.startswith("z")] for r in corpus.page(query).collect()]
    s = corpus.summary(query).first()
    return page, s["found_all"], s["progress"], s["last_pos"]


A, N = Slot(tags="<adj>"), Slot(tags="<n>")
K = Slot(wildmatch="к*")
CASES = {
    "F1": (Q(Slot(word="китап")), ([[1], [4], [7]], 3, 3, 7)),
    "F2": (Q(Slot(word="Китап", case=True)), ([[4]], 1, 1, 4)),
    "F3": (Q(Slot(tags="<sg>,<n>")), ([[1], [4], [7], [11], [15]], 5, 5, 15)),
    "F4": (Q(A, N), ([[6, 7], [10, 11]], 2, 2, 10)),
    "F5": (Q(K, K, distances=[(1, 4)]), ([[4, 7], [11, 13], [13, 15], [15, 16]], 6, 6, 15)),
    "F6": (Q(K, K, distances=[(1, 4)], returned=1), ([[4, 7]], 6, 1, 4)),
    "F7": (Q(K, K, distances=[(1, 4)], cursor=11), ([[13, 15], [15, 16]], 6, 6, 15)),
    "F8": (Q(Slot(lemma="кеше"), Slot(), Slot(tags="<ifi>")), ([[11, 12, 13]], 1, 1, 11)),
    "F9": (Q(Slot(word="укыдым"), Slot(word="бик"), distances=[(2, 4)]), ([], 0, 0, -1)),
    "F9 compat": (Q(Slot(word="укыдым"), Slot(word="бик"), distances=[(2, 4)], boundary="compat"), ([], 0, 0, -1)),
    "F9b": (Q(Slot(word="укыдым"), Slot(word="бик"), distances=[(3, 4)]), ([], 0, 0, -1)),
    "F9b compat": (Q(Slot(word="укыдым"), Slot(word="бик"), distances=[(3, 4)], boundary="compat"), ([[2, 5]], 1, 1, 2)),
    "F10": (Q(Slot(wildmatch="ки?ап")), ([[1], [4], [7]], 3, 3, 7)),
    "F11": (Q(Slot(wildmatch="?")), ([[3], [8], [9], [12], [14], [17]], 6, 6, 17)),
    "F12a": (Q(Slot(word="китап"), source="Г*"), ([[1], [4], [7]], 3, 3, 7)),
    "F12b": (Q(Slot(word="китап"), source="Ф*"), ([], 0, 0, -1)),
    "F12c": (Q(Slot(word="китап"), source="^г.*", regex=True), ([[1], [4], [7]], 3, 3, 7)),
}


@pytest.mark.parametrize("name", CASES)
def test_search(corpus, name):
    query, expected = CASES[name]
    assert answer(corpus, query) == expected


def test_adjacent_by_window(corpus):
    s = corpus.star
    q = Q(A, N)
    assert sorted(map(tuple, sequence.adjacent_tuples(s.main, s.types, s.sources, q).collect())) == sorted(map(tuple, corpus.tuples(q).collect()))
    with pytest.raises(ValueError):
        sequence.adjacent_tuples(s.main, s.types, s.sources, Q(K, K, distances=[(1, 4)]))


def test_pages_join_up(corpus):
    q, cursor, seen = Q(K, K, distances=[(1, 4)], returned=1), -1, []
    while rows := corpus.page(Q(K, K, distances=[(1, 4)], returned=1, cursor=cursor)).collect():
        seen.append(cursor := rows[0]["z1"])
    assert seen == [4, 11, 13, 15]
    last = corpus.summary(Q(K, K, distances=[(1, 4)], returned=1, cursor=13)).first()
    assert last["progress"] == last["found_all"] == 6
    assert corpus.summary(Q(K, K, distances=[(1, 4)], cursor=15)).first().asDict() == {"found_all": 6, "last_pos": 15, "progress": 6}
    assert q.returned == 1


def test_lexicons(corpus):
    s = corpus.star
    words = [r["word_case"] for r in s.words_case.orderBy("id").collect()]
    assert words == "! ( ) , . Китап Мин Яхшы бик кеше килде китап китте укыдым яхшы".split()
    freq = {r["word"]: r["freq"] for r in s.words.collect()}
    assert len(freq) == 13 and freq["китап"] == 3 and freq["яхшы"] == 2
    assert s.main.count() == s.united.agg(F.sum("freq")).first()[0] == s.words.agg(F.sum("freq")).first()[0] == 18
    assert longest(corpus.tokens).first().asDict() == {"length": 6, "word_case": "укыдым"}
    tag = s.tags_uniq.orderBy("id").first()
    assert tag["tag"] == "<sg>" and tag["id"] == 0


def test_segments_and_ngrams(corpus):
    def sizes(punctuation):
        rows = corpus.ngrams(punctuation).groupBy("level").agg(F.count("*").alias("d"), F.sum("freq").alias("t")).collect()
        got = {r["level"]: (r["d"], r["t"]) for r in rows}
        return [got.get(k, (0, 0)) for k in range(1, 7)]

    assert sizes(True) == [(15, 18), (15, 15), (12, 12), (9, 9), (6, 6), (4, 4)]
    assert sizes(False) == [(10, 12), (7, 7), (3, 3), (1, 1), (0, 0), (0, 0)]
    found = corpus.search_ngrams(Q(A, N), punctuation=False)
    words = ngrams.with_words(found, corpus.star.types, 2).collect()
    assert sorted((tuple(r["ngram"]), r["freq"]) for r in words) == [(("Яхшы", "кеше"), 1), (("яхшы", "китап"), 1)]
    assert without_punctuation(corpus.tokens).count() == 12


def test_trie_links(corpus):
    nodes = ngrams.trie(corpus.ngrams()).collect()
    freq = {(r["level"], r["node"]): r["freq"] for r in nodes}
    children = {}
    for r in nodes:
        if r["level"] > 1:
            key = (r["level"] - 1, r["parentnode"])
            children[key] = children.get(key, 0) + r["freq"]
    assert all(freq[k] >= v for k, v in children.items()) and len(freq) == len(nodes) == 61


def test_ngram_files(spark, corpus, tmp_path):
    trie = ngrams.trie(corpus.ngrams())
    tables.write_ngrams(trie, str(tmp_path / "n"))
    assert sorted(map(tuple, tables.read_ngrams(spark, str(tmp_path / "n")).fillna(-1).collect())) == sorted(map(tuple, trie.fillna(-1).collect()))
    paths = [r[0] for r in tables.leaf_paths(corpus.ngrams()).collect()]
    # 18 places to start from; the two full stops that end a sentence are the same path
    assert len(paths) == len(set(paths)) == 17 and "4(1) 5(2)" not in paths


def test_rendering(corpus):
    text = {r["sentence"]: r["sentence_text"] for r in render.plain_sentences(corpus.tokens).collect()}
    assert text[2] == " (Яхшы кеше) килде, кеше китте."
    marked = corpus.rows(Q(A, N)).where("z1 = 6").first()["sentence_text"]
    assert "<span class='found_word' id='found_word_0' title='(яхшы) <adj>'>яхшы</span><!-- found_word_0 -->" in marked
    assert marked.startswith(" <span class='regular_word' title='(китап) <n>,<nom>,<sg>'>Китап</span><!-- regular_word -->")
    assert sorted(r["sentence"] for r in corpus.context(CorpusQuery(extend=1, extend_range=1)).collect()) == [0, 1, 2]


def test_quotes(spark):
    rows = [(0, i, t) for i, t in enumerate(['"', "a", '"', "b", "«", "c", "»", "`", "d"])]
    t = spark.createDataFrame(rows, "sentence bigint, pos bigint, word_case string")
    assert render.plain_sentences(t).first()[1] == ' "a" b «c»`d'


def test_responses(corpus):
    got = json.loads(corpus.respond('{"tags":["<adj>","<n>"],"return":1}').first()[0])
    assert got["found_all"] == 2 and got["last_pos"] == "6" and got["progress"] == 1 and got["example"][-1] == {"id": -1} and got["example"][0]["author"] == "Г. Тукай"
    assert json.loads(corpus.respond('{"word":["нет"]}').first()[0])["example"] == [{"id": -1}]
    assert [e["id"] for e in json.loads(corpus.respond('{"extend":1,"extend_range":1}').first()[0])["example"]] == [0, 1, 2, -1]
    grams = json.loads(corpus.respond_ngrams('{"tags":["<adj>","<n>"]}', punctuation=False).first()[0])
    assert grams["found_all"] == 2 and "кеше" in grams["example"][1]["ngram"][0] + grams["example"][0]["ngram"][0]


def test_source_field(corpus):
    with pytest.raises(ValueError):
        matching_sources(corpus.star.sources, Q(A, source="x", source_field="nothing"))


def test_files(spark, corpus, tmp_path):
    for write, read, name in ((tables.write_parquet, tables.read_parquet, "p"), (tables.write_tsv, tables.read_tsv, "t")):
        write(corpus.star, str(tmp_path / name))
        back = read(spark, str(tmp_path / name))
        for table in tables.SCHEMAS:
            assert sorted(map(tuple, getattr(back, table).collect())) == sorted(map(tuple, getattr(corpus.star, table).collect())), table
        assert sorted(map(tuple, back.types.collect())) == sorted(map(tuple, corpus.star.types.select("id", "freq", "word_case", "word", "lemma", "tags").collect()))


def test_plans(corpus):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    text = plan(corpus.tuples(Q(K, K, N, distances=[(1, 4), (2, 9)])))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    compat = plan(corpus.tuples(Q(K, K, distances=[(2, 9)], boundary="compat")))
    assert "CartesianProduct" not in compat and "NestedLoop" not in compat


def test_tagged_text(spark, tmp_path):
    lines = [
        "﻿^Мин/Мин<prn><pers><p1><sg><nom>$ ^үземне/үз<prn><ref><px1sg><acc>$ – ^ерак/ерак<adj>$ ^идем/и<cop><ifi><p1><sg>$^./.<sent>$ lost",
        "^ике сүз/бер<n>/ике Сүз<num>+и<cop>$ ^x/*x$ ^$",
    ]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = tagged.parse(tagged.read_lines(spark, str(tmp_path / "t.txt"))).orderBy("sentence", "pos").collect()
    got = [(r["sentence"], r["word_case"], r["word"], r["lemma"], r["tags"]) for r in rows]
    assert got[:6] == [
        (0, "Мин", "мин", "мин", "<nom>,<p1>,<pers>,<prn>,<sg>"), (0, "үземне", "үземне", "үз", "<acc>,<prn>,<px1sg>,<ref>"), (0, "–", "–", "–", "<sym>"),
        (0, "ерак", "ерак", "ерак", "<adj>"), (0, "идем", "идем", "и", "<cop>,<ifi>,<p1>,<sg>"), (0, ".", ".", ".", "<sent>"),
    ]
    assert got[6] == (1, "ике_сүз", "ике_сүз", "ике_сүз", "+и<cop>,+ике Сүз<num>,<n>")
    assert got[7] == (1, "x", "x", "x", "*") and got[8] == (1, "", "/", "/", "*")
    (tmp_path / "m.tsv").write_text("0\t5\n1\t6\n")
    full = tagged.with_ids(tagged.parse(tagged.read_lines(spark, str(tmp_path / "t.txt"))), tagged.read_map(spark, str(tmp_path / "m.tsv")))
    assert [r["id"] for r in full.orderBy("sentence", "pos").collect()] == list(range(9))
    (tmp_path / "bad.tsv").write_text("1\t5\n2\t6\n")
    with pytest.raises(ValueError):
        tagged.read_map(spark, str(tmp_path / "bad.tsv"))


def test_stream_counts(spark, tmp_path):
    from lexigrid.streaming import append

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("^A/a<n>$ ^b/b<v><tv>$\n", encoding="utf-8")
        append.maintain_counts(append.parsed_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, append.current_counts(spark, str(tmp_path / "out")).collect())) == [("A", "a", "a", "<n>", 2), ("b", "b", "b", "<tv>,<v>", 2)]


def test_documents_with_nulls(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc", None, None), (2, None, "en", "s"), (None, "x", "en", "s"), (3, "", "en", "s")], "doc_id bigint, text string, lang string, source string")
    c = Corpus.from_documents(docs)
    assert [tuple(r) for r in c.tokens.select("id", "sentence", "pos", "source", "word").orderBy("id").collect()] == [(0, 0, 0, 1, "a"), (1, 0, 1, 1, "b"), (2, 1, 0, 1, "c")]
    slots = plain.slots(c.star.main).orderBy("id").collect()
    assert [(r["slot"], r["sent_slot"]) for r in slots] == [(2, 2), (3, 2), (5, 5)]
    assert paging.anchors(c.tuples(Q(Slot(word="a")))).count() == 1


def test_all_six_levels_are_registered(spark, corpus, monkeypatch):
    from lexigrid import catalog

    monkeypatch.setattr(catalog, "corpus", lambda spark, d: corpus)
    united = {}
    for r in corpus.star.main.orderBy("id").collect():
        united.setdefault(r["sentence"], []).append(r["united"])
    freq = {}
    for us in united.values():
        for i in range(len(us)):
            for k in range(1, min(6, len(us) - i) + 1):
                freq[tuple(us[i : i + k])] = freq.get(tuple(us[i : i + k]), 0) + 1
    leaves = [g for g in freq if not any(len(x) == len(g) + 1 and x[:-1] == g for x in freq)]
    want = sorted(" ".join(f"{g[j]}({freq[g[: j + 1]]})" for j in range(len(g))) for g in leaves)
    assert sorted(r[0] for r in catalog.QUERIES["ng_leaf_paths"](spark, "").collect()) == want
    assert {len(x.split()) for x in want} >= {3, 4, 5, 6}
    for name in ("ng_rank", "ng_wopunct"):
        rows = catalog.QUERIES[name](spark, "").collect()
        grams = {tuple(g for g in r[2:8] if g is not None): r["freq"] for r in rows}
        assert len(grams) == len(rows) and all(len(g) == r["level"] for g, r in zip(grams, rows))
        assert grams == freq if name == "ng_rank" else max(map(len, grams)) == max(r["level"] for r in rows) and set(grams) < set(freq)


def test_stream_is_like_batch(spark, tmp_path):
    from lexigrid.streaming import append

    (tmp_path / "in").mkdir()
    text = "\ufeff^Мин/Мин<prn><pers><p1><sg><nom>$ ^үземне/үз<prn><ref><px1sg><acc>$ – ^ерак/ерак<adj>$ ^идем/и<cop><ifi><p1><sg>$^./.<sent>$\n^a b/c<n>/d<v>+и<cop>$ x ^plain$ ^/$\n"
    (tmp_path / "in" / "0.txt").write_text(text, encoding="utf-8")
    append.maintain_counts(append.parsed_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = tagged.parse(tagged.read_lines(spark, str(tmp_path / "in"))).groupBy(*append.TYPE).agg(F.count("*").alias("freq"))
    got = sorted(map(tuple, append.current_counts(spark, str(tmp_path / "out")).select(*append.TYPE, "freq").collect()))
    assert got == sorted(map(tuple, batch.collect())) and ("–", "–", "–", "<sym>", 1) in got and ("идем", "идем", "и", "<cop>,<ifi>,<p1>,<sg>", 1) in got
    assert ("a_b", "a_b", "d", "+d<v>,+и<cop>,<n>", 1) in got


@pytest.mark.parametrize("bad", ["a{2,1}", "[z-a]", "a{1", "(?<n>a)(?<n>b)"])
def test_what_java_refuses_is_an_error_on_the_driver(corpus, bad):
    with pytest.raises(ValueError):
        corpus.tuples(Q(Slot(wildmatch=bad), regex=True))
    with pytest.raises(ValueError):
        matching_sources(corpus.star.sources, Q(K, source=bad, regex=True))


QUERIES = [
    Q(K), Q(K, A, distances=[(1, 4)]), Q(A, N, K, distances=[(1, 3), (1, 9)]), Q(K, Slot(), A, distances=[(1, 2), (1, 1)]), Q(N, N, N, distances=[(1, 9), (1, 9)]), Q(Slot(tags="<sent>"), K),
    Q(K, K, K, K, K, K, distances=[(1, 1000)] * 5), Q(Slot(), Slot(), Slot(), N, distances=[(1, 2)] * 3), Q(K, A, distances=[(1, 4)], source="*мирхан"),
]


@pytest.mark.parametrize("k", range(len(QUERIES)))
def test_counted_anchors_are_those_of_the_tuples(corpus, k, monkeypatch):
    monkeypatch.setattr(sequence, "SELECTIVE", k % 2 * 0.9)
    query = QUERIES[k]
    by_tuples = paging.anchors(corpus.tuples(query))
    got = sequence.anchor_counts(corpus.star.main, corpus.star.types, corpus.star.sources, query)
    assert sorted(got.columns) == sorted(by_tuples.columns)
    assert sorted(map(tuple, got.select(by_tuples.columns).collect())) == sorted(map(tuple, by_tuples.collect()))


def test_sentence_ranges():
    from lexigrid.plans.engine import sentence_ranges

    assert sentence_ranges([]) == [] and sentence_ranges([7, 7]) == [(7, 7)]
    assert sentence_ranges([1, 2, 3, 90, 91, 500], 2) == [(1, 91), (500, 500)]
    assert sentence_ranges([1, 2, 3, 90, 91, 500]) == [(1, 3), (90, 91), (500, 500)]


def test_numbers_over_many_partitions(spark):
    import random

    from lexigrid.operators.numbering import numbered

    rng = random.Random(2)
    values = [(rng.choice("xyz"), rng.randrange(10_000), i) for i in range(3000)]
    df = spark.createDataFrame(values, "w string, a bigint, b bigint").repartition(7)
    want = sorted(values, key=lambda r: (-r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(numbered(df, "k", [F.desc("a"), F.col("b")]).collect(), key=lambda r: r["k"])] == want
    got = numbered(df, "k", [F.desc("a"), F.col("b")], within="w").collect()
    for w in "xyz":
        own = sorted((r["k"], r["a"], r["b"]) for r in got if r["w"] == w)
        assert [r[0] for r in own] == list(range(len(own))) and [(w, *r[1:]) for r in own] == [r for r in want if r[0] == w]
    assert numbered(df.limit(0), "k", [F.col("a")]).count() == 0


def test_saved_tables_without_places(spark, corpus, tmp_path):
    tables.write_tsv(corpus.star, str(tmp_path / "star"), pos=False)
    again = Corpus.from_tables(tables.read_tsv(spark, str(tmp_path / "star")))
    query = Q(K, A, distances=[(1, 4)])
    key = "z1"
    assert sorted(map(tuple, again.rows(query).select(key, "sentence_text", "s_author").collect())) == sorted(map(tuple, corpus.rows(query).select(key, "sentence_text", "s_author").collect()))
    assert answer(again, query) == answer(corpus, query)


def test_tree_dump(spark, corpus, tmp_path):
    tables.write_tree(corpus.ngrams(), str(tmp_path / "tree"))
    lines = [line for p in sorted((tmp_path / "tree").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == "#NodeId;parentNodeId;WordId;amount" and lines[-1] == f"#Next free id:{len(lines) - 1}"
    united = {}
    for r in corpus.star.main.orderBy("id").collect():
        united.setdefault(r["sentence"], []).append(r["united"])
    tree = {}
    for us in united.values():
        for i in range(len(us)):
            at = tree
            for u in us[i : i + 6]:
                node = at.setdefault(u, [0, {}])
                node[0] += 1
                at = node[1]
    want = []

    def walk(at, above):
        for u in sorted(at):
            want.append(f"{len(want) + 1};{above};{u};{at[u][0]}")
            walk(at[u][1], len(want))

    walk(tree, 0)
    assert lines[1:-1] == want


def test_requests_for_counts_and_beyond_the_end(corpus):
    got = json.loads(corpus.respond('{"wildmatch":["к*"],"count_only":1}').first()["response"])
    assert got["example"] == [{"id": -1}] and got["found_all"] == corpus.summary(Q(K)).first()["found_all"]
    assert json.loads(corpus.respond('{"extend":2}').first()["response"])["example"][0]["id"] == 2
    assert len(json.loads(corpus.respond('{"extend":99,"wildmatch":["к*"]}').first()["response"])["example"]) > 1
    with pytest.raises(ValueError):
        corpus.respond('{"extend":99}')
