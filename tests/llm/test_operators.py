"""Operators on small tables: brute force, nulls, empty tables, repeated rows, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import archive, decontaminate, language_id, line_templates, ngram_join, packing, records, site_quality, suffix_dedup, vector_join
from lexigrid.llm import textkernel as tk
from lexigrid.llm.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ("key", "n", "label", "grams", "h", "part", "id", "good", "host", "path", "cell", "size", "shard", "a", "b", "__gone", "__drop", "leaf", "line")
WORDS = {"x": ["alba", "berun", "cordi", "delma", "erato", "fintu", "golan", "hirma"], "y": ["quix", "zyp", "wox", "vyk", "kuzz", "jyx", "pywk", "xoq"]}


def prose(rng, n, lang="x"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "en", "or", "is"]) for _ in range(n))


def make(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, *(r if (r := rest) else ("x", "s", 0))) for i, t, *rest in rows], DOCS)
    for c in EXTRA if extra else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def awkward(spark):
    rng = random.Random(7)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    rows = [(1, None), (2, ""), (None, same), (3, same), (4, same), (4, same), (5, "word"), (6, long), (7, "12 34 !!"), (8, "x" * 50_000), (9, None, None, None, None), (10, "\n\n"), (11, " é   ")]
    return make(spark, rows)


def collected(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect())) if cols else df.collect()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1050)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted({(x, find(x)) for e in edges if e[0] != e[1] for x in e})
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert collected(got, "node", "root") == want and len({root for _, root in want}) > 10
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def jaccard_links(docs, n, threshold):
    sets = {}
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0], r[1] is None, r[1])):
        w = tk.words_of(t)
        g = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        if i is not None and t is not None and i not in sets:
            sets[i] = g
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-9:
                n_links[a] += 1
                n_links[b] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted((i, find(i), k) for i, k in n_links.items() if k)


def linked(docs):
    return collected(ngram_join.links(docs), "doc_id", "class_id", "n_links")


@pytest.mark.parametrize("seed", [1, 4])
def test_ngram_join(spark, seed, monkeypatch):
    if seed == 4:  # hot groups are split
        monkeypatch.setattr(ngram_join, "CROWD", 3)
        monkeypatch.setattr(ngram_join, "UNIT_SETS", 3)
        monkeypatch.setattr(ngram_join, "PART_GRAMS", 100)
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for i in range(200):
        if i % 4 and rows:
            words = (rng.choice(rows) if seed % 2 else rng.choice(rows[:3]))[1].split()
            share = rng.choice([0, 0.01, 0.02, 0.08, 0.15, 0.3])
            words = [rng.choice(vocabulary) if rng.random() < share else w for w in words]
            words = words[: rng.choice([len(words), len(words), len(words) * 2 // 3])]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 20, 60, 150]))]
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    docs = make(spark, rows)
    got = linked(docs)
    assert got == jaccard_links(rows, ngram_join.N, ngram_join.THRESHOLD) and got
    gone = {i for i, root, _ in got if i != root}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == sorted(i for i, _ in rows if i not in gone)


@pytest.mark.parametrize("fans", [4095, 20])
def test_ngram_join_dense(spark, fans, monkeypatch):
    """A group of near copies that grows with the table doesn't become as many pairs of classes as it has pairs of documents."""
    monkeypatch.setattr(ngram_join, "FANS", fans, raising=False)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    edited = lambda share: " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)
    rows = [(i, edited(rng.random() * 0.1)) for i in range(300)] + [(300 + i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(20)]
    rows += [(400 + i, rows[rng.randrange(320)][1]) for i in range(40)]
    counts, save = {}, ngram_join.save

    def counted(df, label, *scratch):
        out = save(df, label, *scratch)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "save", counted)
    got = linked(make(spark, rows))
    assert got == jaccard_links(rows, ngram_join.N, ngram_join.THRESHOLD) and len(got) > 250
    assert counts["pairs"] < 6 * len(rows)


def test_ngram_join_awkward(spark):
    docs = awkward(spark)
    assert linked(docs) == [(3, 3, 1), (4, 3, 1)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11]
    assert ngram_join.links(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0
    rows = [(1, "b c d e"), (1, "a b c d"), (2, "a b c d"), (3, "b c d e"), (4, "one two"), (5, "two one"), (6, "One, two!"), (7, ""), (8, None), (None, "one two")]
    assert linked(make(spark, rows)) == [(1, 1, 1), (2, 1, 1), (4, 4, 1), (6, 4, 1)]


@pytest.mark.parametrize("most", [1 << 20, 70_000, 300])
def test_gaps(most):
    x = np.unique(np.random.default_rng(most).integers(0, 1 << 32, most // 100, dtype=np.uint32) if most > 300 else np.array([0, 65534, 65535, 65536, 1 << 31, (1 << 32) - 1], np.uint32))
    assert (ngram_join._from_gaps(ngram_join._gaps(x)) == x).all()
    assert (ngram_join._from_gaps(ngram_join._gaps(np.array([3, 3, 70_000], np.uint32))) == [3, 3, 70_000]).all()


def test_list_blocks():
    rng = np.random.default_rng(4)
    n = 400
    grams, cls = np.sort(rng.integers(0, 12, n)), rng.integers(0, 90, n)
    lo = rng.integers(3, 60, n)
    hi, room = lo + rng.integers(0, 5, n), rng.integers(1, 60, n)
    got = {(min(x, y), max(x, y)) for i, j in ngram_join.candidates(grams, cls, lo, hi, room, 0.5) for x, y in zip(i, j)}
    fits = lambda i, j: grams[i] == grams[j] and cls[i] != cls[j] and hi[i] >= 0.5 * lo[j] and hi[j] >= 0.5 * lo[i] and min(room[i], room[j]) >= ngram_join.least(0.5, lo[i], lo[j])
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if fits(i, j)}


def test_language_id(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60, lang), lang, "s", 0) for i, lang in enumerate(["x", "y"] * 60)]
    docs = make(spark, rows, extra=False)
    filters = language_id.fit(docs)
    held = make(spark, [(1000 + i, prose(rng, 15, lang), lang, "s", 0) for i, lang in enumerate(["x", "y"] * 20)] + [(2000, "ΩΨ ЖЩ ΩΨЖ ЩЩ", None, None, 0), (2001, None), (2002, "123")])
    got = {r["doc_id"]: r["language"] for r in language_id.identify(held, filters).collect()}
    assert got == {1000 + i: lang for i, lang in enumerate(["x", "y"] * 20)}
    assert sorted(r["doc_id"] for r in language_id.identify(held, filters, rejected=True).collect()) == [2000, 2001, 2002]
    kept = language_id.keep_identified(held, filters)
    assert kept.columns == held.columns and kept.count() == 40
    a = awkward(spark)
    language_id.identify(a).collect()
    assert language_id.identify(a.limit(0)).count() == 0 and language_id.keep_identified(a.where("lang IS NULL")).count() == 0


def test_line_templates(spark):
    rng = random.Random(6)
    rows = []
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    prose = lambda rng, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    for i in range(30):
        own = [prose(rng, 12) for _ in range(3)]
        if i % 2:
            own.insert(rng.randrange(4), f"Posted on 2024-01-{i:02d} by user{i} in the general forum")
        if i % 3 == 0:
            own.append("All rights reserved by the " + ["first", "second", "third"][i % 9 // 3] + " owner of this site here")
        rows.append((i, "\n".join(own)))
    copy = "\n".join(prose(rng, 12) for _ in range(4))
    rows += [(100 + k, copy) for k in range(12)]  # copies of one document aren't boilerplate
    docs = make(spark, rows)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_templates.strip_lines(docs).collect()}
    for i, t in rows:
        keep = [line for line in t.split("\n") if not line.startswith(("Posted on", "All rights"))]
        assert got[i] == ("\n".join(keep), len(t.split("\n")) - len(keep)), i
    clean = line_templates.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())


def test_line_templates_awkward(spark):
    docs = awkward(spark)
    want = sorted((r["doc_id"] or -1, r["text"]) for r in docs.collect() if r["text"] is not None)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in line_templates.clean_documents(docs).collect() if r["text"] is not None) == want
    assert line_templates.strip_lines(docs).count() == docs.count() and line_templates.strip_lines(docs.limit(0)).count() == 0


def test_packing(spark):
    docs = awkward(spark)
    rows = packing.packed(docs, capacity=64, shard_docs=5).collect()
    from lexigrid.llm.tokenizer import encoder

    sizes = {}
    for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + len(encoder().encode_ordinary(r["text"])) + 1
    got = {}
    for r in rows:
        assert r["used"] == sum(r["lengths"]) <= 64
        for d, n in zip(r["doc_ids"], r["lengths"]):
            got[d] = got.get(d, 0) + n
    assert got == sizes and packing.packed(docs.limit(0)).count() == 0


def test_records(spark):
    docs = awkward(spark)
    index = records.write_records(docs)
    from lexigrid.llm.tokenizer import encoder

    want = sorted((r["doc_id"], encoder().encode_ordinary(r["text"])) for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect())
    assert sorted((r["doc_id"], list(r["tokens"])) for r in records.read_records(index.orderBy(F.rand(1))).collect()) == want
    assert index.where("length <> 2 * n_tokens + 8 + 16").count() == 0 and records.write_records(docs.limit(0)).count() == 0


def vector_links(rows, cosine):
    root, n_links, vectors = {}, {}, {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])), key=lambda r: (r[0], r[1])):
        vectors.setdefault(i, np.array(v) / np.linalg.norm(v))

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, x in vectors.items():
        for b, y in vectors.items():
            if a < b and len(x) == len(y) and x @ y >= cosine:
                n_links[a], n_links[b] = n_links.get(a, 0) + 1, n_links.get(b, 0) + 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((i, find(i), n) for i, n in n_links.items())


@pytest.mark.parametrize("most", [10_000, 30])
def test_vector_join(spark, monkeypatch, most):
    monkeypatch.setattr(vector_join, "MOST_CELL", most)  # 30: cells are cut into blocks
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8))
    near = lambda: (base[rng.integers(60)] + rng.standard_normal(8) * rng.choice([0.05, 0.3]))
    rows = [(i, [float(x) for x in near()]) for i in range(400)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(40)]  # equal ones
    rows += [(600, [0.0] * 8), (601, None), (602, [1.0, None] * 4), (None, rows[0][1]), (603, [float("nan")] + [1.0] * 7), (604, []), (605, [1.0, 2.0]), (606, [2.0, 4.0]), (607, [-1.0, 0.5]), (5, rows[9][1]), (6, rows[6][1]), (608, [0.0, -0.0, 1.0]), (609, [-0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit("clash")).withColumn("docs", F.lit(7))
    got = collected(vector_join.links(df, 0.95), "vec_id", "class_id", "n_links")
    assert got == vector_links(rows, 0.95) and len(got) > 250
    assert vector_join.links(df.limit(0)).count() == 0


def test_decontaminate(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([15, 25, 40, 60, 100]))) for i in range(12)]
    rows, want = [], set()
    for i in range(150):
        words = text(rng.choice([10, 100, 400])).split()
        if i % 5 == 0:
            item, t = items[i // 5 % len(items)]
            if i % 2:  # a paraphrase: words left out and put in
                t = " ".join(w if k % 8 else w + " " + rng.choice(vocabulary) for k, w in enumerate(t.split()))
            at = rng.randrange(len(words))
            words[at:at] = t.split()
            want.add((i, item))
        rows.append((i, " ".join(words)))
    docs, bench = make(spark, rows), spark.createDataFrame([*items, (50, None), (51, ""), (None, items[0][1]), (52, "too short")], "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    a = awkward(spark)
    assert decontaminate.leaks(a, bench).count() == 0 and decontaminate.drop_leaks(a, bench).count() == a.count()
    assert decontaminate.leaks(a.limit(0), bench).count() == 0 and decontaminate.leaks(a, bench.limit(0)).count() == 0


def slow_repeats(rows, least):
    words = [(i, tk.words_of(t)) for i, t in rows if i is not None and t is not None]
    where = {}
    for i, w in words:
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for i, w in words:
        covered = sorted({k + j for k in range(len(w) - least + 1) if len(where[tuple(w[k : k + least])]) > 1 for j in range(least)})
        runs = [k for k in covered if k - 1 not in set(covered)]
        for a in runs:
            b = a
            while b in set(covered):
                b += 1
            out.add((i, a, b))
    return sorted(out)


@pytest.mark.parametrize(("least", "seed"), [(50, 20), (12, 4)])
def test_suffix_dedup(spark, least, seed):
    rng = random.Random(9)
    passage = [prose(rng, n) for n in (49, 50, 51, 120)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passage), prose(rng, rng.randrange(5))]
        rows.append((i, " ".join(parts)))
    rows.append((0, rows[0][1]))
    got = sorted(map(tuple, suffix_dedup.repeats(make(spark, rows), least, seed).collect()))
    assert got == slow_repeats(rows, least) and got
    a = awkward(spark)
    assert sorted(map(tuple, suffix_dedup.repeats(a).collect())) == [(3, 0, 80), (4, 0, 80)]
    assert suffix_dedup.repeats(a.limit(0)).count() == 0


def test_site_quality(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        kind = i % 4
        words = prose(rng, 60).split()
        if kind == 1:
            words[5] = words[30] = rng.choice(["vilword", "badword"])
        text = " ".join(words).upper() + "!!" if kind == 2 else " ".join(words)
        rows.append((i, text, "x", f"h{i % 3}", 0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(kind != 2), int(kind == 1)))
    docs, labs = make(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    known = {i for i, *_ in labels}
    kept = {r["doc_id"] for r in site_quality.judge(docs, labs).collect()}
    for kind, low, high in ((0, 0.95, 1), (3, 0.95, 1), (1, 0, 0.05), (2, 0, 0.05)):
        held = [i for i in range(600) if i % 4 == kind and i not in known] or [i for i in range(600) if i % 4 == kind]
        assert low <= sum(i in kept for i in held) / len(held) <= high, kind
    assert kept.isdisjoint({r["doc_id"] for r in site_quality.judge(docs, labs, rejected=True).collect()})
    a = awkward(spark)
    assert site_quality.judge(a, labs.limit(0)).count() == a.where("doc_id IS NOT NULL").count()
    assert site_quality.judge(a.limit(0), labs).count() == 0
    # sparse sites stay near the prior
    few = [(i, "w", "x", "big" if i else "small", 0) for i in range(200)]
    priors = {r["host"]: r["prior"] for r in site_quality.judge(make(spark, few), labs.limit(0), bound=0.0).collect()}
    assert abs(priors["small"] - 0.5) < 0.05


def pages_of(spark):
    rows = [(i, f"http://h{i % 5}.example/{i}", f"<p>{i} é</p>\r\n\r\n" * (i % 50)) for i in range(200)]
    rows += [(200, None, "x"), (201, "http://a.example/é x", None), (None, "u", "h"), (3, rows[3][1], rows[3][2]), (202, "u", "y" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit("clash")).withColumn("offset", F.lit(1))


def test_archive_round_trip(spark):
    rows, pages = pages_of(spark)
    files = archive.write_packages(pages)
    got = sorted(((r["page_id"], r["url"], r["html"]) for r in archive.read_packages(files).collect()), key=repr)
    assert got == sorted(((i, u or "", h) for i, u, h in rows if i is not None), key=repr)
    assert archive.read_packages(archive.write_packages(pages.limit(0))).count() == 0


def test_zip_directories(tmp_path):
    records_ = [(i, f"http://e.example/{i}", archive.make_record(i, f"http://e.example/{i}", "x" * i)) for i in range(9)]
    for zip64 in (False, True):
        data = archive.package(records_, force_zip64=zip64)
        read = lambda o, n, d=data: d[o : o + n]
        ranges = list(archive.record_ranges(read, len(data)))
        got = sorted(int(archive.parse_record(read(o, n))[0]["content-length"]) for _, o, n, _ in ranges)
        assert got == list(range(9))
    # a ZIP64 end record, written by hand: counts and sizes are only there
    at = data.rindex(archive.END)
    import struct

    count, length, offset = struct.unpack_from("<HII", data, at + 10)
    end64 = archive.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, offset)
    tail = archive.LOCATOR64 + struct.pack("<IQI", 0, at, 1) + archive.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 2) + b"hi"
    big = data[:at] + end64 + tail
    assert len(list(archive.record_ranges(lambda o, n: big[o : o + n], len(big)))) == 9
    for bad in (b"", b"no zip" * 20, data[: len(data) // 2]):
        with pytest.raises(ValueError):
            archive.directory(lambda o, n, d=bad: d[o : o + n], len(bad))


def test_damaged_record_is_an_error():
    raw = archive.make_record(1, "u", "text")
    with pytest.raises(ValueError):
        archive.parse_record(b"HTTP/1.1 200\r\n\r\n")
    import gzip

    with pytest.raises(ValueError):
        archive.parse_record(gzip.decompress(raw)[:-8])


def test_line_templates_joined(spark, monkeypatch):
    """Beyond the bound on what is broadcast, the same result by joins."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = [(i, "\n".join([" ".join(rng.choice(vocabulary) for _ in range(9)), "terms of use apply to this page", "" if i % 2 else "more words"])) for i in range(20)]
    docs = make(spark, [*rows, (None, rows[0][1]), (30, None)])
    want = sorted(map(repr, line_templates.strip_lines(docs).collect()))
    monkeypatch.setattr(line_templates, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, line_templates.strip_lines(docs).collect())) == want
    assert sum("n_dropped=1" in r for r in want) == 20


def test_line_templates_of_few_words(spark):
    """Documents that share their words, not their trigrams, are families of their own; near copies of one are one family."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join([prose(20), prose(20), "all of these rights are reserved"])) for i in range(200)]
    base = [prose(12) for _ in range(12)]
    for i in range(60):
        rows.append((300 + i, "\n".join(base[:9] + [prose(12) if j % 3 == i % 3 else base[9 + j] for j in range(3)])))
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_templates.strip_lines(make(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == ((t.rpartition("\n")[0], 1) if i < 300 else (t, 0)), i


def test_line_templates_short(spark):
    """Short lines recur too, in more families; numbers alone only as they are."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, gone = [], ("All rights reserved.", "Posted ", "Home")
    for i in range(90):
        own = [prose(12), prose(12), f"{i} {i * i}", "All rights reserved." if i % 2 else "Home", f"Posted 2024-01-{i:02d}"]
        rows.append((i, "\n".join([*own, "By chance"] if i % 15 == 0 else own)))
    copy = "\n".join(prose(12) for _ in range(4))
    rows += [(200 + k, copy + "\nOf copies") for k in range(50)]
    got = {r["doc_id"]: r["text"] for r in line_templates.strip_lines(make(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == "\n".join(line for line in t.split("\n") if not line.startswith(gone)), i


def test_long_runs(spark):
    texts = [" " * 2_000_000, "a" + "\n" * 30_000 + "b c", "x" * 1_500_000, "no" + " " * 20_000, "-" * 300_000 + " " * 12_000 + "."]
    docs = make(spark, list(enumerate(texts)))
    sizes = {}
    for r in packing.packed(docs).collect():
        for d, n in zip(r["doc_ids"], r["lengths"]):
            sizes[d] = sizes.get(d, 0) + n
    index = records.write_records(docs)
    assert {r["doc_id"]: r["n_tokens"] + 1 for r in index.collect()} == sizes and len(sizes) == len(texts)
    assert records.read_records(index).count() == len(texts)


def test_pieces_of_white_space(monkeypatch):
    import re

    from lexigrid.llm import tokenizer

    monkeypatch.setattr(tokenizer, "LONG_SPACE", re.compile(tokenizer.LONG_SPACE.pattern.replace("10000", "3")))
    rng, e = random.Random(6), tokenizer.encoder()
    encode = tokenizer.ids_of()
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", "7", "!", " ", "  ", "    ", "\n\n\n", "\t", " ", "'s", " é"]) for _ in range(rng.randrange(14)))
        assert encode(text) == e.encode_ordinary(text)


def test_many_languages(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for i in range(150)}
    line = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    docs = make(spark, [(i, line(k, 40), k, "s", 0) for i, k in enumerate(sorted(words) * 4)], extra=False)
    filters = language_id.fit(docs)
    assert len(filters.languages) == 150 and len(filters.words) == 3
    held = make(spark, [(i, line(k, 15), None, "s", 0) for i, k in enumerate(sorted(words))])
    got = {r["doc_id"]: r["language"] for r in language_id.identify(held, filters).collect()}
    assert got == dict(enumerate(sorted(words)))
    # brute force: sets instead of filters; without false positives the filters' shares are the sets'
    profiles = {k: set() for k in words}
    import pyarrow as pa

    grams, rows = language_id.ngrams(pa.array([" ".join(v) for v in words.values()]))
    for k, i in zip(words, range(len(words))):
        profiles[k] = set(grams[rows == i].tolist())
    exact = language_id.Filters({k: np.array(sorted(v), np.int64) for k, v in profiles.items()})
    column = pa.array([line(k, 10) for k in sorted(words)])
    shares, total = exact.shares(column)
    grams, rows = language_id.ngrams(column)
    want = np.array([[sum(g in profiles[k] for g in grams[rows == i].tolist()) / total[i] for k in exact.languages] for i in range(len(column))])
    assert np.abs(shares - want).max() < 0.05 and (shares.argmax(1) == want.argmax(1)).all()


def test_labels_that_disagree(spark):
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(20)], [f"bad{i}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(30)), "x", "s", 0) for i in range(200)]
    docs = make(spark, [*rows, (1, "aaa", "x", "s", 0)], extra=False)
    labels = [(i, i % 2, 0) for i in range(200)]
    first = site_quality.fit(docs, spark.createDataFrame([*labels, (1, 0, 1), (1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int"))
    second = site_quality.fit(docs, spark.createDataFrame([(1, 0, 1), (3, 0, 0), *[x for x in labels if x[0] not in (1, 3)]], "doc_id bigint, quality int, toxic int"))
    assert (first.quality.weights == second.quality.weights).all() and first.rate == second.rate


def foreign_package(path):
    """As other writers make them: HTTP messages, digests in base 32, chunks, coded bodies, records that aren't pages."""
    import base64
    import gzip
    import hashlib
    import json
    import zipfile

    page = "<p>grüße</p>".encode()
    chunked = b"5\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:x}".encode() + b";x=1\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = lambda more, body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + more + b"\r\n" + body
    blocks = [
        ("response", "application/http; msgtype=response", http(b"", page), b32(page)),
        ("response", "application/http;msgtype=response", http(b"Transfer-Encoding: chunked\r\n", chunked), b32(page)),
        ("response", "application/http; msgtype=response", http(b"Transfer-Encoding: chunked\r\n", chunked), b32(chunked)),
        ("response", "application/http", http(b"Content-Encoding: gzip\r\n", gzip.compress(page)), ""),
        ("metadata", "application/warc-fields", b"via: x\r\n", ""),
        ("resource", "text/html", page, "sha256:" + hashlib.sha256(page).hexdigest()),
    ]
    body, lines = b"", []
    for i, (kind, content, block, digest) in enumerate(blocks):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://h.x/{i}\r\nWARC-Block-Digest: {b32(block)}\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + f"Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
        raw = gzip.compress(head.encode() + block + b"\r\n\r\n")
        lines.append(f"x,h)/{i} 2020 " + json.dumps({"url": f"http://h.x/{i}", "filename": "data.warc.gz", "offset": str(len(body)), "length": str(len(raw))}))
        body += raw
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.warc.gz", body)
        z.writestr(zipfile.ZipInfo("indexes/index.cdx.gz"), gzip.compress("\n".join(["!meta {}", *lines]).encode()), zipfile.ZIP_DEFLATED)
    return page.decode()


def test_foreign_packages(spark, tmp_path):
    page = foreign_package(tmp_path / "a.wacz")
    files = spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "file string")
    want = sorted([(f"http://h.x/{i}", "via: x\r\n" if i == 4 else page, None) for i in range(6)])
    assert collected(archive.read_packages(files), "url", "html", "page_id") == want
    assert not archive.agrees("sha1:AAAA", [b"x"]) and archive.agrees("crc32:1", [b"x"])


def test_ranges_read_together():
    gap, most = archive.GAP, archive.MOST_READ
    ranges = [("a", 0, 10), ("a", 10, 5), ("a", 15 + gap, 5), ("a", 21 + 2 * gap, 4), ("b", 0, most - 2), ("b", most - 2, 3)]
    assert list(archive._runs(ranges)) == [("a", 0, 20 + gap, [(0, 10), (10, 5), (15 + gap, 5)]), ("a", 21 + 2 * gap, 25 + 2 * gap, [(21 + 2 * gap, 4)]), ("b", 0, most - 2, [(0, most - 2)]), ("b", most - 2, most + 1, [(most - 2, 3)])]
    assert list(archive._runs([])) == []


def test_without_by_shuffle(spark, monkeypatch):
    from lexigrid.llm import shared

    docs, ids = awkward(spark), spark.createDataFrame([(3,), (5,), (77,), (None,)], "id bigint")
    want = sorted(repr(tuple(r)) for r in shared.without(docs, ids).collect())
    assert len(want) == docs.count() - 2
    monkeypatch.setattr(shared.small, "__defaults__", (0,))
    assert sorted(repr(tuple(r)) for r in shared.without(docs, ids).collect()) == want
