import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import decontaminate, packing, records, site_quality, suffix_dedup
from lexigrid.llm import textkernel as tk
from lexigrid.llm.language_id import NGRAM, Filters, ngrams, probes
from lexigrid.llm.line_templates import WILD, Leaf, Lines


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB 1.é\n–", max_size=20)), max_size=6))
def test_words(texts):
    w = tk.Words(pa.array(texts, pa.string()))
    want = [tk.words_of(t) for t in texts]
    assert list(w.counts) == [len(x) for x in want]
    flat = [x for r in want for x in r]
    by_hash = dict(zip(w.hashes.tolist(), flat))
    assert [by_hash[h] for h in w.hashes.tolist()] == flat and len(set(flat)) == len(by_hash)
    for n in (1, 2, 3):
        grams, rows = w.grams(n)
        assert np.bincount(rows, minlength=len(texts)).tolist() == [max(0, len(x) - n + 1) for x in want] if texts else not len(grams)


def test_slices_keep_rows():
    b = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 100, None, "", "y" * 5000, "z"]), "n": pa.array(range(5))})
    parts = list(tk.slices([b, b.slice(0, 0)], most=200))
    assert [r for p in parts for r in p.column("n").to_pylist()] == list(range(5)) and len(parts) > 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab 1\n", max_size=25)), min_size=1, max_size=5))
def test_lines(texts):
    x = Lines(pa.array([t or "" for t in texts]))
    lines = [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]
    assert x.rows.tolist() == [i for i, _ in lines]
    assert [bytes(x.data[a:b]).decode() for a, b in zip(x.starts, x.ends)] == [line for _, line in lines]
    assert x.counts.tolist() == [len(line.split()) for _, line in lines]
    wild = [int(any(c.isdigit() for c in t)) for _, line in lines for t in line.split()]
    assert (x.tokens == WILD).astype(int).tolist() == wild


def test_leaf_is_like_a_search_of_all_templates():
    rng = random.Random(1)
    for n in (5, 8, 12, 20):
        tree, slow = Leaf(n, 0.8), []
        base = [[rng.randrange(6) for _ in range(n)] for _ in range(4)]
        for name in range(120):
            line = np.array([t if rng.random() > 0.15 else rng.randrange(6) for t in rng.choice(base)], np.uint32)
            got = tree.add(name, line)
            common = [int((t == line).sum()) for t, _ in slow]
            best = int(np.argmax(common)) if common else -1
            if best >= 0 and common[best] >= tree.least:
                slow[best] = (np.where(slow[best][0] == line, line, np.uint32(WILD)), slow[best][1])
                assert got == slow[best][1]
            else:
                slow.append((line, name))
                assert got == name


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=6), st.integers(0, 40))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums}
    got = packing.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(got) == max(s for s in sums if s <= room)
    assert all(got.count(k) <= counts[k] for k in got)


def test_pack_keeps_everything():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 300) for _ in range(400)]
    bins = packing.pack(list(range(400)), sizes, 100)
    seen = {}
    for b in bins:
        assert sum(x[2] for x in b) <= 100
        for doc, start, length in b:
            seen.setdefault(doc, []).append((start, length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == size
    assert len(bins) <= -(-sum(sizes) // 100) + 1
    assert packing.pack([], [], 100) == []


def slow_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert slow_crc(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 3, 4, 255, 256, 257, 513, 700, 9])
    data = rng.integers(0, 256, sizes.sum()).astype(np.uint8)
    starts = np.cumsum(sizes) - sizes
    assert records.crc32c(data, starts, sizes).tolist() == [slow_crc(bytes(data[a : a + s])) for a, s in zip(starts, sizes)]


def test_frames():
    payloads = [b"", b"x", bytes(range(256)) * 3]
    data, offsets, _ = records.frame(payloads)
    ends = [*offsets[1:], len(data)]
    parts = [data[a:b] for a, b in zip(offsets, ends)]
    assert [records.parse(p) for p in parts] == payloads
    for at in (0, 9, 20, len(parts[2]) - 1):
        bad = bytearray(parts[2])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.parse(bytes(bad))
    with pytest.raises(ValueError):
        records.parse(b"abc")


def test_suffix_sort():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2, 600).astype(np.uint32)
    starts = np.concatenate([rng.permutation(550)[:n] for n in (1, 2, 7, 130)])
    bounds = np.cumsum([0, 1, 2, 7, 130])
    got = suffix_dedup.Suffixes(words, 50).sort(starts, bounds)
    for a, b in zip(bounds, bounds[1:]):
        assert [tuple(words[s : s + 50]) for s in got[a:b]] == sorted(tuple(words[s : s + 50]) for s in starts[a:b])
        assert sorted(got[a:b]) == sorted(starts[a:b])


def test_language_filters():
    column = pa.array(["The cat sat", None, "", "12 34", "ab"])
    grams, rows = ngrams(column)
    assert np.bincount(rows, minlength=5).tolist() == [13 - NGRAM + 1, 0, 0, 0, 1]
    f = Filters({"x": np.unique(grams[rows == 0]), "y": np.unique(grams[rows == 4])})
    assert (f.masks(grams[rows == 0])[0] & 1).all() and (f.masks(grams[rows == 4])[0] & 2).all()
    shares, total = f.shares(column)
    assert shares[0].argmax() == 0 and shares[4].argmax() == 1 and total[1] == 0
    assert all(((0 <= s) & (s < 1 << 19)).all() for s in probes(grams))


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequences():
    rng = np.random.default_rng(12)
    terms = decontaminate.Terms(np.arange(9, dtype=np.uint32) << np.uint32(20))
    items = [(i, terms.words[rng.integers(0, 9, n)]) for i, n in enumerate([5, 17, 40, 64, 64])]
    segments = decontaminate.Segments(items, terms, np.ones(terms.size, np.float32), rng.standard_normal((terms.size, 3)))
    text = rng.integers(0, 10, 300)  # 9: another word
    which, starts = rng.integers(0, 5, 60), rng.integers(0, 200, 60)
    ends = starts + rng.integers(0, 100, 60)
    bits = ~decontaminate.common(segments.masks(np.arange(5)), which, text, starts, ends)
    for k in range(60):
        for head in (len(items[which[k]][1]), 3):
            want = lcs(terms.known(items[which[k]][1][:head])[1].tolist(), text[starts[k] : ends[k]].tolist())
            assert int(bits[k]) % (1 << head) == int(bits[k]) & ((1 << head) - 1) and bin(int(bits[k]) & ((1 << head) - 1)).count("1") == want


def test_singular_vectors():
    rng = np.random.default_rng(13)
    a = rng.standard_normal((200, 8)) * np.array([9, 8, 7, 6, 5, 4, 3, 2]) @ rng.standard_normal((8, 50))
    omega = np.linalg.qr(rng.standard_normal((50, 8)))[0]
    got = decontaminate.singular_vectors(a.T @ (a @ omega), omega)
    _, values, vectors = np.linalg.svd(a, full_matrices=False)
    want = vectors[2:8].T / values[2:8]  # a quarter of the components is left out
    assert got.shape == want.shape and np.allclose(np.abs((got * values[2:8]).T @ vectors[2:8].T), np.eye(6), atol=5e-3)


def test_terms():
    rng = np.random.default_rng(14)
    words, tokens = rng.integers(0, 1 << 32, 500, dtype=np.uint32), rng.integers(0, 1 << 32, 3000, dtype=np.uint32)
    tokens[::3] = words[rng.integers(0, 500, 1000)]
    terms = decontaminate.Terms(words)
    place = {w: i for i, w in enumerate(terms.words.tolist())}
    assert terms.of(tokens).tolist() == [place.get(t, len(place) + (t >> 17)) for t in tokens.tolist()]
    assert decontaminate.Terms(words[:0]).of(tokens).max() < 1 << decontaminate.TERM_BITS


def test_best_bound():
    rng = np.random.default_rng(15)
    posteriors, good = rng.random(500), rng.random(500) < 0.5
    values = np.r_[0, np.unique(posteriors), 1]
    sums = [(posteriors[good] >= b).mean() + (posteriors[~good] < b).mean() for b in (values[1:] + values[:-1]) / 2]
    got = site_quality.best_bound(posteriors, good)
    own = (posteriors[good] >= got).mean() + (posteriors[~good] < got).mean()
    assert own >= max(sums) - site_quality.NEARLY - 1e-9
    assert all(s < max(sums) - site_quality.NEARLY + 1e-9 for s, b in zip(sums, (values[1:] + values[:-1]) / 2) if b < got - 1e-9)
    apart = site_quality.best_bound(np.r_[np.full(50, 0.1), np.full(50, 0.9)], np.arange(100) >= 50)
    assert apart == pytest.approx(0.5)
    assert site_quality.best_bound(posteriors[:10], good[:10]) == site_quality.BOUND
