"""Sentences as rows: tokens stay in their sentence, so that what a sentence decides (matches, spacing) moves no token.

A row has its place (``sentence``, and ``first``, the id of its first token) and what its tokens are made of. Blocks are runs of sentences in order;
a block is the unit that pages are looked for in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.predicates import matching_sources, slot_column
from lexigrid.operators.render import NO_SPACE_AFTER, NO_SPACE_BEFORE, marked
from lexigrid.plans.query import CorpusQuery

FIELDS = ("word_case", "word", "lemma", "tags")
#: Sentences of a block where sentences come without blocks.
BLOCK = 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once: a column that a lambda refers to would be made again for each element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def exploded(rows: DataFrame, columns: list, array: Column, place: str, item: str) -> DataFrame:
    """A row an element. The outer form, as for the plain one Spark adds a filter that makes the array a second time."""
    return rows.select(*columns, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())


def _counter(k: int, distances: tuple[tuple[int, int], ...], names: list[str]):
    """Anchors of sentences whose tokens have a bit for each slot that they match: sums over ranges are differences of running totals, so distances cost nothing.

    There are 1,000 to the power of 5 tuples of an anchor at most, so no number overflows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, sentence, first, source = (np.asarray(c) for c in batch.columns[:4])
            sizes = np.asarray(batch.column(4).value_lengths())
            bits, ends = np.asarray(batch.column(4).flatten()), np.cumsum(sizes)
            end = np.repeat(ends, sizes)
            n, nexts = (bits >> (k - 1) & 1).astype(np.int64), []
            for i in range(k - 2, -1, -1):
                at = np.flatnonzero(bits >> i & 1)
                lo, hi = at + distances[i][0], np.minimum(at + distances[i][1] + 1, end[at])
                at, lo, hi = (x[lo < hi] for x in (at, lo, hi))
                total, there = np.concatenate([[0], np.cumsum(n)]), np.flatnonzero(n)
                n = np.zeros_like(n)
                n[at] = total[hi] - total[lo]
                onward = np.full(len(n), -1)
                at, lo = at[n[at] > 0], lo[n[at] > 0]
                onward[at] = there[np.searchsorted(there, lo)]
                nexts.insert(0, onward)
            at = np.flatnonzero(n)
            row = np.searchsorted(ends, at, side="right")
            shift, zs = first[row] - (ends - sizes)[row], [at]
            for onward in nexts:
                zs.append(onward[zs[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (block[row], *[z + shift for z in zs], sentence[row], source[row], n[at])], names=names)

    return count


@dataclass
class Lines:
    """rows: block, sentence, first, source, and the columns that ``words`` and ``attributes`` use.

    ``words`` is an array with an element a token, ``attributes`` gives a field of an element. ``starts``: where blocks have numbers of their own, the
    (block, first sentence, sentences, first id) of each, in order; rows then have ``__s`` and ``__t``, the places within the block."""

    stored: DataFrame
    words: Column
    attributes: Callable[[Column, str], Column]
    starts: list[tuple[int, int, int, int]] | None = None
    extra: tuple[str, ...] = ()

    @classmethod
    def of_tokens(cls, tokens: DataFrame) -> Lines:
        """Of a table with a row a token; ids are dense and in the order of the text."""
        item = F.struct("pos", *FIELDS)
        rows = tokens.groupBy("sentence").agg(F.min("id").alias("first"), F.min("source").alias("source"), F.array_sort(F.collect_list(item)).alias("items"))
        return cls(rows.withColumn("block", F.floor(F.col("sentence") / BLOCK).cast("bigint")), F.col("items"), lambda x, name: x[name], None, ("items",))

    def _placed(self, rows: DataFrame) -> DataFrame:
        if self.starts is None:
            return rows
        # a row a block
        starts = rows.sparkSession.createDataFrame([(b, s, t) for b, s, _, t in self.starts], "__b bigint, __s0 bigint, __t0 bigint")
        out = rows.join(F.broadcast(starts), F.col("block") == F.col("__b"))
        return out.select("block", (F.col("__s0") + F.col("__s")).alias("sentence"), (F.col("__t0") + F.col("__t")).alias("first"), "source", *self.extra)

    @property
    def rows(self) -> DataFrame:
        return self._placed(self.stored)

    def of_blocks(self, blocks: list[int]) -> DataFrame:
        return self._placed(self.stored.where(F.col("block").isin(blocks) if blocks else F.lit(False)))

    def between(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """Rows of ranges of sentences; the conditions reach the scan."""
        near = F.lit(False)
        for lo, hi in ranges:
            if self.starts is None:
                near = near | F.col("sentence").between(lo, hi)
            for b, s, n, _ in self.starts or []:
                if n and s <= hi and lo < s + n:
                    near = near | ((F.col("block") == b) & F.col("__s").between(max(0, lo - s), min(n - 1, hi - s)))
        return self._placed(self.stored.where(near))

    def tokens(self, rows: DataFrame | None = None) -> DataFrame:
        """block, id, sentence, pos, source and the fields of each token."""
        rows = self.rows if rows is None else rows
        out = exploded(rows, ["block", "sentence", "first", "source", *self.extra], self.words, "__p", "__w")
        return out.select("block", (F.col("first") + F.col("__p")).alias("id"), "sentence", F.col("__p").cast("bigint").alias("pos"), "source", *[self.attributes(F.col("__w"), f).alias(f) for f in FIELDS])

    def _ways(self, words: Column, query: CorpusQuery, body: Callable[[list[Column]], Column]) -> Column:
        """body of an array a slot: at each token that matches, the number of ways to go on to the last slot, else null."""
        k = len(query.slots)
        hit = lambda i, w: slot_column(query.slots[i], query.regex, of=lambda name: self.attributes(w, name))

        def before(i: int, later: list[Column]) -> Column:
            if i < 0:
                return body(later)
            if i == k - 1:
                ways = F.transform(words, lambda w: F.when(hit(i, w), F.lit(1).cast("bigint")))
            else:
                a, b = query.distances[i]
                onward = lambda p: F.aggregate(F.slice(later[0], p + (1 + a), F.lit(b - a + 1)), F.lit(None).cast("bigint"), lambda n, x: F.coalesce(n + x, n, x))
                ways = F.when(F.exists(later[0], lambda x: x.isNotNull()), F.transform(words, lambda w, p: F.when(hit(i, w), onward(p))))
            return let(ways, lambda n: before(i - 1, [n, *later]))

        return before(k - 1, [])

    def _of_sources(self, found: DataFrame, sources: DataFrame, query: CorpusQuery) -> DataFrame:
        wanted = matching_sources(sources, query)
        return found if wanted is None else found.join(wanted, "source", "left_semi")

    def anchors(self, sources: DataFrame, query: CorpusQuery, rows: DataFrame | None = None) -> DataFrame:
        """block, z1, z2..zk, sentence, source, n_tuples: for each first token the number of its tuples, and the first of them in lexicographic order.

        Tuples are counted, not made, and nothing leaves its sentence."""
        if query.boundary != "strict":
            raise ValueError("tuples are counted within sentences")
        rows = self.rows if rows is None else rows
        k = len(query.slots)
        hit = lambda i, w: F.when(slot_column(query.slots[i], query.regex, of=lambda name: self.attributes(w, name)), 1 << i).otherwise(0)
        bits = F.transform(self.words, lambda w: reduce(add, [hit(i, w) for i in range(k)]).cast("tinyint"))
        names = ["block", *[f"z{j + 1}" for j in range(k)], "sentence", "source", "n_tuples"]
        found = rows.select("block", "sentence", "first", "source", bits.alias("bits")).mapInArrow(_counter(k, query.distances, names), ", ".join(f"{c} bigint" for c in names))
        return self._of_sources(found, sources, query)

    def tuples(self, sources: DataFrame, query: CorpusQuery) -> DataFrame:
        """sentence, source, z1..zk of every match within a sentence; tokens that don't go on to the last slot are left out at once."""
        k = len(query.slots)
        places = lambda ways: F.filter(F.transform(ways, lambda n, p: F.when(n.isNotNull(), p)), lambda p: p.isNotNull())
        ways = let(self.words, lambda words: self._ways(words, query, lambda ns: F.struct(*[places(n).alias(f"a{j + 1}") for j, n in enumerate(ns)])))
        out = self.rows.select("sentence", "first", "source", ways.alias("__w"))
        held = lambda j: [F.col(f"a{i + 1}") for i in range(j, k)]
        out = out.select("sentence", "first", "source", *[F.col(f"__w.a{j + 1}").alias(f"a{j + 1}") for j in range(1, k)], F.posexplode_outer("__w.a1").alias("__i", "p1")).where("p1 IS NOT NULL")
        for j in range(1, k):
            a, b = query.distances[j - 1]
            last = F.col(f"p{j}")
            near = F.filter(f"a{j + 1}", lambda p: p.between(last + a, last + b))
            out = exploded(out, ["sentence", "first", "source", *[f"p{i + 1}" for i in range(j)], *held(j + 1)], near, "__i", f"p{j + 1}").drop("__i")
        found = out.select("sentence", "source", *[(F.col("first") + F.col(f"p{j + 1}")).alias(f"z{j + 1}") for j in range(k)])
        return self._of_sources(found, sources, query)

    def text(self, shown: Callable[[Column, Column], Column]) -> Column:
        """The sentence: each token as ``shown`` (element, place), with a space before it where one belongs; double quotes open and close in turn."""

        def spaced(words: Column, firsts: Column, quotes: Column) -> Column:
            nth = lambda c, p: F.when(c == '"', F.array_position(quotes, p)).otherwise(0)

            def space(p: Column) -> Column:
                c, above = F.get(firsts, p), F.get(firsts, p - 1)
                before = c.isin(*NO_SPACE_BEFORE) | ((c == '"') & (nth(c, p) % 2 == 0))
                after = F.coalesce(above.isin(*NO_SPACE_AFTER) | (nth(above, p - 1) % 2 == 1), F.lit(False))
                return F.when(before | after, "").otherwise(" ")

            return F.array_join(F.transform(words, lambda w, p: F.concat(space(p), shown(w, p))), "")

        places = lambda firsts: F.filter(F.transform(firsts, lambda c, p: F.when(c == '"', p)), lambda p: p.isNotNull())
        return let(self.words, lambda words: let(F.transform(words, lambda w: F.substring(self.attributes(w, "word_case"), 1, 1)), lambda firsts: let(places(firsts), lambda quotes: spaced(words, firsts, quotes))))

    def _marked(self, w: Column, hit: Column | None = None) -> Column:
        return marked(hit, lambda name: self.attributes(w, name))

    def plain_sentences(self) -> DataFrame:
        return self.rows.select("sentence", self.text(lambda w, p: self.attributes(w, "word_case")).alias("sentence_text"))

    def hit_sentences(self, rows: DataFrame, page: DataFrame) -> DataFrame:
        """z1, sentence, source and the marked text for each row of a page, which has 1,000 rows at most and is broadcast."""
        zs = [c for c in page.columns if c.startswith("z")]
        wanted = page.select(F.col("sentence").alias("__s"), F.col("z1"), F.array(*zs).alias("__zs"))
        own = rows.join(F.broadcast(wanted), F.col("sentence") == F.col("__s"))

        def shown(w: Column, p: Column) -> Column:
            at = F.array_position("__zs", F.col("first") + p)
            return self._marked(w, F.when(at > 0, at - 1))

        return own.select("z1", "sentence", "source", self.text(shown).alias("sentence_text"))

    def context(self, around: int, reach: int) -> DataFrame:
        """Sentences around - reach to around + reach, across sources, without marks of hits."""
        return self.between([(around - reach, around + reach)]).select("sentence", "source", self.text(lambda w, p: self._marked(w)).alias("sentence_text"))
