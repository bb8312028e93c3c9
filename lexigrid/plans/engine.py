"""A corpus that answers requests."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.tokens import PUNCTUATION
from lexigrid.operators import coding, grams, ngrams, paging, render
from lexigrid.operators.dictionary import Star, lexicon, main_of, types_of, united_of, unique_tags
from lexigrid.operators.lines import Lines
from lexigrid.operators.numbering import numbered
from lexigrid.operators.predicates import slot_column
from lexigrid.operators.sequence import tuples
from lexigrid.plans.query import CorpusQuery, Slot
from lexigrid.sources import plain, tables, tagged
from lexigrid.sources.shared import stored

VERSION = "1.0"


#: Searches whose totals by block are kept: the pages of one search come from one scan.
KEPT = 64
#: Ranges of sentences that a page is read by.
RANGES = 32


def sentence_ranges(wanted: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most this many ranges that hold all the numbers, cut at the widest gaps."""
    at = sorted(set(wanted))
    gaps = sorted(range(1, len(at)), key=lambda i: at[i - 1] - at[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if at[i] - at[i - 1] > 1), len(at)]
    return [(at[a], at[b - 1]) for a, b in zip(cuts, cuts[1:]) if b > a]


class LazyStar:
    """The star schema of a corpus; each table is made when it is first asked for."""

    def __init__(self, of: Corpus, sources: DataFrame):
        self.of, self.sources = of, sources

    @cached_property
    def types(self) -> DataFrame:
        return self.of.made_types()

    @cached_property
    def words_case(self) -> DataFrame:
        return lexicon(self.types, "word_case")

    @cached_property
    def words(self) -> DataFrame:
        return lexicon(self.types, "word")

    @cached_property
    def lemmas(self) -> DataFrame:
        return lexicon(self.types, "lemma")

    @cached_property
    def tags(self) -> DataFrame:
        return lexicon(self.types, "tags", "combinations")

    @cached_property
    def tags_uniq(self) -> DataFrame:
        return unique_tags(self.types)

    @cached_property
    def united(self) -> DataFrame:
        return united_of(self.types, self.words_case, self.words, self.lemmas, self.tags)

    @cached_property
    def main(self) -> DataFrame:
        return coding.main_of(self.of.ids)


class Corpus:
    """Sentences and the star schema; what a query doesn't need isn't made.

    A corpus of plain texts keeps its lines, from which tokens are cut where they are read; any other one has a token table."""

    def __init__(self, star: Star | LazyStar | None, tokens: DataFrame | None = None, lines: Lines | None = None):
        self.star, self.given, self.plain = star, tokens, lines
        self.kept: dict[CorpusQuery, list[Row] | DataFrame] = {}

    @classmethod
    def from_documents(cls, docs: DataFrame) -> Corpus:
        """A table of plain texts."""
        out = cls(None, None, plain.lines(docs))
        out.star = LazyStar(out, plain.sources(docs))
        return out

    @classmethod
    def from_tagged(cls, spark: SparkSession, text: str, sentence_map: str, sources: DataFrame) -> Corpus:
        """Tagged text, the map of its sentences to sources, and the table of sources."""
        out = cls(None, stored(tagged.placed(tagged.read_lines(spark, text), tagged.read_map(spark, sentence_map)), "tokens"))
        out.star = LazyStar(out, sources)
        return out

    @classmethod
    def from_tables(cls, star: Star) -> Corpus:
        """A star schema that was read from files or a database."""
        return cls(star)

    @cached_property
    def lines(self) -> Lines:
        if self.plain is not None:
            return self.plain
        found = Lines.of_tokens(self.tokens)
        found.stored = stored(found.stored.repartitionByRange("sentence").sortWithinPartitions("sentence"), "lines")
        return found

    @cached_property
    def tokens(self) -> DataFrame:
        """id, sentence, pos, source, word_case, word, lemma, tags."""
        if self.plain is not None:
            return self.plain.tokens().drop("block")
        if self.given is not None:
            return self.given
        return tables.debug_dump(self.star).join(self.star.main.select("id", "pos"), "id").select("id", "sentence", "pos", "source", "word_case", "word", "lemma", "tags")

    def made_types(self) -> DataFrame:
        return plain.types_of(self.plain) if self.plain is not None else types_of(self.tokens)

    @cached_property
    def ids(self) -> DataFrame:
        """sentence, first, source, ids: the types of each sentence's tokens."""
        if self.plain is not None:
            found = coding.coded(self.plain, self.star.types, plain.attribute)
        else:
            found = coding.of_main(main_of(self.tokens, self.star.types) if isinstance(self.star, LazyStar) else self.star.main)
        return stored(found, "ids")

    def dump(self) -> DataFrame:
        """The facts with their strings."""
        return coding.dump_of(coding.coded(self.plain, self.star.types, plain.attribute, words=True), plain.attribute) if self.plain is not None else tables.debug_dump(self.star)

    def tuples(self, query: CorpusQuery) -> DataFrame:
        if query.boundary == "compat":
            return tuples(plain.slots(self.star.main), self.star.types, self.star.sources, query)
        return self.lines.tuples(self.star.sources, query)

    def anchors(self, query: CorpusQuery) -> DataFrame:
        """A row for each first token that has tuples."""
        if query.boundary == "compat":
            return self._keep(query, lambda: paging.anchors(self.tuples(query)).persist())
        return self.lines.anchors(self.star.sources, query).drop("block")

    def _keep(self, query: CorpusQuery, make):
        key = query.alike()
        found = self.kept.pop(key, None)
        self.kept[key] = found = make() if found is None else found
        while len(self.kept) > KEPT:
            old = self.kept.pop(next(iter(self.kept)))
            if isinstance(old, DataFrame):
                old.unpersist()
        return found

    def totals(self, query: CorpusQuery) -> list[Row]:
        """block, anchors, n (tuples), lo and hi (the least and the largest anchor) of each block with matches, in order: a row a block, from one scan."""

        def make() -> list[Row]:
            found = self.lines.anchors(self.star.sources, query).groupBy("block")
            return sorted(found.agg(F.count("*").alias("anchors"), F.sum("n_tuples").alias("n"), F.min("z1").alias("lo"), F.max("z1").alias("hi")).collect(), key=lambda r: r["block"])

        return self._keep(query, make)

    def _within(self, query: CorpusQuery, blocks: list[int]) -> DataFrame:
        return self.lines.anchors(self.star.sources, query, self.lines.of_blocks(blocks)).drop("block")

    def page(self, query: CorpusQuery) -> DataFrame:
        """The next anchors after the cursor, read from the blocks that have them."""
        if query.boundary == "compat":
            return paging.page(self.anchors(query), query.returned, query.cursor)
        blocks, sure = [], 0
        for r in self.totals(query):
            if r["hi"] > query.cursor and sure < query.returned:
                blocks.append(r["block"])
                sure += r["anchors"] if r["lo"] > query.cursor else 1
        return paging.page(self._within(query, blocks), query.returned, query.cursor)

    def _summary(self, query: CorpusQuery, last: int) -> DataFrame:
        if query.boundary == "compat":
            return paging.summary(self.anchors(query), last)
        totals = self.totals(query)
        at = [r["block"] for r in totals if r["lo"] <= last <= r["hi"]]
        own = paging.summary(self._within(query, at), last).first()["progress"] if at else 0
        progress = own + sum(r["n"] for r in totals if r["hi"] < last) if own else 0
        row = (int(sum(r["n"] for r in totals)), last, int(progress))
        return self.lines.stored.sparkSession.createDataFrame([row], "found_all bigint, last_pos bigint, progress bigint")

    def summary(self, query: CorpusQuery) -> DataFrame:
        last = self.page(query).agg(F.max("z1")).first()[0]
        return self._summary(query, query.cursor if last is None else last)

    def _sentences(self, rows: list[Row], schema) -> DataFrame:
        """z1, sentence, source, sentence_text of a page's rows, 1,000 at most. Ranges of their sentences reach the scan, which leaves out other files."""
        near = self.lines.between(sentence_ranges([r["sentence"] for r in rows]))
        return self.lines.hit_sentences(near, near.sparkSession.createDataFrame(rows, schema))

    def _rows(self, rows: list[Row], schema) -> DataFrame:
        sources = self.star.sources.where(F.col("id").isin(sorted({r["source"] for r in rows})))
        return render.with_sources(self._sentences(rows, schema), F.broadcast(sources))

    def sentences(self, query: CorpusQuery) -> DataFrame:
        """z1, sentence, source, sentence_text of the page."""
        page = self.page(query)
        return self._sentences(page.collect(), page.schema)

    def rows(self, query: CorpusQuery) -> DataFrame:
        """The page's sentences, marked, with their sources."""
        page = self.page(query)
        return self._rows(page.collect(), page.schema)

    def context(self, query: CorpusQuery) -> DataFrame:
        # 19 sentences at most
        return render.with_sources(F.broadcast(self.lines.context(query.extend, query.extend_range)), self.star.sources)

    def _last_sentence(self) -> int:
        if self.lines.starts is not None:
            return max((s + n - 1 for _, s, n, _ in self.lines.starts), default=0)
        return self.lines.rows.agg(F.max("sentence")).first()[0] or 0

    def respond(self, request: str) -> DataFrame:
        """One row, ``response``: the JSON answer to a JSON request. The page (1,000 rows at most) is all that is gathered.

        A sentence to extend that the corpus doesn't have counts as none; ``count_only`` leaves the examples out."""
        query = CorpusQuery.from_json(request)
        if query.extend >= 0 and query.extend > self._last_sentence():
            query = replace(query, extend=-1).normalise()
        if query.extend >= 0:
            items, key, tail = self.context(query), "sentence", "}"
        else:
            page = self.page(query)
            rows, key = page.collect(), "z1"
            found = self._summary(query, max((r["z1"] for r in rows), default=query.cursor)).first()
            tail = f',"last_pos":"{found["last_pos"]}","found_all":{found["found_all"]},"progress":{found["progress"]}}}'
            if query.count_only or not rows:
                return self.star.sources.sparkSession.createDataFrame([('{"example":[{"id":-1}]' + tail,)], "response string")
            items = self._rows(rows, page.schema)
        listed = items.select(F.col(key).alias("k"), F.to_json(render.row_struct()).alias("j")).agg(F.array_sort(F.collect_list(F.struct("k", "j"))).alias("js"))
        return listed.select(F.concat(F.lit('{"example":['), F.concat_ws(",", F.concat(F.col("js.j"), F.array(F.lit('{"id":-1}')))), F.lit("]" + tail)).alias("response"))

    def _unigrams(self, punctuation: bool) -> DataFrame:
        """Types, without those that cut segments if ``punctuation`` is out."""
        return self.star.types if punctuation else self.star.types.where(~F.col("tags").isin(*PUNCTUATION))

    def windows(self, depth: int, punctuation: bool = True) -> DataFrame:
        """The windows of all tokens, in order."""
        # marks of punctuation: some forms
        marks = None if punctuation else [r[0] for r in self.star.types.where(F.col("tags").isin(*PUNCTUATION)).select("id").collect()]
        return grams.in_order(grams.windows(self.ids, depth, marks))

    def level(self, k: int, punctuation: bool = True, slots: tuple[Slot, ...] = (), regex: bool = False, numbers: bool = True) -> DataFrame:
        """level, node, g1..g6, freq of the n-grams of k types (without node if ``numbers`` is off) that match the slots. Windows are as long as these n-grams."""
        if k == 1:
            own = self._unigrams(punctuation)
            found = numbered(own.select("id", "freq"), "node", [F.desc("freq"), F.col("id")]) if numbers else own.select("id", "freq")
            if slots:
                found = found.join(own.where(slot_column(slots[0], regex, anchor=False)).select("id"), "id", "left_semi")
            return found.select(F.lit(1).cast("bigint").alias("level"), *(["node"] if numbers else []), F.col("id").alias("g1"), *[F.lit(None).cast("bigint").alias(g) for g in ngrams.GRAMS[1:]], "freq")
        wanted = None
        if slots:
            size = (self.star.types.agg(F.max("id")).first()[0] or 0) + 1
            wanted = [None if s.empty else grams.bitmap(self.star.types.where(slot_column(s, regex, anchor=False)), size) for s in slots]
        return grams.counted(self.windows(k, punctuation), k, [k], numbers, wanted)

    def ngrams(self, punctuation: bool = True, numbers: bool = True) -> DataFrame:
        """All n-grams of one to six types, numbered by frequency at each level."""
        longer = grams.counted(self.windows(ngrams.LEVELS, punctuation), ngrams.LEVELS, list(range(2, ngrams.LEVELS + 1)), numbers)
        return self.level(1, punctuation, numbers=numbers).unionByName(longer)

    def trie(self) -> DataFrame:
        return grams.trie(self.windows(ngrams.LEVELS), self.level(1))

    def tree_rows(self) -> DataFrame:
        return grams.tree(self.windows(ngrams.LEVELS), self.star.types)

    def leaf_paths(self) -> DataFrame:
        return grams.leaf_paths(self.windows(ngrams.LEVELS), self.star.types)

    def search_ngrams(self, query: CorpusQuery, punctuation: bool = True, compat: bool = False) -> DataFrame:
        """All n-grams whose words match the filled slots before the first gap. Regular expressions match any part of a word.

        ``compat`` leaves out n-grams that pass through the most frequent node of a level above."""
        slots = query.prefix
        if not slots:
            raise ValueError("an n-gram search needs a condition in the first slot")
        out = self.level(len(slots), punctuation, slots, query.regex)
        for j in range(1, len(slots)) if compat else ():
            top = self.level(j, punctuation).where("node = 0").select(*ngrams.GRAMS[:j]).first()
            if top is not None:
                same = F.lit(True)
                for g in ngrams.GRAMS[:j]:
                    same = same & (F.col(g) == top[g])
                out = out.where(~same)
        return out

    def respond_ngrams(self, request: str, punctuation: bool = True) -> DataFrame:
        """The JSON answer; as clients expect, an n-gram's last word comes first."""
        query = CorpusQuery.from_json(request)
        found = stored(self.search_ngrams(query, punctuation), "found")
        shown, k = ngrams.top(found, query.returned), len(query.prefix)
        t = self.star.types
        rows = shown
        for g in ngrams.GRAMS[:k]:
            span = F.concat(F.lit("<span title='("), F.col("lemma"), F.lit(") "), F.col("tags"), F.lit("'>"), F.col("word_case"), F.lit("</span>"))
            rows = rows.join(t.select(F.col("id").alias(f"__{g}"), span.alias(f"w{g}")), F.col(g) == F.col(f"__{g}")).drop(f"__{g}")
        items = rows.select(F.struct((-F.col("freq")).alias("f"), "node").alias("k"), F.to_json(F.struct(F.col("node").alias("id"), "freq", F.array(*[f"w{g}" for g in reversed(ngrams.GRAMS[:k])]).alias("ngram"))).alias("j"))
        listed = items.agg(F.array_sort(F.collect_list(F.struct("k", "j"))).alias("js"))
        total = found.agg(F.count("*").alias("found_all"))
        body = F.concat(F.lit('{"example":['), F.concat_ws(",", F.concat(F.col("js.j"), F.array(F.lit('{"id":-1}')))), F.lit(f'],"last_pos":"{max(query.cursor, 0)}","found_all":'), F.col("found_all").cast("string"), F.lit(',"progress":0}'))
        return listed.crossJoin(F.broadcast(total)).select(body.alias("response"))


_corpora: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder's documents, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        _corpora[key] = Corpus.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _corpora[key]
