"""The engine's queries over the given tables, each with the DuckDB SQL of its result."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.tokens import LEMMA, MARKS, PUNCTUATION, TOKEN
from lexigrid.operators import ngrams
from lexigrid.operators.dictionary import longest
from lexigrid.operators.predicates import matching_sources, slot_column
from lexigrid.operators.segments import without_punctuation
from lexigrid.plans.engine import Corpus, corpus
from lexigrid.plans.query import CorpusQuery, Slot
from lexigrid.sources import tables, tagged
from lexigrid.sources.shared import fresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_marks = " ".join("WHEN s = '{}' THEN '{}'".format(m.replace("'", "''"), t) for m, t in MARKS.items())
BASE = f"""
lines AS (SELECT doc_id, lang, i - 1 AS sidx, regexp_extract_all(l, '{TOKEN}') AS w FROM (
  SELECT doc_id, coalesce(lang, '') AS lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
sents AS (SELECT doc_id, lang, sidx, w, row_number() OVER (ORDER BY doc_id, sidx) - 1 AS sentence FROM lines WHERE len(w) > 0),
raw AS (SELECT doc_id, lang, sentence, unnest(w) AS s, generate_subscripts(w, 1) - 1 AS pos FROM sents),
tokens AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sentence, pos) - 1 AS id, sentence, pos, doc_id AS source, s AS word_case, lower(s) AS word,
  regexp_replace(lower(s), '{LEMMA}', '\\1') AS lemma,
  CASE WHEN regexp_matches(s, '^\\p{{N}}+$') THEN '<num>' WHEN regexp_matches(s, '^\\p{{Lu}}') THEN '<' || lang || '>,<np>' WHEN regexp_matches(s, '^[\\p{{L}}\\p{{N}}]') THEN '<' || lang || '>,<n>' {_marks} ELSE '<sym>' END AS tags FROM raw)"""
TYPES = """
types AS MATERIALIZED (SELECT row_number() OVER (ORDER BY word_case, word, lemma, tags) - 1 AS id, count(*) AS freq, word_case, word, lemma, tags FROM tokens GROUP BY word_case, word, lemma, tags)"""
FACTS = """
facts AS MATERIALIZED (SELECT k.id, t.id AS united, k.sentence, k.source, k.pos FROM tokens k JOIN types t USING (word_case, word, lemma, tags))"""


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def with_(*parts: str) -> str:
    return "WITH " + ",".join((BASE, *parts)) + "\n"


# tokens and lexicons


@add("tok_counts", with_() + "SELECT source, count(*) AS n_tokens, count(DISTINCT word_case) AS n_forms FROM tokens GROUP BY source")
def _(spark, d):
    return corpus(spark, d).tokens.groupBy("source").agg(F.count("*").alias("n_tokens"), F.count_distinct("word_case").alias("n_forms"))


@add("sent_counts", with_() + "SELECT source, count(DISTINCT sentence) AS n_sentences, min(sentence) AS first_sentence FROM tokens GROUP BY source")
def _(spark, d):
    return corpus(spark, d).lines.rows.groupBy("source").agg(F.count("*").alias("n_sentences"), F.min("sentence").alias("first_sentence"))


for _name, _column, _out in (("words_case", "word_case", "word_case"), ("words", "word", "word"), ("lemmas", "lemma", "lemma"), ("tags", "tags", "combinations")):
    add(f"lex_{_name}", with_() + f"SELECT row_number() OVER (ORDER BY {_column}) - 1 AS id, count(*) AS freq, {_column} AS {_out} FROM tokens GROUP BY {_column}")(lambda spark, d, n=_name: getattr(corpus(spark, d).star, n))


@add("lex_tags_uniq", with_() + "SELECT row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS id, count(*) AS freq, tag FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM tokens) WHERE tag NOT LIKE '%*%' GROUP BY tag")
def _(spark, d):
    return corpus(spark, d).star.tags_uniq


@add(
    "united_table",
    with_(TYPES)
    + """, a AS (SELECT word_case AS v, row_number() OVER (ORDER BY word_case) - 1 AS i FROM tokens GROUP BY 1), b AS (SELECT word AS v, row_number() OVER (ORDER BY word) - 1 AS i FROM tokens GROUP BY 1),
c AS (SELECT lemma AS v, row_number() OVER (ORDER BY lemma) - 1 AS i FROM tokens GROUP BY 1), e AS (SELECT tags AS v, row_number() OVER (ORDER BY tags) - 1 AS i FROM tokens GROUP BY 1)
SELECT t.id, t.freq, a.i AS word_case, b.i AS word, c.i AS lemma, e.i AS tags FROM types t JOIN a ON a.v = t.word_case JOIN b ON b.v = t.word JOIN c ON c.v = t.lemma JOIN e ON e.v = t.tags""",
)
def _(spark, d):
    return corpus(spark, d).star.united


@add("main_table", with_(TYPES, FACTS) + "SELECT id, united, sentence, source, pos FROM facts")
def _(spark, d):
    return corpus(spark, d).star.main.select("id", "united", "sentence", "source", "pos")


@add("debug_dump", with_(TYPES, FACTS) + "SELECT f.id, f.united, f.sentence, f.source, t.word_case, t.word, t.lemma, t.tags FROM facts f JOIN types t ON t.id = f.united")
def _(spark, d):
    return corpus(spark, d).dump()


@add("debug_types", with_(TYPES) + "SELECT id, freq, word_case, word, lemma, tags FROM types")
def _(spark, d):
    return tables.types_dump(corpus(spark, d).star)


@add("stream_parse", with_() + "SELECT id, sentence, pos, source, word_case, word, lemma, tags FROM tokens")
def _(spark, d):
    """The corpus written as tagged text with a map of its sentences, and read again."""
    c, folder = corpus(spark, d), fresh(spark, "tagged")
    tables.write_tagged_lines(c.lines, f"{folder}/text", f"{folder}/map")
    return tagged.placed(tagged.read_lines(spark, f"{folder}/text"), tagged.read_map(spark, f"{folder}/map"))


@add("tables_reload", with_(TYPES, FACTS) + "SELECT id, united, sentence, source, pos FROM facts")
def _(spark, d):
    """The star schema in text files, as a database would hold it (without pos), and read again."""
    c, folder = corpus(spark, d), fresh(spark, "star")
    tables.write_tsv(c.star, folder, pos=False)
    return Corpus.from_tables(tables.read_tsv(spark, folder)).star.main.select("id", "united", "sentence", "source", "pos")


@add("source_table", "SELECT doc_id AS id, coalesce(source, '') AS author, 'document ' || doc_id AS title, coalesce(lang, '') AS genre FROM documents WHERE doc_id IS NOT NULL")
def _(spark, d):
    return corpus(spark, d).star.sources.select("id", "author", "title", "genre")


@add("longest_word", with_() + "SELECT length(word_case) AS length, word_case FROM tokens ORDER BY 1 DESC, 2 LIMIT 1")
def _(spark, d):
    return longest(corpus(spark, d).tokens)


_punct = ", ".join(f"'{p}'" for p in PUNCTUATION)
SEGMENTS = f"""
marked AS (SELECT *, sum(CASE WHEN tags IN ({_punct}) THEN 1 ELSE 0 END) OVER (PARTITION BY sentence ORDER BY pos) AS segment FROM tokens),
segs AS (SELECT * FROM marked WHERE tags NOT IN ({_punct}))"""


@add("segments_wopunct", with_(SEGMENTS) + "SELECT id, sentence, CAST(segment AS BIGINT) AS segment, word FROM segs")
def _(spark, d):
    return without_punctuation(corpus(spark, d).tokens).select("id", "sentence", "segment", "word")


# conditions on types

SLOTS = {
    "m_word": (Slot(word="the"), False, "word = 'the'"),
    "m_word_case": (Slot(word="The", case=True), False, "word_case = 'The'"),
    "m_lemma": (Slot(lemma="ered"), False, "lemma = 'ered'"),
    "m_tags_and": (Slot(tags="<np>,<en>"), False, "tags LIKE '%<en>%<np>%'"),
    "m_tags_order": (Slot(tags="<n,<fr"), False, "tags LIKE '%<fr%<n%'"),
    "m_glob_prefix": (Slot(wildmatch="th*"), False, "word LIKE 'th%'"),
    "m_glob_suffix": (Slot(wildmatch="*tion"), False, "word LIKE '%tion'"),
    "m_glob_infix": (Slot(wildmatch="*ent*er*"), False, "word LIKE '%ent%er%'"),
    "m_glob_qmark": (Slot(wildmatch="?h?", case=True), False, "word_case LIKE '_h_'"),
    "m_glob_lemma": (Slot(wildmatch_lemma="an*?t"), False, "lemma LIKE 'an%_t'"),
    "m_regex_anchored": (Slot(wildmatch="th[aeiou]+n?"), True, "regexp_matches(word, '^th[aeiou]+n?$')"),
    "m_regex_alt": (Slot(wildmatch="the|ion"), True, "regexp_matches(word, '^the|ion$')"),
    "m_regex_lemma": (Slot(wildmatch_lemma="[[:alpha:]]{2}"), True, "regexp_matches(lemma, '^\\p{L}{2}$')"),
    "m_conj": (Slot(wildmatch="t*", wildmatch_lemma="*e", tags="<en>,<n>"), False, "word LIKE 't%' AND lemma LIKE '%e' AND tags LIKE '%<en>%<n>%'"),
}
for _name, (_slot, _regex, _sql) in SLOTS.items():
    add(_name, with_(TYPES) + f"SELECT id, freq, word_case, lemma, tags FROM types WHERE {_sql}")(
        lambda spark, d, s=_slot, r=_regex: corpus(spark, d).star.types.where(slot_column(s, r)).select("id", "freq", "word_case", "lemma", "tags")
    )


@add("m_regex_search", with_(TYPES) + "SELECT id, freq, word_case FROM types WHERE regexp_matches(word, 'h[ae]n')")
def _(spark, d):
    return corpus(spark, d).star.types.where(slot_column(Slot(wildmatch="h[ae]n"), True, anchor=False)).select("id", "freq", "word_case")


# sources

Q = CorpusQuery.of


@add("src_glob", "SELECT doc_id AS source FROM documents WHERE source LIKE 'src1%'")
def _(spark, d):
    return matching_sources(corpus(spark, d).star.sources, Q(Slot(word="the"), source="src1*"))


@add("src_regex_ci", "SELECT doc_id AS source FROM documents WHERE regexp_matches(source, '(?i)^SRC[3-5]$')")
def _(spark, d):
    return matching_sources(corpus(spark, d).star.sources, Q(Slot(word="the"), source="SRC[3-5]", regex=True))


@add("src_field", "SELECT doc_id AS source FROM documents WHERE lang LIKE 'e%'")
def _(spark, d):
    return matching_sources(corpus(spark, d).star.sources, Q(Slot(word="the"), source="e*", source_field="genre"))


# sequences


def sequence_sql(conditions: list[str], distances: list[tuple[int, int]], source: str = "TRUE", select: str | None = None) -> str:
    k = len(conditions)
    hits = ", ".join(f"h{i} AS MATERIALIZED (SELECT id, sentence, pos, source FROM tokens WHERE {c})" for i, c in enumerate(conditions, 1))
    joins = " ".join(f"JOIN h{i + 1} ON h{i + 1}.sentence = h{i}.sentence AND h{i + 1}.pos BETWEEN h{i}.pos + {a} AND h{i}.pos + {b}" for i, (a, b) in enumerate(distances, 1))
    zs = ", ".join(f"h{i}.id AS z{i}" for i in range(1, k + 1))
    found = f"found AS MATERIALIZED (SELECT h1.sentence, h1.source, {zs} FROM h1 {joins} WHERE h1.source IN (SELECT doc_id FROM documents WHERE {source}))"
    return with_(hits, found) + (select or "SELECT * FROM found")


SEQUENCES = {
    "seq1_source": ((Slot(wildmatch="th*"),), [], ["word LIKE 'th%'"], dict(source="src1*"), "source LIKE 'src1%'"),
    "seq2_adjacent": ((Slot(word="of"), Slot(word="the")), [(1, 1)], ["word = 'of'", "word = 'the'"], {}, "TRUE"),
    "seq2_range": ((Slot(word="The", case=True), Slot(lemma="and")), [(1, 3)], ["word_case = 'The'", "lemma = 'and'"], {}, "TRUE"),
    "seq3_range": ((Slot(wildmatch="th*"), Slot(wildmatch="*n"), Slot(wildmatch="e?*")), [(1, 10), (1, 10)], ["word LIKE 'th%'", "word LIKE '%n'", "word LIKE 'e_%'"], {}, "TRUE"),
    "seq3_heavy": ((Slot(wildmatch="b*"), Slot(wildmatch="*n", tags="<n>"), Slot(lemma="the")), [(1, 10), (1, 10)], ["word LIKE 'b%'", "word LIKE '%n' AND tags LIKE '%<n>%'", "lemma = 'the'"], {}, "TRUE"),
    "seq6": (tuple(Slot(wildmatch=g) for g in ("*erst", "*tion", "*ly", "*ing", "*ble", "*hat")), [(1, 30)] * 5, [f"word LIKE '%{g}'" for g in ("erst", "tion", "ly", "ing", "ble", "hat")], {}, "TRUE"),
    "seq4": (tuple(Slot(wildmatch=g) for g in ("th*", "*n", "e*", "*s")), [(1, 3), (1, 3), (1, 3)], ["word LIKE 'th%'", "word LIKE '%n'", "word LIKE 'e%'", "word LIKE '%s'"], {}, "TRUE"),
    "seq5": ((Slot(tags="<np>"), *[Slot(wildmatch=g) for g in ("th*", "*n", "e*", "*s")]), [(1, 2), (1, 3), (1, 3), (1, 3)], ["tags LIKE '%<np>%'", "word LIKE 'th%'", "word LIKE '%n'", "word LIKE 'e%'", "word LIKE '%s'"], {}, "TRUE"),
    "seq_gap_any": ((Slot(word="in"), Slot(), Slot(tags="<np>")), [(1, 1), (1, 2)], ["word = 'in'", "TRUE", "tags LIKE '%<np>%'"], {}, "TRUE"),
    "seq_source_regex": ((Slot(word="and"), Slot(wildmatch="[aeiou].*")), [(2, 5)], ["word = 'and'", "regexp_matches(word, '^[aeiou].*$')"], dict(source="SRC1.*", regex=True), "regexp_matches(source, '(?i)^src1.*$')"),
}
for _name, (_slots, _distances, _conditions, _more, _source) in SEQUENCES.items():
    add(_name, sequence_sql(_conditions, _distances, _source))(lambda spark, d, s=_slots, g=_distances, m=_more: corpus(spark, d).tuples(Q(*s, distances=g, **m)))


@add("seq2_lead", SQL["seq2_adjacent"])
def _(spark, d):
    return corpus(spark, d).tuples(Q(Slot(word="of"), Slot(word="the")))


@add(
    "seq_cross_compat",
    with_(
        """places AS (SELECT *, id + sentence + 1 + dense_rank() OVER (ORDER BY source) AS slot FROM tokens)""",
        """placed AS (SELECT *, min(slot) OVER (PARTITION BY sentence) AS sent_slot FROM places)""",
    )
    + "SELECT a.sentence, a.source, a.id AS z1, b.id AS z2 FROM placed a JOIN placed b ON b.slot BETWEEN a.slot + 2 AND a.slot + 6 AND b.sent_slot <= a.slot + 2 WHERE a.tags = '<sent>' AND b.word = 'the'",
)
def _(spark, d):
    return corpus(spark, d).tuples(Q(Slot(tags="<sent>"), Slot(word="the"), distances=[(2, 6)], boundary="compat"))


# pages

HEAVY = (SEQUENCES["seq3_range"][0], SEQUENCES["seq3_range"][1], SEQUENCES["seq3_range"][2])
ANCHORS = "a AS (SELECT z1, min(struct_pack(z2 := z2, z3 := z3)) AS f, min(sentence) AS sentence, min(source) AS source, count(*) AS n_tuples FROM found GROUP BY z1)"
PAGE_SQL = "SELECT z1, f.z2 AS z2, f.z3 AS z3, sentence, source, n_tuples FROM a WHERE z1 > {} ORDER BY z1 LIMIT {}"


def page_sql(select: str) -> str:
    return sequence_sql(HEAVY[2], HEAVY[1], select="").rstrip() + ",\n" + ANCHORS + "\n" + select


def heavy(**more) -> CorpusQuery:
    return Q(*HEAVY[0], distances=HEAVY[1], **more)


SQL_FOUND = sequence_sql(HEAVY[2], HEAVY[1], select="SELECT count(*) AS found_all FROM found")


@add("hits_total", SQL_FOUND)
def _(spark, d):
    return corpus(spark, d).anchors(heavy()).agg(F.coalesce(F.sum("n_tuples"), F.lit(0)).alias("found_all"))


def _page_query(cursor: int, limit: int) -> str:
    return sequence_sql(HEAVY[2], HEAVY[1], select=f"SELECT z1, f.z2 AS z2, f.z3 AS z3, sentence, source, n_tuples FROM (SELECT z1, min(struct_pack(z2 := z2, z3 := z3)) AS f, min(sentence) AS sentence, min(source) AS source, count(*) AS n_tuples FROM found GROUP BY z1) WHERE z1 > {cursor} ORDER BY z1 LIMIT {limit}")


@add("page_first", _page_query(-1, 100))
def _(spark, d):
    return corpus(spark, d).page(heavy())


@add("page_next", _page_query(5000, 50))
def _(spark, d):
    return corpus(spark, d).page(heavy(returned=50, cursor=5000))


@add(
    "page_progress",
    sequence_sql(HEAVY[2], HEAVY[1], select="""SELECT (SELECT count(*) FROM found) AS found_all, l AS last_pos, (SELECT count(*) FROM found WHERE z1 <= l) AS progress
FROM (SELECT max(z1) AS l FROM (SELECT DISTINCT z1 FROM found WHERE z1 > 5000 ORDER BY z1 LIMIT 50))"""),
)
def _(spark, d):
    return corpus(spark, d).summary(heavy(returned=50, cursor=5000))


WIDEST = [f"*{c}" for c in "eansto"]


def counted_parts(conditions: list[str], distances: list[tuple[int, int]]) -> list[str]:
    """Anchors with the number of their tuples and the first one, slot by slot from the last."""
    k = len(conditions)
    parts = [f"c{k} AS MATERIALIZED (SELECT id, sentence, pos, source, CAST(1 AS HUGEINT) AS n, NULL AS t FROM tokens WHERE {conditions[-1]})"]
    for i in range(k - 1, 0, -1):
        a, b = distances[i - 1]
        t = f"min(struct_pack(z{i + 1} := y.id" + (", t := y.t))" if i < k - 1 else "))")
        parts.append(f"c{i} AS MATERIALIZED (SELECT x.id, any_value(x.sentence) AS sentence, any_value(x.pos) AS pos, any_value(x.source) AS source, sum(y.n) AS n, {t} AS t FROM tokens x JOIN c{i + 1} y ON y.sentence = x.sentence AND y.pos BETWEEN x.pos + {a} AND x.pos + {b} WHERE {conditions[i - 1]} GROUP BY x.id)")
    return parts


def counted_sql(conditions: list[str], distances: list[tuple[int, int]]) -> str:
    zs = ", ".join("t" + ".t" * (i - 2) + f".z{i} AS z{i}" for i in range(2, len(conditions) + 1))
    return with_(*counted_parts(conditions, distances)) + f"SELECT id AS z1, {zs}, sentence, source, CAST(n AS BIGINT) AS n_tuples FROM c1"


@add("seq6_widest", counted_sql([f"word LIKE '%{g[1]}'" for g in WIDEST], [(1, 100)] * 5))
def _(spark, d):
    return corpus(spark, d).anchors(Q(*[Slot(wildmatch=g) for g in WIDEST], distances=[(1, 100)] * 5))


# rendering

SPACED = """
q AS (SELECT *, substr(word_case, 1, 1) AS c, sum(CASE WHEN substr(word_case, 1, 1) = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY sentence ORDER BY pos) AS n FROM tokens),
o AS (SELECT *, c IN ('(', '[', '{', '«', '`') OR (c = '"' AND n % 2 = 1) AS nsa, c IN ('.', '!', '?', ',', ':', ';', ')', ']', '}', '%', '»', '`') OR (c = '"' AND n % 2 = 0) AS nsb FROM q),
spaced AS (SELECT *, CASE WHEN nsb OR coalesce(lag(nsa) OVER (PARTITION BY sentence ORDER BY pos), FALSE) THEN '' ELSE ' ' END AS space FROM o)"""
PLAIN = "'<span class=''regular_word'' title=''(' || lemma || ') ' || tags || '''>' || word_case || '</span><!-- regular_word -->'"


@add("render_plain", with_(SPACED) + "SELECT sentence, string_agg(space || word_case, '' ORDER BY pos) AS sentence_text FROM spaced GROUP BY sentence")
def _(spark, d):
    return corpus(spark, d).lines.plain_sentences()


@add(
    "render_markup",
    with_(
        "h1 AS (SELECT id, sentence, pos, source FROM tokens WHERE word = 'of')", "h2 AS (SELECT id, sentence, pos FROM tokens WHERE word = 'the')",
        "p AS (SELECT h1.id AS z1, min(h2.id) AS z2, min(h1.sentence) AS sentence, min(h1.source) AS source FROM h1 JOIN h2 ON h2.sentence = h1.sentence AND h2.pos = h1.pos + 1 GROUP BY h1.id ORDER BY 1 LIMIT 100)",
        SPACED,
    )
    + f"""SELECT p.z1, p.sentence, p.source, string_agg(space || CASE WHEN s.id IN (p.z1, p.z2) THEN '<span class=''found_word'' id=''found_word_' || CASE WHEN s.id = p.z1 THEN '0' ELSE '1' END || ''' title=''(' || lemma || ') ' || tags || '''>' || word_case || '</span><!-- found_word_' || CASE WHEN s.id = p.z1 THEN '0' ELSE '1' END || ' -->'
ELSE {PLAIN} END, '' ORDER BY s.pos) AS sentence_text FROM p JOIN spaced s ON s.sentence = p.sentence GROUP BY p.z1, p.sentence, p.source""",
)
def _(spark, d):
    c = corpus(spark, d)
    return c.sentences(Q(Slot(word="of"), Slot(word="the")))


@add("context", with_(SPACED) + f"SELECT s.sentence, s.source, string_agg(space || {PLAIN}, '' ORDER BY pos) AS sentence_text, min(coalesce(d.source, '')) AS author FROM spaced s JOIN documents d ON d.doc_id = s.source WHERE sentence BETWEEN 120 AND 124 GROUP BY s.sentence, s.source")
def _(spark, d):
    return corpus(spark, d).context(CorpusQuery(extend=122, extend_range=2).normalise()).select("sentence", "source", "sentence_text", F.col("s_author").alias("author"))


HITS_SQL = (
    "h1 AS MATERIALIZED (SELECT id, sentence, pos, source FROM tokens WHERE word = 'of')", "h2 AS MATERIALIZED (SELECT id, sentence, pos FROM tokens WHERE word = 'the')",
    "found AS MATERIALIZED (SELECT h1.id AS z1, h2.id AS z2, h1.sentence, h1.source FROM h1 JOIN h2 ON h2.sentence = h1.sentence AND h2.pos = h1.pos + 1)",
    "p AS MATERIALIZED (SELECT * FROM found ORDER BY z1 LIMIT 20)",
)
_number = "CASE WHEN s.id = p.z1 THEN '0' ELSE '1' END"
MARKED = f"CASE WHEN s.id IN (p.z1, p.z2) THEN '<span class=''found_word'' id=''found_word_' || {_number} || ''' title=''(' || lemma || ') ' || tags || '''>' || word_case || '</span><!-- found_word_' || {_number} || ' -->' ELSE {PLAIN} END"
SOURCE_JSON = "to_json(struct_pack(id := sentence, nice := '', author := coalesce(d.source, ''), title_id := r.source, title := 'document ' || r.source, date := '', type := 'document', genre := coalesce(d.lang, ''), source := '', url := '', meta := '', \"full\" := '', sentence := sentence_text))"
TOTALS = """'],"last_pos":"' || (SELECT max(z1) FROM p) || '","found_all":' || (SELECT count(*) FROM found) || ',"progress":' || (SELECT count(*) FROM found WHERE z1 <= (SELECT max(z1) FROM p)) || '}'"""


@add(
    "response_json",
    with_(*HITS_SQL, SPACED)
    + f""", r AS (SELECT p.z1, p.sentence, p.source, string_agg(space || {MARKED}, '' ORDER BY s.pos) AS sentence_text FROM p JOIN spaced s ON s.sentence = p.sentence GROUP BY p.z1, p.sentence, p.source)
SELECT '{{"example":[' || (SELECT string_agg(j, ',' ORDER BY z1) FROM (SELECT z1, {SOURCE_JSON}::VARCHAR AS j FROM r JOIN documents d ON d.doc_id = r.source)) || ',{{"id":-1}}' || {TOTALS} AS response""",
)
def _(spark, d):
    return corpus(spark, d).respond('{"word":["of","the"],"dist_from":[1],"dist_to":[1],"return":20}')


@add("response_count", with_(*HITS_SQL) + """SELECT '{"example":[{"id":-1}' || """ + TOTALS + " AS response")
def _(spark, d):
    return corpus(spark, d).respond('{"word":["of","the"],"return":20,"count_only":1}')


@add(
    "response_context",
    with_(SPACED)
    + f""", r AS (SELECT s.sentence, s.source, string_agg(space || {PLAIN}, '' ORDER BY pos) AS sentence_text FROM spaced s WHERE sentence BETWEEN 120 AND 124 GROUP BY s.sentence, s.source)
SELECT '{{"example":[' || (SELECT string_agg(j, ',' ORDER BY sentence) FROM (SELECT sentence, {SOURCE_JSON}::VARCHAR AS j FROM r JOIN documents d ON d.doc_id = r.source)) || ',{{"id":-1}}]}}' AS response""",
)
def _(spark, d):
    return corpus(spark, d).respond('{"extend":122,"extend_range":2}')


# whole answers: page, totals and marked sentences with their sources


def answer_sql(conditions: list[str], distances: list[tuple[int, int]], returned: int = 100) -> str:
    k = len(conditions)
    zs = ", ".join(["id", *("t" + ".t" * (i - 2) + f".z{i}" for i in range(2, k + 1))])
    number = "CAST(list_position(p.zs, s.id) - 1 AS VARCHAR)"
    shown = f"CASE WHEN list_contains(p.zs, s.id) THEN '<span class=''found_word'' id=''found_word_' || {number} || ''' title=''(' || lemma || ') ' || tags || '''>' || word_case || '</span><!-- found_word_' || {number} || ' -->' ELSE {PLAIN} END"
    page = f"p AS MATERIALIZED (SELECT id AS z1, [{zs}] AS zs, sentence, source FROM c1 ORDER BY id LIMIT {returned})"
    last = "(SELECT max(z1) FROM p)"
    return with_(*counted_parts(conditions, distances), page, SPACED) + f""", r AS (SELECT p.z1, p.sentence, p.source, string_agg(space || {shown}, '' ORDER BY s.pos) AS sentence_text FROM p JOIN spaced s ON s.sentence = p.sentence GROUP BY p.z1, p.sentence, p.source)
SELECT '{{"example":[' || (SELECT string_agg(j, ',' ORDER BY z1) FROM (SELECT z1, {SOURCE_JSON}::VARCHAR AS j FROM r JOIN documents d ON d.doc_id = r.source)) || ',{{"id":-1}}],"last_pos":"' || {last} || '","found_all":' || (SELECT CAST(sum(n) AS BIGINT) FROM c1)
|| ',"progress":' || (SELECT CAST(sum(n) AS BIGINT) FROM c1 WHERE id <= {last}) || '}}' AS response"""


ANSWERS = {
    "answer_1": ({"word": ["the"]}, ["word = 'the'"], []),
    "answer_2": ({"word": ["The"], "case": [1], "lemma": ["", "and"], "dist_from": [1], "dist_to": [3]}, ["word_case = 'The'", "lemma = 'and'"], [(1, 3)]),
    "answer_3": ({"wildmatch": ["b*", "*n"], "tags": ["", "<n>"], "lemma": ["", "", "the"], "dist_from": [1, 1], "dist_to": [10, 10]}, ["word LIKE 'b%'", "word LIKE '%n' AND tags LIKE '%<n>%'", "lemma = 'the'"], [(1, 10)] * 2),
    "answer_6": ({"wildmatch": WIDEST, "dist_from": [1] * 5, "dist_to": [100] * 5}, [f"word LIKE '%{g[1]}'" for g in WIDEST], [(1, 100)] * 5),
}
for _name, (_request, _conditions, _distances) in ANSWERS.items():
    add(_name, answer_sql(_conditions, _distances))(lambda spark, d, r=_request: corpus(spark, d).respond(json.dumps(r)))


# n-grams


def gram_sql(k: int, table: str = "facts", keys: str = "sentence") -> str:
    leads = ", ".join(f"lead(united, {i}) OVER (PARTITION BY {keys} ORDER BY pos) AS g{i + 1}" for i in range(1, 6))
    ahead = f"ahead AS MATERIALIZED (SELECT united AS g1, {leads} FROM {table})"
    levels = " UNION ALL ".join(f"SELECT {j} AS level, {', '.join(f'g{i}' if i <= j else f'NULL::BIGINT AS g{i}' for i in range(1, 7))}, count(*) AS freq FROM ahead WHERE g{j} IS NOT NULL GROUP BY {', '.join(f'g{i}' for i in range(1, j + 1))}" for j in range(1, k + 1))
    return ahead + f", grams AS MATERIALIZED ({levels}), nodes AS MATERIALIZED (SELECT CAST(level AS BIGINT) AS level, g1, g2, g3, g4, g5, g6, freq, row_number() OVER (PARTITION BY level ORDER BY freq DESC, g1, g2, g3, g4, g5, g6) - 1 AS node FROM grams)"


GRAMS_SQL = with_(TYPES, FACTS, gram_sql(6))
NO_PUNCT = with_(TYPES, SEGMENTS, "facts AS MATERIALIZED (SELECT k.id, t.id AS united, k.sentence, k.segment, k.pos FROM segs k JOIN types t USING (word_case, word, lemma, tags))", gram_sql(6, keys="sentence, segment"))


for _k in range(1, 7):
    add(f"ng_counts_{_k}", GRAMS_SQL + f"SELECT {', '.join(f'g{i}' for i in range(1, _k + 1))}, freq FROM grams WHERE level = {_k}")(
        lambda spark, d, k=_k: corpus(spark, d).level(k, numbers=False).select(*ngrams.GRAMS[:k], "freq")
    )


@add("ng_rank", GRAMS_SQL + "SELECT level, node, g1, g2, g3, g4, g5, g6, freq FROM nodes")
def _(spark, d):
    return corpus(spark, d).ngrams().select("level", "node", *ngrams.GRAMS, "freq")


def linked_sql(table: str, number: str, above: str, columns: str) -> str:
    """Each n-gram with the number of the one that it continues."""
    parts = [f"SELECT {columns.format(k=1, above=above)} FROM {table} n WHERE n.level = 1"]
    for k in range(2, 7):
        same = " AND ".join(f"p.g{i} = n.g{i}" for i in range(1, k))
        parts.append(f"SELECT {columns.format(k=k, above=f'p.{number}')} FROM {table} n JOIN {table} p ON p.level = {k - 1} AND {same} WHERE n.level = {k}")
    return " UNION ALL ".join(parts)


@add("ng_trie", GRAMS_SQL + linked_sql("nodes", "node", "CAST(NULL AS BIGINT)", "n.level, n.node, {above} AS parentnode, n.g{k} AS united, n.freq"))
def _(spark, d):
    return corpus(spark, d).trie()


TREE = f", tree AS MATERIALIZED (SELECT level, {', '.join(ngrams.GRAMS)}, freq, row_number() OVER (ORDER BY {', '.join(f'{g} NULLS FIRST' for g in ngrams.GRAMS)}) AS num FROM grams) "


@add("ng_tree", GRAMS_SQL + TREE + linked_sql("tree", "num", "CAST(0 AS BIGINT)", "n.num AS node, {above} AS parent, n.g{k} AS word, n.freq AS amount"))
def _(spark, d):
    return corpus(spark, d).tree_rows()


@add("ng_wopunct", NO_PUNCT + "SELECT level, node, g1, g2, g3, g4, g5, g6, freq FROM nodes")
def _(spark, d):
    return corpus(spark, d).ngrams(False).select("level", "node", *ngrams.GRAMS, "freq")


def search_sql(conditions: list[str], base: str = GRAMS_SQL, more: str = "") -> str:
    k = len(conditions)
    tests = " ".join(f"AND g{i} IN (SELECT id FROM types WHERE {c})" for i, c in enumerate(conditions, 1))
    return base + f"SELECT level, node, {', '.join(f'g{i}' for i in range(1, k + 1))}, freq FROM nodes WHERE level = {k} {tests} {more}"


def _found(spark, d, query, **kw):
    k = len(query.prefix)
    return corpus(spark, d).search_ngrams(query, **kw).select("level", "node", *ngrams.GRAMS[:k], "freq")


@add("ng_search_2", search_sql(["word = 'of'", "tags LIKE '%<n>%'"]))
def _(spark, d):
    return _found(spark, d, Q(Slot(word="of"), Slot(tags="<n>")))


@add("ng_search_3", search_sql(["word LIKE 'th%'", "lemma = 'of'", "word LIKE '%e'"]))
def _(spark, d):
    return _found(spark, d, Q(Slot(wildmatch="th*"), Slot(lemma="of"), Slot(wildmatch="*e")))


@add("ng_search_regex", search_sql(["regexp_matches(word, 'tio')", "regexp_matches(word, '^o.$')"]))
def _(spark, d):
    return _found(spark, d, Q(Slot(wildmatch="tio"), Slot(wildmatch="^o.$"), regex=True))


@add("ng_prefix_gap", search_sql(["word = 'of'"]))
def _(spark, d):
    return _found(spark, d, Q(Slot(word="of"), Slot(), Slot(word="the")))


@add("ng_search_wopunct", search_sql(["word = 'of'", "word = 'the'"], NO_PUNCT))
def _(spark, d):
    return _found(spark, d, Q(Slot(word="of"), Slot(word="the")), punctuation=False)


@add("ng_topk", search_sql(["word LIKE 't%'", "TRUE"]).replace("AND g2 IN (SELECT id FROM types WHERE TRUE)", "AND g2 IN (SELECT id FROM types WHERE word LIKE '%n')") + " ORDER BY freq DESC, node LIMIT 100")
def _(spark, d):
    return ngrams.top(_found(spark, d, Q(Slot(wildmatch="t*"), Slot(wildmatch="*n"))), 100)


@add("ng_hits", GRAMS_SQL + "SELECT count(*) AS found_all FROM nodes WHERE level = 2 AND g1 IN (SELECT id FROM types WHERE word LIKE 'a%') AND g2 IN (SELECT id FROM types WHERE word LIKE '%e')")
def _(spark, d):
    return corpus(spark, d).search_ngrams(Q(Slot(wildmatch="a*"), Slot(wildmatch="*e"))).agg(F.count("*").alias("found_all"))


@add("ng_parent0_compat", search_sql(["word LIKE 't%'", "word LIKE '%e'"], more="AND g1 <> (SELECT g1 FROM nodes WHERE level = 1 AND node = 0)"))
def _(spark, d):
    return _found(spark, d, Q(Slot(wildmatch="t*"), Slot(wildmatch="*e")), compat=True)


@add("ng_words", GRAMS_SQL + "SELECT n.node, n.freq, [a.word_case, b.word_case] AS ngram FROM nodes n JOIN types a ON a.id = n.g1 JOIN types b ON b.id = n.g2 WHERE level = 2 AND a.word = 'of'")
def _(spark, d):
    c = corpus(spark, d)
    return ngrams.with_words(c.level(2, slots=(Slot(word="of"), Slot())), c.star.types, 2)


@add(
    "ng_response_json",
    GRAMS_SQL
    + """, found AS MATERIALIZED (SELECT node, freq, g1, g2 FROM nodes WHERE level = 2 AND g1 IN (SELECT id FROM types WHERE word = 'of') AND g2 IN (SELECT id FROM types WHERE word = 'the')),
shown AS (SELECT * FROM found ORDER BY freq DESC, node LIMIT 10), spans AS (SELECT id, '<span title=''(' || lemma || ') ' || tags || '''>' || word_case || '</span>' AS w FROM types)
SELECT '{"example":[' || (SELECT string_agg(to_json(struct_pack(id := node, freq := freq, ngram := [b.w, a.w]))::VARCHAR, ',' ORDER BY freq DESC, node) FROM shown JOIN spans a ON a.id = g1 JOIN spans b ON b.id = g2)
|| ',{"id":-1}],"last_pos":"0","found_all":' || (SELECT count(*) FROM found) || ',"progress":0}' AS response""",
)
def _(spark, d):
    return corpus(spark, d).respond_ngrams('{"word":["of","the"],"return":10}')


def leaf_sql() -> str:
    same = lambda t, k: " AND ".join(f"{t}.g{i} = n.g{i}" for i in range(1, k + 1))
    parts = []
    for k in range(1, 7):
        above = " ".join(f"JOIN nodes p{j} ON p{j}.level = {j} AND {same(f'p{j}', j)}" for j in range(1, k))
        cells = ", ".join(f"n.g{j} || '(' || {f'p{j}' if j < k else 'n'}.freq || ')'" for j in range(1, k + 1))
        leaf = f" AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.level = {k + 1} AND {same('x', k)})" if k < 6 else ""
        parts.append(f"SELECT concat_ws(' ', {cells}) AS value FROM nodes n {above} WHERE n.level = {k}{leaf}")
    return " UNION ALL ".join(parts)


@add("ng_leaf_paths", GRAMS_SQL + leaf_sql())
def _(spark, d):
    return corpus(spark, d).leaf_paths()
