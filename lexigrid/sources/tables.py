"""The star schema and n-gram tables in files and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.operators.dictionary import SOURCE_FIELDS, Star
from lexigrid.operators.lines import Lines
from lexigrid.sources.shared import stored

SCHEMAS = {
    "main": "id bigint, united bigint, sentence bigint, source bigint, pos bigint",
    "united": "id bigint, freq bigint, word_case bigint, word bigint, lemma bigint, tags bigint",
    "words_case": "id bigint, freq bigint, word_case string",
    "words": "id bigint, freq bigint, word string",
    "lemmas": "id bigint, freq bigint, lemma string",
    "tags": "id bigint, freq bigint, combinations string",
    "tags_uniq": "id bigint, freq bigint, tag string",
    "sources": "id bigint, " + ", ".join(f"{c} string" for c in SOURCE_FIELDS),
}


def write_parquet(star: Star, folder: str) -> None:
    """main is laid out by sentence, so that a sentence range prunes files."""
    for name in SCHEMAS:
        df = getattr(star, name)
        (df.repartitionByRange("sentence").sortWithinPartitions("sentence", "pos") if name == "main" else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def types_from(star_tables: dict[str, DataFrame]) -> DataFrame:
    """Token types with their strings."""
    out = star_tables["united"]
    for name, column, value in (("words_case", "word_case", "word_case"), ("words", "word", "word"), ("lemmas", "lemma", "lemma"), ("tags", "tags", "combinations")):
        out = out.withColumnRenamed(column, "__k").join(star_tables[name].select(F.col("id").alias("__k"), F.col(value).alias(column)), "__k").drop("__k")
    return out.select("id", "freq", "word_case", "word", "lemma", "tags")


def with_pos(main: DataFrame) -> DataFrame:
    """main with ``pos``, the place within the sentence, where it is missing or empty: ids are dense and in the order of the text."""
    if "pos" in main.columns:
        first = main.select("pos").first()
        if first is None or first["pos"] is not None:
            return main
        main = main.drop("pos")
    return main.withColumn("pos", (F.col("id") - F.min("id").over(Window.partitionBy("sentence"))).cast("bigint"))


def _star(tables: dict[str, DataFrame]) -> Star:
    return Star(types=types_from(tables), **{**tables, "main": with_pos(tables["main"])})


def read_parquet(spark: SparkSession, folder: str) -> Star:
    return _star({n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()})


def write_tsv(star: Star, folder: str, pos: bool = True) -> None:
    """All tables, tab-separated and packed; ``pos=False`` leaves out the place within the sentence, which some databases don't keep."""
    for name in SCHEMAS:
        df = getattr(star, name)
        df = df.select("id", "united", "sentence", "source", *(["pos"] if pos else [])) if name == "main" else df
        df.write.mode("overwrite").option("sep", "\t").option("compression", "bzip2").option("quote", "").option("emptyValue", "").csv(f"{folder}/{name}")


def read_tsv(spark: SparkSession, folder: str) -> Star:
    return _star({n: spark.read.schema(s).option("sep", "\t").option("quote", "").csv(f"{folder}/{n}").fillna("") for n, s in SCHEMAS.items()})


def write_tagged(tokens: DataFrame, text: str, sentence_map: str) -> None:
    """A line of units for each sentence, in order, and the map of sentences to sources."""
    write_tagged_lines(Lines.of_tokens(tokens), text, sentence_map)


def write_tagged_lines(lines: Lines, text: str, sentence_map: str) -> None:
    """The same of sentences: one exchange brings them in order, and the text is packed."""
    special = r"([\\^$/<>+*@\[\]{}~])"
    plain = lambda c: F.regexp_replace(c, special, r"\\$1")
    unit = lambda w: F.concat(F.lit("^"), plain(lines.attributes(w, "word_case")), F.lit("/"), plain(lines.attributes(w, "lemma")), F.translate(lines.attributes(w, "tags"), ",", ""), F.lit("$"))
    out = lines.rows.repartitionByRange("sentence").sortWithinPartitions("sentence")
    out.select(F.array_join(F.transform(lines.words, unit), " ").alias("value")).write.option("compression", "gzip").text(text)
    lines.rows.select("sentence", "source").write.csv(sentence_map, sep="\t")


def read_jdbc(spark: SparkSession, url: str, prefix: str = "corpus_", partitions: int = 64, **options: str) -> Star:
    """All tables from a database; main is read in ``partitions`` ranges of its id at once."""

    def one(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        if name == "main":
            ends = reader.option("query", f"SELECT min(id) AS lo, max(id) AS hi FROM {prefix}main").load().first()
            reader = spark.read.format("jdbc").option("url", url).options(**options).option("partitionColumn", "id").option("lowerBound", ends["lo"] or 0).option("upperBound", ends["hi"] or 0).option("numPartitions", partitions)
        return reader.option("dbtable", f"{prefix}{name}").load()

    return _star({n: one(n) for n in SCHEMAS})


def debug_dump(star: Star) -> DataFrame:
    """main with its strings."""
    t = star.types.select(F.col("id").alias("united"), "word_case", "word", "lemma", "tags")
    return star.main.join(t, "united").select("id", "united", "sentence", "source", "word_case", "word", "lemma", "tags")


def write_ngrams(trie: DataFrame, path: str) -> None:
    """``level node parent united freq``, space-separated; level 1 has -1 for its parent."""
    rows = trie.select("level", "node", F.coalesce("parentnode", F.lit(-1)).alias("parentnode"), "united", "freq")
    rows.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.mode("overwrite").option("sep", " ").csv(path)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("level bigint, node bigint, parentnode bigint, united bigint, freq bigint").option("sep", " ").csv(path)
    return rows.withColumn("parentnode", F.when(F.col("parentnode") >= 0, F.col("parentnode")))


def tree_rows(nodes: DataFrame) -> DataFrame:
    """node, parent, word, amount: n-grams as a tree, numbered from 1 in depth-first order with words ascending; the root is 0."""
    from lexigrid.operators.ngrams import GRAMS, LEVELS
    from lexigrid.operators.numbering import numbered

    placed = numbered(nodes.select("level", *GRAMS, "freq"), "node", [F.asc_nulls_first(g) for g in GRAMS]).withColumn("node", F.col("node") + 1)
    out = placed.where("level = 1").select("node", F.lit(0).cast("bigint").alias("parent"), F.col("g1").alias("word"), F.col("freq").alias("amount"))
    for k in range(2, LEVELS + 1):
        above = placed.where(F.col("level") == k - 1).select(*[F.col(g).alias(f"__{g}") for g in GRAMS[: k - 1]], F.col("node").alias("parent"))
        own = placed.where(F.col("level") == k).join(above, [F.col(g) == F.col(f"__{g}") for g in GRAMS[: k - 1]])
        out = out.unionByName(own.select("node", "parent", F.col(f"g{k}").alias("word"), F.col("freq").alias("amount")))
    return out


def write_tree(nodes: DataFrame, path: str) -> None:
    """``node;parent;word;amount`` lines in the order of their numbers, with a head line first and the next free number last."""
    rows = stored(tree_rows(nodes), "tree")
    lines = rows.select(F.col("node").alias("__n"), F.concat_ws(";", "node", "parent", "word", "amount").alias("value"))
    ends = rows.agg((F.coalesce(F.max("node"), F.lit(0)) + 1).alias("free")).select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("#NodeId;parentNodeId;WordId;amount").alias("v")), F.struct(F.col("free").alias("n"), F.concat(F.lit("#Next free id:"), "free").alias("v")))).alias("x"))
    lines.unionByName(ends.select(F.col("x.n").alias("__n"), F.col("x.v").alias("value"))).repartitionByRange("__n").sortWithinPartitions("__n").select("value").write.mode("overwrite").text(path)


def types_dump(star: Star) -> DataFrame:
    """united with its strings."""
    return star.types.select("id", "freq", "word_case", "word", "lemma", "tags")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """One text row for each n-gram that no longer one continues: ``id(count)`` of each prefix, in order."""
    from lexigrid.operators.ngrams import GRAMS, LEVELS

    out = None
    for k in range(1, LEVELS + 1):
        own = nodes.where(F.col("level") == k)
        if k < LEVELS:
            longer = nodes.where(F.col("level") == k + 1).select(*GRAMS[:k]).distinct()
            own = own.join(longer, GRAMS[:k], "left_anti")
        cells = []
        for j in range(1, k + 1):
            if j < k:
                above = nodes.where(F.col("level") == j).select(*[F.col(g).alias(f"__{j}{g}") for g in GRAMS[:j]], F.col("freq").alias(f"__f{j}"))
                own = own.join(above, [F.col(g) == F.col(f"__{j}{g}") for g in GRAMS[:j]])
            cells.append(F.concat(F.col(f"g{j}").cast("string"), F.lit("("), F.col(f"__f{j}" if j < k else "freq").cast("string"), F.lit(")")))
        part = own.select(F.concat_ws(" ", *cells).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
