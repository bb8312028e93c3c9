"""Sequences of token slots: tuples of positions with distances between neighbours.

Conditions are tested on token types, not on tokens; the facts are then joined to the types that pass. Neighbouring slots are joined on the
sentence with a range on the position, from the rarest slot outwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.predicates import matching_sources, slot_column
from lexigrid.plans.query import CorpusQuery


def slot_frequencies(types: DataFrame, query: CorpusQuery) -> list[int]:
    """Tokens that each slot matches by itself: exact, from type frequencies."""
    row = types.agg(*[F.sum(F.when(slot_column(s, query.regex), F.col("freq")).otherwise(0)).alias(f"n{i}") for i, s in enumerate(query.slots)]).first()
    return [row[i] or 0 for i in range(len(query.slots))]


def _facts(main: DataFrame, sources: DataFrame, query: CorpusQuery) -> DataFrame:
    wanted = matching_sources(sources, query)
    return main if wanted is None else main.join(wanted, "source", "left_semi")


def _slot(facts: DataFrame, types: DataFrame, query: CorpusQuery, i: int) -> DataFrame:
    slot = query.slots[i]
    rows = facts if slot.empty else facts.join(types.where(slot_column(slot, query.regex)).select(F.col("id").alias("united")), "united", "left_semi")
    return rows.select("sentence", F.col("pos").alias(f"p{i + 1}"), F.col("id").alias(f"z{i + 1}"), *([F.col("source")] if i == 0 else []))


def tuples(main: DataFrame, types: DataFrame, sources: DataFrame, query: CorpusQuery, frequencies: list[int] | None = None) -> DataFrame:
    """sentence, source, z1..zk (token ids) of every match within a sentence."""
    if query.boundary == "compat":
        return compat_tuples(main, types, sources, query)
    facts, k = _facts(main, sources, query), len(query.slots)
    frequencies = frequencies or (slot_frequencies(types, query) if k > 2 else [0] * k)
    start = min(range(k), key=lambda i: (query.slots[i].empty, frequencies[i]))
    out = _slot(facts, types, query, start)
    lo = hi = start
    while lo > 0 or hi < k - 1:
        # the rarer of the two neighbours comes next
        right = lo == 0 or hi < k - 1 and (query.slots[hi + 1].empty, frequencies[hi + 1]) <= (query.slots[lo - 1].empty, frequencies[lo - 1])
        if right:
            a, b = query.distances[hi]
            new = _slot(facts, types, query, hi + 1).withColumnRenamed("sentence", "__s")
            near = F.col(f"p{hi + 2}").between(F.col(f"p{hi + 1}") + a, F.col(f"p{hi + 1}") + b)
            hi += 1
        else:
            a, b = query.distances[lo - 1]
            new = _slot(facts, types, query, lo - 1).withColumnRenamed("sentence", "__s")
            near = F.col(f"p{lo + 1}").between(F.col(f"p{lo}") + a, F.col(f"p{lo}") + b)
            lo -= 1
        out = out.join(new, (F.col("sentence") == F.col("__s")) & near).drop("__s")
    return out.select("sentence", "source", *[f"z{i + 1}" for i in range(k)])


#: A slot is selective if it has less than this share of the tokens: then only its sentences are looked at.
SELECTIVE = 0.02


def anchor_counts(main: DataFrame, types: DataFrame, sources: DataFrame, query: CorpusQuery, frequencies: list[int] | None = None) -> DataFrame:
    """z1, z2..zk, sentence, source, n_tuples: for each first token the number of its tuples, and the first of them in lexicographic order.

    Tuples are counted, not made: from the last slot to the first, each token gets the number of ways to go on from it and the first of these, sums and minima over
    a range of positions within the sentence. All slots' windows share one sort, so the facts are read once whatever the distances."""
    if query.boundary != "strict":
        raise ValueError("tuples are counted within sentences")
    k = len(query.slots)
    frequencies = frequencies or slot_frequencies(types, query)
    flags = types.select(F.col("id").alias("united"), "freq", *[slot_column(s, query.regex).alias(f"m{i + 1}") for i, s in enumerate(query.slots)])
    if not any(s.empty for s in query.slots):
        flags = flags.where(" OR ".join(f"m{i + 1}" for i in range(k)))
    rows = _facts(main, sources, query).join(flags.drop("freq"), "united").select("sentence", "source", "pos", "id", *[f"m{i + 1}" for i in range(k)])
    rare = min(range(k), key=lambda i: frequencies[i])
    if k > 1 and frequencies[rare] < SELECTIVE * sum(frequencies):
        rows = rows.join(_slot(_facts(main, sources, query), types, query, rare).select("sentence").distinct(), "sentence", "left_semi")
    rows = rows.withColumn("n", F.when(F.col(f"m{k}"), F.lit(1).cast("bigint"))).withColumn("t", F.lit(None).cast("string"))
    ordered = Window.partitionBy("sentence").orderBy("pos")
    for i in range(k - 1, 0, -1):
        ahead = ordered.rangeBetween(*query.distances[i - 1])
        following = F.struct(F.col("id").alias(f"z{i + 1}"), *([F.col("t")] if i < k - 1 else []))
        n, t = F.sum("n").over(ahead), F.min(F.when(F.col("n").isNotNull(), following)).over(ahead)
        rows = rows.select("sentence", "source", "pos", "id", *[f"m{j + 1}" for j in range(i)], F.when(F.col(f"m{i}"), n).alias("n"), t.alias("t"))
    path = lambda i: "t" + ".t" * (i - 2) + f".z{i}"
    return rows.where("n > 0").select(F.col("id").alias("z1"), *[F.col(path(i)).alias(f"z{i}") for i in range(2, k + 1)], "sentence", "source", F.col("n").alias("n_tuples"))


def adjacent_tuples(main: DataFrame, types: DataFrame, sources: DataFrame, query: CorpusQuery) -> DataFrame:
    """The same for distances of 1 alone, by looking ahead in a window: better than joins if no slot is selective."""
    if any(d != (1, 1) for d in query.distances) or query.boundary != "strict":
        raise ValueError("all distances must be 1")
    k = len(query.slots)
    flags = types.select(F.col("id").alias("united"), *[slot_column(s, query.regex).alias(f"m{i + 1}") for i, s in enumerate(query.slots)])
    rows = _facts(main, sources, query).join(flags, "united")
    w = Window.partitionBy("sentence").orderBy("pos")
    ahead = rows.select("sentence", "source", "m1", F.col("id").alias("z1"), *[x for i in range(1, k) for x in (F.lead(f"m{i + 1}", i).over(w).alias(f"n{i + 1}"), F.lead("id", i).over(w).alias(f"z{i + 1}"))])
    for c in ("m1", *[f"n{i + 1}" for i in range(1, k)]):
        ahead = ahead.where(F.col(c))
    return ahead.select("sentence", "source", *[f"z{i + 1}" for i in range(k)])


def compat_tuples(main: DataFrame, types: DataFrame, sources: DataFrame, query: CorpusQuery) -> DataFrame:
    """Matches that may pass a sentence's end if the first step does: places count a marker per sentence and one per source change.

    main needs ``slot`` and ``sent_slot``. The band join has an equi key: places are cut into bins as wide as the band, and the left side
    goes to the two bins that its band touches."""
    if "slot" not in main.columns:
        raise ValueError("compat needs slot and sent_slot")
    facts = _facts(main, sources, query)

    def rows(i):
        slot = query.slots[i]
        r = facts if slot.empty else facts.join(types.where(slot_column(slot, query.regex)).select(F.col("id").alias("united")), "united", "left_semi")
        return r

    out = rows(0).select("sentence", "source", F.col("slot").alias("p1"), F.col("id").alias("z1"))
    for i in range(1, len(query.slots)):
        a, b = query.distances[i - 1]
        width = max(1, b - a + 1)
        bins = F.sequence(F.floor((F.col(f"p{i}") + a) / width), F.floor((F.col(f"p{i}") + b) / width))
        left = out.withColumn("__bin", F.explode(bins))
        right = rows(i).select(F.floor(F.col("slot") / width).alias("__bin2"), F.col("slot").alias(f"p{i + 1}"), F.col("sent_slot").alias("__begin"), F.col("id").alias(f"z{i + 1}"))
        near = F.col(f"p{i + 1}").between(F.col(f"p{i}") + a, F.col(f"p{i}") + b) & (F.col("__begin") <= F.col(f"p{i}") + a)
        out = left.join(right, (F.col("__bin") == F.col("__bin2")) & near).drop("__bin", "__bin2", "__begin")
    return out.select("sentence", "source", *[f"z{i + 1}" for i in range(len(query.slots))])
