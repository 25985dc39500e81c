"""Ranking supporting provisions for texts: BM25, vectors, min-max, fusion with tags, top k."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import fixed, text, vectors

#: The provisions are the stated set that every text is held against, so many at a time.
BLOCK_PROVISIONS = 5_000
#: Queries of a search that are held against all rows at a time.
BLOCK_QUERIES = 2_000


def search_text(heading: Column, summary: Column, bare_act: Column, topics: Column) -> Column:
    """What a provision is found by; blank wording of the act and null topics are left out."""
    act = F.when(F.coalesce(text.strip(bare_act), F.lit("")) != "", F.concat(F.lit(" "), bare_act)).otherwise("")
    return F.concat(F.coalesce(heading, F.lit("")), F.lit(". "), F.coalesce(summary, F.lit("")), act, F.lit(" "), F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "))


def index(corpus: DataFrame, ord_: str = "ord", body: str = "search_text") -> DataFrame:
    """(ord, term, weight): what a term adds to a provision's score each time a query has it."""
    tokens = corpus.select(F.col(ord_).alias("ord"), text.terms(F.col(body)).alias("terms"))
    size = tokens.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("terms")), F.lit(1e-9)).alias("mean"))
    frequency = tokens.select("ord", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("ord", "length", "term").agg(F.count("*").alias("tf"))
    documents = frequency.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (fixed.BM25_K1 + 1) / (F.col("tf") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("length") / F.col("mean")))
    return frequency.join(documents, "term").join(F.broadcast(size)).select("ord", "term", weight.alias("weight"))


def bm25(queries: DataFrame, corpus: DataFrame, key: str, body: str = "text", ord_: str = "ord", search: str = "search_text") -> DataFrame:
    """(key, ord, score) of the provisions that share a term with a query; repeated query terms count repeatedly.

    Terms are counted inside the row, so a query sends each distinct term once; those that no provision has are dropped
    by the join where the text is, as long as the planner can broadcast the index (it grows with the provisions, not
    with the queries). Scores are summed per (key, ord), on the map side first.
    """
    terms = queries.select(key, F.array_sort(text.terms(F.col(body))).alias("terms")).where(F.size("terms") > 0)
    # In sorted order a term's first place and the next term's first place give its count.
    first = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: (i == 1) | (F.element_at("terms", i) != F.element_at("terms", F.greatest(i - 1, F.lit(1)))))
    placed = terms.select(key, "terms", first.alias("firsts"))
    ends = F.concat(F.slice("firsts", F.lit(2), F.size("firsts")), F.array(F.size("terms") + 1))
    counted = placed.select(key, F.explode(F.zip_with("firsts", ends, lambda a, b: F.struct(F.element_at("terms", a).alias("term"), (b - a).alias("qtf")))).alias("t")).select(key, "t.term", "t.qtf")
    return counted.join(index(corpus, ord_, search), "term").groupBy(key, "ord").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def cosine_scores(queries: DataFrame, corpus: DataFrame, key: str, vector: str = "embedding", most: int | None = None) -> DataFrame:
    """(key, ord, score): dot products of the queries' vectors with those of a corpus (ord, embedding).

    The corpus is the stated set that every query is held against, broadcast in blocks of at most BLOCK_PROVISIONS rows.
    With `most`, a query keeps so many of its best of each block (equal scores by ord) before anything is shuffled, and
    of these the best at last.
    """
    blocks = max(1, -(-corpus.count() // BLOCK_PROVISIONS))
    queries = queries.where(F.col(vector).isNotNull()).select(key, vector)

    def scored(block: DataFrame) -> DataFrame:
        held = block.where(F.col(vector).isNotNull()).agg(F.collect_list(F.struct("ord", F.col(vector).alias("v"))).alias("held"))
        scores = F.transform("held", lambda h: F.struct((-vectors.dot(F.col(vector), h["v"])).alias("less"), h["ord"].alias("ord")))
        best = F.slice(F.array_sort(scores), 1, most) if most else scores
        return queries.join(F.broadcast(held)).select(key, F.explode(best).alias("s")).select(key, "s.ord", (-F.col("s.less")).alias("score"))

    parts = [scored(corpus.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == n) if blocks > 1 else corpus) for n in range(blocks)]
    every = functools.reduce(DataFrame.unionByName, parts)
    if most and blocks > 1:
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord")))
        every = ranked.where(F.col("rank") <= most).drop("rank")
    return every


def best_matches(rows: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", most: int = 3) -> DataFrame:
    """(ord, key, score): for each query (ord, embedding) the `most` rows (key, embedding) with the greatest dot products.

    Queries are broadcast in blocks of at most BLOCK_QUERIES; each task keeps the best of its own rows for each of them,
    so what is shuffled is bounded by tasks times queries. Equal scores go by the lesser key. Null vectors take no part.
    """
    import numpy as np
    import pyarrow as pa

    kept = queries.where(F.col(vector).isNotNull()).select("ord", vector)
    blocks = max(1, -(-kept.count() // BLOCK_QUERIES))
    parts = []
    for n in range(blocks):
        held = (kept.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == n) if blocks > 1 else kept).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((held.column(0).to_pylist(), np.array(held.column(1).to_pylist(), dtype=np.float64)))

        def run(batches, shared=shared):
            ords, wanted = shared.value
            keys, scores = np.zeros((len(ords), 0), dtype=object), np.zeros((len(ords), 0))
            for batch in batches:
                if not batch.num_rows or not ords:
                    continue
                own = np.array(batch.column(0).to_pylist(), dtype=object)
                made = wanted @ np.array(batch.column(1).to_pylist(), dtype=np.float64).T
                keys, scores = np.hstack([keys, np.broadcast_to(own, made.shape)]), np.hstack([scores, made])
                order = np.array([sorted(range(scores.shape[1]), key=lambda k: (-round(scores[q, k], 12), keys[q, k]))[:most] if scores.shape[1] <= 4 * most else _best(scores[q], keys[q], most) for q in range(len(ords))])
                keys, scores = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1)
            if keys.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array([o for o in ords for _ in range(keys.shape[1])]), pa.array(keys.ravel().tolist()), pa.array(scores.ravel())], names=["ord", key, "score"])

        kinds = f"ord {queries.schema['ord'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double"
        parts.append(rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, kinds))
    every = functools.reduce(DataFrame.unionByName, parts)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc(F.round("score", 12)), key)))
    return ranked.where(F.col("rank") <= most).select("ord", key, "score")


def _best(scores, keys, most: int) -> list[int]:
    """Places of the `most` greatest scores, equal ones by key, from the few at or above the last of them."""
    import numpy as np

    least = np.partition(scores, -most)[-most]  # there are more than `most`
    near = np.flatnonzero(scores >= least - 1e-12)
    return sorted(near.tolist(), key=lambda k: (-round(scores[k], 12), keys[k]))[:most]


def ground(clauses: DataFrame, corpus: DataFrame, scores: DataFrame, key: str, kind: str = "type", vectors_scores: DataFrame | None = None, k: int = fixed.TOP_K) -> DataFrame:
    """(key, rank, ord, score, method): the k best provisions of each clause.

    Scores are brought to 0..1 over all provisions, those without a score included (a range below 1e-9 gives zeros).
    A provision tagged with the clause's type gains 0.55, unless the clause is unclassified. Totals below 0.30 drop
    out; what is kept is at most 1, and equal totals keep the corpus' order. Blank texts have no match.

    corpus: (ord, clause_types). Every clause meets the few provisions that scored or are tagged, never all of them: the
    least score is zero as soon as one provision went without. Tags are broadcast up to BLOCK_PROVISIONS provisions.
    """
    total = corpus.count()
    method = "bm25" if vectors_scores is None else "hybrid"
    first, second = fixed.FUSION[method]

    def scaled(given: DataFrame, name: str) -> DataFrame:
        each = Window.partitionBy(key)
        low = F.when(F.count("*").over(each) < total, F.least(F.lit(0.0), F.min("score").over(each))).otherwise(F.min("score").over(each))
        high = F.when(F.count("*").over(each) < total, F.greatest(F.lit(0.0), F.max("score").over(each))).otherwise(F.max("score").over(each))
        return given.withColumn("low", low).withColumn("high", high).select(key, "ord", F.when(F.col("high") - F.col("low") <= 1e-9, 0.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).alias(name))

    tags = corpus.select("ord", F.explode("clause_types").alias("_type")).distinct()
    typed = clauses.where(F.coalesce(F.col(kind), F.lit(fixed.UNCLASSIFIED)) != fixed.UNCLASSIFIED)
    tagged = typed.join(F.broadcast(tags) if total <= BLOCK_PROVISIONS else tags, F.col(kind) == F.col("_type")).select(key, "ord", F.lit(fixed.TAG_BONUS).alias("tag"))
    joined = scaled(scores, "bm").join(tagged, [key, "ord"], "full")
    value = first * F.coalesce("bm", F.lit(0.0)) + F.coalesce("tag", F.lit(0.0))
    if vectors_scores is not None:
        joined = joined.join(scaled(vectors_scores, "emb"), [key, "ord"], "full")
        value = value + second * F.coalesce("emb", F.lit(0.0))
    visible = clauses.where(F.coalesce(text.strip(F.col("text")), F.lit("")) != "").select(key)
    kept = joined.withColumn("score", F.round(value, 12)).where(F.col("score") >= fixed.MATCH_LEAST).withColumn("score", F.least(F.lit(1.0), "score"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)
    return ranked.join(visible, key, "left_semi").select(key, "rank", "ord", "score", F.lit(method).alias("method"))
