"""Regimes as plans: keyword, dense, pooled and weight-only retrieval, expansion, metrics, fitting.

A corpus is a DataFrame with unit_id, note_uid, text, color, is_bold, effective_weight,
section_color, tree_path and the vector columns. Every result carries query_id and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import colour_weight, dot, norm, share_of_top, tag
from quillspark.operators.lexical import bm25_top, bm25_where_they_lie, build_index, corpus_size, parse_queries, top_per_query
from quillspark.operators.neighbours import nearest
from quillspark.plans.regimes import Regime
from quillspark.sources.storage import scratch_table, small

EXPANDED_SHARE = 0.5
Vectors = Sequence[tuple[int, Sequence[float]]] | DataFrame
COLUMNS = ("query_id", "rank", "unit_id", "note_uid", "score", "cosine", "source")


def embedding_text(text: Column, tree_path: Column, caption: Column, context: bool) -> Column:
    """What is embedded: the text, or the text behind its path or caption in brackets."""
    if not context:
        return text
    place = F.coalesce(F.nullif(tree_path, F.lit("")), F.nullif(caption, F.lit("")), F.lit(""))
    return F.concat(F.lit("["), place, F.lit("] "), text)


def cosines(corpus: DataFrame, vector: str, queries: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """corpus rows with a vector, once per query, with query_id and cosine.

    Query vectors are literals in one projection, so the corpus is scanned once for all of them."""
    wrong = [q for q, v in queries if not any(v)]
    if wrong:
        raise ValueError(f"zero query vectors: {wrong}")
    unit = [(q, [x / sum(y * y for y in v) ** 0.5 for x in v]) for q, v in queries]
    dims = {len(v) for _, v in queries}
    if len(dims) > 1:
        raise ValueError(f"query vectors of different lengths: {sorted(dims)}")
    wrong_size = F.raise_error(F.concat(F.lit(f"a vector of {vector} has not the queries' {max(dims, default=0)} places: "), F.size(vector).cast("string")))
    length = F.when(F.size(vector) == max(dims, default=0), norm(F.col(vector))).otherwise(wrong_size.cast("double"))
    scored = F.array(*(F.struct(F.lit(q).cast("long").alias("query_id"), (dot(F.col(vector), v) / F.col("__norm")).alias("cosine")) for q, v in unit))
    with_norm = corpus.where(F.col(vector).isNotNull()).withColumn("__norm", length)
    return with_norm.withColumn("__scores", scored).select(*corpus.columns, F.inline("__scores"))


def dense(corpus: DataFrame, regime: Regime, queries: Vectors, vector: str, k: int | None = None) -> DataFrame:
    """cosine x (1 + alpha w) x (1 + beta s), with w and s the unit's and its section's share of the
    top weight; the weight floor holds before the cut. queries: a few (id, vector), or a table of them."""
    k = regime.top_k if k is None else k
    base = corpus if regime.min_weight is None else corpus.where(F.col("effective_weight") >= regime.min_weight)
    own, section = share_of_top(F.col("effective_weight")), share_of_top(colour_weight(F.col("section_color")))
    if isinstance(queries, DataFrame):
        factor = (1 + regime.alpha * own) * (1 + regime.beta * section)
        top = top_per_query(nearest(base.select("unit_id", "note_uid", factor.alias("factor"), F.col(vector).alias("vector")), queries, k), k)
        return top.withColumn("source", F.lit("retrieved")).select(*COLUMNS)
    scored = cosines(base.select("unit_id", "note_uid", "effective_weight", "section_color", vector), vector, queries)
    score = F.col("cosine") * (1 + regime.alpha * own) * (1 + regime.beta * section)
    top = top_per_query(scored.select("query_id", "unit_id", "note_uid", "cosine", score.alias("score")), k)
    return top.withColumn("source", F.lit("retrieved")).select(*COLUMNS)


def lexical(corpus: DataFrame, regime: Regime, queries: DataFrame, index: DataFrame | None = None, size: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """BM25, cut at four times k, then the weight floor, then the first k. Without a stored index units are
    scored where they lie."""
    k = regime.top_k if k is None else k
    if index is None and size is None:
        first = bm25_where_they_lie(corpus, queries, 4 * k).drop("rank")
    else:
        index = build_index(corpus, parse_queries(queries)) if index is None else index
        size = corpus_size(corpus) if size is None else size
        first = bm25_top(index, size, queries, 4 * k).drop("rank")
    found = first.join(corpus.select("unit_id", "note_uid", "effective_weight"), "unit_id")
    if regime.min_weight is not None:
        found = found.where(F.col("effective_weight") >= regime.min_weight)
    top = top_per_query(found, k)
    return top.select("query_id", "rank", "unit_id", "note_uid", "score", F.lit(None).cast("double").alias("cosine"), F.lit("retrieved").alias("source"))


def by_weight(corpus: DataFrame, regime: Regime, queries: DataFrame) -> DataFrame:
    """No retrieval: the heaviest units at or above the floor, the same for each query."""
    base = corpus if regime.min_weight is None else corpus.where(F.col("effective_weight") >= regime.min_weight)
    top = base.orderBy(F.desc("effective_weight"), "unit_id").limit(regime.top_k)
    spread = queries.select(F.col("query_id").cast("long")).crossJoin(F.broadcast(top))  # at most top_k rows
    ranked = top_per_query(spread.withColumn("score", F.col("effective_weight")), regime.top_k)
    return ranked.select("query_id", "rank", "unit_id", "note_uid", "score", F.lit(None).cast("double").alias("cosine"), F.lit("retrieved").alias("source"))


def pooled(corpus: DataFrame, regime: Regime, queries: DataFrame, vectors: Vectors, vector: str, index: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """Half keyword, half dense; a unit found by both keeps its keyword place, scores are not mixed."""
    half = max(1, regime.top_k // 2)
    both = lexical(corpus, regime, queries, index, size, k=half).withColumn("__arm", F.lit(0)).unionByName(dense(corpus, regime, vectors, vector, k=regime.top_k - half).withColumn("__arm", F.lit(1)))
    seen = F.row_number().over(Window.partitionBy("query_id", "unit_id").orderBy("__arm", "rank"))
    kept = both.withColumn("__seen", seen).where("__seen = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("__arm", "rank"))
    return kept.withColumn("rank", place).select(*COLUMNS)


def expand(hits: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """hits followed by the n best other units of each hit's note, at half the hit's score.

    The n are chosen before those already there are dropped; a unit reached from two hits keeps the
    first hit's score. Hits are stored first, as they are read four times and retrieval is worth it once."""
    hits = scratch_table(hits.select(*COLUMNS))
    order = Window.partitionBy("query_id", "rank").orderBy(F.desc("effective_weight"), "sibling")
    others = corpus.select(F.col("note_uid"), F.col("unit_id").alias("sibling"), "effective_weight")
    near = hits.select("query_id", "rank", "note_uid", "unit_id", "score").join(others, "note_uid").where("sibling <> unit_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    fresh = near.join(hits.select("query_id", F.col("unit_id").alias("sibling")), ["query_id", "sibling"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "sibling").orderBy("rank", "place"))
    fresh = fresh.withColumn("__n", first).where("__n = 1")
    last = hits.groupBy("query_id").agg(F.max("rank").alias("__last"))
    behind = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "place"))
    added = fresh.withColumn("__behind", behind).join(last, "query_id").select(
        "query_id",
        (F.col("__last") + F.col("__behind")).alias("rank"),
        F.col("sibling").alias("unit_id"),
        "note_uid",
        (F.col("score") * EXPANDED_SHARE).alias("score"),
        F.lit(None).cast("double").alias("cosine"),
        F.lit("expanded").alias("source"),
    )
    return hits.unionByName(added)


def retrieve(corpus: DataFrame, regime: Regime, queries: DataFrame, vectors: Vectors = (), index: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """Ranked fragments of each query (query_id, query) under a regime. vectors: embedded queries;
    the corpus has the columns vector_plain and vector_context. index and size: a stored index of the
    corpus (lexical.build_index, corpus_size); without one units are scored where they lie."""
    vector = f"vector_{regime.embed}"
    if regime.retriever == "fts":
        hits = lexical(corpus, regime, queries, index, size)
    elif regime.retriever == "vector":
        hits = dense(corpus, regime, vectors, vector)
    elif regime.retriever == "none":
        hits = by_weight(corpus, regime, queries)
    elif regime.retriever == "pooled":
        hits = pooled(corpus, regime, queries, vectors, vector, index, size)
    else:
        raise ValueError(f"unknown retriever {regime.retriever!r}")
    return expand(hits, corpus, regime.expand) if regime.expand else hits


def metrics(fragments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per query: fragments, expanded, mean score (3 places), greatest score, share of weight 1 or more
    in percent (1 place), notes, characters."""
    found = fragments.join(corpus.select("unit_id", "text", "effective_weight"), "unit_id")
    return found.groupBy("query_id").agg(
        F.count("*").alias("n_fragments"),
        F.sum(F.when(F.col("source") == "expanded", 1).otherwise(0)).cast("long").alias("n_expanded"),
        F.bround(F.avg("effective_weight"), 3).alias("mean_weight"),
        F.max("effective_weight").alias("max_weight"),
        F.bround(100.0 * F.avg(F.when(F.col("effective_weight") >= 1.0, 1.0).otherwise(0.0)), 1).alias("pct_weighted"),
        F.countDistinct("note_uid").alias("n_notes"),
        F.sum(F.length("text")).alias("context_chars"),
    )


def fragment_text(regime: Regime) -> Column:
    """One fragment of a prompt: number, tag and path as the regime shows them."""
    number = F.lit("") if regime.narrative_style else F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))
    if not regime.prompt_meta:
        return F.concat(number, F.col("text"))
    head = F.rtrim(F.concat(number, tag(F.col("color"), F.coalesce("is_bold", F.lit(False)))))
    head = F.concat(head, F.when(F.coalesce("tree_path", F.lit("")) != "", F.concat(F.lit(" ("), F.col("tree_path"), F.lit(")"))).otherwise(""))
    return F.when(head != "", F.concat(head, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))


def fit(fragments: DataFrame, corpus: DataFrame, regime: Regime, window_tokens: int, fixed_chars: int | Column, max_tokens: int = 1500) -> DataFrame:
    """Fragments that fit a model's window: the longest prefix by rank whose prompt of fixed_chars plus
    the formatted fragments, blank lines between, stays within max(256, window - max_tokens - 300)
    tokens of four characters. Only found units' texts are moved."""
    budget = max(256, window_tokens - (max_tokens + 300))
    fragments = scratch_table(fragments)
    wanted = small(scratch_table(fragments.select("unit_id").distinct()))
    found = fragments.join(corpus.join(wanted, "unit_id", "left_semi").select("unit_id", "text", "color", "is_bold", "tree_path"), "unit_id").withColumn("shown", fragment_text(regime))
    upto = Window.partitionBy("query_id").orderBy("rank")
    chars = F.sum(F.length("shown")).over(upto) + 2 * (F.row_number().over(upto) - 1) + fixed_chars
    return found.withColumn("prompt_chars", chars).where(F.col("prompt_chars") / 4 <= budget)


def context(fragments: DataFrame) -> DataFrame:
    """(query_id, context): shown fragments in rank order, blank lines between."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "shown")))
    return fragments.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "\n\n").alias("context"))
