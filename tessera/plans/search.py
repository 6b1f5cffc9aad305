"""Hybrid search: three lists, gates, fusion, reranking, diversity, scores, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import answers, context, labels, retrieval
from tessera.operators import synonyms as Y
from tessera.sources.tables import written


def search(queries: DataFrame, chunks: DataFrame, embed=None, top_k: int = 10, min_score: float | None = None, rerank: bool = True, diversify: bool = True, context_window: int = 0, label_filters: list[dict] = (), bridge: DataFrame | None = None, wanted: DataFrame | None = None, expand: bool = True, synonyms: DataFrame | None = None, fuzzy: bool | str = False) -> DataFrame:
    """(query_id, rnk, id, book, section, page, text, score, vec, fts, trgm, rerank, importance, is_parent).

    ``queries`` (query_id, text); ``chunks`` as ``plans.ingest`` makes them. Without ``emb`` their vectors are made as they
    are needed, of all chunks for the vector list, then of a query's pool. Filters
    apply before any list is cut. ``embed`` is the query embedder that the chunks were embedded with; without
    it there is no vector list. ``min_score`` None adapts to each query. ``fuzzy`` lets the gate
    of trigram hits count misspelt tokens, within an edit or two or, with "ratio", by their edit ratio. ``synonyms``
    (key, synonym) expand the queries; None takes the library's own. Lists, pools and hits, a few hundred
    rows a query, are written (``sources.tables.written``), so that no step's plan holds another's.
    """
    for f in label_filters:
        chunks = labels.having(chunks, bridge, f["ns"], f.get("code"), f.get("prefix"), "id")
    queries = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = written(queries, "queries")
    synonyms = Y.table(queries.sparkSession) if synonyms is None else synonyms
    variants = written(retrieval.expanded(queries, synonyms), "variants") if expand else queries.select("query_id", F.lit(1).alias("variant"), T.normalize_query(F.col("text")).alias("text"))
    stored, passage = "emb" in chunks.columns, F.concat(F.lit("passage: "), "text")
    # each variant is a query of its own until the best score of each document is taken
    v = variants.select(F.struct("query_id", "variant").alias("query_id"), "text")
    body = chunks.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "section", "text").alias("text"))
    back = lambda d, s: d.select(F.col("query_id.query_id").alias("query_id"), F.lit(s).alias("signal"), "doc_id", "score")
    lists = back(retrieval.lexical(v, body, retrieval.DEPTH["fts"]), "fts")
    grams = v.where(retrieval.wants_trigrams(F.col("text")))
    lists = lists.unionByName(back(retrieval.trigram(grams, body, retrieval.DEPTH["trgm"]), "trgm"))
    if embed is not None:
        qv = v.select("query_id", embed(F.concat(F.lit("query: "), "text")).alias("vec"))
        made = None if stored else getattr(embed, "rows", None)
        vec = F.col("emb") if stored else F.coalesce(passage, F.lit("")) if made else embed(passage)
        near = retrieval.vector(qv, chunks.select(F.col("id").alias("doc_id"), vec.alias("vec"), F.col("importance_score").alias("importance")), retrieval.DEPTH["vec"], made=made)
        lists = lists.unionByName(back(near, "vec"))
    # the lists are short (a few hundred rows a query) and used many times: kept, so that no plan holds them twice
    lists = written(retrieval.ranked(lists), "lists")
    # chunks meet the listed ids where they are read: no text is shuffled but those of the lists
    listed = chunks.withColumnRenamed("id", "doc_id").join(retrieval._small(lists.select("doc_id").distinct()), "doc_id", "left_semi")
    info = listed.select("doc_id", "book", "section", "page", "text", F.col("importance_score").alias("importance"), "is_parent", "parent_group", *(["emb"] if stored and embed is not None else []))
    wide = lists.groupBy("query_id", "doc_id").pivot("signal", ["vec", "fts", "trgm"]).agg(F.max("score"))
    x = written(wide.join(info, "doc_id").join(queries.withColumnRenamed("text", "q"), "query_id"), "candidates")
    head = F.concat_ws(" ", "section", F.substring("text", 1, retrieval.HEAD_CHARS))
    near = (lambda a, b: Z.overlap(a, b, Z.GATE_EASE)) if fuzzy == "ratio" else T.fuzzy_overlap if fuzzy else T.overlap
    overlaps = x.select("query_id", "doc_id", near(T.tokens(T.normalize(F.col("q"))), T.tokens(head)).alias("overlap"))
    want = max(80, 6 * top_k)
    pool = retrieval.topped_up(retrieval.gated(lists, queries, overlaps, want), lists, want)
    x = pool.join(x, ["query_id", "doc_id"])
    x = x.withColumn("rerank", retrieval.lexical_reranker(F.col("q"), F.col("section"), F.col("text")) if rerank else F.lit(0.0))
    order = [F.desc("rerank"), F.desc("fused"), F.col("pos"), F.col("doc_id")] if rerank else [F.col("pos")]
    x = x.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    x = retrieval.final_scores(x, reranked=rerank)
    if wanted is not None and bridge is not None:
        x = retrieval.label_boost(x, bridge, wanted)
    x = written(x, "pool")
    if diversify and top_k >= 3 and embed is not None:
        qvec = queries.select("query_id", embed(F.concat(F.lit("query: "), "text")).alias("query_vec"))
        vec = F.col("emb") if stored else embed(passage)
        picks = retrieval.mmr(x.select("query_id", "doc_id", "pos", vec.alias("vec"), F.col("parent_group").alias("group")).join(qvec, "query_id"), top_k)
        x = x.join(picks, ["query_id", "doc_id"]).withColumn("pos", F.col("mmr_rank"))
    floor = F.lit(min_score) if min_score is not None else retrieval.T.adaptive_min_score(F.size(T.stem_tokens(F.col("q"))))
    x = x.where((F.col("pos") <= top_k) & (F.col("score") >= floor)).withColumn("rnk", F.row_number().over(W.partitionBy("query_id").orderBy("pos")))
    out = x.select("query_id", "rnk", F.col("doc_id").alias("id"), "book", "section", "page", "text", "score", "vec", "fts", "trgm", "rerank", "importance", "is_parent")
    if context_window:
        out = written(out, "hits")
        wide_text = context.widened(out.select("query_id", "rnk", "id"), chunks, context_window).select("query_id", "rnk", F.col("text").alias("wide"))
        out = out.join(wide_text, ["query_id", "rnk"]).withColumn("text", F.col("wide")).drop("wide")
    return out


def answer(queries: DataFrame, chunks: DataFrame, answerer=None, **kw) -> DataFrame:
    """(query_id, answer, context, grounding, confidence, fallback, question_type, citations): search and its answer.

    ``answerer`` is a column function of (question, context); by default the answer is extractive. Small talk
    and questions outside the domain get no answer.
    """
    hits = written(search(queries, chunks, **kw), "answered-hits")
    gate = retrieval.domain_gate(hits, queries)
    q = queries.join(gate, "query_id").withColumn("chat", T.is_smalltalk(F.col("text"))).withColumn("question_type", T.question_type(F.col("text")))
    ctx = answers.context(hits.select("query_id", "id", "book", "section", "page", "text", "score", "is_parent"))
    q = q.join(ctx, "query_id", "left").join(answers.extractive(hits), "query_id", "left")
    if answerer is not None:
        q = q.withColumn("answer", answerer(F.col("text"), F.col("context")))
    q = q.withColumn("answer", F.when(F.col("in_domain") & ~F.col("chat"), F.col("answer")))
    g = answers.grounding(q.select("query_id", "answer"), hits.select("query_id", "rnk", "text"), fuzzy=kw.get("fuzzy") == "ratio")
    q = q.join(g, "query_id")
    c = answers.confidence(hits.select("query_id", "rnk", "score"), q.select("query_id", "answer", "grounding"))
    cites = answers.citations(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "book", "section", "page", "relevance", "is_parent"))).alias("citations"))
    return q.join(c, "query_id").join(cites, "query_id", "left").select("query_id", "answer", "context", "grounding", "confidence", answers.needs_fallback(F.col("confidence"), F.col("grounding")).alias("fallback"), "question_type", "citations")


def embedder(dim: int = 256):
    return V.hashing_embedder(dim)
