"""Index, search, chunks and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.language import detect_language
from ..operators import neardup as N
from ..operators import retrieval as R
from ..operators.relate import tool_limit
from ..session import cut_lineage, scratch_path
from . import frames as T
from .columns import _cosine_sql, _letter_sql
from .frames import sql_words, with_sql
from .registry import query


def counts_sql(name: str, source: str, key: str, text: str) -> str:
    """(id, bucket, n) of the hashed words, and the length of each vector."""
    return f"""{name}_words AS (
        SELECT {key} AS id, unnest({sql_words(text)}) AS word FROM {source}),
    {name} AS (
        SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % {R.DIMS} AS bucket, count(*) AS n
        FROM {name}_words GROUP BY ALL),
    {name}_norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY id)"""


def hits_sql(k: int, same: str = "") -> str:
    """Top k of corpus ``c`` for queries ``q`` by cosine; pairs without a shared word score 0.

    Queries without words have no norm and no hits.
    """
    return f"""dots AS (
        SELECT q.id AS qid, c.id AS cid, sum(q.n * c.n) AS dot
        FROM q JOIN c ON q.bucket = c.bucket GROUP BY ALL),
    scored AS (
        SELECT qs.id AS query_id, cs.id AS corpus_id,
               coalesce(round(dot / (qn.norm * cn.norm), {R.SCORE_DIGITS}), 0) AS score
        FROM qs JOIN q_norm qn ON qn.id = qs.id CROSS JOIN cs
        LEFT JOIN dots ON qid = qs.id AND cid = cs.id
        LEFT JOIN c_norm cn ON cn.id = cs.id {same}),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id
                                     ORDER BY score DESC, corpus_id) AS rank FROM scored),
    hits AS (SELECT query_id, rank, corpus_id, round(score, 6) AS score
             FROM ranked WHERE rank <= {k})"""


def documents_index(spark, tables):
    docs = T.scan(spark, tables, "documents").withColumnRenamed("lang", "language")
    return R.build_search_index(docs, "doc_id", "text", ["language", "source"]).withColumnRenamed(
        "doc_id", "corpus_id"
    )


def benchmark_queries(spark, tables):
    items = T.scan(spark, tables, "benchmark")
    return R.embed(items, "text").select(F.col("item_id").alias("query_id"), "embedding")


@query(
    "build_search_index",
    "WITH "
    + counts_sql("c", "documents", "doc_id", "text")
    + """ SELECT id AS doc_id, lang AS language, source, bucket AS dim,
           round(n / norm, 6) AS value
    FROM c JOIN c_norm USING (id) JOIN documents ON doc_id = id""",
)
def build_search_index(spark, tables):
    index = documents_index(spark, tables)
    flat = index.select(
        F.col("corpus_id").alias("doc_id"), "language", "source",
        F.posexplode_outer("embedding").alias("dim", "value"),
    )
    return flat.filter("value > 0").select(
        "doc_id", "language", "source", F.col("dim").cast("bigint").alias("dim"),
        F.round("value", 6).alias("value"),
    )


BENCHMARK_HITS = (
    "WITH "
    + counts_sql("q", "benchmark", "item_id", "text")
    + ", "
    + counts_sql("c", "documents", "doc_id", "text")
    + ", qs AS (SELECT item_id AS id FROM benchmark), cs AS (SELECT doc_id AS id FROM documents), "
)


@query("vector_topk", BENCHMARK_HITS + hits_sql(V.TOP_K) + " SELECT * FROM hits")
def vector_topk(spark, tables):
    corpus = documents_index(spark, tables).select("corpus_id", "embedding")
    return R.vector_topk(corpus, benchmark_queries(spark, tables))


@query(
    "vector_topk_filtered",
    "WITH counted AS (SELECT *, ["
    + ", ".join(_letter_sql(ch) for ch in V.LETTERS)
    + "]::BIGINT[] AS counts FROM benchmark), shared AS (SELECT *, list_transform(counts,"
    + " lambda c: CASE WHEN list_sum(counts) = 0 THEN 0.0::DOUBLE"
    + " ELSE c::DOUBLE / list_sum(counts)::DOUBLE END) AS shares FROM counted), "
    + f"""asked AS (SELECT item_id, CASE WHEN {_cosine_sql(V.LETTER_SHARE_EN)}
                                        > {_cosine_sql(V.LETTER_SHARE_DE)}
                                   THEN 'en' ELSE 'de' END AS language FROM shared), """
    + counts_sql("q", "benchmark", "item_id", "text")
    + ", "
    + counts_sql("c", "documents", "doc_id", "text")
    + """, qs AS (SELECT item_id AS id, language, 'src' || item_id % 4 AS source FROM asked),
    cs AS (SELECT doc_id AS id, lang AS language, source FROM documents), """
    + hits_sql(V.TOOL_TOP_K, "WHERE qs.language = cs.language AND qs.source = cs.source")
    + " SELECT * FROM hits",
)
def vector_topk_filtered(spark, tables):
    """Search among the documents in the guessed language and of the source of each query."""
    asked = detect_language(T.scan(spark, tables, "benchmark")).select(
        F.col("item_id").alias("query_id"),
        "language",
        F.concat(F.lit("src"), F.col("item_id") % 4).alias("source"),
    )
    queries = benchmark_queries(spark, tables).join(asked, "query_id")
    path = scratch_path(spark, "index")
    R.write_index(documents_index(spark, tables), path)
    index = R.read_index(spark, path, ["corpus_id", "embedding", "language", "source"])
    return R.vector_topk(index, queries, tool_limit(None), ["language", "source"])


@query(
    "join_query_corpus",
    BENCHMARK_HITS
    + hits_sql(1)
    + """ SELECT query_id, (SELECT count(*) FROM documents) AS n_compared,
           corpus_id AS best_id, score AS best_score FROM hits""",
)
def join_query_corpus(spark, tables):
    corpus = documents_index(spark, tables).select("corpus_id", "embedding")
    return R.compared_with_corpus(corpus, benchmark_queries(spark, tables))


def label_centroids(spark, tables):
    """Mean vector per label of the given embeddings, as a query each."""
    vectors = T.scan(spark, tables, "embeddings")
    dims = vectors.select("label", F.posexplode_outer("embedding").alias("dim", "value"))
    means = dims.groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", "value")))
    return means.groupBy("label").agg(
        F.transform(ordered, lambda d: d["value"]).alias("embedding")
    ).withColumnRenamed("label", "query_id")


def given_vectors(spark, tables):
    return T.scan(spark, tables, "embeddings").select(F.col("vec_id").alias("corpus_id"), "embedding")


@query(
    "vector_topk_external",
    f"""WITH flat AS (
        SELECT vec_id, label, unnest(embedding)::DOUBLE AS value,
               unnest(range(len(embedding))) AS dim FROM embeddings),
    means AS (SELECT label, dim, avg(value) AS value FROM flat GROUP BY ALL),
    qn AS (SELECT label, sqrt(sum(value * value)) AS norm FROM means GROUP BY label),
    cn AS (SELECT vec_id, sqrt(sum(value * value)) AS norm FROM flat GROUP BY vec_id),
    scored AS (
        SELECT m.label, f.vec_id,
               round(sum(m.value * f.value) / (any_value(qn.norm) * any_value(cn.norm)),
                     {R.SCORE_DIGITS}) AS score
        FROM means m JOIN flat f ON m.dim = f.dim JOIN qn ON qn.label = m.label
        JOIN cn ON cn.vec_id = f.vec_id GROUP BY m.label, f.vec_id)
    SELECT label::BIGINT AS query_id, rank, vec_id AS corpus_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank
        FROM scored) WHERE rank <= {V.TOP_K}""",
)
def vector_topk_external(spark, tables):
    return R.vector_topk(given_vectors(spark, tables), label_centroids(spark, tables))


@query(
    "vector_topk_approx",
    f"""SELECT DISTINCT label::BIGINT AS query_id,
           least({V.TOP_K}, (SELECT count(*) FROM embeddings)) AS n_hits,
           true AS exact_scores, true AS found_enough
    FROM embeddings""",
)
def vector_topk_approx(spark, tables):
    """Per query: hits, whether all scores are the cosines of their pairs, and recall of 0.95."""
    corpus, queries = given_vectors(spark, tables), label_centroids(spark, tables)
    hits = cut_lineage(R.vector_topk_approx(corpus, queries), "hits")
    right = F.abs(F.col("score") - F.col("cosine")) < 2e-6
    checked = R.with_cosine(hits, corpus, queries).groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.min(right).alias("exact_scores")
    )
    recalled = R.recall(hits, R.vector_topk(corpus, queries))
    return checked.join(recalled, "query_id").select(
        "query_id", "n_hits", "exact_scores", (F.col("recall") >= 0.95).alias("found_enough")
    )


@query(
    "retrieve_text_chunks",
    "WITH asked AS (SELECT item_id, text FROM benchmark UNION ALL"
    " SELECT -1 - item_id, CASE WHEN item_id % 2 = 0 THEN '' ELSE '!! ?' END FROM benchmark), "
    + counts_sql("q", "asked", "item_id", "text")
    + ", "
    + counts_sql("c", "documents", "doc_id", "text")
    + ", qs AS (SELECT item_id AS id FROM asked), cs AS (SELECT doc_id AS id FROM documents), "
    + hits_sql(V.TOP_K)
    + f""" SELECT item_id AS query_id, count(text) AS n_chunks,
           coalesce(string_agg(text, '{chr(10)}' ORDER BY rank), '') AS chunks
    FROM (SELECT item_id FROM asked) LEFT JOIN hits ON query_id = item_id
    LEFT JOIN (SELECT * FROM documents WHERE length(text) > 0) ON doc_id = corpus_id
    GROUP BY item_id""",
)
def retrieve_text_chunks(spark, tables):
    """Every item asks twice, once without a word; those queries get no text."""
    corpus = documents_index(spark, tables).select("corpus_id", "embedding")
    items = T.scan(spark, tables, "benchmark")
    silent = items.select(
        (-1 - F.col("item_id")).alias("item_id"),
        F.when(F.col("item_id") % 2 == 0, "").otherwise("!! ?").alias("text"),
    )
    both = items.select("item_id", "text").unionByName(silent)
    queries = R.embed(both, "text").select(F.col("item_id").alias("query_id"), "embedding")
    texts = T.scan(spark, tables, "documents").select(F.col("doc_id").alias("corpus_id"), "text")
    lists = R.retrieve_text_chunks(queries, R.vector_topk(corpus, queries), texts, "text")
    return lists.select(
        "query_id",
        F.size("chunks").cast("bigint").alias("n_chunks"),
        F.array_join("chunks", "\n").alias("chunks"),
    )


@query(
    "refresh_index",
    """SELECT doc_id, lang AS language, l.doc_id IS NULL AS refreshed, 1.0::DOUBLE AS norm
    FROM documents LEFT JOIN labels l USING (doc_id) WHERE regexp_matches(text, '[A-Za-zÀ-ÿ0-9]')""",
)
def refresh_index(spark, tables):
    """An index of the labelled documents brought up to all documents."""
    docs = T.scan(spark, tables, "documents").withColumnRenamed("lang", "language")
    labels = T.scan(spark, tables, "labels")
    known = R.build_search_index(
        docs.join(labels, "doc_id", "left_semi"), "doc_id", "text", ["language"]
    )
    fresh = R.refresh_index(known, docs, "doc_id", "text", ["language"])
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v * v)
    return fresh.select("doc_id", "language", "refreshed", F.round(norm, 6).alias("norm"))


@query(
    "chunk_documents",
    """WITH sized AS (SELECT doc_id, lang, text,
                          greatest(ceil((length(text) - 50) / 450), 1)::BIGINT AS n FROM documents
                   WHERE length(text) > 0),
    numbered AS (SELECT doc_id, lang, text, unnest(range(n)) AS chunk_no FROM sized)
    SELECT doc_id, lang, chunk_no, substr(text, chunk_no * 450 + 1, 500) AS chunk_text
    FROM numbered""",
)
def chunk_documents(spark, tables):
    return R.chunk_documents(T.scan(spark, tables, "documents"), "doc_id", "text", ["lang"])


@query(
    "build_kb_articles",
    with_sql("pairs")
    + """ SELECT ticket_id AS kb_id, conv_id AS source_ticket_id, body AS body_question,
           answer AS body_answer FROM answered""",
)
def build_kb_articles(spark, tables):
    return R.build_kb_articles(T.answered_tickets(spark, tables))


# --- near duplicates ------------------------------------------------------------------------------

SHINGLE_LINKS = f"""worded AS (
        SELECT doc_id AS id, {sql_words('text')} AS w FROM documents),
    shingles AS (
        SELECT DISTINCT id, unnest(
            CASE WHEN len(w) >= 3
                 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                 ELSE [array_to_string(w, ' ')] END) AS s
        FROM worded WHERE len(w) > 0),
    sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
    pairs AS (
        SELECT x.id AS a, y.id AS b, count(*) AS shared
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN sizes na ON na.id = a JOIN sizes nb ON nb.id = b
        WHERE shared / sqrt(na.n::DOUBLE * nb.n) >= {V.NEAR_DUPLICATE_COSINE} - 1e-12)"""
CLUSTERS = (
    "WITH RECURSIVE "
    + SHINGLE_LINKS
    + """, both_ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
    reach AS (
        SELECT u, v FROM both_ways
        UNION SELECT r.u, n.v FROM reach r JOIN both_ways n ON n.u = r.v),
    clusters AS (SELECT u AS doc_id, least(u, min(v)) AS cluster FROM reach GROUP BY u)"""
)
KEPT = CLUSTERS + """, member AS (
        SELECT doc_id, text, coalesce(cluster, doc_id) AS cluster
        FROM documents LEFT JOIN clusters USING (doc_id)),
    kept AS (SELECT doc_id, cluster, length(text) AS size FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster
                                     ORDER BY length(text) DESC, doc_id) AS rn FROM member)
        WHERE rn = 1)"""


@query(
    "dedup_near_pairs",
    CLUSTERS
    + """, sets AS (SELECT id, string_agg(s, '|' ORDER BY s) AS own FROM shingles GROUP BY id),
    copied AS (SELECT own, count(*) > 1 AS copied FROM sets GROUP BY own)
    SELECT doc_id, cluster, copied AS has_copy, count(*) OVER (PARTITION BY cluster) AS members
    FROM clusters JOIN sets ON id = doc_id JOIN copied USING (own)""",
)
def dedup_near_pairs(spark, tables):
    """Per document with a near duplicate: its cluster, whether it has a copy, the cluster's size.

    Which edges link a group is up to the algorithm; what they lead to is not.
    """
    edges = cut_lineage(
        N.near_pairs(T.scan(spark, tables, "documents"), "doc_id", "text"), "edges"
    )
    clusters = N.connected_components(edges)
    same = edges.filter("cosine > 1 - 1e-12")
    copies = same.select(F.col("a").alias("id")).union(same.select("b")).distinct()
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    return (
        clusters.join(copies.withColumn("has_copy", F.lit(True)), "id", "left")
        .join(sizes, "cluster")
        .select(
            F.col("id").alias("doc_id"), "cluster",
            F.coalesce("has_copy", F.lit(False)).alias("has_copy"), "members",
        )
    )


@query("dedup_near_clusters", CLUSTERS + " SELECT * FROM clusters")
def dedup_near_clusters(spark, tables):
    return N.near_clusters(T.scan(spark, tables, "documents"), "doc_id", "text").withColumnRenamed(
        "id", "doc_id"
    )


@query("dedup_near_keep_best", KEPT + " SELECT doc_id, cluster, size FROM kept")
def dedup_near_keep_best(spark, tables):
    docs = T.scan(spark, tables, "documents")
    best = N.keep_best(docs, N.near_clusters(docs, "doc_id", "text"), "doc_id", "text")
    return best.select("doc_id", "cluster", F.length("text").cast("bigint").alias("size"))


@query(
    "dedup_near_report",
    KEPT
    + """, n AS (SELECT (SELECT count(*) FROM documents) AS documents,
                     (SELECT count(*) FROM kept) AS kept)
    SELECT *, documents - kept AS removed,
           round((documents - kept) / documents * 100, 6) AS removed_percentage FROM n""",
)
def dedup_near_report(spark, tables):
    docs = T.scan(spark, tables, "documents").select("doc_id", "text")
    best = N.keep_best(docs, N.near_clusters(docs, "doc_id", "text"), "doc_id", "text")
    return N.removal_report(docs, best)
