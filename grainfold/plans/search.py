"""Queries: vector search, BM25, hybrid retrieval, and what follows retrieval up to the prompt."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions.vectors import normalised
from grainfold.operators import ranking, retrieval
from grainfold.operators.embedding import hashing
from grainfold.operators.vector_index import VectorIndex
from grainfold.plans import base as B
from grainfold.plans.base import query, table, text_queries
from grainfold.session import scratch_dir


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def vector_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("SELECT label % 2 AS part, count(*) AS n, min(len(embedding))::INT AS dim FROM embeddings GROUP BY 1")
def vector_index(spark, sf_dir):
    """Vectors added to an index in two parts, with their dimension checked."""
    rows = table(spark, sf_dir, "embeddings").withColumn("part", F.col("label") % 2)
    index = retrieval.added(retrieval.added(None, rows.where("part = 0"), 64), rows.where("part != 0 OR part IS NULL"), 64)
    return index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dim"))


DENSE = f"""SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({B.dot("q.embedding", "d.embedding")}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0"""
TOP_DENSE = "SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM ({DENSE}) QUALIFY rank < {k}"


def top_dense(k: int) -> str:
    return TOP_DENSE.format(DENSE=DENSE, k=k)


@query(top_dense(10))
def vector_search(spark, sf_dir):
    return retrieval.vector_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 10)


BY_LABEL = f"""SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({B.dot("q.embedding", "d.embedding")}, 6) AS score FROM embeddings q JOIN embeddings d ON q.label IS NOT DISTINCT FROM d.label WHERE q.vec_id % 20 = 0"""


@query(f"SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM ({BY_LABEL}) QUALIFY rank < 5")
def corpus_vectors(spark, sf_dir):
    """Vectors stored by label in two additions; each query looks at those of its label."""
    rows = table(spark, sf_dir, "embeddings").withColumn("corpus_id", F.coalesce("label", F.lit(-1)))
    path = f"{scratch_dir(spark)}/vectors-{uuid.uuid4().hex}"
    stored = rows.select("corpus_id", F.col("vec_id").alias("doc_id"), "embedding")
    VectorIndex.add(stored.where("doc_id % 2 = 0"), path)
    index = VectorIndex.add(stored.where("doc_id % 2 != 0"), path)
    asked = rows.where("vec_id % 20 = 0").select("corpus_id", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_search(asked, index, 5)


@query("SELECT vec_id AS doc_id, label AS corpus_id, list_transform(embedding, lambda x: round(x::DOUBLE, 9)) AS embedding FROM embeddings WHERE label % 3 = 1 AND vec_id % 7 = 0")
def stored_vectors(spark, sf_dir):
    """Vectors of some corpora taken back out of the stored blocks, without a read of the others' folders."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("corpus_id"), F.col("vec_id").alias("doc_id"), "embedding")
    index = VectorIndex.add(rows, f"{scratch_dir(spark)}/vectors-{uuid.uuid4().hex}")
    found = index.vectors(rows.where("corpus_id % 3 = 1 AND doc_id % 7 = 0").select("corpus_id", "doc_id"))
    return found.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 9)))


@query(f"SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / greatest(sqrt({B.dot('embedding', 'embedding')}), 1e-12), 9)) AS unit FROM embeddings")
def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(normalised(F.col("embedding")), lambda x: F.round(x, 9)).alias("unit"))


@query(f"""WITH RECURSIVE h AS ({top_dense(20)}), v AS (SELECT h.*, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt({B.dot("embedding", "embedding")}), 1e-12)) AS u FROM h JOIN embeddings ON vec_id = doc_id),
near AS (SELECT a.query_id, a.rank, any_value(a.doc_id) AS doc_id, any_value(a.score) AS score, list({B.dot("a.u", "b.u")} ORDER BY b.rank) AS sims FROM v a JOIN v b USING (query_id) GROUP BY a.query_id, a.rank),
pick AS (SELECT query_id, 0 AS n, []::INT[] AS sel FROM near WHERE rank = 0 UNION ALL
  SELECT p.query_id, any_value(p.n) + 1, list_append(any_value(p.sel), first(c.rank ORDER BY round(CASE WHEN n = 0 THEN score ELSE 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * list_max(list_transform(sel, lambda j: sims[j + 1])) END, 9) DESC, c.rank))
  FROM pick p JOIN near c ON c.query_id = p.query_id AND NOT list_contains(p.sel, c.rank) GROUP BY p.query_id),
last AS (SELECT query_id, sel FROM pick QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1), places AS (SELECT query_id, unnest(sel) AS was, unnest(generate_series(0, len(sel) - 1))::INT AS rank FROM last)
SELECT p.query_id, doc_id, score, p.rank FROM places p JOIN near n ON n.query_id = p.query_id AND n.rank = p.was""")
def diversified_search(spark, sf_dir):
    hits = retrieval.vector_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 20)
    return retrieval.diversify(hits.join(vectors(spark, sf_dir), "doc_id"))


@query(f"""WITH h AS ({top_dense(10)}), v AS (SELECT h.query_id, h.rank, e.embedding FROM h JOIN embeddings e ON e.vec_id = h.doc_id),
p AS (SELECT a.query_id, a.rank < 5 AND b.rank < 5 AS near, {B.dot("a.embedding", "b.embedding")} AS s FROM v a JOIN v b ON a.query_id = b.query_id AND a.rank < b.rank),
q AS (SELECT query_id, avg(s) FILTER (WHERE near) AS mean, max(s) FILTER (WHERE near) AS highest, avg(s) AS mean_all FROM p GROUP BY query_id),
t AS (SELECT round(avg(mean), 6) AS mean_similarity, round(avg(highest), 6) AS mean_highest, round(avg(mean_all), 6) AS mean_similarity_all, round(avg((highest >= 0.9)::INT), 6) AS dup_share FROM q)
SELECT *, CASE WHEN dup_share >= 0.6 THEN 'HIGH' WHEN dup_share >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS verdict FROM t""")
def redundancy_probe(spark, sf_dir):
    hits = retrieval.vector_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 10).join(vectors(spark, sf_dir), "doc_id")
    return retrieval.redundancy(hits)


HASHED = f"""{B.hashed("documents", "doc_id", "text", "v")}, {B.hashed("benchmark", "item_id", "text", "a")}, s AS (SELECT item_id AS query_id, doc_id, sum(a.x * v.x) AS score FROM a JOIN v USING (cell) GROUP BY ALL),
r AS (SELECT b.item_id AS query_id, d.doc_id, round(coalesce(score, 0), 6) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN s ON s.query_id = b.item_id AND s.doc_id = d.doc_id)"""


@query(f"WITH {HASHED} SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM r QUALIFY rank < 10")
def dense_search(spark, sf_dir):
    return retrieval.dense_search(text_queries(spark, sf_dir), table(spark, sf_dir, "documents"), hashing(), 10)


BM25 = B.bm25(10, "documents", "(SELECT item_id AS query_id, text FROM benchmark)")


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_search(spark, sf_dir):
    return retrieval.bm25(text_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 10)


def fused_sql(dense: str) -> str:
    return f"""f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS r1, b.rank AS r2,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM {dense} a FULL JOIN bm25 b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, r1 NULLS LAST, r2 NULLS LAST) - 1)::INT AS rank FROM f QUALIFY rank < 10"""


@query(f"WITH {BM25}, {B.overlap(10)}, {fused_sql('dense')}")
def hybrid_search(spark, sf_dir):
    """A model-free dense list (shared words) fused with BM25."""
    queries, docs = text_queries(spark, sf_dir), table(spark, sf_dir, "documents")
    return retrieval.fuse(retrieval.overlap_search(queries, docs, 10), retrieval.bm25(queries, docs, 10), 10)


@query(f"WITH {BM25}, {HASHED}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM r QUALIFY rank < 10), {fused_sql('h')}")
def hybrid_vectors(spark, sf_dir):
    return retrieval.hybrid()(text_queries(spark, sf_dir), table(spark, sf_dir, "documents"), hashing(), 10)


def overlap_hits(spark, sf_dir, k: int) -> DataFrame:
    return retrieval.overlap_search(text_queries(spark, sf_dir), table(spark, sf_dir, "documents"), k)


def with_texts(hits: DataFrame, spark, sf_dir) -> DataFrame:
    return retrieval.joined_to(hits, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(text_queries(spark, sf_dir), "query_id")


@query(f"""WITH {BM25}, t AS (SELECT bm25.query_id, doc_id, bm25.rank AS was, list_distinct({B.tokens("d.text")}) AS t, list_distinct({B.tokens("b.text")}) AS q FROM bm25 JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = bm25.query_id),
s AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_intersect(t, q)) / sqrt(len(t)) ELSE 0 END AS score FROM t)
SELECT query_id, doc_id, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, was) - 1)::INT AS rank FROM s QUALIFY rank < 5""")
def reranked(spark, sf_dir):
    hits = with_texts(retrieval.bm25(text_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 10), spark, sf_dir)
    return ranking.lexical_reranker()(hits, 5).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank < 3""")
def first_hits(spark, sf_dir):
    return ranking.keep_order()(retrieval.bm25(text_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 10), 3)


@query(f"""WITH {B.overlap(10)}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM dense)
SELECT query_id, doc_id, rank::INT AS forward, (n - 1 - rank)::INT AS reverse, (CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END)::INT AS sides FROM n""")
def repacking(spark, sf_dir):
    hits = overlap_hits(spark, sf_dir, 10).withColumn("n", ranking.count_window())
    return hits.select("query_id", "doc_id", *[ranking.repacked(F.col("rank"), F.col("n"), k).cast("int").alias(k) for k in ("forward", "reverse", "sides")])


#: The best half of a document's sentences by x.score, in reading order; texts of one sentence, and without a query, stay.
SHORTENED = """m AS (SELECT doc_id, len(s) AS n FROM d), k AS (SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place, n FROM x JOIN m USING (doc_id)),
j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY i) AS short FROM k WHERE place <= ceil(0.5 * n) GROUP BY doc_id),
o AS (SELECT d.doc_id, CASE WHEN len(s) <= 1 OR {plain} THEN text ELSE short END AS text FROM d LEFT JOIN j USING (doc_id))
SELECT doc_id, length(text) AS n, md5(text) AS text_md5 FROM o"""
#: Each document's own beginning is its query.
SPLIT = f"""d AS (SELECT doc_id, text, substring(text, 1, 80) AS q, list_distinct({B.tokens("substring(text, 1, 80)")}) AS qt, {B.sentences("text")} AS s FROM documents),
e AS (SELECT doc_id, qt, unnest(s) AS sentence, unnest(generate_series(1, len(s))) AS i FROM d WHERE len(s) > 0)"""


def beginnings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 1, 80).alias("query"))


def digest(short: DataFrame) -> DataFrame:
    return short.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


@query(f"""WITH {SPLIT}, t AS (SELECT *, list_distinct({B.tokens("sentence")}) AS t FROM e), x AS (SELECT doc_id, i, sentence, CASE WHEN len(t) > 0 THEN len(list_intersect(t, qt)) / sqrt(len(t)) ELSE 0 END AS score FROM t),
{SHORTENED.format(plain="len(qt) = 0")}""")
def compression(spark, sf_dir):
    return digest(ranking.lexical_summarizer()(beginnings(spark, sf_dir)))


@query(f"""WITH {SPLIT}, {B.hashed("e", "doc_id, i", "sentence", "v")}, {B.hashed("d", "doc_id", "q", "a")}, p AS (SELECT v.doc_id, i, round(sum(a.x * v.x), 9) AS score FROM a JOIN v USING (doc_id, cell) GROUP BY ALL),
x AS (SELECT e.doc_id, e.i, sentence, coalesce(score, 0) AS score FROM e LEFT JOIN p USING (doc_id, i)), {SHORTENED.format(plain="false")}""")
def compression_vectors(spark, sf_dir):
    return digest(ranking.embedding_summarizer()(beginnings(spark, sf_dir)))


@query(rf"""WITH q AS (SELECT conv_id, turn, lower({B.strip("coalesce(text, '')")}) AS q FROM conversations), c AS (SELECT *, len(regexp_extract_all(q, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')) AS n,
 contains(q, 'hello') OR contains(q, 'hi ') OR contains(q, 'hey') OR contains(q, 'thanks') OR contains(q, 'thank you') OR contains(q, 'bye') OR regexp_matches(q, 'good (morning|evening|night)') AS talk FROM q)
SELECT conv_id, turn, NOT (q = '' OR n < 3 OR talk) AS needs_retrieval, CASE WHEN q = '' THEN 1.0 WHEN n < 3 THEN 0.8 WHEN talk THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, true AS always FROM c""")
def query_classes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", ranking.heuristic()(F.col("text")).alias("c"), ranking.always()(F.col("text"))["needs_retrieval"].alias("always")).select("conv_id", "turn", "c.*", "always")


@query(f"""WITH {B.overlap(3)}, t AS (SELECT query_id, string_agg('[' || (rank + 1) || '] ' || text, chr(10) ORDER BY rank) AS context, string_agg(text, chr(10) ORDER BY rank) AS plain FROM dense JOIN documents USING (doc_id) GROUP BY query_id),
k AS (SELECT * FROM (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in ranking.INSTRUCTIONS.items())}) AS v(kind, instruction)),
p AS (SELECT query_id, kind, plain, CASE WHEN instruction = '' THEN '' ELSE instruction || chr(10) || chr(10) END || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS p FROM t JOIN benchmark ON item_id = query_id, k)
SELECT query_id, kind, length(p) AS prompt_chars, md5(p) AS prompt_md5, md5(plain) AS context_md5 FROM p""")
def prompts(spark, sf_dir):
    hits = retrieval.joined_to(overlap_hits(spark, sf_dir, 3), table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    asked = ranking.in_order(hits).join(text_queries(spark, sf_dir), "query_id")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), ranking.prompt(F.col("texts"), F.col("query"), v).alias("p")) for k, v in ranking.INSTRUCTIONS.items()]))
    made = asked.select("query_id", ranking.context(F.col("texts")).alias("context"), kinds.alias("k"))
    return made.select("query_id", "k.kind", F.length("k.p").alias("prompt_chars"), F.md5("k.p").alias("prompt_md5"), F.md5("context").alias("context_md5"))
