"""Queries: chunks, sentences, keys and figures about texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.operators import chunking, evaluation, judging, tables_in_sql
from grainfold.plans import base as B
from grainfold.plans.base import query, table


def checked(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", "chunk_id", F.md5("text").alias("text_md5"))


def chunked(spark, sf_dir, kind: str, **options) -> DataFrame:
    return checked(chunking.chunk(table(spark, sf_dir, "documents"), kind, **options))


@query(f"""WITH d AS (SELECT doc_id, {B.words("text")} AS w FROM documents), c AS (
SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 128) / 112.0)::INT))) AS k FROM d WHERE len(w) > 0)
SELECT doc_id, k::INT AS chunk_no, doc_id || '-' || k AS chunk_id, md5(array_to_string(w[k * 112 + 1 : k * 112 + 128], ' ')) AS text_md5 FROM c""")
def chunk_fixed(spark, sf_dir):
    return chunked(spark, sf_dir, "fixed", size=128, overlap=16)


@query(f"""WITH d AS (SELECT doc_id, {B.words("text")} AS w FROM documents), c AS (
SELECT doc_id, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 128) / 112.0)::INT))) AS k FROM d WHERE len(w) > 0)
SELECT doc_id, k::INT AS chunk_no, doc_id || '-' || k AS chunk_id, md5(array_to_string(w[k * 112 + 1 : k * 112 + 128], ' ')) AS text_md5 FROM c""")
def chunks_in_sql(spark, sf_dir):
    """The same chunks from a text of SQL over a table function."""
    tables_in_sql.register_table_functions(spark)
    return checked(spark.sql("SELECT * FROM fixed_chunks(TABLE(SELECT doc_id, text FROM {docs}) PARTITION BY (doc_id), 128, 16)", docs=table(spark, sf_dir, "documents")))


@query(f"SELECT doc_id, 0 AS chunk_no, doc_id || '-0' AS chunk_id, md5(text) AS text_md5 FROM documents WHERE {B.strip('text')} != ''")
def chunk_none(spark, sf_dir):
    return chunked(spark, sf_dir, "none")


@query(rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{B.BLANK}*\n'), lambda p: {B.strip('p')}), lambda p: p != '') AS p1,
  list_filter(list_transform(string_split(text, chr(10)), lambda p: {B.strip('p')}), lambda p: p != '') AS p2 FROM documents),
e AS (SELECT doc_id, CASE WHEN len(p1) > 1 THEN p1 ELSE p2 END AS p FROM d),
c AS (SELECT doc_id, p, unnest(generate_series(0, greatest(0, len(p) - 2))) AS k FROM e WHERE len(p) > 0)
SELECT doc_id, k::INT AS chunk_no, doc_id || '-' || k AS chunk_id, md5(array_to_string(p[k + 1 : k + 2], chr(10) || chr(10))) AS text_md5 FROM c""")
def chunk_paragraphs(spark, sf_dir):
    return chunked(spark, sf_dir, "paragraphs")


@query(f"""WITH d AS (SELECT doc_id, {B.strip("text")} AS t FROM documents), e AS (
SELECT doc_id, t, {B.strip("replace(substring(t, 1, 150), chr(10), ' ')")} || chr(10) || chr(10) AS head, unnest(generate_series(0, greatest(0, ceil((length(t) - 500) / 400.0)::INT))) AS k FROM d WHERE t != '')
SELECT doc_id, k::INT AS chunk_no, doc_id || '-' || k AS chunk_id, md5(head || substring(t, k * 400 + 1, 500)) AS text_md5 FROM e""")
def chunk_summary(spark, sf_dir):
    return chunked(spark, sf_dir, "summary", size=500, overlap=100)


def semantic_sql(cut: str) -> str:
    """cut: whether to cut behind sentence i, of near, dist and the document's sorted distances dd."""
    return f"""WITH d AS (SELECT doc_id, {B.sentences("text")} AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS sentence, unnest(generate_series(1, len(s))) AS i FROM d WHERE len(s) > 0),
{B.hashed("e", "doc_id, i", "sentence", "v")}, p AS (SELECT a.doc_id, a.i, sum(a.x * b.x) AS near FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.cell = b.cell GROUP BY ALL),
n AS (SELECT e.*, round(coalesce(near, 0), 9) AS near, count(*) OVER (PARTITION BY e.doc_id) AS n FROM e LEFT JOIN p USING (doc_id, i)),
t AS (SELECT doc_id, list_sort(list(1 - near)) AS dd FROM n WHERE i < n GROUP BY doc_id),
b AS (SELECT doc_id, dd, dd[1 + floor((len(dd) - 1) * 0.8)::INT] AS a1, dd[least(len(dd), 2 + floor((len(dd) - 1) * 0.8)::INT)] AS b1, (len(dd) - 1) * 0.8::DOUBLE - floor((len(dd) - 1) * 0.8::DOUBLE) AS f FROM t),
l AS (SELECT doc_id, CASE WHEN f < 0.5 THEN a1 + (b1 - a1) * f ELSE b1 - (b1 - a1) * (1 - f) END AS lim FROM b),
c AS (SELECT n.*, coalesce(i < n AND ({cut}), false) AS cut FROM n LEFT JOIN l USING (doc_id)),
g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS k FROM c)
SELECT doc_id, k AS chunk_no, doc_id || '-' || k AS chunk_id, md5(string_agg(sentence, ' ' ORDER BY i)) AS text_md5 FROM g GROUP BY doc_id, k"""


@query(semantic_sql("1 - near > lim"))
def chunk_semantic(spark, sf_dir):
    return chunked(spark, sf_dir, "semantic", percentile=80.0)


@query(semantic_sql("near < 0.3"))
def chunk_semantic_absolute(spark, sf_dir):
    return chunked(spark, sf_dir, "semantic", breakpoint="absolute", threshold=0.3)


@query(f"""WITH d AS (SELECT doc_id, {B.sentences("text")} AS s FROM documents), e AS (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM d WHERE len(s) > 0)
SELECT doc_id, '0' || {B.letters("i")} AS key, md5(s[i]) AS text_md5 FROM e""")
def sentence_keys(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.keyed_sentences(F.col("text"), F.lit("0"))).alias("k"))
    return keyed.select("doc_id", "k.key", F.md5("k.text").alias("text_md5"))


#: A conversation as an example: its turns but the last are the documents, the last one is the answer.
TURNS = "last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn = last AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations JOIN last USING (conv_id))"


def conversations(spark, sf_dir) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("t"))
    return whole.select("conv_id", F.slice("t", 1, F.size("t") - 1).alias("documents"), F.element_at("t", -1).alias("answer"))


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, answer, pos, {B.sentences("text")} AS s FROM t), e AS (SELECT conv_id, answer, pos, s, unnest(generate_series(1, len(s))) AS i FROM s WHERE len(s) > 0)
SELECT conv_id, answer, CASE WHEN answer THEN '' ELSE pos::VARCHAR END || {B.letters("i")} AS key, md5(s[i]) AS text_md5 FROM e""")
def judge_inputs(spark, sf_dir):
    seg = conversations(spark, sf_dir).select("conv_id", T.segmented(F.col("documents"), F.col("answer")).alias("s"))
    both = seg.select("conv_id", F.explode(F.concat(F.transform(F.flatten("s.documents"), lambda k: F.struct(F.lit(False).alias("answer"), k.alias("k"))), F.transform("s.response", lambda k: F.struct(F.lit(True).alias("answer"), k.alias("k"))))).alias("x"))
    return both.select("conv_id", "x.answer", "x.k.key", F.md5("x.k.text").alias("text_md5"))


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, answer, pos, {B.sentences("text")} AS s FROM t), e AS (SELECT conv_id, answer, pos, s, unnest(generate_series(1, len(s))) AS i FROM s WHERE len(s) > 0),
l AS (SELECT conv_id, answer, pos, i, CASE WHEN answer THEN '' ELSE pos::VARCHAR END || {B.letters("i")} || '. ' || s[i] AS line FROM e),
j AS (SELECT c.conv_id, coalesce(string_agg(line, chr(10) ORDER BY pos, i) FILTER (WHERE NOT answer), '') AS d, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE answer), '') AS r, count(line) FILTER (WHERE NOT answer) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l USING (conv_id) GROUP BY c.conv_id)
SELECT conv_id, n::INT AS n_sentences, md5(replace(replace(replace('{judging.QUESTION.replace("'", "''")}', '{{documents}}', d), '{{question}}', conv_id::VARCHAR), '{{response}}', r) || chr(10) || chr(10) || '{judging.CONSERVATIVE.replace("'", "''")}') AS prompt_md5 FROM j""")
def judge_prompts(spark, sf_dir):
    seg = conversations(spark, sf_dir).select("conv_id", T.segmented(F.col("documents"), F.col("answer")).alias("s"))
    asked = judging.judge_prompt(F.col("conv_id").cast("string"), F.col("s.documents"), F.col("s.response"), conservative=True)
    return seg.select("conv_id", judging.total_sentences(F.col("s.documents")).alias("n_sentences"), F.md5(asked).alias("prompt_md5"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def distinct_documents(spark, sf_dir):
    return chunking.distinct_documents(table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("text_md5"))


def statistics_sql(by: str, rows: str) -> str:
    """rows: a relation (by, documents)."""
    return f"""r AS ({rows}), e AS (SELECT {by}, count(*) AS n, median(len(documents))::DOUBLE AS docs_median, max(len(documents))::INT AS docs_max FROM r GROUP BY ALL),
w AS (SELECT {by}, len({B.words("d")}) AS words FROM (SELECT {by}, unnest(documents) AS d FROM r)), l AS (SELECT {by}, list_sort(list(words)) AS w FROM w GROUP BY ALL),
p AS (SELECT {by}, w[1 + round_even(0.5 * (len(w) - 1), 0)::INT]::INT AS words_median, w[1 + round_even(0.95 * (len(w) - 1), 0)::INT]::INT AS words_p95, w[len(w)]::INT AS words_max FROM l)
SELECT e.*, words_median, words_p95, words_max, CASE WHEN words_median IS NULL THEN '?' WHEN words_p95 > 800 THEN 'HIGH' WHEN words_median < 200 AND docs_median >= 3 THEN 'LOW' ELSE 'MEDIUM' END AS chunking_lever
FROM e LEFT JOIN p USING ({by})"""


@query(f"WITH {statistics_sql('source', 'SELECT source, [coalesce(text, chr(32))] AS documents FROM documents')}")
def corpus_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.array(F.coalesce("text", F.lit(" "))).alias("documents"))
    return evaluation.document_statistics(docs, "source")


@query(f"""WITH {TURNS}, {statistics_sql("many", "SELECT count(*) > 4 AS many, list(text ORDER BY turn) AS documents FROM t GROUP BY conv_id")}""")
def conversation_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("documents"))
    return evaluation.document_statistics(docs.withColumn("many", F.size("documents") > 4), "many")


@query("""SELECT * FROM (VALUES ('doc_id', true, true, 'bigint', (SELECT count(doc_id) FROM documents)), ('text', true, true, 'string', (SELECT count(text) FROM documents)), ('question', true, false, NULL, 0),
('lang', false, true, 'string', (SELECT count(lang) FROM documents)), ('n_chars', false, true, 'bigint', (SELECT count(n_chars) FROM documents)), ('source', false, true, 'string', (SELECT count(source) FROM documents))) AS t(field, expected, present, type, n_values)""")
def field_presence(spark, sf_dir):
    return evaluation.field_presence(table(spark, sf_dir, "documents"), ["doc_id", "text", "question"])


@query("""SELECT 'quality' AS field, count(quality) AS n, round(min(quality), 3)::DOUBLE AS low, round(max(quality), 3)::DOUBLE AS high, round(avg(quality), 3) AS mean FROM labels
UNION ALL SELECT 'toxic', count(toxic), round(min(toxic), 3)::DOUBLE, round(max(toxic), 3)::DOUBLE, round(avg(toxic), 3) FROM labels""")
def score_ranges(spark, sf_dir):
    return evaluation.score_ranges(table(spark, sf_dir, "labels"), ["quality", "toxic", "adherence_score"])


@query("SELECT lang, source FROM documents WHERE n_chars > 500 EXCEPT ALL SELECT lang, source FROM documents WHERE n_chars <= 500")
def only_in_long(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = lambda d: d.select("lang", "source")
    return evaluation.only_in(pairs(docs.where("n_chars > 500")), pairs(docs.where("n_chars <= 500")))


@query("SELECT source, nullif(count(*) FILTER (WHERE lang = 'en'), 0) AS en, nullif(count(*) FILTER (WHERE lang = 'fr'), 0) AS fr, nullif(count(*) FILTER (WHERE lang = 'de'), 0) AS de FROM documents GROUP BY source")
def split_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")
    return evaluation.split_sizes(docs, ["en", "fr", "de"], "source")
