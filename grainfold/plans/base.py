"""What the registered queries share: the registry, the tables, and pieces of the same queries in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: Blank characters, and words, sentences and tokens of a text (a border character instead of a look-behind).
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w != '')"


def sentences(x: str) -> str:
    marked = rf"""regexp_replace({strip(x)}, '([.!?])["'')\]]?{BLANK}+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s != '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def letters(i: str) -> str:
    """Of a number from 1 on."""
    return f"""CASE WHEN {i} <= 26 THEN chr((96 + {i})::INT) WHEN {i} <= 702 THEN chr((97 + ({i} - 27) // 26)::INT) || chr((97 + ({i} - 27) % 26)::INT)
 ELSE chr((97 + ({i} - 703) // 676)::INT) || chr((97 + ({i} - 703) // 26 % 26)::INT) || chr((97 + ({i} - 703) % 26)::INT) END"""


def hashed(source: str, key: str, text: str, name: str) -> str:
    """CTEs that make `name` (key..., cell, x): the hashed vectors of texts, without their zeros."""
    return f"""{name}_t AS (SELECT {key}, unnest({tokens(text)}) AS tok FROM {source}), {name}_h AS (SELECT {key}, ('0x' || substring(md5(tok), 1, 7))::BIGINT AS h FROM {name}_t),
{name}_c AS (SELECT {key}, (h % 64)::INT AS cell, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {key}, cell, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY {key})), 1e-12) AS x FROM {name}_c)"""


def bm25(k: int, docs: str, queries: str, name: str = "bm25", corpus: str | None = None) -> str:
    """CTEs that make `name` (query_id, doc_id, score, rank). docs (doc_id, text), queries (query_id, text): each with the
    column `corpus`, if there are several."""
    c = f"{corpus}, " if corpus else ""
    on = f"{corpus}, " if corpus else ""
    same = f"USING ({corpus})" if corpus else "ON true"
    group = f"GROUP BY {corpus}" if corpus else ""
    part = f"PARTITION BY {corpus} " if corpus else ""
    low = words("lower(text)")
    return f"""{name}_w AS (SELECT {c}doc_id, {low} AS w FROM {docs}), {name}_size AS (SELECT {c}doc_id, len(w) AS dl FROM {name}_w),
{name}_n AS (SELECT {c}count(*) AS n, avg(dl) AS avgdl FROM {name}_size {group}),
{name}_tf AS (SELECT {c}doc_id, term, count(*) AS tf FROM (SELECT {c}doc_id, unnest(w) AS term FROM {name}_w) GROUP BY ALL),
{name}_df AS (SELECT {c}term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_idf0 AS (SELECT {c}term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM {name}_df JOIN {name}_n {same}),
{name}_mean AS (SELECT {c}avg(idf) AS mean_idf FROM {name}_idf0 {group}),
{name}_idf AS (SELECT {c}term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM {name}_idf0 JOIN {name}_mean {same}),
{name}_q AS (SELECT {c}query_id, term, count(*) AS qf FROM (SELECT {c}query_id, unnest({low}) AS term FROM {queries}) GROUP BY ALL),
{name}_m AS (SELECT {c}query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {name}_q JOIN {name}_idf USING ({on}term) JOIN {name}_tf USING ({on}term) JOIN {name}_size USING ({on}doc_id) JOIN {name}_n {same} GROUP BY ALL),
{name}_first AS (SELECT {c}doc_id FROM {name}_size QUALIFY row_number() OVER ({part}ORDER BY doc_id) <= {k}),
{name} AS (SELECT query_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1)::INT AS rank FROM (
  SELECT query_id, doc_id, score FROM {name}_m UNION ALL SELECT query_id, f.doc_id, 0.0 FROM {queries} JOIN {name}_first f {same} ANTI JOIN {name}_m m USING (query_id, doc_id)) QUALIFY rank < {k})"""


def overlap(k: int) -> str:
    """CTEs that make `dense` (query_id, doc_id, score, rank) from shared tokens."""
    return rf"""q AS (SELECT item_id AS query_id, list_distinct({tokens("text")}) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct({tokens("text")}) AS t FROM documents),
overlap AS (SELECT query_id, doc_id, round(len(list_intersect(q.t, d.t)) / sqrt(greatest(len(d.t), 1)), 6) AS score FROM q, d),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM overlap QUALIFY rank < {k})"""
