"""After retrieval: reranking, repacking, compression, query classification, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.operators.embedding import Embedder, named
from grainfold.operators.registry import register
from grainfold.operators.retrieval import top
from grainfold.session import ship_package

#: Small talk that needs no retrieval, and model names behind short names.
SMALL_TALK = ["hello", "hi ", "hey", "thanks", "thank you", "bye", "good morning", "good evening", "good night"]
CROSS_ENCODER, BGE_LARGE = "cross-encoder/ms-marco-MiniLM-L-6-v2", "BAAI/bge-reranker-large"

# Rerankers: (hits with query and text, top_n) -> the same columns


@register("reranker", "none")
def keep_order() -> Callable[[DataFrame, int], DataFrame]:
    return lambda hits, top_n: hits.where(F.col("rank") < top_n)


def by_score(score: Callable[[Column, Column], Column]) -> Callable[[DataFrame, int], DataFrame]:
    """The top_n best of a query by a new score, ties in the old order; score and rank are new."""
    def rerank(hits: DataFrame, top_n: int) -> DataFrame:
        scored = hits.withColumns({"score": score(F.col("query"), F.col("text")).cast("double"), "__was": F.col("rank")})
        return top(scored, top_n, F.desc("score"), F.col("__was")).drop("__was")

    return rerank


def overlap(query: Column, text: Column) -> Column:
    """Shared tokens by the root of the text's tokens."""
    return T.let(T.token_set(text), lambda t: F.when(F.size(t) > 0, F.size(F.array_intersect(t, T.token_set(query))) / F.sqrt(F.size(t))).otherwise(0.0))


@register("reranker", "lexical")
def lexical_reranker() -> Callable[[DataFrame, int], DataFrame]:
    """A scorer without a model."""
    return by_score(overlap)


@lru_cache(2)
def cross_encoder_model(model: str):
    from sentence_transformers import CrossEncoder

    return CrossEncoder(model)


@register("reranker", "cross_encoder")
def cross_encoder(model: str = CROSS_ENCODER, batch_size: int = 32, load: Callable | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """load(model) -> an object with predict(pairs, batch_size, show_progress_bar), made once in each worker."""
    load = load or cross_encoder_model

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = load(model)
        for query, text in parts:
            pairs = list(zip(query.fillna(""), text.fillna(""), strict=True))
            yield pd.Series([float(s) for s in made.predict(pairs, batch_size=batch_size, show_progress_bar=False)] if pairs else [], dtype=float)

    def score(query: Column, text: Column) -> Column:
        ship_package(SparkSession.active())
        return F.pandas_udf(run, "double")(query, text)

    return by_score(score)


@register("reranker", "bge_large")
def bge_large(model: str = BGE_LARGE, batch_size: int = 16, load: Callable | None = None) -> Callable[[DataFrame, int], DataFrame]:
    return cross_encoder(model, batch_size, load)


# Repackers: the new place of a hit


def repacked(position: Column, n: Column, kind: str) -> Column:
    """As it is, reversed, or best at both ends."""
    return {
        "forward": position,
        "reverse": n - 1 - position,
        "sides": F.when(position % 2 == 0, F.floor(position / 2)).otherwise(n - 1 - F.floor((position - 1) / 2)).cast("int"),
    }[kind]


for _kind in ("forward", "reverse", "sides"):
    register("repacker", _kind)(lambda kind=_kind: lambda position, n: repacked(position, n, kind))


# Summarizers: (text, query) columns in `hits` -> shorter texts


def checked_share(ratio: float, min_keep: int) -> None:
    if not 0 < ratio <= 1 or min_keep < 1:
        raise ValueError("0 < ratio <= 1 and min_keep >= 1 are needed")


def best_sentences(text: Column, sentences: Column, scores: Column, ratio: float, min_keep: int) -> Column:
    """The share of sentences with the highest scores, at least min_keep, earlier ones first among equals, in reading
    order; the text itself where there is nothing to choose."""
    costs = F.zip_with(scores, F.sequence(F.lit(0), F.size(sentences) - 1), lambda s, i: F.struct((-s).alias("cost"), i.alias("i")))
    keep = F.least(F.size(sentences), F.greatest(F.lit(min_keep), F.ceil(F.lit(ratio) * F.size(sentences)).cast("int")))
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(costs), 1, keep), lambda c: c["i"]))
    return F.when(F.size(sentences) <= min_keep, text).otherwise(F.array_join(F.transform(chosen, lambda i: F.get(sentences, i)), " "))


@register("summarizer", "none")
def keep_text() -> Callable[[DataFrame], DataFrame]:
    return lambda hits: hits


@register("summarizer", "lexical")
def lexical_summarizer(ratio: float = 0.5, min_keep: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Sentences by their overlap with the query; a query without tokens leaves the text as it is."""
    checked_share(ratio, min_keep)

    def compress(hits: DataFrame) -> DataFrame:
        own = hits.withColumns({"__q": T.token_set(F.coalesce("query", F.lit(""))), "__s": T.sentences(F.col("text"))})
        share = lambda x: T.let(T.token_set(x), lambda t: F.when(F.size(t) > 0, F.size(F.array_intersect(t, F.col("__q"))) / F.sqrt(F.size(t))).otherwise(0.0))
        scored = own.withColumn("__score", F.transform("__s", share))
        short = best_sentences(F.col("text"), F.col("__s"), F.col("__score"), ratio, min_keep)
        return scored.withColumn("text", F.when(F.size("__q") == 0, F.col("text")).otherwise(short)).drop("__q", "__s", "__score")

    return compress


@register("summarizer", "extractive_embedding")
def embedding_summarizer(model: str | None = None, ratio: float = 0.5, min_keep: int = 1, embedder: Embedder | None = None) -> Callable[[DataFrame], DataFrame]:
    """Sentences by the inner product of their vectors with the query's, to nine places."""
    checked_share(ratio, min_keep)
    model = embedder or named(model)

    def compress(hits: DataFrame) -> DataFrame:
        own = hits.withColumn("__s", T.sentences(F.col("text")))
        seen = own.withColumn("__v", model.nearness(F.col("query"), F.col("__s")))
        scored = seen.withColumn("__score", F.transform("__v", lambda x: F.round(x, 9)))
        return scored.withColumn("text", best_sentences(F.col("text"), F.col("__s"), F.col("__score"), ratio, min_keep)).drop("__s", "__v", "__score")

    return compress


def compress(docs: DataFrame, query: Column, ratio: float = 0.5, min_keep: int = 1) -> DataFrame:
    """doc_id and the sentences of each text that share most with the query."""
    return lexical_summarizer(ratio, min_keep)(docs.select("doc_id", "text", query.alias("query"))).select("doc_id", "text")


# Query classifiers


def verdict(yes: bool, sure: float) -> Column:
    return F.struct(F.lit(yes).alias("needs_retrieval"), F.lit(sure).alias("confidence"))


@register("query_classifier", "always")
def always() -> Callable[[Column], Column]:
    return lambda query: verdict(True, 1.0)


@register("query_classifier", "heuristic")
def heuristic(min_length: int = 3, skip_keywords: list[str] | None = None) -> Callable[[Column], Column]:
    return lambda query: needs_retrieval(query, min_length, SMALL_TALK if skip_keywords is None else skip_keywords)


def needs_retrieval(query: Column, min_words: int = 3, phrases: list[str] = SMALL_TALK) -> Column:
    q = F.lower(T.strip(F.coalesce(query, F.lit(""))))
    count = F.size(F.regexp_extract_all(q, F.lit(r"((?U)\b\w+\b)"), 1))
    talk = F.lit(False)
    for p in phrases:
        talk = talk | q.contains(p)
    return F.when(q == "", verdict(False, 1.0)).when(count < min_words, verdict(False, 0.8)).when(talk, verdict(False, 0.7)).otherwise(verdict(True, 0.9))


# Prompts


def numbered(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")


def prompt(chunks: Column, question: Column, instruction: str = "") -> Column:
    head = f"{instruction}\n\n" if instruction else ""
    return F.concat(F.lit(f"{head}Context:\n"), numbered(chunks), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer:"))


GROUNDED = (
    "Use only what the numbered passages below say. Do not add facts of your own.\n"
    "If the passages do not hold the answer, reply with exactly: I don't know based on the provided context."
)
EXAMPLES = """Context:
[1] The library opens at nine on weekdays. It is closed on public holidays.

Question: When does the library open on a Tuesday?
Answer: The library opens at nine on weekdays, so on a Tuesday it opens at nine.

Context:
[1] The north trail is four kilometres long. Dogs must be kept on a lead there.

Question: How much does a guided tour cost?
Answer: I don't know based on the provided context."""
INSTRUCTIONS = {
    "minimal": "",
    "grounded": GROUNDED,
    "grounded_complete": f"{GROUNDED}\nName every fact in the passages that bears on the question, and leave none of them out.",
    "extractive": f"{GROUNDED}\nKeep to the wording of the passages: quote the sentences that answer the question, or stay as close to them as grammar allows.",
    "grounded_coverage": f"{GROUNDED}\nGo through the passages one by one. From each that bears on the question take what it adds, and then write one answer that covers all of them.",
    "grounded_fewshot": f"{GROUNDED}\n\nTwo worked examples follow.\n\n{EXAMPLES}\n\nNow answer this question.",
}
for _name, _instruction in INSTRUCTIONS.items():
    register("prompt", _name)(lambda instruction=_instruction: lambda chunks, question: prompt(chunks, question, instruction))


def context(chunks: Column) -> Column:
    """What the generator was given, without numbers: one text a line."""
    return F.array_join(chunks, "\n")


def in_order(hits: DataFrame, place: str = "rank") -> DataFrame:
    """query_id, texts by place."""
    return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), "text"))), lambda c: c["text"]).alias("texts"))


def count_window() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("query_id"))
