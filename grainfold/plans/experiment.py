"""An experiment from end to end, as one DataFrame program for each configuration.

examples: example_id, question, documents (array of texts), and whatever else is to be carried. Documents are cut into
chunks, which are written once (they are the index); every question finds, reranks, orders and shortens its chunks, a
prompt is made and answered, the answer is judged, and scores are averaged. With the index per example a question sees its
own documents only, with a pooled one all documents, each text once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.config import Config, Stage, load_plugins
from grainfold.functions import text as T
from grainfold.operators import experiments, judging, ranking
from grainfold.operators.evaluation import REFERENCE
from grainfold.operators.models import Generator
from grainfold.operators.registry import OPERATORS
from grainfold.operators.retrieval import joined_to
from grainfold.plans import ledger
from grainfold.session import stash
from grainfold.sources import tables

#: How many chunks are looked for and kept if the configuration doesn't say.
K, TOP_N = 20, 5
SOURCE = "array<struct<place: int, chunk_id: string, text: string, score: double, rank: int>>"


def made(kind: str, stage: Stage | None, *without: str):
    return OPERATORS.build(kind, stage.type, **{k: v for k, v in stage.params.items() if k not in without}) if stage else None


@dataclass
class Pipeline:
    config: Config

    def __post_init__(self):
        load_plugins()
        c = self.config
        self.k = c.retriever.params.get("k", K)
        self.top_n = c.reranker.params.get("top_n", TOP_N) if c.reranker else TOP_N
        self.mode = made("index", c.index)
        self.chunker, self.embedder = made("chunker", c.chunker), made("embedder", c.embedder)
        self.prompt, self.generator, self.splitter = made("prompt", c.prompt), made("generator", c.generator), made("splitter", c.splitter)
        kind = c.retriever.type if ("retriever", c.retriever.type) in OPERATORS.made else "dense"
        self.retriever = made("retriever", Stage(kind, c.retriever.params if kind == c.retriever.type else {}), "k")
        self.reranker = made("reranker", c.reranker, "top_n") or ranking.keep_order()
        self.repacker = made("repacker", c.repacker) or (lambda position, n: position)
        self.summarizer = made("summarizer", c.summarizer) or ranking.keep_text()
        self.classifier = made("query_classifier", c.query_classifier) or ranking.always()

    @cached_property
    def pooled(self) -> bool:
        return self.mode == "pooled"

    def chunks(self, examples: DataFrame, corpus: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
        """([corpus_id], doc_id, chunk_id, text), written. corpus (doc_id, text): what a pooled index holds instead of the
        examples' own documents. documents (example_id, pos, text): the examples' own documents, one a row, instead of the
        arrays in examples. doc_id here is the chunk's place: its document's number and its own."""
        if documents is None and (corpus is None or not self.pooled):
            documents = examples.select("example_id", F.posexplode("documents").alias("pos", "text"))
        if not self.pooled:
            # a corpus is dealt to few tasks, so that its words are counted and its blocks filled there
            own = documents.select(F.col("example_id").alias("corpus_id"), "pos", "text").repartitionByRange("corpus_id", "pos")
        else:
            given = corpus.select(F.struct("doc_id").alias("at"), "text") if corpus is not None else documents.select(F.struct("example_id", "pos").alias("at"), "text")
            first = given.groupBy("text").agg(F.min("at").alias("at"))  # each text once, where it is met first
            own = tables.numbered(first, "at").select(F.lit(0).alias("corpus_id"), F.col("row_no").alias("pos"), "text")
        cut = self.chunker(own.select(F.struct("corpus_id", "pos").alias("doc_id"), "text"))
        names = ["corpus_id"] if not self.pooled else []
        found = cut.select(F.col("doc_id.corpus_id").alias("corpus_id"), F.struct(F.col("doc_id.pos").cast("bigint").alias("pos"), "chunk_no").alias("doc_id"), F.concat_ws("-", F.col("doc_id.pos").cast("string"), "chunk_no").alias("chunk_id"), "text")
        return stash(found.select(*names, "doc_id", "chunk_id", "text"), "chunks")

    def sources(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        """query_id and the chunks in the order of the prompt; each keeps its rank. questions: example_id, question."""
        queries = questions.select(*([] if self.pooled else [F.col("example_id").alias("corpus_id")]), F.col("example_id").alias("query_id"), F.col("question").alias("query"))
        hits = self.retriever(queries, chunks.drop("chunk_id"), self.embedder, self.k)
        met = joined_to(hits, chunks, "doc_id") if self.pooled else joined_to(hits.withColumn("corpus_id", F.col("query_id")), chunks, "corpus_id", "doc_id")
        kept = self.reranker(met.join(queries.select("query_id", "query"), "query_id"), self.top_n)
        n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
        placed = kept.withColumns({"n": n, "position": position}).withColumn("place", self.repacker(F.col("position"), F.col("n")).cast("int"))
        short = self.summarizer(placed)
        return short.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "text", "score", F.col("rank").cast("int").alias("rank")))).cast(SOURCE).alias("sources"))

    def prompts(self, examples: DataFrame, corpus: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
        """examples with needs_retrieval, sources, context and prompt; a question that needs no retrieval has no sources."""
        asked = examples.withColumn("needs_retrieval", self.classifier(F.col("question"))["needs_retrieval"])
        found = self.sources(asked.where("needs_retrieval"), self.chunks(examples, corpus, documents))
        none = F.array().cast(SOURCE)
        met = asked.join(found.withColumnRenamed("query_id", "example_id"), "example_id", "left").withColumn("sources", F.coalesce("sources", none))
        texts = F.transform("sources", lambda s: s["text"])
        return met.withColumns({"context": ranking.context(texts), "prompt": self.prompt(texts, F.col("question"))})

    def answers(self, examples: DataFrame, corpus: DataFrame | None = None, judge=None, documents: DataFrame | None = None) -> DataFrame:
        """prompts() with answer, its token counts, the four scores (null without a judge or a label) and failed."""
        return self.answered(self.prompts(examples, corpus, documents), judge)

    def answered(self, prompts: DataFrame, judge=None) -> DataFrame:
        """The same of prompts that are made already. A model's answers are written before anything reads them, so that each
        prompt is sent once."""
        answered = self.generator.answers(prompts)
        if isinstance(self.generator, Generator):
            answered = stash(answered, "generated")
        if judge is None:
            nothing = {m: F.lit(None).cast("double") for m in ("relevance", "utilization", "completeness")}
            none = {f"judge_{c}": F.lit(None).cast("bigint") for c in ("in_tokens", "out_tokens")}
            return answered.withColumns(nothing | {"adherence": F.lit(None).cast("boolean"), "failed": F.lit(False)} | none)
        parts = answered.withColumns({"__texts": F.transform("sources", lambda s: s["text"]), "__answer": F.coalesce("answer", F.lit(""))})
        if self.config.splitter.type == "regex":
            split = parts.withColumns({"__documents": T.split_documents(F.col("__texts")), "__response": self.splitter(F.col("__answer"))})
        else:  # a splitter that is no column of its own cannot run inside an array: sentences are split text by text
            each = parts.select("example_id", F.posexplode("__texts").alias("i", "t")).select("example_id", "i", self.splitter(F.col("t")).alias("s"))
            lists = each.groupBy("example_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("__documents"))
            split = parts.join(lists, "example_id", "left").withColumns({"__documents": F.coalesce("__documents", F.array().cast("array<array<string>>")), "__response": self.splitter(F.col("__answer"))})
        keyed = split.withColumns({"documents_sentences": T.keyed_documents(F.col("__documents")), "response_sentences": T.keyed(F.col("__response"), F.lit(""))})
        scored = judge.scores(keyed.withColumnsRenamed({"in_tokens": "gen_in_tokens", "out_tokens": "gen_out_tokens"}), "question", "documents_sentences", "response_sentences")
        scored = scored.drop("__texts", "__answer", "__documents", "__response").withColumnsRenamed({"in_tokens": "judge_in_tokens", "out_tokens": "judge_out_tokens"})
        if "judge_in_tokens" not in scored.columns:
            scored = scored.withColumns({f"judge_{c}": F.lit(None).cast("bigint") for c in ("in_tokens", "out_tokens")})
        return scored.withColumnsRenamed({"gen_in_tokens": "in_tokens", "gen_out_tokens": "out_tokens"})


def matrix_row(answers: DataFrame, config: Config, name: str | None = None) -> DataFrame:
    """The one row of a result matrix."""
    kinds = {s: (config.types().get(s) or {"type": "none"})["type"] for s in tables.STAGES}
    known = {"config_name": name, "config_id": experiments.config_id(config.types()), "domain": config.domain, **kinds}
    row = experiments.means(answers).select(*[F.lit(v).cast("string").alias(c) for c, v in known.items()], "*")
    return row.select(*[F.col(f.name).cast(f.dataType) for f in tables.MATRIX])


def run_experiment(
    config: Config, examples: DataFrame, judge=None, corpus: DataFrame | None = None, name: str | None = None, traces: str | None = None,
    documents: DataFrame | None = None, budget: ledger.Budget | None = None,
) -> DataFrame:
    """One configuration over examples: the matrix row. With traces, a record of every example is written there.

    With a budget, prompts are answered slice by slice under its ledger: a run that was stopped goes on behind the last
    slice committed, one whose cost passes the cap raises CapPassed, and each trace tells the cost so far.
    """
    pipeline, name_or_id = Pipeline(config), name or experiments.config_id(config.types())
    if budget is None:
        answers = stash(pipeline.answers(examples, corpus, judge, documents), "answers")
        costs = None
    else:
        prompts = pipeline.prompts(examples, corpus, documents)
        answers = budget.run(f"{name_or_id}/{config.domain}", prompts, partial(pipeline.answered, judge=judge), pipeline.generator, judge)
        costs = budget.snapshot
    if traces:
        optional = {"id": F.col("example_id").cast("string"), "_config": F.lit("")}
        known = answers.withColumns({c: v for c, v in optional.items() if c not in answers.columns})
        scores = F.when(F.col("relevance").isNotNull(), F.struct("relevance", "utilization", "completeness", "adherence"))
        known = known.withColumns({"config_name": F.lit(name_or_id), "domain": F.lit(config.domain), "scores": scores})
        index = tables.numbered(known, "example_id") if costs is None else costs(known)
        tables.write_traces(tables.trace_records(index.withColumnRenamed("row_no", "example_index")), traces)
    return matrix_row(answers, config, name)


def run_matrix(spark: SparkSession, cells: list[tuple[str, Config]], examples_for, path: str, corpus_for=lambda domain: None, judge=None, traces: str | None = None, budget: ledger.Budget | None = None) -> DataFrame:
    """All cells that the matrix at path doesn't have yet, one after the other; each is appended when it is done, so
    that a run goes on where another one stopped. examples_for and corpus_for map a domain to its tables. A budget holds
    for all cells together."""
    for name, config in cells:
        cell = spark.createDataFrame([(name, config.domain)], "config_name string, domain string")
        if not tables.pending(cell, tables.read_matrix(spark, path), "config_name", "domain").isEmpty():
            tables.append_matrix(run_experiment(config, examples_for(config.domain), judge, corpus_for(config.domain), name, traces, budget=budget), path)
    return tables.read_matrix(spark, path)


def validated(judge, examples: DataFrame, n: int | None = None) -> DataFrame:
    """A judge's scores of examples with gold scores (the first n of them), each beside its reference: what judge_report() reads.
    examples: example_id, question, documents_sentences, response_sentences and the reference scores."""
    chosen = examples if n is None else tables.first_rows(examples, n, "example_id")
    known = chosen.withColumns({f"{m}_ref": F.col(c) for m, c in REFERENCE.items()})
    return judge.scores(known, "question", "documents_sentences", "response_sentences")


def run_validation(spark: SparkSession, judge, model: str, variant: str, cells: list[tuple[str, str]], examples_for, root: str, n: int) -> DataFrame:
    """Reports of a judge on example sets (domain, config), one after the other; those that are there already are skipped.
    examples_for maps a config to its examples."""
    path = tables.report_path(root, model, variant, n)
    schema = tables.report_schema()
    for domain, config in cells:
        cell = spark.createDataFrame([(model, variant, config)], "model string, prompt_variant string, config string")
        if not tables.pending(cell, tables.appended_rows(spark, path, schema), *cell.columns).isEmpty():
            report = judging.judge_report(validated(judge, examples_for(config), n))
            names = {"model": model, "prompt_variant": variant, "domain": domain, "config": config}
            tables.append_reports(report.withColumns({c: F.lit(v) for c, v in names.items()}), path)
    return tables.appended_rows(spark, path, schema)
