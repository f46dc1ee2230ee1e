"""Labels of a judge model: the question put to it, its answer's JSON, repaired where possible, and the scores that follow."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators import evaluation
from grainfold.session import ship_package

#: The names in a label, and what a fenced object looks like.
RELEVANT, UTILIZED, SUPPORTED = "all_relevant_sentence_keys", "all_utilized_sentence_keys", "overall_supported"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
LABEL = f"struct<{RELEVANT}: array<string>, {UTILIZED}: array<string>, {SUPPORTED}: boolean>"

QUESTION = """You check how an answer uses the documents it was given. Every sentence has a key.

Documents:
{documents}

Question:
{question}

Answer:
{response}

Reply with one JSON object and nothing else, with these fields:
"relevance_explanation": a string, which parts of the documents help with the question, and why;
"all_relevant_sentence_keys": a list of the keys of all document sentences that help with the question;
"overall_supported_explanation": a string, whether the documents support the answer, sentence by sentence;
"overall_supported": true if they support all of it, otherwise false;
"sentence_support_information": a list with an object for each sentence of the answer: "response_sentence_key", "explanation", "supporting_sentence_keys" (a list of keys) and "fully_supported" (true or false);
"all_utilized_sentence_keys": a list of the keys of all document sentences that the answer makes use of."""
CONSERVATIVE = "Be strict about relevance and use: list a key only if its sentence is needed for the question, or if the answer clearly takes something from it. When in doubt, leave it out."


def lines(keyed: Column) -> Column:
    return F.array_join(F.transform(keyed, lambda s: F.concat(s["key"], F.lit(". "), s["text"])), "\n")


def judge_prompt(question: Column, documents: Column, response: Column, conservative: bool = False) -> Column:
    """documents: an array of keyed sentences each; response: keyed sentences."""
    values = {"documents": lines(F.flatten(documents)), "question": F.coalesce(question, F.lit("")), "response": lines(response)}
    parts = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\{(\w+)\}", QUESTION))]
    return F.concat(*parts, F.lit(f"\n\n{CONSERVATIVE}" if conservative else ""))


def total_sentences(documents: Column) -> Column:
    """Sentences of all documents."""
    return F.aggregate(documents, F.lit(0), lambda n, d: n + F.size(d))


def json_part(answer: Column) -> Column:
    """The fenced object of an answer, or what lies from its first to its last brace; null if there is none."""
    fenced = F.regexp_extract(answer, FENCED, 1)
    first, last = F.instr(answer, "{"), F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    bare = F.when((first > 0) & (F.instr(answer, "}") > 0) & (last > first), F.substr(answer, first, last - first + 1))
    return F.when(fenced != "", fenced).otherwise(bare)


BLANKS = re.compile(r"\s*")


def escape_inner_quotes(text: str | None) -> str | None:
    """A quote inside a string ends it only if :, a comma, a closing bracket or the end follows; others are escaped."""
    if text is None:
        return None
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            after = BLANKS.match(text, i + 1).end()
            ends = not inside or text[after : after + 1] in ("", ":", ",", "}", "]")
            inside = not inside if ends else inside
            c = c if ends else '\\"'
        out.append(c)
        i += 1
    return "".join(out)


def parsed_object(text: str | None) -> dict | None:
    """The JSON object in a text as it is, or else in the repaired text."""
    for candidate in (text, escape_inner_quotes(text)):
        try:
            found = json.loads(candidate) if candidate is not None else None
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def label_of(answer: str | None) -> dict | None:
    """The object in a judge's answer; None if there is none that can be read."""
    answer = answer or ""
    fenced = re.search(FENCED, answer)
    first, last = answer.find("{"), answer.rfind("}")
    return parsed_object(fenced[1] if fenced else answer[first : last + 1] if 0 <= first < last else None)


def canonical(label: dict | None) -> str | None:
    """The label with its lists as lists of strings and the verdict as a boolean by the rules of truth: an empty string,
    list or object, zero and null are false, anything else, the string "false" too, is true. What is missing is empty or
    false. None if a list is null, a number or a boolean, or holds what is no plain value."""
    if label is None:
        return None
    out: dict = {SUPPORTED: bool(label.get(SUPPORTED, False))}
    for name in (RELEVANT, UTILIZED):
        keys = label.get(name, [])
        if not isinstance(keys, list | str | dict) or any(isinstance(k, list | dict) for k in keys):
            return None
        out[name] = [k if isinstance(k, str) else json.dumps(k) for k in keys]
    return json.dumps(out)


def parsed(answer: Column) -> Column:
    """The label in an answer, null where it has none."""

    def every(texts: pd.Series) -> pd.Series:
        return pd.Series([canonical(parsed_object(x)) for x in texts], dtype=object)

    ship_package(SparkSession.active())
    return F.from_json(F.pandas_udf(every, "string")(json_part(answer)), LABEL)


def scored(answers: DataFrame, answer: str = "answer", total: str = "n_sentences") -> DataFrame:
    """answers with the four scores; all null where the answer has no label, and failed is true there."""
    label = answers.withColumn("__label", parsed(F.col(answer)))
    scores = evaluation.grounding(F.col(total), F.col(f"__label.{RELEVANT}"), F.col(f"__label.{UTILIZED}"), F.array())[:3]
    given = F.col("__label").isNotNull()
    scores = [F.when(given, s).alias(m) for s, m in zip(scores, evaluation.METRICS, strict=True)]
    return label.select(*answers.columns, *scores, F.when(given, F.col(f"__label.{SUPPORTED}")).alias("adherence"), (~given).alias("failed"))


def fake_scores(df: DataFrame, documents: str, relevant: float, utilized: float, supported: bool) -> DataFrame:
    """A judge without a model: the first part of all keys, one at least if there are any."""
    keys = df.withColumn("__keys", F.transform(F.flatten(documents), lambda s: s["key"]))
    cut = keys.withColumns({"__r": evaluation.first_keys(F.col("__keys"), relevant), "__u": evaluation.first_keys(F.col("__keys"), utilized)})
    scores = evaluation.grounding(F.size("__keys"), F.col("__r"), F.col("__u"), F.array())[:3]
    return cut.select(*df.columns, *scores, F.lit(supported).alias("adherence"), F.lit(False).alias("failed"))


def judge_report(rows: DataFrame, *by: str) -> DataFrame:
    """Agreement of a judge with reference scores. rows: each metric, {metric}_ref, adherence, adherence_ref, failed."""
    ok = ~F.col("failed")
    rate = lambda c: F.coalesce(F.avg(F.when(ok, c.cast("int"))), F.lit(0.0))
    out = [F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_scored"), F.count_if(F.col("failed")).alias("n_failed")]
    for m in evaluation.METRICS:
        d = F.when(ok, F.col(m) - F.col(f"{m}_ref"))
        for name, v in (("rmse", F.sqrt(F.avg(d * d))), ("mae", F.avg(F.abs(d))), ("signed", F.avg(d))):
            out.append(F.round(F.coalesce(v, F.lit(0.0)), 6).alias(f"{m}_{name}"))
    us, ref = F.col("adherence"), F.col("adherence_ref")
    rates = (("adherence_acc", us == ref), ("adherence_over_flag", ~us & ref), ("adherence_under_flag", us & ~ref))
    return rows.groupBy(*by).agg(*out, *[F.round(rate(c), 6).alias(n) for n, c in rates])


def judge_verdict(*reports: DataFrame) -> DataFrame:
    """Mean agreement by model and prompt variant. Reports of different age: one without a variant is the baseline; of
    rows with equal model, variant and config the last report's holds (within a report, that of its last line)."""
    every = None
    for i, r in enumerate(reports):
        variant = F.coalesce("prompt_variant", F.lit("baseline")) if "prompt_variant" in r.columns else F.lit("baseline")
        line = F.col("line_no") if "line_no" in r.columns else F.lit(0)
        one = r.select("model", variant.alias("prompt_variant"), "config", "relevance_rmse", "relevance_signed", "utilization_rmse", "completeness_rmse", "adherence_acc", F.struct(F.lit(i).alias("file"), line.cast("bigint").alias("line")).alias("at"))
        every = one if every is None else every.unionByName(one)
    figures = ("relevance_rmse", "relevance_signed", "utilization_rmse", "completeness_rmse", "adherence_acc")
    last = every.groupBy("model", "prompt_variant", "config").agg(F.max_by(F.struct(*figures), "at").alias("r"))
    return last.groupBy("model", "prompt_variant").agg(F.count(F.lit(1)).alias("configs"), *[F.round(F.avg(f"r.{c}"), 3).alias(c) for c in figures])
