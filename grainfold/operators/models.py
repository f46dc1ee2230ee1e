"""Models behind HTTP: generators of answers and judges, called from the tasks of a DataFrame.

A client object has complete(prompt, sample=False) -> Completion and is built in the worker. Calls of one task run one
after the other; `parallel` tasks run at a time, and a limit of calls a minute is divided among them, so that all of
them together keep it. Keys are read in the worker, from the environment, if none is given.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.operators import judging
from grainfold.operators.registry import register
from grainfold.session import ship_package

#: Models, addresses and limits that apply if nothing else is asked for.
LOCAL_MODEL, LOCAL_HOST, LOCAL_WINDOW = "llama3.1:8b", "http://localhost:11434", 16384
HOSTED_GENERATOR, HOSTED_JUDGE = "llama-3.1-8b-instant", "llama-3.3-70b-versatile"
HOSTED_URL = "https://api.groq.com/openai/v1/chat/completions"
RETRY_TEMPERATURE = 0.3


@dataclass
class Completion:
    text: str
    in_tokens: int = 0
    out_tokens: int = 0
    done_reason: str | None = None


class RateLimited(RuntimeError):
    """The server asks for a longer wait than is allowed."""


def post(url: str, payload: dict, headers: dict[str, str], timeout: float, retries: int = 0, max_backoff: float = 90.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON answer. Status 429 is tried again, after as many seconds as the server says or 1, 2, 4, ...; other errors are raised."""
    body = json.dumps(payload).encode()
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}), timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == retries:
                raise
            wait = float(e.headers.get("Retry-After", 2**attempt))
            if wait > max_backoff:
                raise RateLimited(f"the server asks for {wait:.0f} s, more than the {max_backoff:.0f} s allowed") from e
            sleep(wait)
    raise AssertionError


class Pace:
    """At most so many calls a minute."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.next, self.clock, self.sleep = 60 / per_minute if per_minute > 0 else 0.0, 0.0, clock, sleep

    def wait(self) -> None:
        if self.gap:
            now = self.clock()
            if now < self.next:
                self.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap


@dataclass
class LocalServer:
    """A server with /api/generate."""

    model: str = LOCAL_MODEL
    host: str = LOCAL_HOST
    temperature: float = 0.0
    max_new_tokens: int | None = 256
    timeout: float = 600.0
    num_ctx: int = LOCAL_WINDOW
    as_json: bool = False

    def complete(self, prompt: str, sample: bool = False) -> Completion:
        options = {"temperature": RETRY_TEMPERATURE if sample else self.temperature, "num_ctx": self.num_ctx}
        if self.max_new_tokens is not None:
            options["num_predict"] = self.max_new_tokens
        payload = {"model": self.model, "prompt": prompt, "stream": False, "options": options} | ({"format": "json"} if self.as_json else {})
        found = post(f"{self.host.rstrip('/')}/api/generate", payload, {}, self.timeout)
        return Completion(found["response"], found.get("prompt_eval_count") or 0, found.get("eval_count") or 0, found.get("done_reason"))


@dataclass
class HostedChat:
    """A chat endpoint with a key, limits and usage figures."""

    model: str = HOSTED_GENERATOR
    url: str = HOSTED_URL
    temperature: float = 0.0
    max_new_tokens: int | None = 256
    timeout: float = 120.0
    api_key: str | None = None
    key_name: str = "GROQ_API_KEY"
    max_retries: int = 3
    max_backoff: float = 90.0
    as_json: bool = False
    pace: Pace = field(default_factory=partial(Pace, 0))

    def complete(self, prompt: str, sample: bool = False) -> Completion:
        key = self.api_key or os.getenv(self.key_name)
        if not key:
            raise RuntimeError(f"{self.key_name} is not set")
        payload = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": RETRY_TEMPERATURE if sample else self.temperature, "stream": False}
        if self.max_new_tokens is not None:
            payload["max_tokens"] = self.max_new_tokens
        if self.as_json:
            payload["response_format"] = {"type": "json_object"}
        self.pace.wait()
        found = post(self.url, payload, {"Authorization": f"Bearer {key}"}, self.timeout, self.max_retries, self.max_backoff)
        choice, usage = found["choices"][0], found.get("usage") or {}
        return Completion(choice["message"]["content"] or "", usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0, choice.get("finish_reason"))


class Transformers:
    """A causal language model in the worker itself."""

    def __init__(self, model: str, max_new_tokens: int = 256, temperature: float = 0.0, load_in_4bit: bool = False):
        from transformers import pipeline

        options = {"model_kwargs": {"load_in_4bit": True}} if load_in_4bit else {}
        self.run, self.max_new_tokens, self.temperature = pipeline("text-generation", model=model, **options), max_new_tokens, temperature

    def complete(self, prompt: str, sample: bool = False) -> Completion:
        heat = RETRY_TEMPERATURE if sample else self.temperature
        options = {"do_sample": True, "temperature": heat} if heat > 0 else {"do_sample": False}
        out = self.run([{"role": "user", "content": prompt}], max_new_tokens=self.max_new_tokens, return_full_text=False, **options)
        return Completion(out[0]["generated_text"])


Load = Callable[[], object]
MADE = {"answer": pa.string(), "in_tokens": pa.int64(), "out_tokens": pa.int64(), "done_reason": pa.string()}
LABELLED = {"judge_answer": pa.string(), "judge_error": pa.string(), "in_tokens": pa.int64(), "out_tokens": pa.int64()}
SQL_NAMES = {pa.string(): "string", pa.int64(): "bigint"}


def asked(df: DataFrame, prompt: str, load: Load, ask: Callable[[object, str], tuple], more: dict[str, pa.DataType], parallel: int | None) -> DataFrame:
    """df with the columns `more`, which ask(client, prompt) gives for each row; `parallel` tasks ask, if it is given."""
    ship_package(df.sparkSession)
    dealt = df.repartition(parallel) if parallel else df

    def work(batches):
        client = load()
        for batch in batches:
            rows = [ask(client, p or "") for p in batch[prompt].to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(more.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *more])

    known = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.mapInArrow(work, f"{known}, " + ", ".join(f"{n} {SQL_NAMES[k]}" for n, k in more.items()))


@dataclass
class Generator:
    """load() makes the client in the worker. A failed call fails the task, which Spark then tries again."""

    load: Load
    parallel: int | None = None
    charged: str | None = None  # the model whose price each call costs

    def answers(self, df: DataFrame, prompt: str = "prompt") -> DataFrame:
        def ask(client, text):
            found = client.complete(text)
            return found.text, found.in_tokens, found.out_tokens, found.done_reason

        return asked(df, prompt, self.load, ask, MADE, self.parallel)


def echo(prompt: Column) -> Column:
    """A generator without a model: the prompt's length and the first line that begins with question:."""
    asked = F.trim(F.regexp_extract(prompt, r"(?im)^[ \t]*question:(.*)$", 1))
    return F.concat(F.lit("[ECHO] received a prompt of "), F.length(prompt).cast("string"), F.lit(" chars"), F.when(asked != "", F.concat(F.lit("; question was: "), asked)).otherwise(""))


@register("generator", "echo")
class Echo:
    def answers(self, df: DataFrame, prompt: str = "prompt") -> DataFrame:
        none = F.lit(0).cast("bigint")
        return df.withColumns({"answer": echo(F.col(prompt)), "in_tokens": none, "out_tokens": none, "done_reason": F.lit(None).cast("string")})


@register("generator", "ollama")
def local_generator(parallel: int | None = None, **options) -> Generator:
    return Generator(partial(LocalServer, **options), parallel)


@register("generator", "groq")
def hosted_generator(parallel: int | None = None, **options) -> Generator:
    return Generator(partial(HostedChat, **options), parallel, options.get("model", HOSTED_GENERATOR))


@register("generator", "hf")
def own_generator(model: str, parallel: int | None = None, **options) -> Generator:
    return Generator(partial(Transformers, model, **options), parallel)


@dataclass
class Judge:
    """Asks with temperature 0, and once more (max_retries) with some heat if the answer holds no label.

    label() adds the answer; one that cannot be had is null with the reason in judge_error, so that one example of many
    fails alone.
    """

    load: Load
    max_retries: int = 1
    conservative: bool = False
    parallel: int | None = None
    charged: str | None = None  # the model whose price each call costs

    def label(self, df: DataFrame, question: str = "question", documents: str = "documents", response: str = "response") -> DataFrame:
        retries = self.max_retries
        prompted = df.withColumn("__prompt", judging.judge_prompt(F.col(question), F.col(documents), F.col(response), self.conservative))

        def ask(client, prompt):
            in_tokens = out_tokens = 0
            try:
                for attempt in range(retries + 1):
                    found = client.complete(prompt, sample=attempt > 0)
                    in_tokens, out_tokens = in_tokens + found.in_tokens, out_tokens + found.out_tokens
                    if judging.label_of(found.text) is not None:
                        return found.text, None, in_tokens, out_tokens
            except Exception as e:
                return None, f"{type(e).__name__}: {e}", in_tokens, out_tokens
            return None, "no label in the answers", in_tokens, out_tokens

        return asked(prompted, "__prompt", self.load, ask, LABELLED, self.parallel).drop("__prompt")

    def scores(self, df: DataFrame, question: str = "question", documents: str = "documents", response: str = "response") -> DataFrame:
        labelled = self.label(df, question, documents, response).withColumn("n_sentences", judging.total_sentences(F.col(documents)))
        return judging.scored(labelled, "judge_answer")


@register("judge", "fake")
@dataclass
class FakeJudge:
    """Calls the first part of all keys relevant and utilized."""

    relevant: float = 0.5
    utilized: float = 0.34
    supported: bool = True

    def scores(self, df: DataFrame, question: str = "question", documents: str = "documents", response: str = "response") -> DataFrame:
        return judging.fake_scores(df, documents, self.relevant, self.utilized, self.supported)


def paced_chat(per_minute: float, **options) -> HostedChat:
    return HostedChat(**options, pace=Pace(per_minute))


@register("judge", "ollama")
def local_judge(max_retries: int = 1, conservative: bool = False, parallel: int | None = None, **options) -> Judge:
    return Judge(partial(LocalServer, **({"max_new_tokens": None, "as_json": True} | options)), max_retries, conservative, parallel)


@register("judge", "groq")
def hosted_judge(max_retries: int = 1, conservative: bool = False, parallel: int | None = None, requests_per_minute: float = 0.0, max_rate_limit_retries: int = 5, **options) -> Judge:
    """With requests_per_minute, `parallel` tasks (one if not given) share them."""
    if requests_per_minute > 0:
        parallel = parallel or 1
    options = {"model": HOSTED_JUDGE, "max_new_tokens": None, "as_json": True, "max_retries": max_rate_limit_retries} | options
    return Judge(partial(paced_chat, requests_per_minute / (parallel or 1), **options), max_retries, conservative, parallel, options["model"])


@register("judge", "hf")
def own_judge(model: str, max_retries: int = 1, conservative: bool = False, parallel: int | None = None, max_new_tokens: int = 1536, **options) -> Judge:
    return Judge(partial(Transformers, model, max_new_tokens=max_new_tokens, **options), max_retries, conservative, parallel)
