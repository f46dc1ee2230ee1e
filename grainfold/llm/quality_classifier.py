"""Quality classifier by co-training of two views.

View 1 sees the words of a document (hashed words, their first four and five and last three characters;
which of them occur; the FEATURES that are most overrepresented in toxic documents, as many for low quality, as many
for documents that the other view calls bad; none is cut for being weak, the penalty holds weak ones down). View 2 sees page metadata: language, source, sizes, layout, letter case and
punctuation. Both are logistic models. They start from labelled documents; in each round each view labels
the unlabelled documents it is surest of, and these go into the other view's training set. Both are then
calibrated on labelled documents held out from training, the calibrated log-odds are combined by a third
logistic model, and every document is scored.

Fitting uses a bounded sample, by a hash of the id: at most `labelled` labelled documents and `pool`
unlabelled ones (parameters); one task fits the models on their features, and only the models reach the driver. Good, low-quality and toxic documents share
the sample by their frequency, but a kind gets a sixth of it at least, or all it has; calibration weighs each
document by what it stands for. Every kind has its part of the held-out documents. Scoring reads every document once.
A document is good if its label has quality 1 and not toxic 1.

Defined cases: a null text counts as empty, null metadata as a value of its own; labels with a null are left
out, of several labels of one document the worst holds; of rows that repeat a doc_id the sample takes the
smallest text, and all are scored; very long texts count as any other, by which words occur; without labels
of both kinds, or without documents, nothing can be learned and every document is kept, with probability 1.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import claim, documents, map_texts, remembers, ship_package, trim

LABELLED, POOL, ROUNDS, EXCHANGED = 9_000, 3_000, 3, 400
DIMS, FEATURES, LEAST_SEEN = 1 << 18, 1_000, 3
UNLABELLED, GOOD, LOW, TOXIC = -1, 0, 1, 2  # kinds; a document that is both low and toxic is toxic
KEPT_WORDS = 200_000
META = ("lang", "source", "n_chars")


SHAPES = 4


def word_features(word: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh64_intdigest(s) & (DIMS - 1) for s in (f"w{word}", f"4{word[:4].lower()}", f"5{word[:5].lower()}", f"e{word[-3:]}"))


class WordFeatures(dict):
    """word -> row of the table of hashed features; at most KEPT_WORDS rows."""

    def __init__(self):
        self.table = np.zeros((0, SHAPES), np.int32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.table[row] = word_features(word)
        return row

    def forget(self) -> None:
        self.clear()
        self.table = np.zeros((0, SHAPES), np.int32)

    def of(self, words: set[str]) -> np.ndarray:
        if len(words) > KEPT_WORDS // 2:
            return np.array([word_features(w) for w in words], np.int32)
        if len(self) + len(words) > KEPT_WORDS:  # rows of one text are never thrown away while they are looked up
            self.clear()
        if not len(self.table):
            self.table = np.zeros((KEPT_WORDS, SHAPES), np.int32)
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


WORDS = WordFeatures()
remembers("word features", WORDS.forget)


def word_view(text: str) -> np.ndarray:
    return np.unique(WORDS.of(set(text.split())))


def metadata_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Numbers about the page as a page."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, words = max(len(raw), 1), text.split()
    k, lines = max(len(words), 1), text.count("\n") + 1
    kinds = np.bincount(raw, minlength=256)
    upper, lower, digits, blanks = kinds[65:91].sum() / n, kinds[97:123].sum() / n, kinds[48:58].sum() / n, (kinds[32] + kinds[9:14].sum()) / n
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    plain = (kinds[44] + kinds[46]) / n  # comma, full stop
    distinct = len(set(words)) / k
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    symbols = [kinds[c] / n for c in b"#*$%&|<>!?@:/"]
    sizes = [np.log1p(n), np.log1p(k), np.log1p(lines), np.log1p(n_chars or 0), np.log1p(k / lines), len(raw) / k if words else 0.0]
    dense = [upper, lower, digits, blanks, marks / n - plain, plain, distinct, same, *symbols]
    hot = np.zeros(48)
    hot[xxhash.xxh64_intdigest(f"l{lang}") % 16] = 1
    hot[16 + xxhash.xxh64_intdigest(f"s{source}") % 32] = 1
    return np.concatenate([sizes, dense, np.sqrt(np.maximum(dense, 0)), hot])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def descend(forward, back, y: np.ndarray, size: int, l2: float, steps: int, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic weights, the last one an intercept without penalty, by accelerated gradient descent."""
    v = np.random.default_rng(0).random(size)
    for _ in range(15):
        v = back(weight * forward(v))
        top = np.linalg.norm(v) or 1.0
        v /= top
    rate = 1 / (0.26 * top + l2)
    w = last = np.zeros(size)
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - last)
        grad = back(weight * (sigmoid(forward(ahead)) - y))
        grad[:-1] += l2 * ahead[:-1]
        last, w = w, ahead - rate * grad
    return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 300, weight: np.ndarray | float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    return descend(x.__matmul__, x.T.__matmul__, y, x.shape[1], l2, steps, weight)


def sparse_logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int, l2: float = 0.3, steps: int = 200) -> np.ndarray:
    """As logistic(), of a matrix with a 1 at each (row, column)."""
    forward = lambda w: np.bincount(rows, w[columns], len(y)) + w[-1]
    back = lambda r: np.append(np.bincount(columns, r[rows], width), r.sum())
    return descend(forward, back, y, width + 1, l2, steps)


def stacked(docs: list[np.ndarray], chosen, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of the chosen documents, some at a time."""
    chosen = np.asarray(chosen, np.int64)
    for i in range(0, len(chosen), step):
        part = chosen[i : i + step]
        yield np.repeat(part, [len(docs[k]) for k in part]), np.concatenate([docs[k] for k in part])


def occurrences(docs: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """In how many of these documents each feature occurs."""
    total = np.zeros(DIMS, np.int64)
    for _, features in stacked(docs, np.flatnonzero(of)):
        total += np.bincount(features, minlength=DIMS)
    return total


@dataclass
class Words:
    """The view on content. table: feature -> weight, 0 for those not chosen."""

    table: np.ndarray
    bias: float

    @classmethod
    def fit(cls, docs: list[np.ndarray], kind: np.ndarray) -> Words:
        """kind: GOOD or else the group of bad documents it is in; each group has features of its own."""
        y, good, lists = kind == GOOD, occurrences(docs, kind == GOOD), []
        for k in np.unique(kind[~y]):
            bad, n1, n0 = occurrences(docs, kind == k), int(y.sum()), int((kind == k).sum())
            p = (good + bad) / (n1 + n0)
            z = (bad / n0 - good / n1) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
            first = np.argsort(-z, kind="stable")[:FEATURES]
            lists.append(first[(z[first] > 0) & (good + bad >= LEAST_SEEN)[first]])
        chosen = np.unique(np.concatenate(lists))
        place = np.full(DIMS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, features in stacked(docs, range(len(docs))):  # only the chosen features are kept
            found = place[features]
            rows.append(at[found >= 0])
            columns.append(found[found >= 0].astype(np.int64))
        w = sparse_logistic(np.concatenate(rows), np.concatenate(columns), y.astype(float), len(chosen))
        table = np.zeros(DIMS, np.float32)
        table[chosen] = w[:-1]
        return cls(table, float(w[-1]))

    def odds(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.array([self.table[d].sum() + self.bias for d in docs], float)


@dataclass
class Metadata:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Metadata:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1
        return cls(mean, scale, logistic((x - mean) / scale, y.astype(float)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]


@dataclass
class Model:
    words: Words
    metadata: Metadata
    scales: np.ndarray  # slope and intercept of both views' calibration
    joint: np.ndarray

    def probabilities(self, docs: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.clip(self.words.odds(docs) * self.scales[0][0] + self.scales[0][1], -12, 12)
        b = np.clip(self.metadata.odds(x) * self.scales[1][0] + self.scales[1][1], -12, 12)
        return sigmoid(a), sigmoid(b), sigmoid(a * self.joint[0] + b * self.joint[1] + self.joint[2])


def co_train(docs: list[np.ndarray], x: np.ndarray, kind: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> Model | None:
    """weight: how many documents each labelled one stands for. None if there is nothing to learn from."""
    y = np.where(kind == UNLABELLED, -1, kind == GOOD)
    held = np.sort(np.concatenate([np.flatnonzero(kind == k)[2::5] for k in (GOOD, LOW, TOXIC)]))
    train = np.setdiff1d(np.flatnonzero(y >= 0), held)
    if min((y[train] == 1).sum(), (y[train] == 0).sum(), (y[held] == 1).sum(), (y[held] == 0).sum()) < 2:
        return None
    pool = np.flatnonzero(y < 0)
    sets = [dict(zip(train.tolist(), kind[train].tolist(), strict=True)) for _ in range(2)]
    rate = float(np.average(y[train], weights=weight[train]))
    shift = np.log(rate / (1 - rate)) - np.log(y[train].mean() / (1 - y[train].mean()))  # from the sample's odds to the table's
    named_bad = TOXIC + 1

    def fitted(k: int):
        at = np.array(sorted(sets[k]))
        t = np.array([sets[k][i] for i in at.tolist()])
        return Words.fit([docs[i] for i in at], t) if k == 0 else Metadata.fit(x[at], t == GOOD)

    for r in range(rounds + 1):
        views = fitted(0), fitted(1)
        if r == rounds or not len(pool):
            break
        for k, odds in enumerate((views[0].odds([docs[i] for i in pool]) + shift, views[1].odds(x[pool]) + shift)):
            order = np.argsort(odds)
            low, high = order[: int(exchanged * (1 - rate))], order[len(order) - int(exchanged * rate) :]
            for at, label in ((low[odds[low] < -2], named_bad), (high[odds[high] > 2], GOOD)):
                sets[1 - k].update((int(pool[i]), label) for i in at)
    a, b = views[0].odds([docs[i] for i in held]), views[1].odds(x[held])
    t = y[held].astype(float)
    share = weight[held] / weight[held].mean()
    scales = np.array([logistic(np.clip(v, -30, 30)[:, None], t, steps=500, weight=share) for v in (a, b)])
    pair = np.stack([np.clip(v * s[0] + s[1], -12, 12) for v, s in zip((a, b), scales, strict=True)], 1)
    return Model(*views, scales, logistic(pair, t, steps=500, weight=share))


def views(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    claim("word features")
    texts = [t or "" for t in batch["text"].to_pylist()]
    x = np.array([metadata_view(t, *m) for t, *m in zip(texts, *(batch[c].to_pylist() for c in META), strict=True)])
    return [word_view(t) for t in texts], x


def quotas(counts: dict[int, int], total: int) -> dict[int, int]:
    """How many documents of each kind go into a sample of total: by frequency, but a sixth of it at least, or all there are."""
    every = sum(counts.values())
    if every <= total:
        return counts
    least = {k: min(n, total // 6) for k, n in counts.items()}
    more = {k: max(0, n * total // every - least[k]) for k, n in counts.items()}
    over, room = sum(least.values()) + sum(more.values()) - total, max(1, sum(more.values()))
    return {k: least[k] + (v - -(-v * over // room) if over > 0 else v) for k, v in more.items()}


FEATURED = "doc_id bigint, kind int, words binary, meta binary"


def sample(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> tuple[DataFrame, dict[int, float]]:
    """FEATURED rows of the bounded sample, and how many documents one of each kind stands for."""
    by_hash = lambda seed: (F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    docs = with_metadata(docs)
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).dropna()
    known = known.select("doc_id", F.expr(f"CASE WHEN t = 1 THEN {TOXIC} WHEN q = 1 THEN {GOOD} ELSE {LOW} END").alias("kind"))
    counts = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    takes = quotas(counts, labelled)
    parts = [known.where(F.col("kind") == k).orderBy(*by_hash("labelled")).limit(n) for k, n in takes.items()]
    ids = docs.select("doc_id").dropna()
    free = ids.join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti").distinct().orderBy(*by_hash("pool")).limit(pool)
    wanted = reduce(DataFrame.unionByName, parts, free.withColumn("kind", F.lit(UNLABELLED)))
    met = docs.join(F.broadcast(wanted), "doc_id")  # at most labelled + pool rows
    picked = met.groupBy("doc_id", "kind").agg(F.min(F.struct("text", *META)).alias("row")).select("doc_id", "kind", "row.*")

    def work(batch):
        words, x = views(batch)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["kind"], pa.array([w.tobytes() for w in words], pa.binary()), pa.array([m.tobytes() for m in x], pa.binary())], ["doc_id", "kind", "words", "meta"])

    rows = map_texts(picked, "doc_id", "text", lambda: work, FEATURED, ("kind", *META))
    return rows, {k: counts[k] / n for k, n in takes.items() if n} | {UNLABELLED: 1.0}


def with_metadata(docs: DataFrame) -> DataFrame:
    """The columns this classifier reads, null where the table has none."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*[(docs[c] if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word features (parts of one array), metadata and kinds of FEATURED rows, in an order that the tasks' order doesn't change."""
    ids, kinds, sizes, words, meta = [], [], [], [], []
    for batch in batches:
        ids += batch["doc_id"].to_pylist()
        kinds.append(batch["kind"].to_numpy(zero_copy_only=False))
        raw = batch["words"].to_pylist()
        sizes += [len(r) // 4 for r in raw]
        words.append(np.frombuffer(b"".join(raw), np.int32))
        meta += [np.frombuffer(m) for m in batch["meta"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: xxhash.xxh64_intdigest(str(ids[i])))
    every, ends = np.concatenate([*words, np.zeros(0, np.int32)]), np.cumsum(sizes)
    docs = [every[ends[i] - sizes[i] : ends[i]] for i in order]
    return docs, np.array([meta[i] for i in order]), np.concatenate([*kinds, np.zeros(0, np.int32)])[order].astype(int)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """One task gathers the sample's features, which `labelled` and `pool` bound, and fits; a lost one is run again."""
    rows, stands = sample(docs, labels, labelled, pool)

    def run(batches):
        words, x, kind = gathered(batches)
        model = co_train(words, x, kind, np.array([stands[k] for k in kind.tolist()])) if len(kind) else None
        del words, x
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()  # no task at all for an empty table
    return pickle.loads(found["model"]) if found else None


SCORED = "doc_id bigint, p_content double, p_metadata double, p_good double, kept boolean"


def score(docs: DataFrame, model: Model | None, threshold: float = 0.4) -> DataFrame:
    def work(batch):
        if model is None:
            p = [np.ones(batch.num_rows)] * 3
        else:
            p = model.probabilities(*views(batch))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in p), pa.array(p[2] >= threshold)], ["doc_id", "p_content", "p_metadata", "p_good", "kept"])

    return map_texts(with_metadata(docs), "doc_id", "text", lambda: work, SCORED, META)  # rows as they are, repeated ones too


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.4) -> DataFrame:
    """The rows of docs, all columns as they are, that the classifier does not reject."""
    if model is None:
        return docs
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                have = dict(zip(batch.schema.names, batch.columns, strict=True))
                kinds = {"text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
                seen = pa.RecordBatch.from_pydict({c: pc.cast(have[c], k, safe=False) if c in have else pa.nulls(batch.num_rows) for c, k in kinds.items()})
                yield batch.filter(pa.array(model.probabilities(*views(seen))[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
