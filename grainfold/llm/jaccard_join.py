"""Links between documents with similar sets of word n-grams, by prefix filters under several global orders.

Two sets with a Jaccard similarity of t or more share an element among the first n - ceil(t n) + 1 of each,
under any one order of all elements. Here there are three orders. All put rare n-grams first, by how many
sets of the whole corpus have them (in classes that double), and differ in the order within a class. A document
is a candidate only if its prefixes hold n-grams of other sets. Pairs that share a prefix element under the first order,
and have enough left behind it for a link, are looked up in the other two orders by their prefixes alone: the filters are
intersected, and only pairs that pass all of them have their sets brought together. Verification is exact on the whole sets.

What is asked for are the components of the links, so that not every pair has to be met. Equal sets are one
set from the start. All sets of one posting list are compared with one of them first; lists whose sets are then in one
component are done. In the others each set outside the list's largest component is compared with some sets of other components,
with more in each round, other ones in each of its lists, until the list is in one component or all its pairs from different
components were compared. Every pair that can be linked is thus either verified or already connected, and a group of near copies
costs all its pairs only for those of its sets that stay unlinked with nearly all of it.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text of fewer
words than n has its whole sequence as one element; rows with one doc_id and
different texts are linked each by its own text; a null doc_id shares its component's number; an empty table gives no
rows; a document is always within one block, so a very long one takes a worker some 100 bytes a word. N-grams are known by
64-bit hashes. Sets are numbered by one too, but two different sets of one number are found by a second hash, and told apart. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm.common import claim, documents, lean, ship_package, stash, utf8
from grainfold.llm.components import components
from grainfold.llm.lm_scores import HASHES
from grainfold.llm.span_dedup import PACKED, packed, returned_codes, shared_keys, sliced_keys

WORDS, PERCENT = 5, 75
#: Sets of a list that one of another component meets in the round after the hubs, and how many times more in each one after.
FEW, GROWTH = 8, 8
BLOCK_BYTES = 8_000_000
SEEDS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
STEP = np.uint64(0x2545F4914F6CDD1D)


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    rolled = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        rolled = rolled * STEP + h[i : len(h) - width + 1 + i]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * SEEDS[0] + np.uint64(width)
    return distinct_sorted(rolled)


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def frequency_class(owners: np.ndarray) -> np.ndarray:
    """0 for one set, then one more for each doubling."""
    return np.floor(np.log2(owners)).astype(np.uint8)


def order_keys(tokens: np.ndarray, classes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """By which a global order places elements: rare classes first, and within a class by a hash."""
    return (classes.astype(np.uint64) << np.uint64(56)) | ((tokens * seed) >> np.uint64(8))


def in_prefix(key: np.ndarray, percent: int) -> np.ndarray:
    """Which elements of a set are among its first ones under an order; equal keys stay together."""
    size = len(key)
    p = size - -(-percent * size // 100) + 1
    return key <= np.partition(key, p - 1)[p - 1]


def prefix(tokens: np.ndarray, classes: np.ndarray, seed: np.uint64, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of a set that other sets have too, in their order, and their places."""
    key = order_keys(tokens, classes, seed)
    chosen = np.flatnonzero(in_prefix(key, percent))
    chosen = chosen[np.argsort(key[chosen], kind="stable")]
    places = np.flatnonzero(classes[chosen] > 0)
    return tokens[chosen[places]], places.astype(np.int32)


ROWS = "doc_id bigint, n_shingles bigint, set_id bigint, second bigint, tokens binary, p0 binary, p1 binary, p2 binary, places binary"


def folded(tokens: np.ndarray) -> bytes:
    """Sorted 32-bit halves of tokens: equal tokens have equal ones, so that a filter on them loses nothing."""
    return distinct_sorted((tokens ^ (tokens >> np.uint64(32))).astype(np.uint32)).tobytes()


def meet(x: bytes, y: bytes, kind=np.uint64) -> int:
    x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def brought(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and these columns of both sets, as a_ and b_."""
    a, b = (sets.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in ("a", "b"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")


def kept_pairs(both: DataFrame, columns: list[str], holds) -> DataFrame:
    """The pairs for which holds(the columns of a and b, alternating) is true."""

    def run(batches):
        for batch in batches:
            sides = [batch[f"{side}_{c}"].to_pylist() for c in columns for side in ("a", "b")]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array([holds(*x) for x in zip(*sides, strict=True)], pa.bool_()))

    return both.select("a", "b", *[f"{side}_{c}" for c in columns for side in ("a", "b")]).mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, report: list | None = None) -> DataFrame:
    """The pairs (a, b) that are links: those that share a prefix element under the other orders too, by their whole sets.
    report gets the number of pairs before and after the filters, if a list is given."""
    under_all = kept_pairs(brought(pairs, sets, ["p1", "p2"]), ["p1", "p2"], lambda a1, b1, a2, b2: meet(a1, b1, np.uint32) > 0 and meet(a2, b2, np.uint32) > 0)
    if report is not None:
        report.append((pairs.count(), under_all.count()))

    def linked(x: bytes, y: bytes) -> bool:
        same = meet(x, y)
        return 100 * same >= percent * ((len(x) + len(y)) // 8 - same)

    return kept_pairs(brought(under_all, sets, ["tokens"]), ["tokens"], linked)


def candidates(docs: DataFrame, n: int, percent: int, block_bytes: int) -> DataFrame:
    """ROWS of every document; tokens and prefixes only where a prefix holds an element that other sets have too.

    Blocks of documents explode into their distinct n-grams; these are dealt out by value, and each block gets
    back the class of each by how many sets have it. N-grams of a single set come first under every order, so a
    prefix has a shared element exactly if enough of the whole set is shared.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = slices = max(1, -(-total // block_bytes))
    by_block = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block").groupBy("block")

    def sets_of(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        claim("word hashes")
        made = [shingles(t, n) for t in utf8(group["text"].combine_chunks())]
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(m.tobytes()) for m in made), np.uint64).reshape(-1, 2)
        return made, both[:, 0], both[:, 1]

    def explode(group: pa.Table) -> pa.Table:
        made, ids, _ = sets_of(group)
        _, first = np.unique(ids, return_index=True)
        keys, owners = np.unique(np.concatenate([made[i] for i in first]), return_counts=True)
        return packed(sliced_keys(keys, owners, slices, group["block"][0].as_py()))

    def choose(group: pa.Table, found: pa.Table) -> pa.Table:
        made, ids, second = sets_of(group)
        _, places_ = np.unique(np.concatenate(made), return_inverse=True)
        every_class = returned_codes(found.to_pylist())[places_]
        ends = np.cumsum([len(m) for m in made])
        seen: set[tuple[int, int]] = set()
        columns: list[list] = [[], [], [], [], []]
        for i, m in enumerate(made):
            classes = every_class[ends[i] - len(m) : ends[i]]
            parts: list = [None] * 5
            one = int(ids[i]), int(second[i])
            if len(m) and 100 * np.count_nonzero(classes) >= percent * len(m) and one not in seen:
                seen.add(one)
                p0, places = prefix(m, classes, SEEDS[0], percent)
                others = [m[in_prefix(order_keys(m, classes, s), percent) & (classes > 0)] for s in SEEDS[1:]]
                parts = [m.tobytes(), p0.tobytes(), *map(folded, others), places.tobytes()]
            for c, p in zip(columns, parts, strict=True):
                c.append(p)
        return pa.table({"doc_id": group["doc_id"], "n_shingles": pa.array([len(m) for m in made], pa.int64()), "set_id": pa.array(ids.view(np.int64)), "second": pa.array(second.view(np.int64)), **{k: pa.array(c, pa.binary()) for k, c in zip(("tokens", "p0", "p1", "p2", "places"), columns, strict=True)}})

    keys = by_block.applyInArrow(lean(explode), PACKED).repartition(slices, "slice")
    codes = keys.groupBy("slice").applyInArrow(lean(shared_keys(frequency_class)), PACKED).repartition(blocks, "block")
    return by_block.cogroup(codes.groupBy("block")).applyInArrow(lean(choose), ROWS)


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with another number for those sets that share one with a different set: by 64-bit hashes a handful among billions."""
    sets = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("second").alias("first"), F.max("second").alias("last"))
    clashes = sets.where("first != last").select(F.col("set_id").alias("clash"), "first")
    if clashes.isEmpty():
        return rows
    met = rows.join(clashes.hint("merge"), F.col("set_id") == F.col("clash"), "left")
    return met.withColumn("set_id", F.when(F.col("second") != F.col("first"), F.xxhash64("set_id", "second")).otherwise(F.col("set_id"))).drop("clash", "first")


def unpack(rows: DataFrame) -> DataFrame:
    """(token, doc, n, rest) of the shared prefix elements under the first order; rest: the elements from this one on."""

    def run(batches):
        for batch in batches:
            values = [np.frombuffer(x, np.uint64) for x in batch["p0"].to_pylist()]
            sizes = [len(v) for v in values]
            token = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
            doc, n = (np.repeat(batch[c].to_numpy(), sizes) for c in ("set_id", "n_shingles"))
            at = np.concatenate([*(np.frombuffer(x, np.int32) for x in batch["places"].to_pylist()), np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token, doc, n, n - at)], ["token", "doc", "n", "rest"])

    return rows.select("set_id", "n_shingles", "p0", "places").mapInArrow(run, "token bigint, doc bigint, n bigint, rest bigint")


def fits(a: str, b: str, percent: int) -> str:
    """Whether two sets can be a link by their sizes and, if this is the first element they share, by what follows it."""
    n, m, r, q = f"{a}n", f"{b}n", f"{a}rest", f"{b}rest"
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND {100 + percent} * least({r}, {q}) >= {percent} * ({n} + {m})"


def with_hubs(open_: DataFrame, percent: int) -> DataFrame:
    """Every set of a list with one of them: (doc, other.doc) that can be links."""
    central = F.expr("16 * (n - rest) DIV n")  # few rarer elements of its own: close to most others
    hubs = open_.groupBy("token").agg(F.min(F.struct(central.alias("c"), F.xxhash64("doc", F.lit(0)).alias("h"), "doc", "n", "rest", "component")).alias("other"))
    return open_.join(hubs.hint("merge"), "token").where(f"component != other.component AND {fits('', 'other.', percent)}")


def with_slots(open_: DataFrame, seed: int, each: int, percent: int) -> DataFrame:
    """The sets of a list that are not in its largest component, each with one slot of the list: (doc, other.doc) that can be links.

    A list is dealt into slots of about `each` sets, and a set takes another slot in each of its lists. A list of up to `each`
    sets has one slot: all its pairs from different components are compared, because one of the two is always outside the largest.
    """
    by_component = open_.groupBy("token", "component").agg(F.count("*").alias("k"))
    sizes = by_component.groupBy("token").agg(F.ceil(F.sum("k") / each).alias("slots"), F.max(F.struct("k", "component")).getField("component").alias("largest"))
    listed = open_.join(sizes.hint("merge"), "token")
    x = listed.where("component != largest").withColumn("slot", F.expr(f"pmod(xxhash64(doc, token, {seed}), slots)"))
    y = listed.select("token", F.expr(f"pmod(xxhash64(doc, {seed}), slots)").alias("slot"), F.struct("doc", "n", "rest", "component").alias("other"))
    once = "(slots > 1 OR other.component = largest OR doc < other.doc)"
    return x.join(y.hint("merge"), ["token", "slot"]).where(f"component != other.component AND {once} AND {fits('', 'other.', percent)}")


def links(rows: DataFrame, percent: int, report: list | None = None) -> DataFrame:
    """Links (a, b) between different sets, enough to connect whatever all links connect."""
    rows = rows.where("tokens IS NOT NULL")
    found = rows.select("set_id", "tokens", "p1", "p2").dropDuplicates(["set_id"])
    postings = stash(unpack(rows).distinct(), "postings")  # a set of several blocks comes from each
    near, each, seed = None, 0, 0
    open_ = postings.withColumn("component", F.col("doc"))
    while True:
        pairs = with_slots(open_, seed, each, percent) if each else with_hubs(open_, percent)
        met = stash(verify(pairs.select(F.greatest("doc", "other.doc").alias("a"), F.least("doc", "other.doc").alias("b")).distinct(), found, percent, report), "links")
        joined = components(near.unionByName(met) if near else met)
        near = joined.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))  # one link a set says as much as all
        labelled = open_.drop("component").join(joined.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        lists = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
        several = lists.where(f"x != y AND size > {each}").select("token")  # up to each sets: one slot, so all its pairs were compared
        open_ = stash(labelled.join(several.hint("merge"), "token", "left_semi"), "open_postings")
        if open_.isEmpty():
            return near
        each, seed = each * GROWTH or FEW, seed + 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, report: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links. report: see verify()."""
    ship_package(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = told_apart(stash(candidates(docs, n, percent, block_bytes), "sets"))
    joined = components(links(rows, percent, report)).withColumnRenamed("node", "set_id")
    small = rows.select("doc_id", "n_shingles", "set_id").where("n_shingles > 0")
    grouped = small.groupBy("set_id").agg(F.min("doc_id").alias("head")).join(joined.hint("merge"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    heads = grouped.groupBy("component").agg(F.min("head").alias("component_id"))
    heads = grouped.join(heads.hint("merge"), "component").select("set_id", "component_id")
    out = small.join(heads.hint("merge"), "set_id").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


#: All pairs that share a shingle, then whatever links reach.
ORACLE = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - {WORDS - 1}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (n + m - c)), r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(reached) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s"""
