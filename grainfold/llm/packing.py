"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents become tokens, tokens become pieces of at most `capacity`. How many pieces there are of each
length is a table of at most `capacity` numbers, whatever the corpus; the packing is decided on it:

1. Reduction: for a piece j, a small set that contains j and dominates every other feasible set that
   contains j (a piece that fills the rest exactly; j alone if nothing fits; the largest piece that fits,
   if only one fits, or if it is as large as any two that fit) is fixed for good, and the instance shrinks.
   Passes are repeated until nothing more can be fixed.
2. Best-fit decreasing on what is left, for all pieces of one length at a time.

The result is a list of patterns with multiplicities. Pieces are numbered within their length by their
task and place (a running sum over tasks, never a sort of all pieces of one length) and take the slots
of their length in order.

Defined cases: a null text counts as empty and is one piece, the end token alone; repeated rows are
packed each; a document longer than the capacity is cut so that only its first piece may be shorter.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold.llm.common import documents, map_texts, stash

CAPACITY, END = 1024, 2


def reduce_by_dominance(count: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix dominating sets; count (pieces by length) is changed to what is left. Returns (times, lengths) patterns."""
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def fix(times: int, *lengths: int) -> None:
        for w in lengths:
            count[w] -= times
        fixed.append((times, lengths))

    def smallest(without: int) -> list[int]:
        """Up to three of the smallest pieces, besides one of length `without`."""
        out: list[int] = []
        for w in range(1, capacity + 1):
            out += [w] * min(3 - len(out), count[w] - (w == without))
            if len(out) == 3:
                break
        return out

    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while count[w] > 0:
                rest = capacity - w
                low = smallest(w)
                if rest == 0 or not low or low[0] > rest:
                    fix(count[w], w)
                    changed = True
                    continue
                best = next(x for x in range(rest, 0, -1) if count[x] - (x == w) > 0)
                times = count[w] // 2 if best == w else min(count[w], count[best])
                if best == rest:
                    fix(times, w, best)
                    changed = True
                    continue
                fits = sum(1 for k in range(1, len(low) + 1) if sum(low[:k]) <= rest)
                if fits == 1 or fits == 2 and best >= best_pair(count, w, rest):
                    fix(max(1, times - 3), w, best)  # while three of each length remain, the reason stays the same
                    changed = True
                    continue
                break
    return fixed


def best_pair(count: list[int], without: int, rest: int) -> int:
    """The largest sum within rest of two pieces besides one of length `without`."""
    have = [x for x in range(1, rest) if count[x] - (x == without) > 0]
    best, i, j = 0, 0, len(have) - 1
    while i <= j:
        a, b = have[i], have[j]
        if a + b > rest or (i == j and count[a] - (a == without) < 2):
            j -= 1
        else:
            best = max(best, a + b)
            i += 1
    return best


def best_fit(count: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing of all pieces, a group of equal sequences at a time."""
    rooms: list[int] = []  # the rooms there are, ascending
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def add(times: int, lengths: tuple[int, ...]) -> None:
        room = capacity - sum(lengths)
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((times, lengths))

    for w in range(capacity, 0, -1):
        n = count[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                times, lengths, room = n, (), capacity
            else:
                room = rooms[at]
                times, lengths = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // w
            full = min(times, n // each)
            if full:
                add(full, lengths + (w,) * each)
                n -= full * each
                if lengths and times > full:
                    add(times - full, lengths)
            else:
                add(1, lengths + (w,) * n)
                n = 0
                if lengths and times > 1:
                    add(times - 1, lengths)
    return [g for room in rooms for g in groups[room]]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    count = [0] * (capacity + 1)
    for w, n in counts.items():
        if not 1 <= w <= capacity:
            raise ValueError(f"a piece of {w} tokens, where 1 to {capacity} are allowed")
        count[w] = n
    return reduce_by_dominance(count, capacity) + best_fit(count, capacity)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first number of each run of slots, its first sequence and its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, lengths in patterns:
        offset = 0
        for w in lengths:
            runs.setdefault(w, []).append((taken.get(w, 0), sequence, offset))
            taken[w] = taken.get(w, 0) + times
            offset += w
        sequence += times
    return {w: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for w, r in runs.items()}


@lru_cache(4)
def encoding(path: str):
    """The tokenizer of a byte-level JSON file as a rank table, which gives the same ids several times faster."""
    import public_tokenizers
    import tiktoken

    from grainfold.llm.token_counts import load_json

    ranks, special = load_json(path)
    first = max(ranks.values()) + 1
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={s: first + i for i, s in enumerate(special)})


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece. task, nth: where it was made, and its number there among the pieces of its length."""

    def make():
        encode = encoding(tokenizer_path).encode_to_numpy
        task, made = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def work(batch):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encode(text.as_py() or "", allowed_special="all"), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, made[b - a]))
                    made[b - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        return work

    return map_texts(docs, id_col, text_col, make, PIECES)


PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    made = stash(pieces(docs, tokenizer_path, capacity, end, id_col, text_col), "pieces")
    by_task = stash(made.groupBy("length", "task").count(), "piece_counts")
    table = by_task.groupBy("length").agg(F.sum("count").alias("n"))
    plan = slots(pack({r["length"]: r["n"] for r in table.collect()}, capacity))  # at most `capacity` rows

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    numbered = made.join(starts.hint("merge"), ["length", "task"])  # a key has what one task made of one length
    numbered = numbered.select(*[x.split()[0] for x in PIECES.split(", ")[:5]], (F.col("first") + F.col("nth")).alias("number"))

    def place(batches):
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for w in np.unique(length):
                mine = np.flatnonzero(length == w)
                first, base, off = plan[int(w)]
                run = np.searchsorted(first, number[mine], "right") - 1
                sequence[mine] = base[run] + number[mine] - first[run]
                offset[mine] = off[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [x.split()[0] for x in PLACED.split(", ")])

    return numbered.mapInArrow(place, PLACED)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
