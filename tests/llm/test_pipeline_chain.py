import random
import zlib

import public_tokenizers
from test_jaccard_join import brute as brute_near
from tokenizers import Tokenizer

import corpus_pipeline


def removed_spans(texts, ids, width=50):
    least = {}
    for t, i in zip(texts, ids):
        b = t.encode()
        for k in range(len(b) - width + 1):
            least[b[k : k + width]] = min(least.get(b[k : k + width], i), i)
    out = []
    for t, i in zip(texts, ids):
        b, gone = t.encode(), set()
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone.update(range(k, k + width))
        out.append(bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore"))
    return out


def test_the_whole_run_equals_a_chain_of_brute_force(spark, frame, tmp_path):
    rnd = random.Random(12)
    words = [f"{rnd.choice('bcdfg')}{i}é" for i in range(500)]
    passage = " ".join(rnd.choices(words, k=25))
    texts = []
    for _ in range(30):
        base = rnd.choices(words, k=rnd.randint(20, 90))
        texts.append(" ".join(base))
        if rnd.random() < 0.5:
            texts.append("\t ".join(base))  # equal but for blanks
        if rnd.random() < 0.5:
            texts.append(" ".join([*base[:-2], "changed", "end"]))
        if rnd.random() < 0.4:
            texts.append(" ".join(rnd.choices(words, k=60)) + " " + passage)
    texts += ["", None]
    ids = rnd.sample(range(10_000), len(texts))
    frame(texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    first = {}
    for i, t in sorted(zip(ids, texts)):
        first.setdefault(" ".join((t or "").split()) or (t or "")[:1], (i, t or ""))
    docs = sorted(first.values())
    near = brute_near([t for _, t in docs], [i for i, _ in docs])
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    kept = removed_spans([t for _, t in docs], [i for i, _ in docs])
    assert len(docs) < len(texts) - 15 and sum(map(len, kept)) < sum(len(t) for _, t in docs)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for (i, _), t in zip(docs, kept):
        tokens = [*library.encode(t, add_special_tokens=False).ids, 2]
        raw = b"".join(x.to_bytes(4, "little") for x in tokens)
        want.add((i, 0, 0, len(tokens), zlib.crc32(raw)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        assert sum(n for _, n in parts) <= 1024 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
