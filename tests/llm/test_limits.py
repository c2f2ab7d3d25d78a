"""What keeps the operators within their limits."""

import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from quillspark.llm import context_tree, substring


def test_windows_are_shuffled_once(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(3, f"a b {passage} c"), (1, f"d {passage} e f"), (2, None), (None, passage)], "doc_id long, text string")
    kept = substring.remove_repeats(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("MapInArrow _windows(" in line for line in plan.splitlines()) == 1
    assert {r.doc_id: (r.n_words, r.n_removed) for r in kept.collect()} == {3: (63, 60), 1: (63, 0), 2: (0, 0), None: (60, 0)}


def test_words_in_use_are_not_forgotten(monkeypatch):
    import public_tokenizers

    from quillspark.llm import spm

    codec, asked = spm.Codec(public_tokenizers.path("piece_bpe_32k.model")), []
    real = codec.backtrack
    monkeypatch.setattr(spm, "REMEMBERED", 8)
    monkeypatch.setattr(codec, "backtrack", lambda w: asked.append(w) or real(w))
    text = " ".join(f"word{k} the é漢{k}" for k in range(60))
    assert codec.encode(text) == codec._library.encode(text)
    assert asked.count("▁the") == 1


def test_a_stage_starts_by_giving_back_heap(spark, monkeypatch):
    import corpus_pipeline
    from quillspark.llm import common

    common.relax(spark)
    asked = []
    monkeypatch.setattr(corpus_pipeline, "relax", asked.append)
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [1, 3]
    assert asked == [spark]


def test_keys_of_a_chunk_are_taken_by_parts(monkeypatch):
    rnd = random.Random(5)
    texts = [(k % 3 == 0, bytes(rnd.choices(b"abc \x00\xff", k=n))) for k, n in enumerate((0, 1, 5, 9, 4000, 7000))]
    want, numbers = Counter(), []
    for held, t in texts:
        x = bytes(6) + t
        for k in range(6, len(x)):
            key = int.from_bytes(x[k - 6 : k][::-1] + x[k : k + 1], "big")
            want[key] += not held
            numbers.append(key)
    monkeypatch.setattr(context_tree, "STEP", 500)
    keys, counts = context_tree._counted(texts)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == dict(want) and keys.tolist() == sorted(want)
    x, own, _ = context_tree._padded([t for _, t in texts])
    known, number = context_tree._numbered(x, own)
    assert known[number[own]].tolist() == numbers


def test_steps_on_a_chunk_hold_a_few_bytes_for_each_of_its_own():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(2000)]
    text = " ".join(rnd.choices(words, k=2_000_000)).encode()
    tracemalloc.start()
    try:
        keys, _ = context_tree._counted([(False, text)])
        counted = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        context_tree._scores([text], [np.zeros(len(keys), dtype=np.float32).tobytes()])
        scored = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counted < 12 * len(text) and scored < 17 * len(text), (counted / len(text), scored / len(text))


def test_pieces_of_a_subtree_are_the_whole(monkeypatch):
    rnd = random.Random(7)
    chunks = [context_tree._counted([(False, bytes(rnd.choices(b"xyz", k=900)) + b"ab" * 50)]) for _ in range(3)]
    pack = context_tree._pack
    rows = pa.table({"chunk": [10, 11, 12], "bucket": pa.array([3] * 3, pa.int32()), "grams": [pack(np.diff(k, prepend=0)) for k, _ in chunks], "n": [pack(n) for _, n in chunks]})
    sent = SimpleNamespace(value=(np.full((256, 255, 2), 0.1), np.full((256, 255), 0.8)))

    def results():
        out = defaultdict(list)
        mixed = context_tree._mixed(rows)
        pieces = mixed.filter(pa.compute.is_valid(mixed.column("place"))).select(["place", "grams", "bits", "chunks", "asked"])
        for b in context_tree._logs(sent)(iter(pieces.to_batches())):
            for r in b.to_pylist():
                out[r["chunk"]].append((r["place"], r["s"]))
        return {c: b"".join(s for _, s in sorted(x)) for c, x in out.items()}, pieces.num_rows

    whole, one = results()
    monkeypatch.setattr(context_tree, "PIECE", 37)
    pieces, more = results()
    assert one == 1 < more and pieces == whole
    assert [len(whole[c]) for c in (10, 11, 12)] == [4 * len(k) for k, _ in chunks]


def test_the_engine_makes_no_lists_of_words_and_keys(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string")
    plan = context_tree.score(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
