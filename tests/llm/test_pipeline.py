"""The pipeline against brute force on a small corpus, and its registered queries."""

import hashlib
import random
import re

import pytest

import corpus_pipeline


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    n = len(a & b)
    return bool(a and b) and 100 * n >= 75 * (len(a) + len(b) - n)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = [f"word{k}" for k in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    item = prose(30)
    docs, toxic = [], {}
    for k in range(240):
        t = prose(rnd.randint(20, 80))
        toxic[k] = k % 4 == 0
        docs.append((k, t + " nastyword" * toxic[k]))
    clean = [t for k, t in docs if not toxic[k]]
    docs += [(300 + k, clean[k].replace(" ", "  \n")) for k in range(10)]
    for k in range(10):
        w = clean[20 + k].split()
        w[-1] = "edited"
        docs.append((320 + k, " ".join(w)))
    docs += [(340 + k, f"{prose(40)} {item} {prose(5)}") for k in range(5)] + [(350, None), (351, ""), (352, prose(3000)), (None, prose(25))]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, 1, int(v)) for k, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, item


def test_pipeline(spark, corpus, vocabulary):
    import sentencepiece

    root, docs, item = corpus
    kept = [(i, t) for i, t in docs if "nastyword" not in (t or "")]
    first = {}
    for i, t in kept:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in first or (first[key][0] is None) or (i is not None and i < first[key][0]):
            first[key] = (i, t)
    kept = list(first.values())
    sets = {i: shingles(t) for i, t in kept}
    gone = set()
    for i in sets:
        group, todo = {i}, [i]
        while todo and i is not None:
            x = todo.pop()
            for j in sets:
                if j is not None and j not in group and alike(sets[x], sets[j]):
                    group.add(j)
                    todo.append(j)
        if i is not None and min(group) != i:
            gone.add(i)
    kept = [(i, t) for i, t in kept if i not in gone and item not in re.sub(r"\s+", " ", t or "")]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = {i: ([1, *sp.encode(t or ""), 2], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept}
    rows = corpus_pipeline.run(spark, root).collect()
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)
    assert len(gone) >= 10 and len(want) < 200


def test_stages_keep_the_columns(spark, corpus):
    root, docs, _ = corpus
    df = spark.read.parquet(f"{root}/documents.parquet")
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, root).columns == df.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert corpus_pipeline.STAGES[-1][1](spark, none, root).count() == 0


def test_repeated_rows_null_and_extra_columns(spark, corpus, tmp_path):
    root, _, _ = corpus
    text = " ".join(f"unseen{k}" for k in range(30))
    rows = [(1, text, "a", 1), (1, text, "b", 2), (None, None, None, None), (None, None, "c", 3), (2, f"{text}\n", "d", 4), (3, "", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__gone` string, ids int")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3] and {r["__gone"] for r in got if r.doc_id == 1} <= {"a", "b"}


def test_no_documents(spark, corpus, tmp_path):
    root, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
