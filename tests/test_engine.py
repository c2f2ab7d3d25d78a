"""Layout, store, search, figures, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import intervals, metrics, models, search
from quillspark.operators.extract import entity_rows
from quillspark.sources import files, store
from quillspark.streaming import ingest


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "x int, y int, height int, text string, conf double")
    return df.agg(F.collect_list(F.struct("x", "y", "height", "text", "conf")).alias("b"))


def test_lines_follow_the_running_mean(spark):
    rows = [(50, 2, 10, "b", 0.9), (0, 0, 10, "a", 0.9), (0, 5, 10, "c", 0.9), (0, 30, 10, "d", 0.9), (9, 30, 10, " ", 0.9), (9, 30, 10, "low", 0.1)]
    assert boxes(spark, rows).select(intervals.group_into_lines(F.col("b"))).first()[0] == ["a c b", "d"]
    # each is within reach of its neighbour, but not of the line's mean
    drift = [(k, 5 * k, 10, str(k), 0.9) for k in range(4)]
    assert boxes(spark, drift).select(intervals.group_into_lines(F.col("b"))).first()[0] == ["0 1", "2 3"]
    assert boxes(spark, [(0, 0, 0, "z", 0.9)]).select(intervals.group_into_lines(F.col("b"))).first()[0] == ["z"]


def test_spans(spark):
    df = spark.createDataFrame([("😀bcdef<", [(0, 2), (0, 1), (1, 3), (4, 9), (3, 3), (-1, 2), (4, 6)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(intervals.apply_spans(F.col("t"), F.col("s"))).first()[0] == "[[😀b]]cd[[ef]]<"
    tokens = F.array(*(F.struct(F.lit(k).alias("char_start"), F.lit(k + 2).alias("char_end")) for k in (0, 2, 4)))
    assert df.select(F.size(intervals.tokens_in_span(tokens, F.lit(1), F.lit(3)))).first()[0] == 2
    assert df.select(F.size(intervals.tokens_in_span(tokens, F.lit(3), F.lit(3)))).first()[0] == 0
    html = df.select(intervals.highlight_html(F.col("t"), F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("A&B").alias("type"), F.lit(0.5).alias("confidence"))))).first()[0]
    assert html == '😀<mark class="ent ent-A&amp;B" title="A&amp;B (0.50)">b</mark>cdef&lt;'


TEXTS = ["KEDAI ALI SDN BHD\nNo 1, Jalan Bunga, 43650 Bangi\nTotal 5.00", "RESTORAN MAJU\n88 Jalan Tuanku Abdul Rahman, 50100 Kuala Lumpur\nTotal 9.00"]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    s = store.Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    docs = spark.createDataFrame([(k, f"r{k}.png", f"/in/r{k}.png", t) for k, t in enumerate(TEXTS)], "ref int, filename string, path string, ocr_text string")
    found = entity_rows(docs.withColumnRenamed("ref", "doc_ref"), "doc_ref", "ocr_text")
    absent = spark.createDataFrame([(0, "CASHIER", "absent", -1), (1, "CASHIER", "absent", -1)], "doc_ref int, type string, source string, start int")
    s.add(docs, found.unionByName(absent, allowMissingColumns=True))
    return s, docs, found


def test_store(spark, filled, tmp_path):
    s, docs, found = filled
    assert s.stats() == {"documents": 2, "found": found.count(), "absent": 2}
    assert [r.id for r in s.list_documents(1).collect()] == [2]
    one = s.get(1).first()
    assert [e.value for e in one.entities][-1] is None and one.entities[0].value.startswith("KEDAI ALI") and s.get(99).count() == 0
    assert s.entities_of(1).collect()[-1].value is None
    other = store.Store(spark, f"file://{tmp_path}/other")
    for _ in range(2):
        other.add(docs, found)
    assert [r.id for r in other.table("documents").orderBy("id").collect()] == [3, 4]
    other.add(docs.limit(1).withColumn("path", F.lit("")), found)
    other.add(docs.limit(1).withColumn("path", F.lit("")), found)
    assert other.table("documents").count() == 4
    other.delete(3, 4)
    assert other.table("documents").count() == 2 and {r.doc_id for r in other.table("entities").select("doc_id").distinct().collect()} == {5, 6}
    other.set("embed_model", "a")
    other.set("embed_model", "b")
    assert other.setting("embed_model") == "b" and other.setting("none") is None
    other.vacuum()
    assert other.table("documents").count() == 2


def test_search_stages(spark, filled):
    s, *_ = filled
    rows = s.table("entities").withColumnRenamed("id", "entity_id").persist()
    ask = lambda q, **k: search.search(rows, q, **k)
    assert ask("RESTORAN MAJU").mode == "exact" and ask("bangi").mode == "partial"
    near = ask("Kuala Lumpor")
    assert near.mode == "similar" and "Kuala Lumpur" in near.hits.first().value and near.hits.first().matched_by == "lexical"
    assert ask("Kota Kinabalu").mode == "type_fallback" and ask("Kota Kinabalu").hits.first().type == "ADDRESS"
    assert ask("zzqqxx").mode == ask(" ").mode == ask(None).mode == "empty"
    assert ask("...").mode == "partial"
    encoder = search.hashing_encoder()
    with_vectors = search.embed(rows.drop("embedding"), encoder)
    assert with_vectors.filter("embedding IS NOT NULL").count() == rows.filter("value IS NOT NULL AND type IN ('MERCHANT','ADDRESS','ITEM','CASHIER')").count()
    found = search.search(with_vectors, "RESTORN MAJUU", encoder=encoder, floor=0.3)
    assert found.mode == "similar" and found.hits.first().matched_by == "both"
    assert search.embed(with_vectors, encoder).count() == rows.count()


def test_document_search(spark):
    docs = spark.createDataFrame([(1, "Jumlah BESAR"), (2, "besar"), (3, None), (4, "a%b")], "doc_id long, text string")
    ids = lambda q: [r.doc_id for r in search.search_documents(docs, q).collect()]
    assert ids("besar jumlah") == [1] and ids("Besar") == [1, 2] and ids("%") == [1, 2, 4] and ids(" ") == []


def test_figures(spark):
    rows = [("total", "10.00", "RM 10.0"), ("total", None, "1.00"), ("date", "2024-03-14", "14/03/2024"), ("merchant", "Kedai Ali", "KEDAI ALI!"), ("merchant", "Kedai Aly", "KEDAI ALI"), ("merchant", "x", None)]
    c = metrics.compare(spark.createDataFrame(rows, "field string, predicted string, truth string"))
    assert [(r.exact, r.fuzzy) for r in c.collect()] == [(True, True), (False, False), (True, True), (True, True), (False, True), (False, False)]
    board = {r.field: r for r in metrics.with_prf(metrics.scoreboard(c)).collect()}
    assert (board["merchant"].labelled, board["merchant"].tp, board["merchant"].fp, board["total"].fn) == (2, 2, 1, 1)
    assert board["total"].precision == 1.0 and board["total"].recall == 0.5
    nothing = metrics.averages(metrics.scoreboard(c.filter("field = 'none'"))).first()
    assert nothing.micro_f1 == 0.0


def test_files(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.filename for r in files.scan_images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]
    assert files.scan_images(spark, str(tmp_path), 1).count() == 1
    (tmp_path / "l.json").write_text(json.dumps({"a.jpg": {"company": "A", "total": ""}, "b": {"company": "B"}}))
    (tmp_path / "l.tsv").write_text("image\tcompany\na.jpg\tA\n")
    labels = files.read_labels(spark, str(tmp_path / "l.json"))
    joined = {r.filename: (r.company, r.total) for r in files.with_labels(files.scan_images(spark, str(tmp_path)), labels).collect()}
    assert joined == {"a.jpg": ("A", None), "b.PNG": ("B", None)}
    assert files.read_labels(spark, str(tmp_path / "l.tsv")).first().asDict() == {"filename": "a.jpg", "company": "A", "date": None, "address": None, "total": None}
    df = spark.createDataFrame([("{'a': 1, 'b': None}",), ('{"a": null}',), ("junk",)], "s string")
    assert [r[0] for r in df.select(files.parse_literal("s")).collect()] == [{"a": "1", "b": None}, {"a": None}, {}]
    v = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(files.blob_to_vector(files.vector_to_blob("v"))).collect()] == [[1.0, -2.5], None]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        v.select(files.checked_dim(F.col("v"), 3)).collect()


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 3)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = ingest.extracted(ingest.read_documents(spark, str(tmp_path / "in"), docs.schema, "*.parquet", 1))
    ingest.into(stream, lambda df, _: got.extend(map(str, df.collect())), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(got) == sorted(map(str, ingest.extracted(docs).collect()))


def test_models_and_api(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXTS[0]), (2, None), (3, TEXTS[1])], "doc_id long, text string")
    model = lambda texts: [json.dumps({"total": 5.0, "phone": "03-1234 5678"}) for _ in texts]
    got = {r.doc_id: r for r in api.process(docs, model).collect()}
    assert got[1].fields.total == "5.00" and got[1].fields.phone == "03-1234 5678" and got[2].fields.total is None
    assert got[3].fields.total == "9.00"

    def broken(texts):
        raise RuntimeError("no weights")

    assert [r.fields.total for r in api.process(docs, broken).orderBy("doc_id").collect()] == ["5.00", None, "9.00"]
    differs = {(r.doc_id, r.type) for r in api.compare(docs, model).filter("differs").collect()}
    assert (1, "PHONE") in differs and (1, "TOTAL") not in differs
    said = json.loads(docs.filter("doc_id = 1").select(models.messages(F.col("text"), [("x", '{"total": 1, "items": []}')], items=False)).first()[0])
    assert [m["role"] for m in said] == ["system", "user", "assistant", "user"] and "items" not in said[2]["content"] and TEXTS[0] in said[3]["content"]
    s = store.Store(spark, f"file://{tmp_path}/s")
    api.ingest(s, api.process(docs.filter("text IS NOT NULL"), model))
    assert s.stats()["documents"] == 2 and "[[KEDAI ALI SDN BHD]]" in api.show(s, 1) and '<mark class="ent ent-MERCHANT"' in api.show(s, 1, html=True)
    images = spark.createDataFrame([("/a.png", "a.png", b"KEDAI ALI SDN BHD\nTotal 5.00")], "path string, filename string, content binary")
    reader = lambda blobs: [[{"x": 0.0, "y": 20.0 * k, "height": 10.0, "text": t, "conf": 0.9} for k, t in enumerate(b.decode().split("\n"))] for b in blobs]
    assert api.process_images(images, reader).first().fields.total == "5.00"
    assert models.resolve(models.READERS, "none") == "none" and models.resolve({"a/b": 1}, " AB ", {"ab": "a/b"}) == 1
    boxes = "array<struct<x:double,y:double,height:double,text:string,conf:double>>"
    variants = spark.createDataFrame([(1, 0, [(0.0, 0.0, 1.0, "a", 0.5)]), (1, 1, [(0.0, 0.0, 1.0, "b", 0.5)]), (2, 0, [(0.0, 0.0, 1.0, "c", 0.2)]), (2, 1, [(0.0, 0.0, 1.0, "d", 0.4)])], f"k int, variant_order int, boxes {boxes}")
    assert {r.k: r.variant_order for r in models.best_variant(variants, ["k"]).collect()} == {1: 0, 2: 1}


def test_recoverable_and_retrieval_task(spark):
    rows = [("total", "5.00", "x\nTotal 5-00"), ("date", "1/2/2020", "a\n01-02-2020"), ("company", "KEDAI ALI", "x KEDAI ALL y"), ("company", "", "x"), ("total", "6.00", None)]
    df = spark.createDataFrame(rows, "f string, t string, x string")
    assert [r[0] for r in df.select(metrics.recoverable(F.col("f"), F.col("t"), F.col("x"))).collect()] == [True, True, True, False, False]
    addresses = spark.createDataFrame([("1 Jalan A, Johor Bahru",), ("2 Jalan B, Ipoh",), (" ",)], "address string")
    places = spark.createDataFrame([("johor",), ("johor bahru",), ("ipoh",), ("kl",)], "place string")
    assert {r.place for r in metrics.retrieval_task(addresses, places).collect()} == {"johor bahru", "ipoh"}


def test_entry_works_without_the_llm_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]") and int(out.split()[0]) > 30


def test_store_pointer_is_never_missing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/p")
    one = spark.createDataFrame([("k", "1")], store.SCHEMAS["settings"])
    two = spark.createDataFrame([("k", "2")], store.SCHEMAS["settings"])
    s.replace(settings=one)
    (tmp_path / "p" / "next-stopped.json").write_text('{"settings": "gone"}')  # a writer that stopped before its rename
    assert s.setting("k") == "1"
    s.replace(settings=two)
    assert s.setting("k") == "2" and s._pointers() == [2, 1]
    s.vacuum()
    assert s.setting("k") == "2" and s._pointers() == [2]


def test_pooled_ratios_weigh_by_labels(spark):
    counts = spark.createDataFrame([("a", 8, 4, 6), ("b", 2, 2, 2), ("c", 0, 0, 0)], "field string, labelled long, exact long, fuzzy long")
    assert tuple(metrics.pooled(counts).first()) == (10, 0.6, 0.8)
    assert tuple(metrics.pooled(counts.filter("labelled = 0")).first()) == (0, None, None)
    assert tuple(metrics.pooled(counts.limit(0)).first()) == (0, None, None)


def test_route_is_chosen_on_train_alone(spark):
    grid = lambda *rows: spark.createDataFrame(rows, "route_id int, exact double")
    assert metrics.frozen_route(grid((1, 0.5), (2, 0.9), (3, 0.9)), grid((1, 1.0), (2, 0.1), (3, 0.7))).collect() == [(2, 0.9, 0.1)]
    assert metrics.frozen_route(grid((2, 0.9)), grid((1, 1.0))).collect() == [(2, 0.9, None)]


def test_recoverable_values_are_counted(spark):
    rows = [("total", "12.50", "TOTAL 12.50"), ("total", "9.99", "TOTAL 12.50"), ("total", None, "TOTAL 12.50"), ("date", "01/02/2018", "on 01/02/2018")]
    got = metrics.recoverability(spark.createDataFrame(rows, "field string, truth string, text string")).collect()
    assert sorted(map(tuple, got)) == [("date", 1, 1), ("total", 2, 1)]


def test_mean_confidence(spark):
    rows = spark.createDataFrame([(0, [(0.4,), (0.8,), (0.1,)]), (1, [(0.1,)]), (2, []), (3, None)], "i int, b array<struct<conf:double>>")
    got = [r.m for r in rows.orderBy("i").select(models.mean_confidence(F.col("b")).alias("m")).collect()]
    assert got == [pytest.approx(0.6), 0.0, 0.0, 0.0]


def test_place_of_a_span(spark):
    kind = "i int, t array<struct<char_start:int,char_end:int,line:int,points:array<struct<x:double,y:double>>>>"
    tokens = [(0, 5, 3, [(1.0, 2.0), (9.0, 4.0)]), (6, 9, 1, [(0.0, 7.0)]), (10, 12, 3, [(50.0, 50.0)])]
    at = lambda s, e: spark.createDataFrame([(1, tokens)], kind).select(intervals.place_of(F.col("t"), F.lit(s), F.lit(e)).alias("at")).first()[0]
    found = at(2, 8)
    assert (tuple(found.box), found.lines) == ((0, 2, 9, 7), [1, 3])
    assert at(-1, -1) is None and at(5, 6) is None


def test_hits_by_document(spark):
    documents = spark.createDataFrame([(1, "a", "milk and tea"), (2, "b", "none")], "id long, filename string, ocr_text string")
    found = spark.createDataFrame([(1, 7, "tea", 9, 12), (1, 3, "milk", 0, 4), (1, 9, "lost", -1, -1)], "doc_id long, entity_id long, value string, start int, end int")
    rows = search.by_document(found, documents).collect()
    assert [(r.doc_id, r.filename, [h.entity_id for h in r.hits], r.marked) for r in rows] == [(1, "a", [3, 7, 9], "[[milk]] and [[tea]]")]


def test_reindex_records_the_encoder(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([(1, "SYARIKAT MAJU SDN BHD\nNO 5 JALAN BESAR\n50000 KUALA LUMPUR\nTOTAL 5.00")], "doc_id long, text string")
    api.ingest(s, api.process(docs))
    n = api.reindex(s, search.hashing_encoder(8), "hash-8")
    assert n > 0 and (s.setting("encoder"), s.setting("encoder_dim")) == ("hash-8", "8")
    assert api.reindex(s, search.hashing_encoder(16), "hash-16") == n and s.setting("encoder_dim") == "16"
    assert {len(r.embedding) for r in s.table("entities").filter("embedding IS NOT NULL").collect()} == {16}


def test_labelled_images_into_the_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a.png", bytearray(b"TOTAL 5.00"), {"total": "5.00"})], "filename string, content binary, truth map<string,string>")
    reader = lambda images: [[{"x": 0.0, "y": 0.0, "height": 9.0, "text": bytes(x).decode(), "conf": 0.9}] for x in images]
    got = api.dataset(s, rows, reader).collect()
    assert [(r.path, r.truth["total"], r.fields.total) for r in got] == [("dataset/a.png", "5.00", "5.00")]
    assert [r.path for r in s.list_documents().collect()] == ["dataset/a.png"]


def test_three_configurations(spark):
    docs = spark.createDataFrame([(1, "KEDAI MAJU SDN BHD\nTOTAL 5.00")], "doc_id long, text string")
    rows = {r.type: r for r in api.compare(docs, lambda texts: [json.dumps({"date": "2018-02-01", "total": 5}) for _ in texts]).collect()}
    assert (rows["TOTAL"].rules, rows["TOTAL"].model, rows["TOTAL"].hybrid, rows["TOTAL"].differs) == ("5.00", "5.00", "5.00", False)
    assert rows["DATE"].rules is None and rows["DATE"].model and rows["DATE"].differs
    assert rows["MERCHANT"].model is None and rows["MERCHANT"].rules
