"""Receipts are read by all tasks, and each once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.plans.receipts import receipts

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@tables
def test_receipts_are_dealt_over_all_cores(spark):
    assert receipts(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lines_that_differ_in_digits_are_matched_once():
    from quillspark.operators import extract as X

    text = "KEDAI X SDN BHD\nTarikh: 1{0}/03/2024\nNo. Resit: R-000{0}87\nJumlah Kecil 1{0}1.50\nJUMLAH BESAR 3{0}5.17"
    wanted = [X.extract(text.format(3))]
    seen = X._remembered.cache_info().misses
    wanted += [X.extract(text.format(4)), X.extract(text.format(5))]
    assert X._remembered.cache_info().misses == seen
    got = [{e.type: e.value for e in x} for x in wanted]
    assert [x["DATE"] for x in got] == ["2024-03-13", "2024-03-14", "2024-03-15"]
    assert [x["INVOICE_NO"] for x in got] == ["R-000387", "R-000487", "R-000587"]
    assert [(x["SUBTOTAL"], x["TOTAL"]) for x in got] == [("131.50", "335.17"), ("141.50", "345.17"), ("151.50", "355.17")]


def test_a_phone_of_eight_digits_is_found():
    from quillspark.operators.extract import extract

    assert [e.value for e in extract("KEDAI X SDN BHD\nNo. 7/B 00072519") if e.type == "PHONE"] == ["00072519"]


def test_a_comparison_extracts_once(monkeypatch):
    from quillspark.operators import reconcile as R

    text = "KEDAI ALI SDN BHD\nDate 1/2/2020\nSubtotal 10.00\nTax 0.60\nTotal 10.60"
    reply = '{"merchant": "kedai ali sdn bhd", "total": 10.6, "date": "2020-02-02"}'
    calls, real = [], R.extract
    monkeypatch.setattr(R, "extract", lambda t: calls.append(t) or real(t))
    got = {x["type"]: tuple(x.get(w) for w in R.WAYS) for x in R.three_ways(text, reply)}
    assert len(calls) == 1
    assert got["TOTAL"] == ("10.60", "10.60", "10.60") and got["TAX"] == ("0.60", None, "0.60")
    assert got["DATE"] == ("2020-02-01", "2020-02-02", "2020-02-01")
    assert {x["type"] for x in R.three_ways(None, None)} == set()


@tables
def test_fields_extract_once(spark):
    from quillspark.plans import catalog

    plan = catalog.rule_extract_fields(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("entities(") == 1


@tables
def test_flagship_extracts_once(spark):
    from quillspark.plans import catalog

    plan = catalog.receipts_by_language(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("entities(") == 1


def test_some_fields_are_those_of_all_entities(spark):
    from quillspark.functions import vocabulary as V
    from quillspark.operators import extract as X

    rnd = random.Random(8)
    lines = ["KEDAI ALI SDN BHD", "ALI", "SDN BHD", "No 12, Jalan Bunga Raya, 43650 Bangi", "Tarikh: 13/03/2024", "2 Mac 2024 10:45 pm", "Masa 9:05", "No. Resit: R-000387", "GST ID: 0012-3456", "Tel: 03-8925 1234",
             "Cashier: Siti", "Subtotal 1,234.50", "Jumlah Kecil", "RM 12-50", "SST 6% 74.07", "JUMLAH BESAR 1,308.57", "Total", "1,308.57", "Total items 3 2.00", "GST SUMMARY", "Tunai 1,350.00", "Cash 20", "Baki 41.43", "Teh 2 x 3.50", "", "VISA 12.00", "~~ ** ||"]
    texts = ["\n".join(rnd.choices(lines, k=rnd.randint(1, 14))) for _ in range(600)] + [None, "", "  \n "]
    for t in texts:
        first = {}
        for e in X.extract(t):
            first.setdefault(e.type, e.value)
        for names in ({"SUBTOTAL", "TAX", "TOTAL"}, {"ADDRESS", "DATE"}, set(V.FIELDS)):
            got = X.Receipt(t).values(frozenset(names)) if t and t.strip() else {}
            assert {k: got.get(k) for k in names} == {k: first.get(k) for k in names}, t
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts[-40:])], "k long, text string")
    names = ("merchant", "total", "date")
    got = df.select("k", X.values(F.col("text"), *names).alias("v")).collect()
    want = {r.k: r.f for r in df.select("k", X.fields(X.entities(F.col("text"))).alias("f")).collect()}
    assert all(tuple(r.v) == tuple(want[r.k][n] for n in names) for r in got) and len(got) == 40


def test_a_sum_of_amounts_looks_for_amounts_only(monkeypatch):
    from quillspark.operators import extract as X

    for name in ("merchant", "address", "date", "time", "phone", "payment", "labelled", "items"):
        monkeypatch.setattr(X.Receipt, name, lambda *_: pytest.fail("not asked for"))
    assert X.Receipt("KEDAI X\nTarikh: 13/03/2024\nTotal 5.00\nCash 10.00").values(frozenset({"TOTAL"})) == {"TOTAL": "5.00"}


@tables
def test_receipts_by_language_asks_for_three_fields(spark):
    from quillspark.plans import catalog

    plan = catalog.receipts_by_language(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("some_entities(") == 1 and "lambda" not in plan
