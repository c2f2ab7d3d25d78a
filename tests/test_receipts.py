"""Extraction, merging and checking of receipts."""

from pyspark.sql import functions as F

from quillspark.operators.extract import entity_rows, extract
from quillspark.operators.reconcile import Reading, Document, plausible_address, reconcile, resolve

MALAY = """KEDAI RUNCIT MAKMUR SDN BHD
No 12, Jalan Bunga Raya, 43650 Bandar Baru Bangi, Selangor
Tel: 03-8926 1234
No. Cukai: W10-1808-31000123
RESIT JUALAN
No. Resit: RJ-2024-00871
Tarikh: 14/03/2024   Masa: 10:25 pagi
Beras Wangi 5kg      2  x  18.90   37.80
Jumlah Kecil                       56.90
Cukai SST 6%                        3.41
JUMLAH BESAR                       60.31
Tunai                              70.00
Baki                                9.69"""
NOISY = """PERNIAGAAN RIANG
GST: 001662431232
Tax INVOICE
1.00 X 21.32   21.32
No. Items: 1
TOTAL 22-60
CASH 30.00
CHANGE 7-40
Rabu, 10-05-2017 Time 21:51
Inv: R000039737"""
SUMMARY = """KEDAI X SDN BHD
Total Sales 24.11
Rounding -0.01
Total after adj 24.10
GST Summary Amount Tax
Total 23.09 0.52"""


def values(text):
    return {e.type: e.value for e in extract(text)}


def test_malay_receipt():
    got = values(MALAY)
    want = {"MERCHANT": "KEDAI RUNCIT MAKMUR SDN BHD", "SUBTOTAL": "56.90", "TAX": "3.41", "TOTAL": "60.31", "PAID": "70.00", "CHANGE": "9.69", "DATE": "2024-03-14", "TIME": "10:25",
            "TAX_ID": "W10-1808-31000123", "INVOICE_NO": "RJ-2024-00871", "PAYMENT_METHOD": "CASH", "PHONE": "03-8926 1234", "ITEM": "Beras Wangi 5kg"}
    assert want.items() <= got.items() and "Bangi" in got["ADDRESS"]
    for e in extract(MALAY):
        assert 0 <= e.start < e.end <= len(MALAY)


def test_noisy_receipt():
    want = {"TOTAL": "22.60", "PAID": "30.00", "CHANGE": "7.40", "DATE": "2017-05-10", "TIME": "21:51", "TAX_ID": "001662431232", "INVOICE_NO": "R000039737", "MERCHANT": "PERNIAGAAN RIANG"}
    got = values(NOISY)
    assert want.items() <= got.items() and "ADDRESS" not in got
    assert values("SFULL Inv;R00oo39737\nToTaL 22-60")["INVOICE_NO"].endswith("39737")
    assert extract(None) == extract(" \n") == []


def test_summary_rows_are_no_totals():
    assert values(SUMMARY)["TOTAL"] == "24.10"


def test_split_names():
    assert values("POPULAR BOOK\nCO. (M) SDN BHD")["MERCHANT"] == "POPULAR BOOK CO. (M) SDN BHD"
    assert values("KEDAI RUNCIT MAKMUR\nSDN BHD")["MERCHANT"] == "KEDAI RUNCIT MAKMUR SDN BHD"
    assert values("| KMF FOOD SDN BHD (1132106-H) |")["MERCHANT"].startswith("KMF FOOD SDN BHD")


def test_impossible_and_consistent_totals():
    doc = resolve("KEDAI X SDN BHD\nTotal 94.10\nCash 25.10\nChange 1.00")
    assert doc.found["TOTAL"].value == "24.10" and "cannot happen" in doc.warnings[0]
    doc = resolve("KEDAI X SDN BHD\nTotal 20.00\nCash 50.00\nChange 30.00")
    assert doc.found["TOTAL"].value == "20.00" and not doc.warnings


def state(**amounts):
    doc = Document("")
    for kind, value in amounts.items():
        doc.found[kind.upper()] = Reading(kind.upper(), value, confidence=0.8, source="rule")
    return doc


def test_implausible_taxes():
    doc = state(tax="21.32", total="22.60")
    doc.fix_tax()
    assert doc.found["SUBTOTAL"].value == "21.32" and "TAX" not in doc.found
    for amounts in ({"tax": "1.28", "total": "22.60"}, {"tax": "4.50", "total": "24.50"}):
        doc = state(**amounts)
        doc.fix_tax()
        assert doc.found["TAX"].value == amounts["tax"] and not doc.warnings
    doc = state(tax="20.00", total="24.50", subtotal="4.50")
    doc.fix_tax()
    assert "TAX" not in doc.found and "dropped" in doc.warnings[0]


def test_arithmetic_settles_disagreement():
    doc = state(subtotal="21.32", tax="0.00", total="22.60")
    doc.found["TAX"].alternative, doc.found["TAX"].alternative_source = "1.28", "llm"
    doc.arbitrate()
    assert doc.found["TAX"].value == "1.28" and doc.found["TAX"].source == "llm+arithmetic" and doc.found["TAX"].confidence == 0.90


def test_tax_is_recovered_and_total_derived():
    doc = resolve("Subtotal 21.32\n1.28 something\nGRAND TOTAL 22.60")
    assert doc.found["TAX"].value == "1.28" and doc.found["TAX"].source == "arithmetic+text"
    doc = resolve("Cash 50.00\nChange 30.00")
    assert doc.found["TOTAL"].value == "20.00" and doc.found["TOTAL"].source == "derived"
    doc = resolve("price inclusive of gst\nSubtotal 21.32\n1.28 something\nGRAND TOTAL 22.60")
    assert "TAX" not in doc.found


def test_models_reading():
    text = "KEDAI ALI SDN BHD\nSubtotal 10.00\nTax 0.60\nTotal 10.60"
    doc = resolve(text, {"merchant": "KEDAI ALI SDN. BHD", "total": 10.6, "tax": 99.9, "address": "GST 12345", "phone": "None", "items": [{"name": "null"}, {"name": "Roti", "qty": 1, "amount": 3.5}]})
    assert doc.found["MERCHANT"].source == doc.found["TOTAL"].source == "rule+llm"
    assert doc.found["TAX"].value == "0.60" and "ADDRESS" not in doc.found and "PHONE" not in doc.found
    assert [(e.value, e.qty, e.amount) for e in doc.items] == [("Roti", 1.0, 3.5)]
    doc = resolve("KEDAI ALI SDN BHD\nDate 1/2/2020", {"date": "2020-02-02", "address": "12 Jalan Ampang Kuala Lumpur"})
    assert doc.found["DATE"].value == "2020-02-01" and doc.found["DATE"].alternative == "2020-02-02" and doc.found["DATE"].confidence == 0.55
    assert doc.found["ADDRESS"].source == "llm" and "kept rule" in doc.warnings[0]
    assert resolve(text, None, expect_model=True).warnings[0].startswith("LLM layer returned nothing")
    assert not plausible_address("001662431232")


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, MALAY), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.r for r in df.select("doc_id", reconcile(F.col("text"), F.lit(None).cast("string")).alias("r")).collect()}
    assert len([e for e in rows[2].entities if e.value is None and e.source == "absent" and e.start == -1]) == 15
    found = [e for e in rows[1].entities if e.value is not None]
    assert [e.start for e in found] == sorted(e.start for e in found)
    assert entity_rows(df).filter("doc_id = 1").count() == len(extract(MALAY))
