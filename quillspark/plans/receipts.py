"""Receipts rendered from the star schema, one for each order with lines.

Expected fields come from the source columns, so a check of the extractor against
them does not repeat the extractor. All money is in decimals until it is printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey``, date, ``subtotal``, ``tax`` and ``total`` of each order with lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("price"))
    sums = lines.groupBy("l_orderkey").agg(F.sum("price").cast(MONEY).alias("subtotal"), F.min("l_suppkey").alias("suppkey"))
    tax = (F.col("subtotal") * F.lit("0.06").cast("decimal(4,2)")).cast(MONEY)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("printed_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_date"))
    return sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("tax", tax).withColumn("total", (F.col("subtotal") + tax).cast(MONEY)).drop("l_orderkey")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``text`` and the expected fields. Even orders are in Malay; every
    fifth has its decimal points read as dashes; every seventh a wrong total."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.upper("s_name"), F.lit(" SDN BHD")).alias("merchant"))
    # a fixed number of partitions is not coalesced: what is done to each text is far more
    # than these narrow rows weigh. By a hash of the key: by the key itself they are dealt
    # already, and the step would be left out
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    o = order_sums(spark, sf_dir).join(suppliers, F.col("suppkey") == F.col("s_suppkey")).repartition(tasks, F.xxhash64("o_orderkey"))
    k = F.col("o_orderkey")
    malay = k % 2 == 0
    label = lambda ms, en: F.when(malay, ms).otherwise(en)
    wrong = F.when(k % 7 == 0, F.col("total") + 100).otherwise(F.col("total")).cast(MONEY)
    paid = (F.ceil(F.col("total") / 50) * 50 + 50).cast(MONEY)
    change = (paid - F.col("total")).cast(MONEY)
    show = lambda c: F.when(k % 5 == 0, F.replace(c.cast("string"), F.lit("."), F.lit("-"))).otherwise(c.cast("string"))
    # grouped by thousands: an amount has at most three leading digits
    money = lambda c: show(F.regexp_replace(c.cast("string"), r"(?<=\d)(?=(\d{3})+\.)", ","))
    text = F.concat_ws(
        "\n", F.col("merchant"), F.lit("No 12, Jalan Bunga Raya, 43650 Bangi, Selangor"), F.concat(label("No. Resit: R-", "Receipt No: R-"), F.lpad(k.cast("string"), 8, "0")),
        F.concat(label("Tarikh: ", "Date: "), F.col("printed_date")), F.concat(label("Jumlah Kecil ", "Subtotal "), money(F.col("subtotal"))), F.concat(label("Cukai SST 6% ", "SST 6% "), money(F.col("tax"))),
        F.concat(label("JUMLAH BESAR ", "GRAND TOTAL "), money(wrong)), F.concat(label("Tunai ", "Cash "), money(paid)), F.concat(label("Baki ", "Change "), money(change)),
    )
    return o.select(k.alias("doc_id"), text.alias("text"), "merchant", "iso_date", "subtotal", "tax", "total", wrong.alias("printed_total"), paid.alias("paid"), change.alias("change"), malay.alias("malay"))


#: The same expectation in SQL, from the source columns alone.
EXPECTED = """
expected AS (
  SELECT o_orderkey AS doc_id, upper(s_name) || ' SDN BHD' AS merchant, strftime(o_orderdate, '%Y-%m-%d') AS iso_date, subtotal,
         CAST(subtotal * CAST(0.06 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS tax,
         CAST(subtotal + CAST(subtotal * CAST(0.06 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total
  FROM (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS subtotal, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey)
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON suppkey = s_suppkey
)"""
