"""Accuracy, ranking and separation figures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.functions import text as X


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def compare(df: DataFrame, field: str = "field", predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """``exact`` and ``fuzzy`` of each row: totals within a cent, dates as dates (else
    by key), texts by key, fuzzily from a similarity of 0.85."""
    p, t, f = F.col(predicted), F.col(truth), F.col(field)
    same_key = X.normalize_key(p) == X.normalize_key(t)
    total = F.coalesce(F.abs(X.parse_money(p) - X.parse_money(t)) < 0.01, F.lit(False))
    dates = X.normalize_date(t)
    day = F.when(dates.isNull(), same_key).otherwise(F.coalesce(X.normalize_date(p) == dates, F.lit(False)))
    exact = F.coalesce(F.when(p.isNull() | t.isNull(), False).when(f == "total", total).when(f == "date", day).otherwise(same_key), F.lit(False))
    alike = F.when(f.isin("total", "date"), exact).otherwise(exact | (K.similarity_udf(p, t) >= 0.85))
    return df.withColumn("exact", exact).withColumn("fuzzy", F.coalesce(alike & p.isNotNull() & t.isNotNull(), F.lit(False)))


def scoreboard(compared: DataFrame, by: str = "field", predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """Counts of each field: labelled, found, exact, fuzzy, tp, fp, fn."""
    p, t = F.col(predicted).isNotNull(), F.col(truth).isNotNull()
    return compared.groupBy(by).agg(
        F.count_if(t).alias("labelled"), F.count_if(p & t).alias("found"), F.count_if(F.col("exact")).alias("exact"), F.count_if(F.col("fuzzy")).alias("fuzzy"),
        F.count_if(F.col("fuzzy")).alias("tp"), F.count_if(p & ~F.col("fuzzy")).alias("fp"), F.count_if(t & ~F.col("fuzzy")).alias("fn"),
    )


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; 0 where a denominator is 0."""
    precision, recall = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(counts: DataFrame) -> DataFrame:
    """One row: micro figures of the pooled counts, macro means over the fields."""
    micro = with_prf(counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))).select(*(F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")))
    macro = with_prf(counts).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return micro.join(F.broadcast(macro))


def pooled(counts: DataFrame) -> DataFrame:
    """One row: ``labelled``, and the shares of all labelled values that match exactly
    and loosely, so that a field with more labels weighs more; null without labels."""
    share = lambda c: F.try_divide(F.sum(c).cast("double"), F.sum("labelled").cast("double")).alias(f"{c}_share")
    return counts.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), share("exact"), share("fuzzy"))


def ranking(ranked: DataFrame, query: str = "query_id", rank: str = "rank", relevant: str = "relevant", k: int = 5) -> DataFrame:
    """One row: ``hit_at_1``, ``hit_at_k`` (any relevant among the first k) and ``mrr``."""
    first = ranked.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first"))
    at = lambda n: F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0))
    return first.agg(at(1).alias("hit_at_1"), at(k).alias("hit_at_k"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def separation(scores: DataFrame, score: str = "score", real: str = "real") -> DataFrame:
    """One row: how far real matches stand above junk; a threshold only where they do."""
    of = lambda f, cond: f(F.when(cond, F.col(score)))
    r, j = F.col(real), ~F.col(real)
    out = scores.agg(of(F.min, r).alias("real_min"), of(F.median, r).alias("real_median"), of(F.max, j).alias("junk_max"), of(F.median, j).alias("junk_median"))
    out = out.withColumn("gap", F.col("real_min") - F.col("junk_max"))
    return out.withColumn("threshold", F.when(F.col("gap") > 0, (F.col("real_min") + F.col("junk_max")) / 2))


def best_route(grid: DataFrame, score: str = "exact", order: str = "route_id") -> DataFrame:
    """The best-scoring row, the first one of equals."""
    return grid.orderBy(F.desc(score), order).limit(1)


def frozen_route(train: DataFrame, test: DataFrame, score: str = "exact", order: str = "route_id") -> DataFrame:
    """The route chosen on ``train`` alone, with its figures there and on ``test``
    (``train_...``, ``test_...``; null if ``test`` lacks the route)."""
    chosen = best_route(train, score, order).select(order, F.col(score).alias(f"train_{score}"))
    return chosen.join(test.select(order, F.col(score).alias(f"test_{score}")), order, "left")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def recoverable(field: Column, truth: Column, text: Column) -> Column:
    """Whether a text holds the truth at all: a total within a cent, a date on some
    line, anything else by windows of words from a similarity of 0.80."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    want, day = X.parse_money(truth), X.normalize_date(truth)
    total = F.exists(lines, lambda x: F.exists(X.money_values(x), lambda v: F.abs(v - want) < 0.01))
    date = F.exists(lines, lambda x: F.coalesce(X.normalize_date(x) == day, F.lit(False)))
    near = K.partial_similarity_udf(truth, text) >= 0.80
    some = truth.isNotNull() & (F.trim(truth) != "") & text.isNotNull() & (text != "")
    return F.coalesce(some & F.when(field == "total", total).when(field == "date", date).otherwise(near), F.lit(False))


def recoverability(df: DataFrame, field: str = "field", truth: str = "truth", text: str = "text") -> DataFrame:
    """Of each field, how many values are labelled and how many of them the text holds."""
    held = df.withColumn("__held", recoverable(F.col(field), F.col(truth), F.col(text)))
    return held.groupBy(field).agg(F.count_if(F.trim(truth) != "").alias("labelled"), F.count_if("__held").alias("recoverable"))


def retrieval_task(addresses: DataFrame, places: DataFrame, address: str = "address", place: str = "place") -> DataFrame:
    """Queries and the addresses that hold them: ``place``, ``relevant`` (sorted). Places
    of four letters or more; of those with the same addresses, the longest name stays.
    ``places`` is a fixed list, broadcast; addresses are matched in one pass."""
    corpus = addresses.select(F.trim(address).alias("address")).filter("address != ''").distinct().withColumn("key", X.normalize_key(F.col("address")))
    named = places.select(F.col(place).alias("place"), X.normalize_key(F.col(place)).alias("p")).filter("length(p) >= 4")
    found = corpus.join(F.broadcast(named), F.contains("key", "p")).groupBy("place").agg(F.array_sort(F.collect_set("address")).alias("relevant"))
    return first_of_each(found, ["relevant"], [F.desc(F.length("place")), F.col("place")])
