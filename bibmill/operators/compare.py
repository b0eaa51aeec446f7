"""Predictions held against what was expected: joins by variant, exact spans, alignment of
two listings, outcomes by style, and a hash of a result that no order changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_predictions(manifest: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every manifest row with its prediction's columns (named predicted_<name>) and predicted,
    whether there is one. Of several predictions of a key the last by seq holds."""
    names = [c for c in predictions.columns if c not in (key, "seq")]
    last = predictions.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), "seq").alias("_p"))
    return manifest.join(last, key, "left").select(*manifest.columns, *(F.col(f"_p.{c}").alias(f"predicted_{c}") for c in names), F.col("_p").isNotNull().alias("predicted"))


def misaligned(left: DataFrame, right: DataFrame, index: str, text: str) -> DataFrame:
    """index, and why two listings differ there: missing in one, other text, or a stored hash
    (column hash of the left one) that isn't the text's."""
    a = left.select(index, F.col(text).alias("_a"), F.col("hash").alias("_h"), F.lit(True).alias("_in_a"))
    b = right.select(index, F.col(text).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, index, "full")
    why = F.when(F.col("_in_b").isNull(), "missing on the right").when(F.col("_in_a").isNull(), "missing on the left").when(~F.col("_a").eqNullSafe(F.col("_b")), "other text").when(~F.col("_h").eqNullSafe(F.sha2("_a", 256)), "other hash")
    return both.select(index, why.alias("problem")).where("problem is not null")


def span_metrics(expected: DataFrame, predicted: DataFrame, row: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall and f1 of spans that agree in row, label, start and
    end; a span told twice counts once."""
    keys = [row, "label", "start", "end"]
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    b = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    e, p = F.col("_e").isNotNull(), F.col("_p").isNotNull()
    out = a.join(b, keys, "full").groupBy("label").agg(n(e & p)("tp"), n(~e & p)("fp"), n(e & ~p)("fn"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("label", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def interleaved(clean: DataFrame, noisy: DataFrame, variant: str, order: str) -> DataFrame:
    """Clean rows in their order, each followed by the noisy one of the same stem; idx tells the
    place of the pair and kind which of the two a row is. Noisy rows without a clean one go."""
    stem = lambda kind: F.regexp_replace(variant, f":{kind}$", "")
    places = clean.select(stem("clean").alias("_stem"), F.col(order).alias("idx"))
    first = clean.withColumns({"idx": F.col(order), "kind": F.lit(0)})
    second = noisy.withColumn("_stem", stem("noisy")).join(places, "_stem").drop("_stem").withColumn("kind", F.lit(1))
    return first.unionByName(second)


def outcomes_by_style(df: DataFrame, style: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """A row a style with a count of each outcome."""
    return df.groupBy(style).pivot(outcome, outcomes).agg(F.count(F.lit(1))).na.fill(0, outcomes)


def product_metrics(df: DataFrame, similarity: Column, accepted: Column, confidence: Column, correct: Column, sure: float = 0.9) -> DataFrame:
    """n, mean_similarity, accept_rate and confident_wrong_rate (of the sure ones those that are
    wrong; 0 where none is sure). Nulls count as not accepted, not sure and not correct."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    certain = confidence >= sure
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg(similarity), F.lit(0.0)).alias("mean_similarity"), F.coalesce(F.avg(yes(accepted)), F.lit(0.0)).alias("accept_rate"), F.when(F.sum(yes(certain)) > 0, F.sum(yes(certain & ~F.coalesce(correct, F.lit(False)))) / F.sum(yes(certain))).otherwise(0.0).alias("confident_wrong_rate"))


def output_hash(df: DataFrame) -> DataFrame:
    """rows and hash: eight sums of 32-bit parts of the rows' hashes, so that neither the order
    of rows nor how they are dealt out changes it, and no row leaves its task."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("_h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)) % F.lit(1 << 32)
    sums = df.select(h.alias("_h")).agg(F.count("*").alias("rows"), *(part(k).cast("long").alias(f"h{k}") for k in range(8)))
    return sums.select("rows", F.concat(*(F.lpad(F.lower(F.hex(f"h{k}")), 8, "0") for k in range(8))).alias("hash"))


def token_set_ratio(a: Column, b: Column) -> Column:
    """How alike two strings' word sets are, 0 to 100: the best of three ratios by edit
    distance between the shared words, and those with each side's own words behind."""
    from ..functions.bind import let

    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")))

    def ratio(x: Column, y: Column) -> Column:
        """Twice the characters of a longest common subsequence over all characters, by edits without replacing."""
        total = F.length(x) + F.length(y)
        return F.when(total == 0, 100.0).otherwise(100.0 * (total - indel(x, y)) / total)

    def indel(x: Column, y: Column) -> Column:
        start = F.transform(F.sequence(F.lit(0), F.length(y)), lambda j: j)

        def row(before: Column, i: Column) -> Column:
            c = F.substring(x, i, F.lit(1))

            def cell(done: Column, j: Column) -> Column:
                left, over, up = F.element_at(done, -1), F.get(before, j - 1), F.get(before, j)
                return F.concat(done, F.array(F.when(F.substring(y, j, F.lit(1)) == c, over).otherwise(F.least(left, up) + 1)))

            return F.aggregate(F.filter(F.sequence(F.lit(0), F.length(y)), lambda j: j > 0), F.array(i), cell)

        return F.element_at(F.aggregate(F.filter(F.sequence(F.lit(0), F.length(x)), lambda i: i > 0), start, row), -1)

    def told(p: Column) -> Column:
        both, x, y = F.array_join(F.array_intersect(p["a"], p["b"]), " "), F.array_join(F.array_except(p["a"], p["b"]), " "), F.array_join(F.array_except(p["b"], p["a"]), " ")
        with_ = lambda c: F.trim(F.concat_ws(" ", both, c))
        inner = let(F.struct(both.alias("s"), with_(x).alias("x"), with_(y).alias("y")), lambda t: F.when((t["s"] != "") & ((t["s"] == t["x"]) | (t["s"] == t["y"])), 100.0).otherwise(F.greatest(ratio(t["x"], t["y"]), F.when(t["s"] != "", F.greatest(ratio(t["s"], t["x"]), ratio(t["s"], t["y"]))).otherwise(0.0))))
        return F.when((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0), 0.0).otherwise(F.round(inner))

    return let(F.struct(words(a).alias("a"), words(b).alias("b")), told)
