"""Metrics per key.  Counts come from one partial aggregate; ranks run over distinct scores with their counts, not over rows."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def binary(pred: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    y, p = F.col("label") == 1, F.col("score") >= threshold
    c = pred.groupBy(*by).agg(*[F.count_if(e).cast("double").alias(n) for n, e in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recalls = F.filter(F.array(F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0.0))), F.when(tn + fp > 0, tn / F.nullif(tn + fp, F.lit(0.0)))), lambda x: x.isNotNull())
    return c.select(
        *by, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(recalls)).alias("balanced_accuracy"),
        ((_ratio(2 * tp, 2 * tp + fp + fn) + _ratio(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"),
        _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def _alike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null."""
    b = b.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return a.join(b, same).drop(*[f"_k{i}" for i in range(len(keys))])


def _by_score(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("n"))


def running_sums(g: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False, buckets: int = 1024) -> DataFrame:
    """Each row of ``g`` (one per key and value) with the sums over all values before its own, as the columns that ``sums`` names.

    In two levels, so that one key of any number of values stays in many tasks: values fall into equal-width buckets of
    their key's range, sums of whole buckets run over at most ``buckets`` + 2 rows a key, and rows are ordered inside
    their bucket only.  Nulls come first and NaN last, turned round when ``descending``.
    """
    v, big = F.col(value).cast("double"), float("inf")
    finite = F.when(~F.isnan(v) & (F.abs(v) < big), v)
    span = g.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    place = F.coalesce(F.floor((v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets), F.lit(0))
    bucket = F.when(v.isNull(), -1).when(F.isnan(v) | (v == big), buckets).when(v == -big, 0).otherwise(F.least(place, F.lit(buckets - 1)))
    g = _alike(g, span, by).withColumn("_b", bucket.cast("int")).drop("_lo", "_hi")
    turn = F.desc if descending else F.asc
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    whole = g.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole = whole.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before(by, "_b")), F.lit(0)).alias(f"_w_{c}") for c in sums])
    own = {out: F.col(f"_w_{c}") + F.coalesce(F.sum(c).over(before([*by, "_b"], value)), F.lit(0)) for c, out in sums.items()}
    return _alike(g, whole, [*by, "_b"]).withColumns(own).drop("_b", *[f"_w_{c}" for c in sums])


def auroc(pred: DataFrame, by: list[str]) -> DataFrame:
    """Tie-exact by average ranks; 0.0 and ``degenerate`` where one class is missing."""
    g = running_sums(_by_score(pred, by), by, "score", {"n": "below"})
    s = g.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    one = (F.col("p") == 0) | (F.col("q") == 0)
    return s.select(*by, F.when(one, 0.0).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auroc"), one.alias("degenerate"))


def average_precision(pred: DataFrame, by: list[str]) -> DataFrame:
    """Step sum over distinct scores; the mean label where one class is missing."""
    g = running_sums(_by_score(pred, by), by, "score", {"pos": "tp", "n": "all"}, descending=True)
    at = (F.col("tp") + F.col("pos")) / (F.col("all") + F.col("n"))
    s = g.groupBy(*by).agg(F.sum(F.col("pos") * at).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    one = (F.col("p") == 0) | (F.col("p") == F.col("n"))
    return s.select(*by, F.when(one, F.col("p") / F.col("n")).otherwise(F.col("s") / F.nullif(F.col("p"), F.lit(0))).alias("average_precision"))


def top_odds(pred: DataFrame, by: list[str], frac: float = 0.01) -> DataFrame:
    """Odds ratio of the best ceil(frac n) rows by score, ties in row order, with 0.5 added to each cell; an empty remainder has odds 1.

    Whole score classes are counted; only rows of the one class that the cut divides are put in row order.
    """
    g = running_sums(_by_score(pred, by), by, "score", {"n": "before"}, descending=True)
    total = g.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("t"), F.ceil(F.sum("n") * frac).alias("_k"))
    g = g.join(total.select(*by, "_k"), by)
    inside = g.where("before + n <= _k").groupBy(*by).agg(F.sum("pos").alias("tp"), F.sum("n").alias("tt"))
    edge = g.where("before < _k AND before + n > _k").select(*by, F.col("score").alias("_s"), (F.col("_k") - F.col("before")).alias("_need"))
    rows = pred.join(edge, by).where(F.col("score").eqNullSafe(F.col("_s"))).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("row_no"))).where("_r <= _need")
    divided = rows.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("ep"), F.count("*").alias("et"))
    c = total.join(inside, by, "left").join(divided, by, "left").na.fill(0, ["tp", "tt", "ep", "et"])
    tp = F.col("tp") + F.col("ep")
    tn = F.col("tt") + F.col("et") - tp
    rp, rn = F.col("p") - tp, F.col("t") - F.col("p") - tn
    rest = F.when(rp + rn == 0, 1.0).otherwise((rp + 0.5) / (rn + 0.5))
    return c.select(*by, ((tp + 0.5) / (tn + 0.5) / rest).alias("top_odds_ratio"))


def multiclass(pred: DataFrame, by: list[str]) -> DataFrame:
    """From the confusion counts: balanced accuracy over true classes, macro F1 over all classes seen, multiclass MCC."""
    cell = pred.groupBy(*by, "label", "pred").agg(F.count("*").cast("double").alias("n"))
    sides = cell.select(*by, F.inline(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("t"), F.lit(0.0).alias("p"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0.0).alias("h")), F.struct(F.col("pred").alias("c"), F.lit(0.0).alias("t"), F.col("n").alias("p"), F.lit(0.0).alias("h")))))
    k = sides.groupBy(*by, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    s = k.groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum("h").alias("c"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.nullif(F.col("t"), F.lit(0.0)))).alias("balanced_accuracy"), F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"),
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("p") ** 2).alias("pp"),
    )
    n = F.col("n")
    return s.select(*by, (F.col("c") / n).alias("accuracy"), "balanced_accuracy", "macro_f1", _ratio(F.col("c") * n - F.col("tp"), F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt"))).alias("mcc"))


def token_metrics(pred: DataFrame, by: list[str], ignore: int = 255) -> DataFrame:
    """Multiclass metrics over the tokens whose true label is known: neither null nor ``ignore``."""
    return multiclass(pred.where(F.col("label") != ignore), by)


def average_rank(df: DataFrame, by: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Ties share the mean rank; ranks are found over distinct values."""
    g = running_sums(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, {"_n": "_below"}, descending)
    g = g.withColumn(out, F.col("_below") + (F.col("_n") + 1) / 2).drop("_n", "_below")
    return _alike(df, g, [*by, value])


def regression(pred: DataFrame, by: list[str]) -> DataFrame:
    """Pearson, Spearman by average ranks, R2, MAE, RMSE; a correlation that is not finite is 0."""
    r = average_rank(average_rank(pred.select(*by, "label", "score"), by, "label", "_rl"), by, "score", "_rs")
    d = F.col("score") - F.col("label")
    finite = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    s = r.groupBy(*by).agg(F.corr("label", "score").alias("pearson"), F.corr("_rl", "_rs").alias("spearman"), F.sum(d * d).alias("sse"), F.var_pop("label").alias("v"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n"))
    return s.select(*by, finite(F.col("pearson")).alias("pearson"), finite(F.col("spearman")).alias("spearman"), (1 - F.col("sse") / F.nullif(F.col("v") * F.col("n"), F.lit(0.0))).alias("r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def ranking(pred: DataFrame, by: list[str], group: str) -> DataFrame:
    """Per key over groups with exactly one positive: MRR, mean rank, recall at 1 and 5; ties in row order.

    ``n_skipped`` counts the groups with none or several; a key that has no other groups has null metrics.
    """
    rank = F.row_number().over(Window.partitionBy(*by, group).orderBy(F.desc("score"), "row_no"))
    hit = F.col("label") == 1
    g = pred.withColumn("_rank", rank).groupBy(*by, group).agg(F.count_if(hit).alias("_p"), F.min(F.when(hit, F.col("_rank"))).alias("_r"))
    one = lambda c: F.avg(F.when(F.col("_p") == 1, c))
    r = F.col("_r")
    return g.groupBy(*by).agg(F.count_if(F.col("_p") == 1).alias("n_groups"), F.count_if(F.col("_p") != 1).alias("n_skipped"), one(1 / r).alias("mrr"), one(r).alias("mean_rank"), one((r <= 1).cast("double")).alias("recall_at_1"), one((r <= 5).cast("double")).alias("recall_at_5"))


def calibration(pred: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    g = pred.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("label").alias("y"), F.sum((F.col("score") - F.col("label")) ** 2).alias("q"))
    return g.groupBy(*by).agg((F.sum("q") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y")) * F.col("n")) / F.sum("n")).alias("ece"))


def multilabel(pred: DataFrame, by: list[str]) -> DataFrame:
    """Rows (label_vec, score_vec): macro average precision (0 without positives) and micro F1 at 0.5."""
    x = pred.select(*by, F.posexplode(F.arrays_zip("label_vec", "score_vec")).alias("output", "z")).select(*by, "output", F.col("z.label_vec").cast("double").alias("label"), F.col("z.score_vec").alias("score"))
    ap = average_precision(x, [*by, "output"])
    pos = x.groupBy(*by, "output").agg(F.count_if(F.col("label") == 1).alias("p"))
    macro = ap.join(pos, [*by, "output"]).groupBy(*by).agg(F.avg(F.when(F.col("p") == 0, 0.0).otherwise(F.col("average_precision"))).alias("macro_ap"))
    y, p = F.col("label") == 1, F.col("score") >= 0.5
    micro = x.groupBy(*by).agg(_ratio(2.0 * F.count_if(y & p), F.count_if(y & p) * 2 + F.count_if(~y & p) + F.count_if(y & ~p)).alias("micro_f1"))
    return macro.join(micro, by)


def change_points(df: DataFrame, by: list[str], pos: str, label: str) -> DataFrame:
    """Positions whose label differs from the last valid one before; null labels are ignored."""
    w = Window.partitionBy(*by).orderBy(pos)
    return df.where(F.col(label).isNotNull()).withColumn("_p", F.lag(label).over(w)).where(F.col("_p") != F.col(label)).drop("_p")


def class_weights(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """n / (k count) of each class, from the class counts alone."""
    g = df.groupBy(*by, label).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    return g.withColumn("weight", F.sum("c").over(w) / (F.count("*").over(w) * F.col("c"))).drop("c")


def multioutput(pred: DataFrame, by: list[str]) -> DataFrame:
    """Rows (label_vec, score_vec): macro means of the outputs' Pearson and R2, pooled MAE and RMSE."""
    x = pred.select(*by, F.posexplode(F.arrays_zip("label_vec", "score_vec")).alias("output", "z")).select(*by, "output", F.col("z.label_vec").cast("double").alias("label"), F.col("z.score_vec").cast("double").alias("score"))
    d = F.col("score") - F.col("label")
    o = x.groupBy(*by, "output").agg(F.corr("label", "score").alias("r"), F.sum(d * d).alias("sse"), F.var_pop("label").alias("v"), F.sum(F.abs(d)).alias("sae"), F.count("*").alias("n"))
    return o.groupBy(*by).agg(F.avg(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias("pearson"), F.avg(1 - F.col("sse") / (F.col("v") * F.col("n"))).alias("r2"), (F.sum("sae") / F.sum("n")).alias("mae"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


def mean_iou(pred: DataFrame, by: list[str]) -> DataFrame:
    """Mean over classes of tp / (tp + fp + fn)."""
    hit = (F.col("label") == F.col("pred")).cast("long")
    sides = pred.select(*by, F.inline(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), hit.alias("h")), F.struct(F.col("pred").alias("c"), F.lit(1).alias("t"), F.lit(0).cast("long").alias("h")))))
    k = sides.groupBy(*by, "c").agg(F.sum("t").alias("t"), F.sum("h").alias("h"))
    return k.groupBy(*by).agg(F.avg(F.col("h") / (F.col("t") - F.col("h"))).alias("mean_iou"))


def retention(full: DataFrame, low: DataFrame, by: list[str], value: str) -> DataFrame:
    """low / full per key; a full value of zero gives null and a flag."""
    x = full.select(*by, F.col(value).alias("full_value")).join(low.select(*by, F.col(value).alias("low_value")), by)
    return x.withColumns({"retention": F.col("low_value") / F.nullif(F.col("full_value"), F.lit(0.0)), "undefined": F.col("full_value") == 0})


def seed_retention(full: DataFrame, low: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """``retention`` of each seed, and for all seeds together, where ``seed`` is null, that of the means over the seeds that both sides have."""
    each = retention(full, low, [*by, seed], value)
    means = each.groupBy(*by).agg(F.avg("full_value").alias("full_value"), F.avg("low_value").alias("low_value"))
    whole = retention(means.select(*by, F.col("full_value").alias(value)), means.select(*by, F.col("low_value").alias(value)), by, value)
    return each.unionByName(whole.withColumn(seed, F.lit(None).cast(each.schema[seed].dataType)))


def _taken(truth: list | None, found: list | None, tolerance: int) -> int:
    free, n = sorted({p for p in found or () if p is not None}), 0
    for t in truth or ():
        if t is not None:
            i = bisect_left(free, t)
            right = free[i] - t if i < len(free) else tolerance + 1
            left = t - free[i - 1] if i else tolerance + 1
            if min(left, right) <= tolerance:
                del free[i - 1 if left <= right else i]
                n += 1
    return n


def boundary_match(df: DataFrame, by: list[str], truth: str, found: str, tolerance: int = 20) -> DataFrame:
    """Precision, recall and F1 of boundaries per key.

    Each row holds one sequence's sorted positions.  True positions, in order, take the nearest free found position within
    ``tolerance``, the smaller on ties.  An Arrow pass over the two arrays of one context, a search for each true position; no rows are exploded.
    """

    @F.arrow_udf("bigint")
    def hits(truths: pa.Array, founds: pa.Array) -> pa.Array:
        return pa.array([_taken(t, f, tolerance) for t, f in zip(truths.to_pylist(), founds.to_pylist(), strict=True)], pa.int64())

    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    x = df.select(*by, hits(F.col(truth).cast("array<bigint>"), F.col(found).cast("array<bigint>")).alias("h"), size(truth).alias("t"), size(found).alias("f"))
    g = x.groupBy(*by).agg(*[F.sum(c).cast("double").alias(f"_{c}") for c in "htf"])
    return g.select(*by, _ratio(F.col("_h"), F.col("_f")).alias("precision"), _ratio(F.col("_h"), F.col("_t")).alias("recall"), _ratio(2 * F.col("_h"), F.col("_t") + F.col("_f")).alias("f1"))


def class_scores(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, support, predicted, f1) of every class seen as label or prediction, from the confusion counts."""
    cell = pred.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    side = lambda c, t, p: F.struct(F.col(c).alias("class"), t.alias("t"), p.alias("p"), (F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0) if c == "label" else F.lit(0).cast("long")).alias("h"))
    none = F.lit(0).cast("long")
    k = cell.select(*by, F.inline(F.array(side("label", F.col("n"), none), side("pred", none, F.col("n")))))
    k = k.groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("_h"))
    return k.withColumn("f1", 2 * F.col("_h") / (F.col("support") + F.col("predicted"))).drop("_h")


def confusion(pred: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts tp, fp, fn, tn at ``threshold``, with precision, recall and specificity; a share of nothing is 0."""
    y, p = F.col("label") == 1, F.col("score") >= threshold
    c = pred.groupBy(*by).agg(*[F.count_if(w).alias(n) for n, w in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
    ratio = lambda a, b: _ratio(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return c.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "specificity": ratio("tn", "fp")})


def multilabel_pooled(pred: DataFrame, by: list[str]) -> DataFrame:
    """Rows (label_vec, score_vec): micro average precision over all cells, and macro F1 at 0.5 over the outputs."""
    x = pred.select(*by, F.posexplode(F.arrays_zip("label_vec", "score_vec")).alias("output", "z")).select(*by, "output", F.col("z.label_vec").cast("double").alias("label"), F.col("z.score_vec").cast("double").alias("score"))
    y, p = F.col("label") == 1, F.col("score") >= 0.5
    f1 = x.groupBy(*by, "output").agg(_ratio(2.0 * F.count_if(y & p), F.count_if(y & p) * 2 + F.count_if(~y & p) + F.count_if(y & ~p)).alias("_f")).groupBy(*by).agg(F.avg("_f").alias("macro_f1"))
    return average_precision(x, by).select(*by, F.col("average_precision").alias("micro_ap")).join(f1, by)


def output_scores(pred: DataFrame, by: list[str]) -> DataFrame:
    """Rows (label_vec, score_vec): the ``regression`` metrics, Spearman with them, of each output."""
    x = pred.select(*by, F.posexplode(F.arrays_zip("label_vec", "score_vec")).alias("output", "z"))
    return regression(x.select(*by, "output", F.col("z.label_vec").cast("double").alias("label"), F.col("z.score_vec").cast("double").alias("score")), [*by, "output"])
