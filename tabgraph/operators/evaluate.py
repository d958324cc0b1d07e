"""Evaluation of scored tables (E1-E10), all splits in one pass.

Binary tables hold (split, y, p); multi-class ones (split, y, pred, probs).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.distributed import materialize, running_totals, with_scalars

NAN = float("nan")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def accuracy(scored: DataFrame, y: str = "y", pred: str = "pred", by: str = "split") -> DataFrame:
    """E1."""
    hit = (F.col(y) == F.col(pred)).cast("double")
    return scored.groupBy(by).agg(F.avg(hit).alias("accuracy"))


def confusion_matrix(scored: DataFrame, y: str = "y", pred: str = "pred", by: str = "split") -> DataFrame:
    """(split, y, pred, n) over all labels seen in either column, zeros included."""
    counts = scored.groupBy(by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    seen = counts.select(by, F.explode(F.array("y", "pred")).alias("label")).distinct()
    # Label grid: classes squared per split.
    grid = seen.withColumnRenamed("label", "y").join(seen.withColumnRenamed("label", "pred"), by)
    return grid.join(counts, [by, "y", "pred"], "left").fillna(0, ["n"])


def class_scores(confusion: DataFrame, by: str = "split") -> DataFrame:
    """(split, label, precision, recall, f1, support) from a confusion matrix."""
    rows = confusion.select(by, F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("true"), F.lit(0).alias("said")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("true"), F.col("n").alias("said")),
    )), (F.col("y") == F.col("pred")).alias("_hit"))
    sums = rows.groupBy(by, "label").agg(
        F.sum("true").alias("support"), F.sum("said").alias("_said"),
        F.sum(F.when(F.col("_hit"), F.col("true")).otherwise(0)).alias("_tp"))
    return sums.select(
        by, "label", _ratio(F.col("_tp"), F.col("_said")).alias("precision"),
        _ratio(F.col("_tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_said") + F.col("support")).alias("f1"), "support",
    )


def f1_binary(scored: DataFrame, y: str = "y", pred: str = "pred", by: str = "split") -> DataFrame:
    """F1 of class 1, 0 on zero division."""
    tp = F.count_if((F.col(y) == 1) & (F.col(pred) == 1))
    wrong = F.count_if((F.col(y) == 1) != (F.col(pred) == 1))
    return scored.groupBy(by).agg(_ratio(2 * tp, 2 * tp + wrong).alias("f1"))


def f1_multiclass(confusion: DataFrame, by: str = "split") -> DataFrame:
    """(split, f1_micro, f1_macro) over all labels in y or pred."""
    macro = class_scores(confusion, by).groupBy(by).agg(F.avg("f1").alias("f1_macro"))
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    micro = confusion.groupBy(by).agg((hit / F.sum("n")).alias("f1_micro"))
    return micro.join(macro, by)


def _count_of(condition: Column, weight: str | None) -> Column:
    """Rows meeting a condition, or the sum of their ``weight``."""
    if weight is None:
        return F.count_if(condition)
    return F.sum(F.when(condition, F.col(weight)).otherwise(0))


def auroc(scored: DataFrame, y: str = "y", p: str = "p", by: list[str] = ("split",),
          weight: str | None = None) -> DataFrame:
    """E5: (by..., auroc), tied scores counted half; NaN where a group holds one class only.

    Rows combine to one per distinct score; the running count of negatives over
    all groups and scores is a distributed running total.
    """
    by = list(by)
    scores = scored.groupBy(*by, F.col(p).alias("_p")).agg(
        _count_of(F.col(y) == 1, weight).alias("_pos"), _count_of(F.col(y) != 1, weight).alias("_neg"))
    summed = running_totals(scores, [*by, "_p"], {"_upto": F.col("_neg")})
    groups = summed.groupBy(*by).agg(
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"),
        F.min(F.col("_upto") - F.col("_neg")).alias("_before"),
        F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") + F.col("_neg") / 2)).alias("_won"),
    )
    wins = F.col("_won") - F.col("_before") * F.col("_P")
    total = F.col("_P") * F.col("_N")
    return groups.select(*by, F.coalesce(F.try_divide(wins, total), F.lit(NAN)).alias("auroc"))


def auroc_ovr_macro(scored: DataFrame, y: str = "y", probs: str = "probs", by: str = "split") -> DataFrame:
    """Mean one-versus-rest E5 over the classes 0..C-1; NaN if a class is absent."""
    each = scored.select(by, F.col(y).alias("_y"), F.posexplode(probs).alias("cls", "p"))
    flat = each.select(by, "cls", "p", (F.col("_y") == F.col("cls")).cast("int").alias("y"))
    per_class = auroc(flat, by=[by, "cls"])
    return per_class.groupBy(by).agg(F.avg("auroc").alias("auroc"))


# The candidate thresholds 0.01 ... 0.99 and the fallback.
THRESHOLDS = [float(t) for t in np.linspace(0.01, 0.99, 99)]
FALLBACK_THRESHOLD = 0.5


def best_threshold(validation: DataFrame, y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """One row (threshold, f1): the first threshold of best F1 with pred = p >= threshold.

    Rows are reduced to at most 100 bins; only the bins are ranked.
    """
    levels = F.array(*[F.lit(t) for t in THRESHOLDS])
    bins = validation.groupBy(F.size(F.filter(levels, lambda t: F.col(p) >= t)).alias("_bin")).agg(
        _count_of(F.col(y) == 1, weight).alias("_pos"), _count_of(F.col(y) != 1, weight).alias("_neg"))
    per_level = bins.select("_pos", "_neg", F.explode(F.transform(
        levels, lambda t, i: F.struct(i.alias("no"), t.alias("threshold"), (F.col("_bin") > i).alias("said"))
    )).alias("l"))
    said = F.col("l.said")
    tp, fp = F.sum(F.when(said, F.col("_pos")).otherwise(0)), F.sum(F.when(said, F.col("_neg")).otherwise(0))
    fn = F.sum(F.when(said, 0).otherwise(F.col("_pos")))
    scores = per_level.groupBy("l.no", "l.threshold").agg(_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    best = scores.agg(F.max(F.struct(F.col("f1"), (-F.col("no")).alias("_no"), "threshold")).alias("b"))
    return best.select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(FALLBACK_THRESHOLD)).alias("threshold"),
        F.coalesce("b.f1", F.lit(0.0)).alias("f1"),
    )


def classification_report(confusion: DataFrame, by: str = "split") -> DataFrame:
    """Per class, accuracy, macro and weighted rows (split, name, precision, recall, f1, support)."""
    classes = class_scores(confusion, by)
    measures = ["precision", "recall", "f1"]
    one = classes.select(by, F.col("label").cast("string").alias("name"), *measures, "support")
    macro = classes.groupBy(by).agg(
        F.lit("macro avg").alias("name"), *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"))
    weighted = classes.groupBy(by).agg(
        F.lit("weighted avg").alias("name"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"))
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")
    overall = confusion.groupBy(by).agg(
        F.lit("accuracy").alias("name"), *[hit.alias(m) for m in measures], F.sum("n").alias("support"))
    return one.unionByName(macro).unionByName(weighted).unionByName(overall)


def evaluate_splits(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """E9 binary: (split, accuracy, f1, auroc); label by p > threshold, E7 on "val" by default.

    Rows first combine to counts per (split, y, p), computed once; every measure
    is read off those.
    """
    counts = materialize(scored.groupBy("split", "y", "p").agg(F.count(F.lit(1)).alias("n")))
    if threshold is None:
        chosen = best_threshold(counts.filter("split = 'val'"), weight="n").select(F.col("threshold").alias("_t"))
    else:
        chosen = counts.sparkSession.range(1).select(F.lit(float(threshold)).alias("_t"))
    judged = with_scalars(counts, chosen)
    pred = F.col("p") > F.col("_t")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    one = F.col("y") == 1
    right, tp = total(pred == one), total(pred & one)
    measures = judged.groupBy("split").agg(
        (right / F.sum("n")).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + F.sum("n") - right).alias("f1"),
    )
    return measures.join(auroc(counts, weight="n"), "split")


def evaluate_multiclass(scored: DataFrame) -> DataFrame:
    """E9 multi-class: (split, accuracy, f1_micro, f1_macro, auroc) of argmax labels.

    The scored rows are written once, so the plan that scores them runs once for all measures.
    """
    scored = materialize(scored.select("split", "y", "pred", "probs"))
    f1 = f1_multiclass(confusion_matrix(scored))
    return accuracy(scored).join(f1, "split").join(auroc_ovr_macro(scored), "split")


def _log(p: Column) -> Column:
    """ln p, minus infinity at 0, where Spark's own is null."""
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log(p))


def log_loss(scored: DataFrame, pos_weight: float = 1.0, by: str = "split") -> DataFrame:
    """E10 binary: mean of -(w y ln p + (1 - y) ln(1 - p)).

    A certain and wrong prediction has an infinite loss. Frames that keep ``raw``, the score
    before the sigmoid, stay finite there: ln p is then taken from the score.
    """
    if "raw" in scored.columns:
        softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        right, wrong = softplus(-F.col("raw")), softplus(F.col("raw"))
    else:
        right, wrong = -_log(F.col("p")), -_log(1 - F.col("p"))
    loss = F.when(F.col("y") == 1, right * F.lit(float(pos_weight))).otherwise(wrong)
    return scored.groupBy(by).agg(F.avg(loss).alias("loss"))


def cross_entropy(scored: DataFrame, class_weights: list[float] | None = None, by: str = "split") -> DataFrame:
    """E10 multi-class: weighted mean of -ln p[y].

    Frames that keep ``raws``, the scores before the softmax, stay finite: -ln p[y] is then the
    log of the summed exponentials less the label's own score.
    """
    weight = F.lit(1.0)
    if class_weights:
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in class_weights]), F.col("y").cast("int") + 1)
    place = F.col("y").cast("int") + 1
    if "raws" in scored.columns:
        top = F.array_max("raws")
        spread = F.aggregate(F.transform("raws", lambda x: F.exp(x - top)), F.lit(0.0), lambda acc, x: acc + x)
        surprise = top + F.log(spread) - F.element_at("raws", place)
    else:
        surprise = -_log(F.element_at("probs", place))
    return scored.groupBy(by).agg((F.sum(surprise * weight) / F.sum(weight)).alias("loss"))
