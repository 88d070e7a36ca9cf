"""Decision quality from one contingency frame.

Rows are counted once by slice, gold label and both sides' parse and prediction;
every metric of every slice is arithmetic over these few counts. A slice with
all rows costs no more than another, since counting combines map-side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.compat import NAN, div_nan, div_zero

DIMENSIONS = ("policy", "source", "grp", "split", "gold")


def slice_values() -> dict[str, Column]:
    """Value of each row in each slice dimension; missing ones are unknown."""
    un = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return {"policy": F.col("policy"), "source": un("source"), "grp": un("grp"), "split": un("split"), "gold": un("gold")}


def sliced(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Each row once for all and once a dimension, as slice_name and slice_value."""
    values = slice_values()
    each = [F.struct(F.lit("all").alias("slice_name"), F.lit("all").alias("slice_value"))] + [F.struct(F.lit(d).alias("slice_name"), values[d].alias("slice_value")) for d in dimensions]
    return rows.withColumn("__s", F.explode(F.array(*each))).withColumns({"slice_name": F.col("__s.slice_name"), "slice_value": F.col("__s.slice_value")}).drop("__s")


def contingency(pairs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Counts of pairs by slice, gold, parse and prediction of both sides.

    Counted first without slices, so the rows that are multiplied by the
    dimensions are at most the different combinations.
    """
    values = slice_values()
    cells = pairs.select(*[values[d].alias(f"__{d}") for d in dimensions], "gold", F.coalesce("a_parse_ok", F.lit(False)).alias("a_ok"), "a_pred", F.coalesce("b_parse_ok", F.lit(False)).alias("b_ok"), "b_pred")
    cells = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n"))
    each = [F.struct(F.lit("all").alias("slice_name"), F.lit("all").alias("slice_value"))] + [F.struct(F.lit(d).alias("slice_name"), F.col(f"__{d}").alias("slice_value")) for d in dimensions]
    return (
        cells.select(F.explode(F.array(*each)).alias("s"), "gold", "a_ok", "a_pred", "b_ok", "b_pred", "n").select("s.*", "gold", "a_ok", "a_pred", "b_ok", "b_pred", "n")
        .groupBy("slice_name", "slice_value", "gold", "a_ok", "a_pred", "b_ok", "b_pred").agg(F.sum("n").alias("n"))
    )


def one_side(cells: DataFrame, side: str) -> DataFrame:
    """The contingency of one side, as ok and pred, with the side's letter."""
    return cells.select("slice_name", "slice_value", F.lit(side.upper()).alias("side"), "gold", F.col(f"{side}_ok").alias("ok"), F.col(f"{side}_pred").alias("pred"), "n")


def both_sides(cells: DataFrame) -> DataFrame:
    return one_side(cells, "a").unionByName(one_side(cells, "b"))


def _n(cond: Column | None = None) -> Column:
    return F.coalesce(F.sum("n" if cond is None else F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")


def audit_metrics(cells: DataFrame, by: tuple[str, ...] = ("slice_name", "slice_value", "side")) -> DataFrame:
    """Audit's metrics: accuracy over all rows, a YES for an unlabelled row is a false positive."""
    gold, pred = F.col("gold"), F.col("pred")
    yes, no = F.coalesce(gold == "YES", F.lit(False)), F.coalesce(gold == "NO", F.lit(False))
    says, denies = F.coalesce(pred == "YES", F.lit(False)), F.coalesce(pred == "NO", F.lit(False))
    counted = cells.groupBy(*by).agg(
        _n().alias("n"), _n((yes & says) | (no & denies)).alias("__right"), _n(yes).alias("__yes"), _n(no).alias("__no"), _n(no & denies).alias("__no_right"),
        _n(says & yes).alias("tp_yes"), _n(says & ~yes).alias("fp_yes"), _n(~says & yes).alias("fn_yes"), _n(~says & no).alias("tn_yes"), _n(pred.isNull()).alias("abstain"),
    )
    return counted.select(
        *by, "n", div_nan(F.col("__right"), F.col("n")).alias("acc"), div_nan(F.col("tp_yes"), F.col("__yes")).alias("diff_acc"), div_nan(F.col("__no_right"), F.col("__no")).alias("equal_acc"),
        div_nan(F.col("tp_yes"), F.col("tp_yes") + F.col("fp_yes")).alias("prec_yes"), div_nan(F.col("abstain"), F.col("n")).alias("abstain_rate"), "tp_yes", "fp_yes", "fn_yes", "tn_yes", "abstain",
    )


def confusion(cells: DataFrame, by: tuple[str, ...] = ("slice_name", "slice_value", "side")) -> DataFrame:
    """n, tp, fp, fn, tn of labelled predictions, and abstentions of all rows."""
    g, p = F.col("gold"), F.col("pred")
    return cells.groupBy(*by).agg(
        _n().alias("n"), _n((p == "YES") & (g == "YES")).alias("tp_yes"), _n((p == "YES") & (g == "NO")).alias("fp_yes"),
        _n((p == "NO") & (g == "YES")).alias("fn_yes"), _n((p == "NO") & (g == "NO")).alias("tn_yes"), _n(p.isNull()).alias("abstain"),
    )


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = div_zero(tp, tp + fp), div_zero(tp, tp + fn)
    return p, r, div_zero(2 * p * r, p + r)


def evaluation_report(cells: DataFrame, by: tuple[str, ...] = ("slice_name", "slice_value", "side")) -> DataFrame:
    """Evaluation's report: rates over labelled rows, metrics over parsed ones."""
    g, p, ok = F.col("gold"), F.col("pred"), F.col("ok")
    known = g.isNotNull()
    c = cells.groupBy(*by).agg(
        _n().alias("n"), _n(known).alias("labeled_n"), _n(~known).alias("unlabeled_n"), _n(g == "YES").alias("gold_n_yes"), _n(g == "NO").alias("gold_n_no"),
        _n(known & ok).alias("__parsed"), _n(known & ok & p.isNull()).alias("__abstain"), _n(known & ok & (p == "YES")).alias("pred_n_yes"), _n(known & ok & (p == "NO")).alias("pred_n_no"),
        _n(ok & (p == "YES") & (g == "YES")).alias("tp"), _n(ok & (p == "YES") & (g == "NO")).alias("fp"), _n(ok & (p == "NO") & (g == "YES")).alias("fn"), _n(ok & (p == "NO") & (g == "NO")).alias("tn"),
        _n(known & (p == g)).alias("__right"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    yes, no = _prf(tp, fp, fn), _prf(tn, fn, fp)
    single = lambda a, b: (F.col(a) + F.col(b) > 0) & ((F.col(a) == 0) | (F.col(b) == 0))
    return c.select(
        *by, "n", "labeled_n", "unlabeled_n", div_zero(F.col("__parsed"), F.col("labeled_n")).alias("parse_ok_rate"), div_zero(F.col("__abstain"), F.col("__parsed")).alias("abstain_rate"),
        div_nan(F.col("__right"), F.col("labeled_n")).alias("acc_including_abstain"), div_nan(tp + tn, tp + fp + fn + tn).alias("acc_on_parsed"),
        ((yes[2] + no[2]) / 2).alias("macro_f1_on_parsed"), ((yes[1] + div_zero(tn, tn + fp)) / 2).alias("balanced_acc_on_parsed"),
        yes[0].alias("yes_precision"), yes[1].alias("yes_recall"), yes[2].alias("yes_f1"), div_zero(F.col("pred_n_yes"), F.col("pred_n_yes") + F.col("pred_n_no")).alias("yes_rate_on_parsed"),
        "gold_n_yes", "gold_n_no", div_zero(F.col("gold_n_yes"), F.col("gold_n_yes") + F.col("gold_n_no")).alias("gold_yes_rate"), single("gold_n_yes", "gold_n_no").alias("gold_single_class"),
        "pred_n_yes", "pred_n_no", single("pred_n_yes", "pred_n_no").alias("pred_single_class"),
    )


def deltas(cells: DataFrame, by: tuple[str, ...] = ("slice_name", "slice_value")) -> DataFrame:
    """B minus A: accuracy and macro F1 on labelled and predicted rows; NaN if a side has none."""
    g = F.col("gold")
    aggs = []
    for s in "ab":
        p = F.col(f"{s}_pred")
        for name, x, y in (("tp", "YES", "YES"), ("fp", "YES", "NO"), ("fn", "NO", "YES"), ("tn", "NO", "NO")):
            aggs.append(_n((p == x) & (g == y)).alias(f"{s}_{name}"))
    c = cells.groupBy(*by).agg(_n().alias("n"), _n(g.isNotNull()).alias("__labeled"), *aggs)
    acc, f1 = {}, {}
    for s in "ab":
        tp, fp, fn, tn = (F.col(f"{s}_{x}") for x in ("tp", "fp", "fn", "tn"))
        acc[s] = div_nan(tp + tn, tp + fp + fn + tn)
        f1[s] = (_prf(tp, fp, fn)[2] + _prf(tn, fn, fp)[2]) / 2
    return c.select(*by, "n", (acc["b"] - acc["a"]).alias("delta_acc"), F.when(F.col("__labeled") > 0, f1["b"] - f1["a"]).otherwise(F.lit(NAN)).alias("delta_macro_f1"))


# ---- exact McNemar ----


def _stirling_rest(x: Column) -> Column:
    """ln(x!) less Stirling's formula, for whole x of 1 and more."""
    exact = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))
    f = x.cast("double")
    series = (1 / 12.0 - (1 / 360.0 - (1 / 1260.0 - 1 / (1680.0 * f * f)) / (f * f)) / (f * f)) / f
    return F.when(x <= 20, exact - (f + 0.5) * F.log(f) + f - F.lit(0.5 * math.log(2 * math.pi))).otherwise(series)


def binomial_tail(m: Column, n: Column) -> Column:
    """P(X <= m) for X ~ Binomial(n, 1/2) and m of n/2 at most.

    The chance of m itself comes from its deviance, and the others follow from m
    downwards by their ratio. Beyond 6 * sqrt(n) + 64 steps they add less than a
    double can hold, so the sum has no more, however many discordant rows there are.
    """
    x, y = m.cast("double"), n.cast("double")
    rest = y - x
    deviance = x * F.log(2 * x / y) + rest * F.log(2 * rest / y)
    at = F.exp(_stirling_rest(n) - _stirling_rest(m) - _stirling_rest(n - m) - deviance) / F.sqrt(F.lit(2 * math.pi) * x * rest / y)
    at = F.when(m == 0, F.exp(-y * F.lit(math.log(2)))).otherwise(at)
    steps = F.least(m, (6 * F.sqrt(y) + 64).cast("bigint"))
    ks = F.when(steps >= 1, F.sequence(F.lit(0).cast("bigint"), steps - 1)).otherwise(F.array().cast("array<bigint>"))
    step = lambda acc, j: F.struct((acc["term"] * (x - j) / (rest + j + 1)).alias("term"), (acc["total"] + acc["term"] * (x - j) / (rest + j + 1)).alias("total"))
    return at * F.aggregate(ks, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step, lambda acc: acc["total"])


def mcnemar(cells: DataFrame, by: tuple[str, ...] = ("slice_name", "slice_value"), min_n: int = 0) -> DataFrame:
    """b (A right, B wrong), c (reverse) and the exact two-sided p of labelled rows.

    No prediction is wrong; without discordant rows p is 1. Slices with fewer
    than ``min_n`` rows are left out.
    """
    right = {s: F.coalesce(F.col(f"{s}_pred") == F.col("gold"), F.lit(False)) for s in "ab"}
    known = cells.where("gold is not null")
    c = known.groupBy(*by).agg(_n().alias("n_labeled"), _n(right["a"] & ~right["b"]).alias("b"), _n(~right["a"] & right["b"]).alias("c"))
    total = cells.groupBy(*by).agg(_n().alias("n")).where(F.col("n") >= min_n)
    n = F.col("b") + F.col("c")
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least("b", "c"), n)))
    joined = total.join(c, list(by), "left") if by else total.crossJoin(c)
    return joined.select(*by, "n", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_labeled", "b", "c")]).withColumn("p_value", p)


# ---- bootstrap ----


def _f1(tp, fp, fn):
    p = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
    r = np.divide(tp, tp + fn, out=np.zeros_like(tp), where=tp + fn > 0)
    return np.divide(2 * p * r, p + r, out=np.zeros_like(tp), where=p + r > 0)


def bootstrap(cells: DataFrame, n_boot: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals of B minus A (accuracy, macro F1) per slice.

    Drawing N rows with replacement is a multinomial draw over the at most 27
    cells of gold and both predictions, so the cost does not depend on N.
    Replicates without a value are dropped and counted.
    """
    small = cells.groupBy("slice_name", "slice_value", "gold", "a_pred", "b_pred").agg(F.sum("n").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf.iloc[0]
        pdf = pdf.fillna({"gold": "", "a_pred": "", "b_pred": ""}).sort_values(["gold", "a_pred", "b_pred"])
        n = pdf["n"].to_numpy()
        rng = np.random.default_rng([seed, *f"{key['slice_name']}={key['slice_value']}".encode()])
        counts = rng.multinomial(int(n.sum()), n / n.sum(), size=n_boot).astype(float)
        total = {}
        for s in ("a_pred", "b_pred"):
            for name, x, y in (("tp", "YES", "YES"), ("fp", "YES", "NO"), ("fn", "NO", "YES"), ("tn", "NO", "NO")):
                total[s, name] = counts[:, ((pdf[s] == x) & (pdf["gold"] == y)).to_numpy()].sum(axis=1)
        out = []
        for metric in ("accuracy", "macro_f1"):
            value = {}
            for s in ("a_pred", "b_pred"):
                tp, fp, fn, tn = (total[s, k] for k in ("tp", "fp", "fn", "tn"))
                known = tp + fp + fn + tn
                value[s] = np.where(known > 0, (tp + tn) / np.maximum(known, 1), np.nan) if metric == "accuracy" else (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2
            d = np.sort((value["b_pred"] - value["a_pred"])[~np.isnan(value["b_pred"] - value["a_pred"])])
            at = lambda q: float(d[int(q * (len(d) - 1))]) if len(d) else float("nan")
            out.append((key["slice_name"], key["slice_value"], metric, n_boot, n_boot - len(d), float(d.mean()) if len(d) else float("nan"), at(alpha / 2), at(1 - alpha / 2)))
        return pd.DataFrame(out, columns=["slice_name", "slice_value", "metric", "n_boot", "n_dropped", "mean", "lo", "hi"])

    return small.groupBy("slice_name", "slice_value").applyInPandas(draw, "slice_name string, slice_value string, metric string, n_boot int, n_dropped int, mean double, lo double, hi double")
