"""Whole runs: audit of a pair of models, evaluation, and a training set, with their artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import cut
from pairlight.config import Settings, run_folder, snapshot
from pairlight.functions import labels, regression
from pairlight.operators import decisions, ingest, pairing, sampling, scoring, stats
from pairlight.operators.filters import filter_pairs, filter_predictions
from pairlight.sources import files


def audit_frame(pairs: DataFrame, scored: DataFrame, judged: DataFrame | None, settings: Settings) -> DataFrame:
    """Pairs with scores of the first view and metric that are scored, and the mode's trigger.

    The preferred order is the settings' views and metrics. ``judged`` has key,
    is_harmful, severity and success.
    """
    a = settings.audit
    known = {(r["view"], r["metric"]) for r in scored.select("view", "metric").distinct().limit(1000).collect()}
    view, metric = next(((v, m) for v in a.views for m in a.metrics if (v, m) in known), (a.views[0], a.metrics[0]))
    rows = pairing.attach_scores(pairs, scored, view, metric)
    trig = regression.trigger("a_score", "b_score", view, metric, a.least_severity, a.thresholds)
    rows = rows.withColumn("trig", trig)
    if judged is None or a.judge_mode == "classifier":
        fields = [F.col(f"trig.{c}") for c in ("triggered", "pool_keep", "view", "metric", "severity", "delta")]
        return rows.select("*", *fields, F.lit("classifier").alias("regression_source"), F.lit(None).cast("boolean").alias("llm_validated")).drop("trig")
    j = judged.groupBy("key").agg(F.max_by(F.struct("is_harmful", "severity", "success"), F.col("success").cast("int") * 2 + F.col("is_harmful").cast("int")).alias("j"))
    rows = rows.join(j, "key", "left")
    if a.judge_mode == "primary":
        s = regression.judge_comparative(F.col("j.is_harmful"), F.col("j.severity"))
        rows = rows.withColumn("s", s).drop("a_score", "b_score")
        on = F.coalesce(F.col("s.delta") > 0, F.lit(False))
        return rows.select("*", "s.*", on.alias("triggered"), (on & regression.at_least("s.severity", a.least_severity)).alias("pool_keep"), F.lit("analysis_only").alias("view"), F.lit("llm_judge").alias("metric"), F.lit("llm_judge").alias("regression_source"), on.alias("llm_validated")).drop("trig", "s", "j")
    args = (F.col("trig"), F.col("j.is_harmful"), F.col("j.success"))
    v = regression.validated(*args, F.col("j.severity"), a.least_severity) if a.judge_mode == "validate" else regression.supplemented(*args)
    return rows.withColumn("v", v).select("*", "v.*").drop("trig", "v", "j")


def run_audit(predictions: DataFrame, cache: DataFrame, model_a: str, model_b: str, settings: Settings = Settings(), judged: DataFrame | None = None, stamp: str | None = None, policies: Sequence[str] | None = None, cap: int | None = None) -> Path:
    """Audits two runs and writes scored pairs, pool, worst cases and reports below a run folder.

    ``policies`` and ``cap`` audit some policies' pairs only, and the first ones by key.
    """
    folder = run_folder(settings, "audit", stamp)
    snapshot(folder, settings, {"predictions": predictions, "cache": cache})
    a = settings.audit
    pairs = cut(filter_pairs(pairing.pair_runs(pairing.run(predictions, model_a), pairing.run(predictions, model_b)), policies, cap))
    scored = cut(scoring.scored(pairing.side_long(pairs), cache, list(a.metrics)))
    rows = cut(audit_frame(pairs, scored, judged, settings))
    rows.write.mode("overwrite").parquet(f"{folder}/scored")
    pool = rows.where("pool_keep").withColumns({"severity_bin": F.col("severity"), "severity_rank": regression.rank("severity")})
    pool.write.mode("overwrite").parquet(f"{folder}/regression_pool")
    top = pool.orderBy(F.desc("severity_rank"), F.desc("delta"), "key").limit(a.top_k)
    files.write_jsonl(top.coalesce(1), f"{folder}/top_regressions")
    long = scored.join(pairs.select("key", "policy", "source", "grp", "split", "gold"), "key")
    by = ["slice_name", "slice_value", "view", "metric"]
    sliced = cut(decisions.sliced(long))
    files.write_csv(stats.summary(sliced, [*by, "side"], "score"), f"{folder}/harm_by_slice")
    tests = stats.rank_test(sliced, by).where((F.col("n_a") >= a.min_slice_n) & (F.col("n_b") >= a.min_slice_n))
    files.write_csv(stats.with_p(tests).withColumn("stars", regression.stars("p_value")), f"{folder}/harm_tests")
    cells = cut(decisions.contingency(pairs))
    files.write_csv(decisions.audit_metrics(decisions.both_sides(cells)), f"{folder}/decisions")
    total = stats.severity_summary(rows).collect()[0].asDict()
    by_source = {r[0]: r[1] for r in rows.groupBy("regression_source").count().collect()}
    files.write_json({"model_a": model_a, "model_b": model_b, "settings": asdict(settings), "regressions": total, "by_regression_source": by_source}, f"{folder}/summary.json")
    return folder


def run_single_evaluation(predictions: DataFrame, model: str, settings: Settings = Settings(), stamp: str | None = None, splits: Sequence[str] | None = None, policies: Sequence[str] | None = None) -> Path:
    """Evaluates one run and writes its report by slice and its confusion counts."""
    folder = run_folder(settings, "evaluate_single", stamp)
    snapshot(folder, settings, {"predictions": predictions})
    cells = cut(single_cells(filter_predictions(pairing.run(predictions, model, texts=False), splits, policies)))
    by = ("slice_name", "slice_value")
    files.write_csv(decisions.evaluation_report(cells, by), f"{folder}/metrics_by_slice")
    whole = cells.where("slice_name = 'all'")
    files.write_json({"model": model, "overall": [r.asDict() for r in decisions.evaluation_report(whole, by).collect()], "by_source": [r.asDict() for r in decisions.evaluation_report(cells.where("slice_name = 'source'"), by).collect()]}, f"{folder}/summary.json")
    return folder


def single_cells(run: DataFrame) -> DataFrame:
    """Counts of one run's rows by slice, gold label, parse and prediction."""
    rows = run.select(
        labels.policy("policy_id").alias("policy"), F.nullif("source", F.lit("")).alias("source"), labels.group("source").alias("grp"), F.nullif("split", F.lit("")).alias("split"),
        labels.label("gold_label").alias("gold"), F.coalesce("parse_ok", F.lit(False)).alias("ok"), labels.prediction("parsed_conclusion", "parse_ok").alias("pred"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    return decisions.sliced(counted).groupBy("slice_name", "slice_value", "gold", "ok", "pred").agg(F.sum("n").alias("n"))


def run_evaluation(predictions: DataFrame, model_a: str, model_b: str, settings: Settings = Settings(), stamp: str | None = None, policies: Sequence[str] | None = None, cap: int | None = None) -> Path:
    """Evaluates two runs against each other and writes reports by slice, tests and intervals.

    ``policies`` and ``cap`` evaluate some policies' pairs only, and the first ones by key.
    """
    folder = run_folder(settings, "evaluate", stamp)
    snapshot(folder, settings, {"predictions": predictions})
    e = settings.evaluation
    pairs = filter_pairs(pairing.pair_runs(pairing.run(predictions, model_a, texts=False), pairing.run(predictions, model_b, texts=False)), policies, cap)
    cells = cut(decisions.contingency(pairs))
    report = cut(decisions.evaluation_report(decisions.both_sides(cells)))
    files.write_csv(report, f"{folder}/metrics_by_slice")
    files.write_csv(decisions.mcnemar(cells, min_n=e.min_slice_n).withColumn("stars", regression.stars("p_value")), f"{folder}/paired_significance")
    files.write_csv(decisions.deltas(cells), f"{folder}/deltas")
    large = cells.groupBy("slice_name", "slice_value").agg(F.sum("n").alias("__all")).where(F.col("__all") >= e.min_slice_n)
    spread = cut(decisions.bootstrap(cells.join(large.drop("__all"), ["slice_name", "slice_value"]), e.n_boot, settings.run.seed, e.alpha))
    files.write_csv(spread, f"{folder}/intervals_by_slice")
    intervals = [r.asDict() for r in spread.where("slice_name = 'all'").collect()]
    files.write_csv(report.where("slice_name = 'source'"), f"{folder}/metrics_by_source")
    names = {"A": model_a, "B": model_b}
    metrics = ["acc_on_parsed", "macro_f1_on_parsed"]
    by_source = report.where("slice_name = 'source'").groupBy(F.col("slice_value").alias("source")).agg(*[F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{names[s]}_{m}") for s in "AB" for m in metrics])
    files.write_text(files.latex_matrix(by_source, [model_a, model_b], metrics) + "\n", f"{folder}/main_table.tex")
    files.write_json({"settings": asdict(settings), "overall": [r.asDict() for r in report.where("slice_name = 'all'").collect()], "bootstrap": intervals}, f"{folder}/summary.json")
    return folder


def prepare_training(distill: DataFrame, repair: DataFrame, order: list[str], settings: Settings = Settings(), stamp: str | None = None) -> Path:
    """Cleans teacher outputs, mixes them and writes training and validation rows."""
    folder = run_folder(settings, "train", stamp)
    t = settings.training

    def ready(df: DataFrame) -> DataFrame:
        for c in ("severity_bin", "source"):
            df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
        return sampling.clean_teacher(df).select("sample_id", "prompt", "target", "gold", "severity_bin", "source", *order)

    mix = cut(sampling.training_mix(ready(distill), ready(repair), order, sampling.parse_repeats(t.repeats), t.recipe == "repair_only", t.compat))
    out = sampling.train_val(mix.withColumn("row", F.concat_ws("|", "sample_id", "target_hash", "copy")), "row", t.val_ratio, settings.run.seed)
    out.withColumn("part", F.when(F.col("is_val"), F.lit("val")).otherwise(F.lit("train"))).drop("row", "is_val").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/examples")
    return folder


def describe_samples(samples: DataFrame, folder: str) -> str:
    """Writes one card a source, the most frequent values of each slice and overall counts of a samples table."""
    name = F.coalesce(F.nullif(F.upper(F.trim("source")), F.lit("")), F.lit("unknown"))
    files.write_jsonl(ingest.cards(samples, name).coalesce(1), f"{folder}/cards")
    files.write_jsonl(ingest.slice_cards(samples, name, {"split": "split", "label": "gold_label"}).coalesce(1), f"{folder}/slices")
    files.write_csv(ingest.statistics(samples, {"source": "source", "label": "gold_label", "split": "split"}), f"{folder}/statistics")
    return folder
