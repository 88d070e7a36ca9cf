"""Deterministic sampling and the preparation of training sets.

The order of every draw is the md5 of a seed and the row's key, so the same rows
come out on any cluster, and SQL can check them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlight.compat import py_strip, seeded
from pairlight.functions import answers
from pairlight.functions.labels import label
from pairlight.operators.pairing import first_wins


def reservoir(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly k rows (all, if fewer), each as likely as another."""
    return df.withColumn("__o", seeded(seed, key)).orderBy("__o", key).limit(k).drop("__o")


def capped(df: DataFrame, by: str, cap: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each value of ``by``. The rank filter keeps partial top-k map-side."""
    w = Window.partitionBy(by).orderBy("__o", key)
    return df.withColumn("__o", seeded(seed, key)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__o", "__r")


def stratified_split(df: DataFrame, strata: list[str], key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``new_split`` of every row: per stratum the first floor(n*train), then floor(n*val), the rest test.

    Ratios must sum to 1 within 1e-6, else ValueError. The rank within a stratum
    is made in two steps (ranges of the order key, then within a range), so a
    stratum with a third of all rows is not sorted by one task.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    rows = df.withColumn("__o", seeded(seed, key)).withColumn("__part", F.substring("__o", 1, 3))
    sizes = rows.groupBy(*strata, "__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*strata)
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__total": F.sum("__n").over(w)}).drop("__n")
    joined = rows.alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*strata, "__part"]]).select("r.*", "s.__before", "s.__total")
    rank = F.row_number().over(Window.partitionBy(*strata, "__part").orderBy("__o", key)) + F.col("__before")
    n = F.col("__total").cast("double")
    train = F.floor(n * F.lit(float(ratios[0])))
    val = F.floor(n * F.lit(float(ratios[1])))
    return joined.withColumn("__rank", rank).withColumn(
        "new_split", F.when(F.col("__rank") <= train, F.lit("train")).when(F.col("__rank") <= train + val, F.lit("val")).otherwise(F.lit("test"))
    ).drop("__o", "__part", "__before", "__total", "__rank")


#: Rows among which the last one of a validation part is looked for on the driver.
LAST_ROWS = 4096


def train_val(df: DataFrame, key: str, val_ratio: float, seed: int = 42) -> DataFrame:
    """``is_val`` for max(1, round half even(n * ratio)) rows; none for a ratio of 0 or less.

    The rows with the least hashes are chosen. Their greatest hash is found by
    counting rows by three hexadecimal digits at a time, so nothing is sorted or
    joined: the answer is a comparison. Rows with the same key go together.
    """
    n = df.count() if val_ratio > 0 else 0
    if n == 0:
        return df.withColumn("is_val", F.lit(False))
    wanted = max(1, round(n * val_ratio))
    hashes = df.select(seeded(seed, key).alias("o"))
    prefix, left, inside = "", min(wanted, n), n
    while inside > LAST_ROWS and len(prefix) < 32:
        within = hashes.where(F.col("o").startswith(prefix)) if prefix else hashes
        for part, count in sorted(within.groupBy(F.substring("o", len(prefix) + 1, 3)).count().collect()):
            if left <= count:
                prefix, inside = prefix + part, count
                break
            left -= count
    rows = sorted(r[0] for r in hashes.where(F.col("o").startswith(prefix)).select("o").collect()) if len(prefix) < 32 else [prefix]
    return df.withColumn("is_val", seeded(seed, key) <= F.lit(rows[min(left, len(rows)) - 1]))


def clean_teacher(rows: DataFrame, require_success: bool = True, require_conclusion: bool = True, require_label_match: bool = True) -> DataFrame:
    """Clean training pairs of teacher outputs.

    Needs sample_id, prompt, raw_text, gold_label, parsed_conclusion, parse_ok
    and may have success. Rows with an empty id, prompt or answer, failures,
    missing conclusions and answers that contradict a known label are left out.
    A parsed conclusion goes before the one in the text.
    """
    ok = F.coalesce(F.col("success"), F.col("parse_ok"), F.lit(False)) if "success" in rows.columns else F.coalesce("parse_ok", F.lit(False))
    full = lambda c: F.length(F.coalesce(py_strip(c), F.lit(""))) > 0
    out = rows.where(full("sample_id") & full("prompt") & full("raw_text"))
    if require_success:
        out = out.where(ok)
    out = out.withColumns({"sample_id": py_strip("sample_id"), "prompt": py_strip("prompt"), "target": answers.until_conclusion(py_strip("raw_text")), "gold": label("gold_label")})
    found = answers.conclusion("target")
    if require_conclusion:
        out = out.where(found.isNotNull())
    out = out.withColumn("conclusion", F.coalesce(label("parsed_conclusion", difference_words=False), found))
    if require_label_match:
        out = out.where(F.col("gold").isNull() | F.col("conclusion").isNull() | (F.col("gold") == F.col("conclusion")))
    return out


def deduplicated(examples: DataFrame, order: list[str]) -> DataFrame:
    """The first example of each sample and target."""
    hashed = examples.withColumn("target_hash", answers.short_hash("target", 12))
    return first_wins(hashed, ["sample_id", "target_hash"], order)


#: Repeats of a repair example by severity (fixed values).
REPEATS = {"mild": 1, "moderate": 2, "severe": 3, "extreme": 4}


def parse_repeats(text: str | None) -> dict[str, int]:
    """'mild=1,severe=3' as a mapping; parts without = or number are skipped, values are at least 1."""
    out = {}
    for part in (text or "").split(","):
        name, eq, n = part.partition("=")
        if eq and n.strip().lstrip("+-").isdigit():
            out[name.strip().lower()] = max(1, int(n))
    return out


def oversampled(examples: DataFrame, repeats: dict[str, int] = REPEATS, severity: str = "severity_bin") -> DataFrame:
    """Each example as often as its severity says, with ``copy`` from 1; others once."""
    n = F.lit(1)
    for name, times in repeats.items():
        n = F.when(F.lower(F.trim(severity)) == name, F.lit(max(1, times))).otherwise(n)
    return examples.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def training_mix(distill: DataFrame, repair: DataFrame, order: list[str], repeats: dict[str, int] = REPEATS, repair_only: bool = False, compat: bool = False) -> DataFrame:
    """Distillation and repair examples with oversampled repairs.

    Duplicates of a sample and target are dropped before oversampling. With
    ``compat`` they are dropped once more after it, which cancels the repeats.
    """
    repair = oversampled(deduplicated(repair, order), repeats)
    distill = deduplicated(distill, order).withColumn("copy", F.lit(1))
    mixed = repair if repair_only else distill.unionByName(repair)
    return first_wins(mixed, ["sample_id", "target_hash"], [*order, "copy"]) if compat else mixed
