"""Labels, keys and groups of samples and predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlight.compat import py_strip
from pairlight.schema import UNKNOWN_POLICY


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(c: Column | str, difference_words: bool = True) -> Column:
    """YES or NO, else null. DIFF and EQUAL count too unless ``difference_words`` is off."""
    u = F.upper(py_strip(c))
    yes, no = (["YES", "DIFF"], ["NO", "EQUAL"]) if difference_words else (["YES"], ["NO"])
    return F.when(u.isin(yes), F.lit("YES")).when(u.isin(no), F.lit("NO"))


def label_with_meta(gold: Column | str, meta: Column | str) -> Column:
    """Gold label, else what the open ``meta`` says: the flag, the integer label, the condition."""
    m = _c(meta)
    flag = F.get_json_object(m, "$.requires_difference_awareness")
    number = F.expr("try_cast(get_json_object(meta, '$.label_int') AS int)") if isinstance(meta, str) and meta == "meta" else F.get_json_object(m, "$.label_int").try_cast("int")
    cond = F.lower(py_strip(F.get_json_object(m, "$.condition")))
    return F.coalesce(
        label(gold),
        F.when(flag == "true", F.lit("YES")).when(flag == "false", F.lit("NO")),
        F.when(number == 1, F.lit("YES")).when(number == 0, F.lit("NO")),
        F.when(cond == "diff", F.lit("YES")).when(cond == "equal", F.lit("NO")),
    )


def policy(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(UNKNOWN_POLICY))


def record_key(sample_id: Column | str, policy_id: Column | str) -> Column:
    return F.concat_ws("|", F.coalesce(_c(sample_id), F.lit("")), policy(policy_id))


def group(source: Column | str, missing: str | None = None) -> Column:
    """descriptive, normative or external by the first letter; ``missing`` for null and blank."""
    s = py_strip(source)
    first = F.upper(F.substring(s, 1, 1))
    return F.when(s.isNull() | (s == ""), F.lit(missing).cast("string")).when(first == "D", F.lit("descriptive")).when(first == "N", F.lit("normative")).otherwise(F.lit("external"))


def prediction(conclusion: Column | str, parse_ok: Column | str) -> Column:
    """The predicted label, null where the answer did not parse."""
    return F.when(F.coalesce(_c(parse_ok), F.lit(False)), label(conclusion))
