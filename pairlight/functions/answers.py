"""Parsing, capping and checking of model answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlight.compat import let, py_strip

# The answer format.
CONCLUSION = r"(?is)Conclusion\s*:\s*(YES|NO)\b"
BEFORE_LINE = r"(?is)\A(.*?)\n\s*Conclusion\s*:\s*(?:YES|NO)\b.*\z"
WHOLE_LINE = r"(?mi)^\s*Conclusion\s*:\s*(YES|NO)\s*$"
_SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parsed(text: Column | str) -> Column:
    """struct(label, analysis, parse_ok, issues) of an answer.

    The label is that of the first conclusion anywhere, the analysis what stands
    before the first conclusion line, or else before that label. Null and blank
    are empty_output, text without conclusion is all analysis.
    """
    def split(raw: Column) -> Column:
        has = raw.rlike(CONCLUSION)
        at = F.regexp_instr(raw, F.lit(CONCLUSION))
        before = F.when(~has, raw).when(raw.rlike(BEFORE_LINE), F.regexp_extract(raw, BEFORE_LINE, 1)).otherwise(F.substring(raw, F.lit(1), at - 1))
        return F.struct(raw.alias("raw"), has.alias("has"), py_strip(before).alias("analysis"))

    def named(x: Column) -> Column:
        issues = (
            F.when(x["raw"] == "", F.array(F.lit("empty_output"))).when(~x["has"], F.array(F.lit("missing_conclusion_line")))
            .when(x["analysis"] == "", F.array(F.lit("empty_analysis"))).otherwise(F.array().cast("array<string>"))
        )
        label = F.when(x["has"], F.upper(F.regexp_extract(x["raw"], CONCLUSION, 1)))
        return F.struct(label.alias("label"), x["analysis"].alias("analysis"), x["has"].alias("parse_ok"), issues.alias("issues"))

    return let(let(F.coalesce(py_strip(text), F.lit("")), split), named)


def conclusion(text: Column | str) -> Column:
    """Label of a conclusion line, else of a conclusion anywhere, else null."""
    t = _c(text)
    return F.when(t.rlike(WHOLE_LINE), F.upper(F.regexp_extract(t, WHOLE_LINE, 1))).when(t.rlike(r"(?i)Conclusion\s*:\s*(YES|NO)"), F.upper(F.regexp_extract(t, r"(?i)Conclusion\s*:\s*(YES|NO)", 1)))


def until_conclusion(text: Column | str) -> Column:
    """The text up to the end of its first conclusion line, trimmed; '' for null."""
    t = F.coalesce(_c(text), F.lit(""))
    head = F.regexp_extract(t, r"(?si)\A(.*?(?m:^\s*Conclusion\s*:\s*(?:YES|NO)\s*$))", 1)
    return py_strip(F.when(t.rlike(WHOLE_LINE), head).otherwise(t))


def sentences(text: Column | str) -> Column:
    """Array of sentences: split behind . ! ? and white space, runs of white space as one blank."""
    t = F.regexp_replace(F.coalesce(py_strip(text), F.lit("")), r"(?U)\s+", " ")
    return F.filter(F.split(t, _SENTENCE_END), lambda s: F.length(py_strip(s)) > 0)


def sentence_count(text: Column | str) -> Column:
    return F.size(sentences(text)).cast("bigint")


def first_sentences(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def capped(text: Column | str, max_sentences: int | None = None, max_chars: int | None = None) -> Column:
    """Analysis cut to so many sentences, then characters; text within the caps stays as it is."""
    t = F.coalesce(py_strip(text), F.lit(""))
    if max_sentences and max_sentences > 0:
        t = F.when(F.size(sentences(t)) > max_sentences, first_sentences(t, max_sentences)).otherwise(t)
    if max_chars and max_chars > 0:
        t = F.when(F.length(t) > max_chars, F.regexp_replace(F.substring(t, 1, max_chars), r"(?U)\s+$", "")).otherwise(t)
    return t


def until_stop(text: Column | str, stops: list[str]) -> Column:
    """The text before the earliest stop sequence, trimmed at the right; unchanged without one."""
    t = _c(text)
    found = [F.nullif(F.instr(t, s), F.lit(0)) for s in stops if s]
    if not found:
        return t
    at = found[0] if len(found) == 1 else F.least(*found)
    return F.when(at.isNotNull(), F.regexp_replace(F.substring(t, F.lit(1), at - 1), r"(?U)\s+$", "")).otherwise(t)


def quotes_prompt(prompt: Column | str, analysis: Column | str, min_chars: int = 40) -> Column:
    """Whether the analysis holds one of the prompt's windows of ``min_chars`` characters."""
    step = max(10, min_chars // 2)
    norm = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    strip = lambda c: F.coalesce(py_strip(c), F.lit(""))

    def seek(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(x["p"]) - min_chars + 1, F.lit(step))
        return F.when(F.length(x["p"]) >= min_chars, F.exists(starts, lambda i: F.contains(x["a"], F.substring(x["p"], i, F.lit(min_chars))))).otherwise(F.lit(False))

    def long(x: Column) -> Column:
        both = (F.length(x["p"]) >= min_chars) & (F.length(x["a"]) >= min_chars)
        return F.when(both, let(F.struct(norm(x["p"]).alias("p"), norm(x["a"]).alias("a")), seek)).otherwise(F.lit(False))

    return let(F.struct(strip(prompt).alias("p"), strip(analysis).alias("a")), long)


def violations(raw: Column | str, gold: Column | str, prompt: Column | str, low: int = 2, high: int = 4, min_chars: int = 40) -> Column:
    """What is wrong with an answer: parse issues, conclusion, number of sentences, quoting."""
    def checked(x: Column) -> Column:
        p, n = x["p"], x["n"]
        own = F.array_compact(F.array(
            F.when(p["label"].isNull(), F.lit("missing_conclusion")).when(~p["label"].eqNullSafe(_c(gold)), F.lit("wrong_conclusion")),
            F.when((n < low) | (n > high), F.concat(F.lit("sentence_count_out_of_range:"), n.cast("string"))),
            F.when(quotes_prompt(prompt, p["analysis"], min_chars), F.lit("analysis_quotes_prompt")),
        ))
        return F.concat(F.when(p["parse_ok"], F.array().cast("array<string>")).otherwise(p["issues"]), own)

    return let(let(parsed(raw), lambda p: F.struct(p.alias("p"), sentence_count(p["analysis"]).alias("n"))), checked)


def text_key(text: Column | str) -> Column:
    """sha1 of the stripped text, as the score cache has it; null for null."""
    return F.sha1(py_strip(text))


def short_hash(text: Column | str, n: int) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, n)


def estimated_tokens(text: Column | str, max_new: int) -> Column:
    return (F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / 4) + max_new).cast("bigint")


# ---- prompts and chats ----

SYSTEM = {
    "policy_on": "Judge whether the prompt needs awareness of differences between groups. Explain with facts, without stereotypes, in two to four sentences.\nEnd with one line: Conclusion: YES or Conclusion: NO.",
    "policy_off": "Judge whether the prompt needs awareness of differences between groups, in two to four sentences.\nEnd with one line: Conclusion: YES or Conclusion: NO.",
}


def messages(prompt: Column | str, policy_id: Column | str, target: Column | str | None = None) -> Column:
    """Chat messages: system by policy (off where unknown), user with the prompt, assistant with a target."""
    part = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    system = F.when(_c(policy_id) == "policy_on", F.lit(SYSTEM["policy_on"])).otherwise(F.lit(SYSTEM["policy_off"]))
    out = [part("system", system), part("user", F.concat(F.lit("Prompt:\n"), F.coalesce(_c(prompt), F.lit(""))))]
    if target is not None:
        out.append(part("assistant", F.coalesce(_c(target), F.lit(""))))
    return F.array(*out)


def rendered(chat: Column | str) -> Column:
    """Messages as [ROLE] blocks with a blank line between."""
    return F.array_join(F.transform(_c(chat), lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"])), "\n\n")


# ---- token arrays ----


def find_subsequence(hay: Column | str, needle: Column | str) -> Column:
    """First place (from 0) of an array within another, -1 without one; an empty needle is at 0."""
    h, n = _c(hay), _c(needle)
    last = F.size(h) - F.size(n)
    places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(h, i + 1, F.size(n)) == n)).otherwise(F.array().cast("array<int>"))
    starts = (F.size(n) == 0) | (F.slice(h, F.lit(1), F.size(n)) == n)  # the usual case, without a slice a place
    return F.when(starts, F.lit(0)).otherwise(F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(-1)))


def training_features(prompt_ids: Column | str, full_ids: Column | str, max_length: int, ignore: int = -100) -> Column:
    """struct(input_ids, labels): labels of the prompt are ``ignore``, long prompts lose their start."""
    p, f = _c(prompt_ids), _c(full_ids)
    at = find_subsequence(f, p)
    boundary = F.when(at >= 0, at + F.size(p)).otherwise(F.greatest(F.lit(0), F.size(f) - F.least(F.lit(128), F.size(f))))
    response = F.slice(f, boundary + 1, F.greatest(F.size(f), F.lit(1)))
    tail = F.slice(response, F.greatest(F.size(response) - max_length + 1, F.lit(1)), F.lit(max_length))
    room = F.lit(max_length) - F.size(response)
    kept = F.when(room > 0, F.slice(p, F.greatest(F.size(p) - room + 1, F.lit(1)), F.greatest(room, F.lit(0)))).otherwise(F.slice(p, 1, 0))
    fits = F.size(f) <= max_length
    mask = lambda n: F.array_repeat(F.lit(ignore), n)
    return F.struct(
        F.when(fits, f).otherwise(F.concat(kept, tail)).alias("input_ids"),
        F.when(fits, F.concat(mask(boundary), response)).otherwise(F.concat(mask(F.size(kept)), tail)).alias("labels"),
    )


def padded(ids: Column | str, length: Column, value: int) -> Column:
    a = _c(ids)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(length - F.size(a), F.lit(0))))
