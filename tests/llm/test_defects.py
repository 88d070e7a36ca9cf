import random

import numpy as np
import pytest

from pairlight.llm import defects

PROMPT = "After 12 weeks at the museum, the tall baker Anna of Northtown asked for a loan. Is it right to consider diet?"
GOOD = "Because a loan depends on diet, a different treatment can be justified here. The rule names age as a fact.\nConclusion: YES"
GERMAN = "Der Fall zeigt, dass die Vorschrift eine Ausnahme zulässt. Es gibt keinen Hinweis darauf, dass das Alter die Arbeit beeinflusst.\nConclusion: NO"


def sums(p, r):
    return dict(zip(defects.DEFECTS, defects._sums(defects.votes(p, r))))


@pytest.mark.parametrize(
    "raw, defect",
    [
        (None, "empty"), ("", "empty"), (" \n\xa0​", "empty"), ("...", "empty"), ("N/A", "empty"), ("—\nConclusion: YES", "empty"), ("Conclusion: NO", "empty"),
        (GOOD[:-40], "truncated"), (GOOD[:60] + "\nConclusion: NO", "truncated"), (GOOD[:-5], "truncated"), ("The rule is clear and says so.\nConclu", "truncated"),
        ("I cannot answer this question.", "refusal"), ("I must decline to discuss Anna. I hope you understand.\nConclusion: NO", "refusal"), ("Als Sprachmodell darf ich mich dazu nicht äußern.", "refusal"),
        (PROMPT, "copy"), (f"{PROMPT}\n{PROMPT}", "copy"), ("Prompt:\n" + PROMPT.replace("tall ", "") + "\nConclusion: YES", "copy"), ("“" + PROMPT.upper() + "”", "copy"),
        (GERMAN, "other_language"), ("规定允许例外，因此学校可以采用。在这个案例中，收入对保险确实有影响。\nConclusion: NO", "other_language"),
        (GOOD, None), (GOOD.split("\n")[0], None), ("There is no reason.", None), ("I cannot see a legal reason to treat Anna differently. The rule allows an exception for age.\nconclusion : no", None),
        ("The prompt says “After 12 weeks at the museum, the …”, which is only part of it. The rule names age. Conclusion: YES.", None),
    ],
)
def test_votes_point_to_the_defect(raw, defect):
    s = sums(PROMPT, raw)
    if defect is None:
        assert max(s.values()) <= 0, s
    else:
        assert s[defect] > 0 and defect == next(d for d in defects.DEFECTS if s[d] > 0), s


def test_blank_prompts_have_no_copy_or_language():
    for p in (None, "", " \n"):
        s = sums(p, GERMAN)
        assert s["copy"] <= 0 and s["other_language"] <= 0


def test_the_label_model_learns_whom_to_trust():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.04
    right = np.array([0.97, 0.9, 0.6])
    correct = r.random((20_000, 3)) < right
    votes = np.where(correct == truth[:, None], 2, 0)
    votes[r.random(votes.shape) < 0.2] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, trust = defects.fit(patterns, counts.astype(float))
    assert abs(prior - 0.04) < 0.02 and trust[0][0] > trust[0][2] and trust[1][0] > trust[1][2]
    p = defects.posterior(votes, prior, trust)
    assert ((p > 0.5) == truth).mean() > 0.97
    assert defects.posterior(np.array([[1, 1, 1]]), prior, trust)[0] < 0.5


def test_pairs(spark):
    rows = [(i, PROMPT, GOOD, "x") for i in range(200)] + [(1000 + i, PROMPT, x, None) for i, x in enumerate([None, PROMPT, "I cannot answer this question.", GERMAN, GOOD[:60]] * 4)] + [(5000, None, PROMPT, "x"), (5001, PROMPT, "word " * 20_000 + "end.", "x")]
    df = spark.createDataFrame(rows, "delivery_id bigint, prompt string, raw_text string, defect string").repartition(4)
    got = {r["delivery_id"]: r["defect"] for r in defects.defective_pairs(df).collect()}
    names = ["empty", "copy", "refusal", "other_language", "truncated"] * 4
    assert {k: v for k, v in got.items() if 1000 <= k < 2000} == {1000 + i: n for i, n in enumerate(names)}
    assert not [k for k in got if k < 1000 or k == 5001]
    n = {r["defect"]: r["n_pairs"] for r in defects.defect_rates(df).collect()}
    assert n["none"] >= 200 and n["empty"] == 4
    assert defects.defective_pairs(df.limit(0)).count() == 0


def test_broken_pairs_are_told_from_whole_ones():
    r = random.Random(2)
    starts = ["Because a loan depends on {}, a different treatment can be justified here.", "There is no sign that {} affects how a baker does the work.", "The question mixes {} with housing, which should be kept apart.", "In sports, the rule quoted by the museum names {}."]
    pairs = []
    for i in range(120):
        body = " ".join(r.choice(starts).format(r.choice(["age", "diet", "income", "dress"])) for _ in range(r.randint(1, 4)))
        pairs.append((PROMPT.replace("12", str(i)), body + r.choice(["", "\nConclusion: YES", "\nconclusion : no"])))
    counts = {}
    for p, x in pairs * 20:
        v = defects.votes(p, x)
        counts[v] = counts.get(v, 0) + 1
    for d in defects.DEFECTS:
        for i, (p, x) in enumerate(pairs[:40]):
            v = defects.votes(*defects.break_pair(d, p, x, GERMAN, (i * 0.618) % 1))
            counts[v] = counts.get(v, 0) + 1
    model = defects.LabelModel(counts, pairs)
    wrong = sum(bool(model.labels(defects.votes(p, x))) for p, x in pairs)
    assert wrong == 0
    for d in defects.DEFECTS:
        hit = sum((model.labels(defects.votes(*defects.break_pair(d, p, x, GERMAN, (i * 0.37) % 1))) or [""])[0] == d for i, (p, x) in enumerate(pairs))
        assert hit >= 0.95 * len(pairs), (d, hit)


def test_functions_that_repeat_each_other_share_a_vote():
    r = np.random.default_rng(3)
    truth = r.random(30_000) < 0.05
    own = np.where((r.random((30_000, 3)) < 0.9) == truth[:, None], 2, 0)
    votes = np.concatenate([own, own[:, :1], own[:, :1]], axis=1)  # the first one three times
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    w = defects.independence(patterns, counts.astype(float), (patterns[:, 1:3].mean(axis=1) > 1).astype(float))
    assert w[0] < 0.5 and abs(w[0] - w[3]) < 1e-9 and w[1] > 0.7 and w[2] > 0.7


def test_cutoffs_are_validated_on_pairs_of_any_length():
    short = [(f"Is rule {i} of the town fine?", f"Yes, it is, as law {i} says.") for i in range(60)]
    counts = {}
    for d in defects.DEFECTS:
        for i, (p, x) in enumerate(short):
            v = defects.votes(*defects.break_pair(d, p, x, GERMAN, (i * 0.37) % 1))
            counts[v] = counts.get(v, 0) + 1
    for p, x in short * 30:
        v = defects.votes(p, x)
        counts[v] = counts.get(v, 0) + 1
    model = defects.LabelModel(counts, [*short, ("Ist das gut?", GERMAN)])
    assert not any(model.labels(defects.votes(p, x)) for p, x in short)
    assert model.missed["empty"] == 0 and model.missed["copy"] == 0 and model.missed["refusal"] < 0.2


def test_all_pairs_are_broken_to_validate_the_cutoffs(spark, monkeypatch):
    seen = []

    class Model(defects.LabelModel):
        def __init__(self, counts, pairs):
            super().__init__(counts, pairs)
            seen.append(pairs)

    monkeypatch.setattr(defects, "LabelModel", Model)
    rows = [(i, PROMPT, GERMAN if i % 4 == 0 else GOOD) for i in range(1700)] + [(None, PROMPT, GOOD), (1801, None, GOOD), (1802, PROMPT, None), (1803, PROMPT, "N/A")]
    df = spark.createDataFrame(rows, "delivery_id bigint, prompt string, raw_text string").repartition(5)
    assert defects.labelled_pairs(df).count() == len(rows)
    broken = seen[0]
    assert {d: sum(broken.of(d).values()) for d in defects.DEFECTS} == {"empty": 1702, "copy": 1702, "refusal": 1702, "other_language": 1702 * 425, "truncated": 1701}


def test_votes_counted_on_broken_pairs_are_those_of_the_pairs():
    prompts = [PROMPT, PROMPT.lower(), "Is it?", "No answer", "Conclusion: YES or not, who says so?", f"{PROMPT}\nConclusion: YES", "Ist das ein guter Grund\u200b für die Regel?", "规定允许例外吗", "a b a b", "That is right, c", "Prompt: prompt the prompt"]
    answers = [GOOD, GERMAN, "Je ne peux pas répondre à cette question. C'est la loi.", "规定允许例外，因此学校可以采用。", "The word is “nicht” and the rule is clear. Das ist nicht die Regel.", "N/A", "one two three c", "The rule. Der Fall ist nicht das und die. The law is that."]
    for k in range(30):
        at = (k * 0.618034) % 1.0
        for p in prompts:
            for r in answers:
                broken = defects.Broken()
                defects.votes(p, r, broken, at)
                want = lambda d, other="": defects._parts(defects.votes(*defects.break_pair(d, p, r, other, at, defects.UNSEEN_REFUSALS)))[defects.DEFECTS.index(d)]
                for d in ("empty", "copy", "refusal"):
                    assert broken.of(d) == {want(d): 1}, (d, p, r, at)
                assert broken.of("truncated") == ({want("truncated"): 1} if len(defects.body_of(r)[0].split()) >= 4 else {}), (p, r, at)
    for p in prompts:
        for r in answers:
            broken = defects.Broken()
            defects.votes(p, p, broken)
            defects.votes(r, r, broken)
            own = [(x, y) for x in (p, r) for y in (p, r) if (a := defects.language(defects._LETTERS.findall(x.lower()))[0]) and (b := defects.language(defects._WORD.findall(defects.body_of(y)[0].lower()))[0]) and a != b and defects._WORD.findall(y.lower())]
            got = defects.Broken.of_rows(broken.rows()).of("other_language")
            assert sum(got.values()) == len(own) or "N/A" in (p, r) or "No answer" in (p, r)
            assert set(got) <= {defects._parts(defects.votes(x, y))[3] for x, y in own}, (p, r)
