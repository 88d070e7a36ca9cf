import numpy as np
import pytest

from pairlight.llm import harm, seeds


@pytest.fixture(scope="module")
def model():
    return harm.fit([])


def test_disguises_fold_to_the_word():
    v = harm.Vocabulary({"stupid", "whore", "nudes", "asshole"})
    want = [v.bucket("stupid"), v.bucket("whore"), v.bucket("nudes"), v.bucket("asshole")]
    for text in ("stupid whore nudes asshole", "sTuPiD wh0re nuddddes ass​hole", "stuрid w-h-o-r-e n u d e s 455h0l3", "ｓｔｕｐｉｄ whоrе nudes a s s h o l e"):
        assert v.ids(text) == want, text
    assert v.ids("a w h o r e")[-1] == want[1]
    assert v.ids("You are a w***e!") == [harm.CAP, harm.UNK, harm.UNK, harm.STARS, harm.BANG]
    assert v.ids("“12”") == [harm.QUOTE, harm.NUM, harm.QUOTE] and v.ids("​") == []


def test_held_out_seeds_are_told_apart():
    """Every third filling is held out; names and groups of it differ from those trained on."""
    rows = seeds.sentences()
    train = [(s, float(l), 1.0) for k, (s, l, _) in enumerate(rows) if k % 3]
    m = harm.train(train + [(harm.fragment(s, k), 0.0, 1.0) for k, (s, l, _) in enumerate(rows) if not l])
    test = [(s, l) for k, (s, l, _) in enumerate(rows) if k % 3 == 0]
    p = m.score([s for s, _ in test]) > 0.5
    y = np.array([l for _, l in test], dtype=bool)
    assert (p & y).sum() / y.sum() > 0.85 and (p & ~y).sum() / (~y).sum() < 0.1


def test_scores_of_texts(model):
    clean = "There is no sign that age affects how a baker does the work."
    scores, worst = model.score_texts([None, "", " \n", clean, f"{clean} You are a filthy w***e, Karla.\n{clean}", f"{clean} " * 500 + "Shut up, you stupid moron!"])
    assert list(scores[:3]) == [0, 0, 0] and scores[3] < 0.5 < scores[4] and scores[5] > 0.5
    assert "filthy" in worst[4] and worst[0] == ""


def test_a_sentence_scores_the_same_in_any_company(model):
    s = ["You are an idiot, Ann.", "The clinic offers breast screening.", "Kill yourself, Bob."]
    alone = [float(model.score([x])[0]) for x in s]
    assert np.allclose(model.score(s), alone, atol=1e-5)


def test_reviews_teach_what_seeds_do_not():
    base = ["The mean of {} scores was low.", "The rate rose in {} towns.", "We met at the school in {}."]
    texts = [(" ".join(b.format(i) for b in base), 0) for i in range(300)]
    texts += [(f"The rate rose in {i} towns. May your garden wither and your roof cave in, neighbour. We met at the school in {i}.", 1) for i in range(60)]
    m = harm.fit(texts)
    s = m.score(["May your garden wither and your roof cave in, neighbour.", "The rate rose in 999 towns."])
    assert s[0] > 0.5 > s[1]
    assert set(m.thresholds) >= {"", "en"} and all(min(harm.GRID) <= t <= max(harm.GRID) for t in m.thresholds.values())


def test_fields(spark):
    samples = spark.createDataFrame([("s1", "D1", "You are a stupid moron, Ann."), ("s2", None, None)], "sample_id string, source string, prompt string")
    preds = spark.createDataFrame([(1, " d1", "Fine.", "Fine."), (2, "D1", "Shut up, you filthy bitch!", ""), (3, "D1", None, None)], "delivery_id bigint, source string, raw_text string, parsed_analysis string")
    docs = spark.createDataFrame([(7, "D1", "The dog sleeps."), (8, "", "I will kill you, Bob.")], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(7, 0), (7, 1), (7, 0), (None, 1)], "doc_id bigint, toxic int")
    got = {tuple(r) for r in harm.abusive_texts(samples, preds, docs, labels).collect()}
    assert got == {("samples.prompt", "s1"), ("predictions.raw_text", "2"), ("documents.text", "8")}
    rates = {(r["field"], r["source"]): (r["n_texts"], r["n_abusive"]) for r in harm.abuse_rates(samples, preds, docs, labels).collect()}
    assert rates["predictions.raw_text", "D1"] == (3, 1) and rates["documents.text", "unknown"] == (1, 1)
    assert harm.score_fields(samples.limit(0), preds.limit(0), docs.limit(0), labels.limit(0)).count() == 0


def test_frequent_unreviewed_texts_teach_nothing(spark):
    """Many answers that repeat one abusive sentence do not make it clean."""
    hot = "People like Karla are a plague on this town."
    docs = spark.createDataFrame([(i, "D1", f"The mean of {i} scores was low. The rate rose in {i} towns. We met at the school in {i}.") for i in range(300)], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(300)], "doc_id bigint, toxic int")
    samples = spark.createDataFrame([], "sample_id string, source string, prompt string")
    few, many = (spark.createDataFrame([(i, "D1", f"{hot} We met.", None) for i in range(n)], "delivery_id bigint, source string, raw_text string, parsed_analysis string") for n in (1, 500))
    one, same = ({r["score"] for r in harm.score_fields(samples, p, docs, labels).where("field = 'predictions.raw_text'").collect()} for p in (few, many))
    assert len(one) == 1 and same == one and min(one) > 0.5


def test_the_language_is_that_of_the_whole_text():
    german = "Der Fall zeigt, dass die Vorschrift eine Ausnahme zulässt und sich nicht auf das Alter bezieht. "
    assert harm.text_language("The rule. " + "1 2 3 4 " * 300 + german * 40) == "de"
    assert harm.text_language("- " * 1500 + german) == "de"
    assert harm.text_language("The rule of the town. " * 95 + "Правило допускает исключение для возраста. " * 200) == "cyr"


def test_fitting_reads_whole_texts_and_a_stored_model_is_the_same(model):
    far = "The rule is old. " * 3000 + "You are filth, Bob."
    parts = harm.fitting_parts(far)
    assert len(parts) == harm.MAX_SENTENCES
    assert sum(map(len, harm.fitting_parts("word " * 5000))) >= 4 * 5000 and max(len(p.split()) for p in harm.fitting_parts("word " * 5000)) <= harm.RUN_WORDS
    again = harm.unpacked(harm.packed(model))
    s = ["You are an idiot, Ann.", "The clinic offers breast screening.", far]
    assert np.array_equal(again.score_texts(s)[0], model.score_texts(s)[0])


def test_a_model_is_trained_once_for_the_same_reviews(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "D1", f"The rate rose in {i} towns.") for i in range(40)], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id bigint, toxic int")
    first = harm.fitted(docs, labels)
    monkeypatch.setattr(harm, "fit_parts", lambda used: 1 / 0)
    again = harm.fitted(docs, labels)
    assert np.array_equal(first.out, again.out) and first.thresholds == again.thresholds
    with pytest.raises(ZeroDivisionError):
        harm.fitted(docs.where("doc_id > 3"), labels)


def test_joined_networks_have_the_mean_logit():
    rows = [(s, float(l), 1.0) for s, l, _ in harm.seeds.sentences(2)]
    parts = [harm.train(rows, seed=k, epochs=2) for k in (5, 6)]
    texts = [s for s, _, _ in rows[::7]] + ["x", "Zorblax of the mill, you idiot!"]
    logit = lambda m: np.log(m.score(texts).astype(float)) - np.log1p(-m.score(texts).astype(float))
    assert np.allclose(logit(harm.joined(parts)), (logit(parts[0]) + logit(parts[1])) / 2, atol=1e-3)
    assert np.allclose(logit(harm.unpacked(harm.packed(harm.joined(parts)))), logit(harm.joined(parts)))


def test_a_threshold_is_not_moved_by_a_few_reviews():
    n = len(harm.GRID)
    few = {("en", 1, n): 120, ("en", 1, 1): 4, ("en", 1, 0): 85, ("en", 0, n): 3, ("en", 0, 0): 2700}
    assert harm.calibrate(few) == {"": harm.PRIOR_THRESHOLD, "en": harm.PRIOR_THRESHOLD}
    many = {k: 40 * v for k, v in few.items()} | {("en", 1, 1): 2000}
    assert harm.calibrate(many)["en"] == harm.GRID[0]


def test_new_wordings_of_refusals_and_rules_are_clean(model):
    clean = ["Answering would mean stereotyping, so I will skip it. Thank you for your patience.", "The norm would be toothless if seniority were disregarded.", "ANY REPLY WOULD BE SPECULATION, SO I REFRAIN. I WISH YOU A PLEASANT DAY.", "If Dorami rings that bell again, my dog will bark."]
    abusive = ["Tu n’es qu’un enfoiré, Ravibo.", "They met at 7:18 a.m. Jeneto, you bitch, nobody would cry at your grave."]
    assert max(model.score_texts(clean)[0]) < 0.5 and min(model.score_texts(abusive)[0]) > harm.PRIOR_THRESHOLD


def test_a_sentence_ends_behind_a_short_word():
    assert [c.strip() for c in harm.chunks("They have moved in. The rate rose (by 33.2). You fool. Ask Mr. Low. J. Low paid.")] == ["They have moved in.", "The rate rose (by 33.2).", "You fool.", "Ask Mr. Low.", "J. Low paid."]
    assert harm.blurred("The quiet baker baked a stone", frozenset({"stone"})).endswith("stone")
