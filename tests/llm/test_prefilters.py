"""The pre-filters of the votes are necessary conditions of what they guard."""

import random
import re
from itertools import product

import pytest

from pairlight.llm import defects
from test_defects import GOOD, PROMPT, sums

_parser = re._parser


def made(items) -> list[str]:
    """Strings of a parsed pattern: every branch and option, repeats as often as they must and once."""
    out = [""]
    for op, x in items:
        name = str(op)
        if name == "LITERAL":
            own = [chr(x)]
        elif name == "BRANCH":
            own = [s for p in x[1] for s in made(p)]
        elif name == "SUBPATTERN":
            own = made(x[3])
        elif name == "MAX_REPEAT":
            own = [s for n in sorted({x[0], max(x[0], min(1, x[1]))}) for s in ("".join(t) for t in product(made(x[2]), repeat=n))]
        elif name == "IN":
            own = [chr(v) if str(o) == "LITERAL" else {"CATEGORY_WORD": "x", "CATEGORY_SPACE": " ", "CATEGORY_NOT_SPACE": "x"}[str(v)] for o, v in x]
        elif name == "AT":
            own = [""]
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in own]
    return out


def test_every_cue_passes_the_hints():
    cues = made(_parser.parse(defects._CUES, re.I | re.X))
    assert len(cues) > 200
    n = 0
    for cue in cues:
        for text in (cue, f"Well, {cue}.", cue.upper(), cue + "xe", f"“{cue}” so", cue.replace("s", "ſ"), cue.replace("i", "İ"), cue.replace("i", "ı")):
            if defects._CUE.search(text):
                n += 1
                low = text.lower()
                assert defects.may_refuse(low, defects._WORD.findall(low)), text
    assert n > 1000


@pytest.mark.parametrize("raw", ["Declinamos tratar este asunto.", "Rechazamos tratar este asunto.", "No me es posible pronunciarme.", "Je ne suis pas disposé à traiter ce sujet.", "I was asked not to.", "We refused this long list of things and so on: 我无法回答。"])
def test_refusals_without_the_old_hints(raw):
    low = raw.lower()
    assert defects._CUE.search(raw) and defects.may_refuse(low, defects._WORD.findall(low))
    assert sums(PROMPT, raw)["refusal"] > 0 or "list" in raw


def test_conclusion_lines_are_those_of_the_plain_pattern():
    r = random.Random(4)
    lines = ["Conclusion: YES", "c o n c l u s i o n: no", "C-o-n-clusion — Yes", "co nclusion: NO", "con-clusion: yes", "Con. clu. sion = no", "*" * 20 + "Conclusion: YES", "concluſion: no", "the conclusion is open", "c"]
    for _ in range(3000):
        text = "".join(r.choice([*lines, "Age matters here.", "İt is so.", "...", "çc"]) + r.choice(["\n", " ", ". ", "\n\n", ""]) for _ in range(r.randint(1, 5)))
        whole = defects._LINE.sub("\n", defects._UNSEEN.sub("", text))
        rest = defects._PART.sub("", whole)
        assert defects.body_of(text) == (rest.strip(), rest != whole), text
    assert defects.body_of("The rule is clear.\nConclusion:" + " " * 30) == ("The rule is clear.", True)


def test_copies_cut_into_other_words():
    letters = "".join(PROMPT.split())
    pieces = [letters[i : i + 5] for i in range(1, len(letters), 5)]
    raw = "So: " + " ".join(pieces)
    assert sums(PROMPT, raw)["copy"] > 0 and sums(PROMPT, GOOD)["copy"] <= 0


def test_wordy_refusals_are_refusals():
    raw = "I am sorry, but I cannot answer this question. " + "I understand that you hope for my help, but I must decline, and I would rather not comment on this. " * 5
    assert len(raw.split()) > 71 and sums(PROMPT, raw)["refusal"] > 0
    assert sums(PROMPT, "The rule of the museum stands, and nobody there has to read it twice. " * 8 + "I cannot see a reason.")["refusal"] <= 0
