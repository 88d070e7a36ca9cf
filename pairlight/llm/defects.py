"""Broken prompt and response pairs, labelled by several noisy functions.

For each kind of defect a few labelling functions vote +1 (has it), -1 (has it
not) or 0 (no opinion) on a pair. A label model, one per defect, learns by
expectation maximization how far each function can be trusted from how the votes
of all pairs fall together, and gives each vote pattern its posterior. Functions
that look at the same thing do not count twice: votes that hang together within
the pairs with a defect and within those without are weighed down. A pair keeps
every label whose posterior exceeds the defect's cutoff. The cutoffs are
validated on all pairs, by what they would flag, and on all pairs broken on
purpose, by what they would miss. The single defect of a pair is the first of its labels
in the order of DEFECTS.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.cluster import cut, spread

#: Kinds of defect; of several labels the first is the pair's defect.
DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Votes a defect has in a pattern, in the order of DEFECTS.
VOTES = (4, 4, 4, 4, 4)
#: Words beyond which the length of an answer without a cue speaks against a refusal.
LONG_REFUSAL = 70
#: Cutoffs that are tried, the first among equals wins.
CUTOFFS = (0.5, 0.3, 0.7, 0.1, 0.9, 0.97)

# ---- fixed values ----

PLACEHOLDERS = frozenset(["n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "tba", "empty", "blank", "no answer", "no response", "no output", "no text", "no analysis", "not available", "not applicable", "placeholder", "pending", "unknown", "undefined", "answer", "analysis", "response", "text", "your answer here", "answer here", "insert answer here", "insert text", "xxx", "x", "lorem ipsum", "keine antwort", "leer", "k a", "keine angabe", "entfällt", "sans réponse", "aucune réponse", "néant", "vide", "sin respuesta", "vacío", "ninguno", "n a"])
_STOP = {
    "en": "the a an of and to in is that for on with as by it this be are was were not at from which or but would should have has had his her their no can does because than other who what same any there how my our your you i we they",
    "de": "der die das und ist nicht ein eine einen einem einer für von mit den dem des zu im auf dass wird werden sich als auch nach bei aus über wenn keine kein sind hat wäre wer zeigt ich sie wir oder noch durch diesem diese dieser ob zum zur nur mich dazu es aber",
    "fr": "le la les un une des du de et est pas que qui pour dans sur au aux avec ce cette ne sont être il elle par plus son sa ses leur comme si ou où mais je nous vous d l n c qu s se ils elles rien doit celle peut",
    "es": "el la los las un una de y es que en por para con no del al se lo su sus como más pero este esta hay ser son fue si o cuando quien debe solo cual nada muy mi yo nos ha han puede esto",
    "it": "il lo la gli le di e che è per non una un del della con sono si da nel alla questo come più ma anche",
    "pt": "o a os as um uma de e que é em para com não do da dos das no na se por mais como ao à mas ser são seu sua",
    "nl": "de het een en van is niet dat in op te voor met zijn die er aan ook als bij door maar naar wordt of uit",
}
_MARKS = {"de": "äöüß", "es": "ñ¿¡", "fr": "çœêèëîïùûàâ"}
_CUES = r"""
\b(?:can(?:no|['’])t|can\s+not|could(?:n['’]t|\s+not)|won['’]t|will\s+not|unable|not\s+able|not\s+(?:be\s+)?(?:appropriate|comfortable|allowed|permitted|possible|in\s+a\s+position)|refuse|decline|must\s+(?:refuse|pass|skip)|have\s+to\s+(?:pass|decline|refuse|skip)|(?:would|['’]d)\s+(?:rather|prefer)\s+not|prefer\s+not|rather\s+not|going\s+to\s+(?:skip|leave|pass|decline)|not\s+going\s+to|will\s+skip|i['’]ll\s+(?:skip|pass)|not\s+touching|leave\s+this|unanswered|no\s+(?:opinion|comment|answer|position|view)|do(?:es)?\s+not\s+(?:answer|allow|comment|discuss|permit)|don['’]t\s+(?:answer|comment|discuss)|not\s+to\s+(?:discuss|answer|comment|respond|talk)|asked\s+not\s+to|against\s+my|my\s+(?:guidelines|policies|policy|rules|programming|instructions)|outside\s+(?:of\s+)?(?:what|my)|beyond\s+(?:what\s+i|my)|something\s+else|as\s+an?\s+(?:ai|artificial|(?:large\s+)?language\s+model|assistant|chatbot)|not\s+(?:answer|respond|comment|help|assist|comply|engage))\b
|\b(?:kann\s+(?:ich|dazu|dabei|hier)?\s*(?:\w+\s+){0,4}nicht|nicht\s+(?:helfen|beantworten|äußern|antworten|weiterhelfen|unterstützen|bearbeiten|möglich)|keine\s+(?:auskunft|antwort|aussage|stellung|meinung|angaben)|als\s+(?:ki|sprachmodell|assistent)\w*|(?:ablehnen|verweigern|verzichte|enthalten|passen))\b
|\b(?:ne\s+(?:peux|puis|souhaite|veux|suis)\s+(?:pas|point)|préfère\s+ne|impossible\s+d['’e]|refuse|décliner?|m['’]abst\w+|pas\s+(?:répondre|prononcer|commenter|en\s+mesure|aider|autorisé\w*)|en\s+tant\s+qu['’](?:ia|assistant|modèle)\w*|aucun\s+avis|modèle\s+de\s+langage|sans\s+réponse)
|\b(?:no\s+(?:puedo|quiero|debo|voy|me\s+es|estoy|deseo|soy)|prefiero\s+no|debo\s+(?:rechazar|abstenerme|declinar)|me\s+niego|rechaz\w+|declin\w+|me\s+abstengo|como\s+(?:ia|modelo|asistente)|modelo\s+de\s+lenguaje|no\s+(?:responder|opinar|comentar|contestar|ayudar)|imposible)\b
|(?:我(?:无法|不能|不便|不会|拒绝)|作为(?:一个)?(?:ai|人工智能|语言模型)|お答えできません|回答できません|お手伝いできません|لا\s+(?:أستطيع|يمكنني)|не\s+(?:могу|буду|готов|вправе)|отказ\w+|मैं\s+\S+\s+नहीं|ไม่สามารถ)
"""
_POLITE = r"\b(?:sorry|apolog\w+|hope\s+you|thank\s+you|thanks|patience|understand\w*|let\s+me\s+know|please|consult|lawyer|expert\w*|professional|best\s+left|qualified|sensitive|unfortunately|leid|leider|bitte|danke|verständnis|wenden|désolé\w*|merci|veuillez|compréhension|malheureusement|lo\s+siento|gracias|por\s+favor|lamento|disculp\w+|abogad\w+|comprensión|lamentablemente|expertos?|avocat|anwalt|anwältin)\b"
_FIRST = r"\b(?:i|i['’]\w+|me|my|mine|let['’]s|ich|mir|mich|mein\w*|je|j['’]\w+|m['’]\w+|moi|mon|mes|ma|yo|mi|mis|prefiero|debo|puedo|siento|lamento|tengo|soy|niego)\b|我|私|わたし|أنا|\bя\b|मैं|ฉัน|ผม"
_LEGAL = r"\b(?:rules?\s+quoted|justified|justif\w+|relevant|standard|legal\s+(?:reason|duty)|exception|treat\w*|depends|assessed|differen\w+|turns\s+on|mixes|equal|no\s+sign|because|purpose|beside\s+the\s+point|bedeutung|vorschrift|hinweis|unterschied|gleich|ausnahme|règlement|différence|pertinent|justifi\w+|examin\w+|reglamento|diferencia|relevante|excepción|estudiarse|indique|indica)\b"
#: Function words that a finished sentence does not end with.
_OPEN_END = frozenset("a an the of in on at by for from to with and or but that than as is are was were be which yet only where if when who not no into its their his her this der die das dem den des ein eine einen einem einer und oder aber dass in im am auf von vom zu zum zur für mit bei als ist sind wenn le la les un une du de d des au aux et ou mais que qui en dans par pour sur est sont el los las una del al y o con por para se es lo su sus".split())

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CUE, _POL, _ME, _LAW = (re.compile(x, re.I | re.X if x is _CUES else re.I) for x in (_CUES, _POLITE, _FIRST, _LEGAL))
_SENTENCE = re.compile(r"(?<=[.!?…。！？؟।])[\"”’»“)]*\s+|(?<=[。！？])|[\r\n]+")
_UNSEEN = re.compile("[­​-‏ -‮⁠-⁤﻿️᠎ᅟᅠㅤ]")
_LINE = re.compile(r"(?:^|(?<=\s)|(?<=[.!?。！？”\"»)]))[\W_]*c\W{0,2}o\W{0,2}n\W{0,2}c\W{0,2}l\W{0,2}u\W{0,2}s\W{0,2}i\W{0,2}o\W{0,2}n[\s*_]*[:：=\-–—>]*[\s*_\"“«(\[]*(?:yes|no)(?![^\W_])[\s*_.!\"”»)\]]*(?:$|(?=\n))", re.I)
#: What every match of _LINE holds, in small letters, and every match of _PART besides these signs.
_CORE = re.compile(r"c\W{0,2}o\W{0,2}n\W{0,2}c\W{0,2}l\W{0,2}u\W{0,2}[sſ]\W{0,2}[iı]\W{0,2}o\W{0,2}n")
_SIGNS = re.compile(r"[\s*_:：]+")
_PART = re.compile(r"(?:^|\n|(?<=[.!?。！？”\"»)]\s))[ \t*_]*(?:c|co|con|conc|concl|conclu|conclus|conclusi|conclusio|conclusion\s*[:：]?[\s*_]*(?:y|ye|n)?)\s*$", re.I)
_SCRIPTS = (("han", re.compile("[一-鿿㐀-䶿]")), ("kana", re.compile("[぀-ヿ]")), ("cyr", re.compile("[Ѐ-ӿ]")), ("arab", re.compile("[؀-ۿ]")), ("deva", re.compile("[ऀ-ॿ]")), ("thai", re.compile("[฀-๿]")), ("hang", re.compile("[가-힯]")), ("greek", re.compile("[Ͱ-Ͽ]")), ("hebr", re.compile("[֐-׿]")))
_STOP_SETS = {name: frozenset(text.split()) for name, text in _STOP.items()}
#: Every match of _CUES holds one of these whole words, or one of the stems; the order is that of _CUES.
_HINTS = frozenset(
    "can cannot could couldn won will unable able appropriate comfortable allowed permitted possible position refuse decline must pass skip rather prefer going touching leave unanswered opinion comment answer view allow discuss permit respond talk asked against my outside beyond else ai artificial model assistant chatbot help assist comply engage"
    " kann nicht keine als ablehnen verweigern verzichte enthalten passen peux puis souhaite veux suis préfère impossible tant aucun modèle sans"
    " puedo quiero debo voy me estoy deseo soy prefiero niego ia modelo asistente responder opinar comentar contestar ayudar imposible".split()
)
_STEMS = ("refuse", "abst", "prononcer", "commenter", "mesure", "aider", "rechaz", "declin")
_MARKED_STEMS = ("décline", "répondre", "autorisé", "我", "作为", "できません", "أستطيع", "يمكنني", "могу", "буду", "готов", "вправе", "отказ", "मैं", "ไม่สามารถ")
#: Signs in small letters that come of, or match, others where case is ignored.
_ODD = re.compile("[ſı\u0307\u1c80-\u1c88]")


def script(text: str) -> str:
    """The script of most letters: latin, or a name out of _SCRIPTS; kana beats Han."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else ""
    counts = {n: len(p.findall(text)) for n, p in _SCRIPTS}
    letters = sum(map(str.isalpha, text))
    if not letters:
        return ""
    if counts["kana"] > 0.1 * letters:
        return "kana"
    # signs of one script carry more than letters do in others
    weight = {n: c * (3 if n in ("han", "hang") else 1) for n, c in counts.items()}
    best = max(weight, key=weight.get)
    return best if weight[best] > letters - sum(c for n, c in counts.items()) else "latin"


def language(words: list[str]) -> tuple[str, float]:
    """Language by different function words, and its lead over the next; '' without any."""
    own = set(words)
    first = second = 0
    best = ""
    for name, stop in _STOP_SETS.items():
        n = len(own & stop)
        if n > first:
            best, first, second = name, n, first
        elif n > second:
            second = n
    return best, float(first - second)


def marked(text: str) -> str:
    """Language by letters that only it has among the marked ones; '' if none or several."""
    if text.isascii():
        return ""
    found = [x for x, cs in _MARKS.items() if any(c in text for c in cs)]
    return found[0] if len(found) == 1 else ""


def body_of(raw: str) -> tuple[str, bool]:
    """The answer without its conclusion line, and whether that line breaks off."""
    text = raw if raw.isascii() else _UNSEEN.sub("", raw)
    low = text.lower()
    core = _CORE.search(low)
    whole = text
    if core:
        at = core.start() if len(low) == len(text) else 0
        while at and not text[at - 1].isalnum():
            at -= 1
        at = max(0, at - 1)  # the sign before counts too
        whole = text[:at] + _LINE.sub("\n", text[at:])
    part = False
    last = max(whole.rfind("c"), whole.rfind("C"))
    if last >= 0 and (len(whole) - last <= 16 or len(_SIGNS.sub("", whole[last:])) <= 9):
        rest = _PART.sub("", whole)
        part = rest != whole
        whole = rest
    return whole.strip(), part


def may_refuse(low: str, words: list[str]) -> bool:
    """Whether _CUES can match a text, given in small letters and as its words."""
    if not _HINTS.isdisjoint(words) or any(x in low for x in _STEMS):
        return True
    return not low.isascii() and (any(x in low for x in _MARKED_STEMS) or bool(_ODD.search(low)))


def votes(prompt: str | None, raw: str | None, broken: Broken | None = None, at: float = 0.0) -> bytes:
    """All votes on a pair, each as the byte vote + 1; ``broken`` also counts those on the pair broken on purpose, ``at`` saying how."""
    if raw is None:
        return bytes([2, 2, 2, 2] + [0, 1, 1, 1] * 4)
    body, part = body_of(raw)
    low = body.lower()
    words = _WORD.findall(low)
    # empty
    bare = " ".join(words)
    place = bare in PLACEHOLDERS
    given = _WORD.findall((prompt if prompt.isascii() else _UNSEEN.sub("", prompt)).lower()) if prompt else []
    e = [1 if not words else 0 if place else -1, 1 if place or not words else 0, 1 if not raw.strip() else 0, 1 if len(words) == 0 else -1 if len(words) > 3 else 1 if place else 0]
    if not words or place:
        if broken is not None and words and given:
            broken.add_prompt(prompt, given, (script(prompt), *language(_LETTERS.findall(prompt.lower()))), at)
        cut_line = part and not words
        return _bytes(e if not cut_line else [-1, 0, 0, -1], [-1, 0, 0, 0], [-1, 0, 0, 0], [-1, 0, 0, 0], [1, 1, 1, 0] if cut_line else [-1, 0, 0, 0])
    # copy
    c = _copy_votes(given, words)
    # refusal
    r = [-1, -1, -1, -1]
    parts = [s for s in _SENTENCE.split(body) if s and _WORD.search(s)]
    cue = [bool(_CUE.search(s)) for s in parts] if may_refuse(low, words) else []
    if any(cue):
        soft = [k or bool(_POL.search(s)) for k, s in zip(cue, parts)]
        hard = sum(1 for k, s in zip(soft, parts) if not k and not _ME.search(s))
        legal = sum(bool(_LAW.search(s)) for s in parts)
        first = any(k and _ME.search(s) for k, s in zip(cue, parts))
        r = [1 if hard == 0 and soft[0] else 0 if hard <= 1 and cue[0] else -1, 1 if first or cue[0] and len(parts) == 1 else -1, 1 if not legal else 0 if legal < len(parts) and cue[0] and len(parts) <= 2 and hard == 0 and not _LAW.search(parts[0]) else -1, 1 if len(words) <= 25 and hard == 0 else 0 if len(words) <= 45 else -1]
    elif len(parts) <= 2 and all(_POL.search(s) or _ME.search(s) for s in parts) and not _LAW.search(body):
        r = [0, 1, 1, 0 if len(words) <= LONG_REFUSAL else -1]
    # other language
    o = [0, 0, 0, 0]
    if given:
        sp, sb = script(prompt), script(body)
        if broken is not None or sp == sb == "latin":
            lp, mp = language(_LETTERS.findall(prompt.lower()))
            lb, mb = language(words)
        if broken is not None:
            broken.add_prompt(prompt, given, (sp, lp, mp), at)
            broken.add_answer(body, parts, (sb, lb, mb), at)
        if sp and sb and sp != sb:
            o = [1, 1, 1, 0]
        elif sp == sb == "latin":
            o[0] = -1 if lp == lb else 0
            if lp and lb:
                o[1] = -1 if lp == lb else 1 if mp >= 1 and mb >= 2 else 0
            kb = marked(body.lower())
            if kb and lp:
                o[2] = -1 if kb == lp else 1 if lb != lp else 0
            if lp and lb and lp != lb and mb >= 2:
                same = sum(language(_WORD.findall(s.lower()))[0] == lp for s in _SENTENCE.split(body) if s.strip())
                o[3] = 1 if same == 0 else -1 if same > 1 else 0
            elif lp and lb == lp:
                o[3] = -1
        else:
            o = [-1, 0, 0, 0]
    # truncated
    t = _end_votes(body, words, part)
    return _bytes(e, c, r, o, t)


def _copy_votes(given: list[str], words: list[str]) -> list[int]:
    c = [-1, -1, -1, 0]
    if given:
        times = max(1, round(len(words) / len(given)))
        near = abs(len(words) - times * len(given)) <= max(2, 0.2 * times * len(given))
        if near:
            want, have = Counter(given), Counter(words)
            both = sum(min(n * times, have[w]) for w, n in want.items())
            share = both / max(len(words), times * len(given))
            pairs = set(zip(given, given[1:]))
            kept = sum(p in pairs for p in zip(words, words[1:])) / max(1, len(words) - 1)
            joined, flat = "".join(given), "".join(words)
            c = [1 if share >= 0.8 else 0 if share > 0.6 else -1, 1 if kept >= 0.7 else 0 if kept > 0.4 else -1, 1 if share >= 0.7 and near else 0, 1 if flat == joined * times or joined in flat or (given[:3] == words[:3] and given[-2:] == words[-2:]) else 0]
            if share < 0.75 and len(joined) > 20 and _alike(joined, flat, times):
                c = [1, 1, 1, 0]
    return c


def _end_votes(body: str, words: list[str], part: bool) -> list[int]:
    tail = body.rstrip("\"”’»›」』)]*_ \t\r\n")
    if tail and body[len(tail) : len(tail) + 1] != "“" and tail.endswith("“"):
        tail = tail[:-1].rstrip("\"”’»") if len(tail) > 1 and not tail[-2].isspace() else tail
    last = tail[-1:]
    done = bool(last) and last in ".!?。！？؟।…"
    dots = tail.endswith("…") or tail.endswith("...")
    open_marks = sum(body.count(x) for x in "“„«「(") - sum(body.count(x) for x in "”»」)") - (body.count("“") if "„" in body else 0)
    unclosed = open_marks > 0 and ("“" not in body or "„" not in body or body.count("„") > body.count("“"))
    thai = bool(words) and script(words[-1]) == "thai"
    ends = done and not dots
    return [
        1 if part else 0 if ends else 1 if not done else 0,
        -1 if (ends or thai) and not part else 1,
        1 if unclosed or part else 0,
        1 if part or (not done and (words[-1] in _OPEN_END or last in ",;:(–—-“„«/")) else -1 if ends or thai else 1 if dots else 0,
    ]


def _alike(a: str, b: str, times: int) -> bool:
    """Whether letters of b repeat those of a, by shared runs of five letters."""
    grams = {a[i : i + 5] for i in range(len(a) - 4)}
    own = [b[i : i + 5] for i in range(len(b) - 4)]
    return bool(own) and len(grams.intersection(own)) >= 0.75 * len(grams) and sum(g in grams for g in own) >= 0.75 * len(own)


def _bytes(*groups: list[int]) -> bytes:
    return bytes(v + 1 for g in groups for v in g)


#: Plain refusals.
REFUSALS = ("I cannot answer this question.", "I must decline to discuss this. I hope you understand.\nConclusion: NO", "Dazu kann ich mich nicht äußern.", "Je ne peux pas répondre à cette question.", "Prefiero no opinar sobre esto.")
#: Answers that are empty.
EMPTIES = ("", "  \n", "N/A", "...", "Conclusion: NO")
#: Words of a prompt from which all functions vote for a copy if the answer is the prompt as _copied gives it back.
SURE_COPY = 4
#: Refusals that validate the cutoffs; written apart from _CUES, so that some of them have none of its words.
UNSEEN_REFUSALS = (
    "That is a topic I stay out of.", "Sorry, this one is off limits for me.", "I do not think I should weigh in here.", "I won't take sides on this. Please ask a lawyer.",
    "Das überlasse ich lieber anderen.", "Dazu möchte ich nichts sagen.", "Tut mir leid, aber hier halte ich mich heraus.",
    "Je laisse cette question à d'autres.", "Désolé, je ne dirai rien là-dessus.", "Je ne souhaite pas me prononcer.",
    "Esto se lo dejo a otros.", "Lo siento, no voy a entrar en ese tema.", "Prefiero callar sobre este asunto.",
)


# ---- label model ----


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.02, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Prior and trust [class, function] by expectation maximization.

    Trust is the chance that a function's vote, if it votes, is right. No
    opinion says nothing about the class. Starts from functions that are right
    in most cases; pseudo counts keep a defect that hardly occurs from turning a
    function round.
    """
    k = patterns.shape[1]
    trust = np.full((2, k), 0.9)
    pseudo = np.array([50.0, 5.0])[:, None]
    total = counts.sum()
    for _ in range(rounds):
        p = posterior(patterns, prior, trust)
        for cls, each, right in ((0, (1 - p) * counts, 0), (1, p * counts, 2)):
            hit = (each[:, None] * (patterns == right)).sum(axis=0)
            spoke = (each[:, None] * (patterns != 1)).sum(axis=0)
            trust[cls] = (hit + 0.9 * pseudo[cls]) / (spoke + pseudo[cls])
        new = ((p * counts).sum() + 1.0) / (total + 50.0) if total else prior
        if abs(new - prior) < 1e-9:
            break
        prior = float(new)
    return prior, trust


def posterior(patterns: np.ndarray, prior: float, trust: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Chance of the defect for each pattern; ``weight`` is what a vote of each function counts, 1 at most."""
    logs = []
    for cls, base, right in ((0, 1 - prior, 0), (1, prior, 2)):
        t = np.clip(trust[cls], 1e-4, 1 - 1e-4)
        each = np.where(patterns == 1, 0.0, np.where(patterns == right, np.log(t), np.log(1 - t)))
        logs.append(np.log(base) + (each if weight is None else each * weight).sum(axis=1))
    return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def independence(patterns: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What a vote of each function counts: 1 over the number of functions that vote with it for no other reason.

    Taken within the pairs with and without the defect, as given by the
    posteriors ``p``, over all pairs: functions that repeat each other share one
    vote, functions that err apart keep theirs whole.
    """
    k = patterns.shape[1]
    shared = np.zeros((k, k))
    votes_ = patterns.astype(float) - 1
    for w in (p * counts, (1 - p) * counts):
        if w.sum() <= 0:
            continue
        centred = votes_ - np.average(votes_, axis=0, weights=w)
        cov = (centred * w[:, None]).T @ centred / w.sum()
        sd = np.sqrt(np.diag(cov))
        corr = np.divide(cov, np.outer(sd, sd), out=np.eye(k), where=np.outer(sd, sd) > 1e-9)
        shared = np.maximum(shared, np.clip(corr, 0, 1) ** 2)
    np.fill_diagonal(shared, 1.0)
    return 1.0 / shared.sum(axis=0)


def _parts(pattern: bytes) -> list[bytes]:
    out, at = [], 0
    for n in VOTES:
        out.append(pattern[at : at + n])
        at += n
    return out


def break_pair(defect: str, prompt: str, raw: str, other: str, at: float, refusals: tuple[str, ...] = REFUSALS) -> tuple[str, str]:
    """The pair with one defect put in, to validate cutoffs; ``other``: an answer in another language."""
    if defect == "empty":
        return prompt, EMPTIES[int(at * len(EMPTIES))]
    if defect == "copy":
        return prompt, _copied(prompt, at)
    if defect == "refusal":
        return prompt, refusals[int(at * len(refusals))]
    if defect == "other_language":
        return prompt, other
    return prompt, _shortened(body_of(raw)[0], at)


def _copied(prompt: str, at: float) -> str:
    return (prompt, f"{prompt}\n{prompt}", f"Prompt:\n{prompt}\nConclusion: YES")[int(at * 3)]


def _shortened(body: str, at: float) -> str:
    stop = min(len(body), max(2, int(len(body) * (0.3 + 0.6 * at))))
    while stop > 1 and not body[stop - 1].isalnum():
        stop -= 1
    return body[:stop] + ("\nConclusion: YES" if at > 0.5 else "")


def _last_words(text: str) -> list[str]:
    """The words of a text; of one with more words than placeholders have, those behind its last blank are enough for _end_votes."""
    at = text.rfind(" ")
    if at > 0 and len(text) > 60 and len(list(islice(_WORD.finditer(text), 4))) == 4:
        words = _WORD.findall(text[at:].lower())
        if words and " ".join(words) not in PLACEHOLDERS:
            return words
    return _WORD.findall(text.lower())


class Broken:
    """Counts of the votes on pairs broken on purpose, a defect's own votes each, over any number of pairs.

    Only what a vote depends on is computed: texts that replace the answer are
    judged once, and for another language every prompt meets every answer whose
    language differs, as counts of what the votes see of either.
    """

    def __init__(self):
        self.counts: dict[str, Counter] = {name: Counter() for name in (*DEFECTS, "prompt", "answer")}

    def add_prompt(self, prompt: str, given: list[str], side: tuple[str, str, float], at: float) -> None:
        self.counts["empty"][_of_text("empty", EMPTIES[int(at * len(EMPTIES))])] += 1
        self.counts["refusal"][_of_text("refusal", UNSEEN_REFUSALS[int(at * len(UNSEEN_REFUSALS))])] += 1
        text = _copied(prompt, at)
        whole = text if int(at * 3) < 2 else f"Prompt:\n{prompt}"
        if len(given) >= SURE_COPY and body_of(text)[0] == whole.strip():
            self.counts["copy"][b"\2\2\2\2"] += 1
        else:
            self.counts["copy"][_parts(votes(prompt, text))[1]] += 1
        if side[1]:
            self.counts["prompt"][side[0], side[1], side[2] >= 1] += 1

    def add_answer(self, body: str, parts: list[str], side: tuple[str, str, float], at: float) -> None:
        if len(body.split()) >= 4:
            text, part = body_of(_shortened(body, at))
            words = _last_words(text)
            if not words or " ".join(words) in PLACEHOLDERS:
                own = [1, 1, 1, 0] if part and not words else [-1, 0, 0, 0]
            else:
                own = _end_votes(text, words, part)
            self.counts["truncated"][_bytes(own)] += 1
        if side[1]:
            several: Counter = Counter(language(_WORD.findall(s.lower()))[0] for s in parts) if side[2] >= 2 else Counter()
            self.counts["answer"][side[0], side[1], side[2] >= 2, marked(body.lower()), tuple(sorted((x, min(2, n)) for x, n in several.items() if x))] += 1

    def rows(self) -> list[tuple[str, bytes, int]]:
        """(kind, what was counted, count), to be added up over partitions."""
        return [(kind, x if isinstance(x, bytes) else json.dumps(x).encode(), n) for kind, c in self.counts.items() for x, n in c.items()]

    @classmethod
    def of_rows(cls, rows: list[tuple[str, bytes, int]]) -> Broken:
        out = cls()
        for kind, x, n in rows:
            out.counts[kind][tuple(tuple(map(tuple, v)) if isinstance(v, list) else v for v in json.loads(x)) if kind in ("prompt", "answer") else x] += n
        return out

    def of(self, defect: str) -> Counter:
        """Votes of the functions of a defect on the pairs that have it put in."""
        if defect != "other_language":
            return self.counts[defect]
        out: Counter = Counter()
        for (sp, lp, led), n in self.counts["prompt"].items():
            for (sb, lb, clear, kb, several), m in self.counts["answer"].items():
                if lp == lb:
                    continue
                if sp and sb and sp != sb:
                    o = [1, 1, 1, 0]
                elif sp == sb == "latin":
                    same = dict(several).get(lp, 0)
                    o = [0, 1 if led and clear else 0, 0 if not kb else -1 if kb == lp else 1, 0 if not clear else 1 if same == 0 else -1 if same > 1 else 0]
                else:
                    o = [-1, 0, 0, 0]
                out[_bytes(o)] += n * m
        return out


@cache
def _of_text(defect: str, text: str) -> bytes:
    """The defect's votes on a text that they judge without its prompt."""
    return _parts(votes("", text))[DEFECTS.index(defect)]


class LabelModel:
    """Posterior of each defect for each vote pattern, with validated cutoffs."""

    def __init__(self, counts: dict[bytes, int], pairs: Iterable[tuple[str, str]] | Broken):
        """``counts`` of vote patterns; ``pairs``: those that are broken to validate the cutoffs, or what was counted of them."""
        if not isinstance(pairs, Broken):
            broken = Broken()
            for i, (p, r) in enumerate(pairs):
                votes(p, r, broken, (i * 0.618034) % 1.0)
            pairs = broken
        self.models = []
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(len(DEFECTS)):
            own: Counter = Counter()
            for p, n in counts.items():
                own[_parts(p)[d]] += n
            keys = sorted(own)
            arr = np.array([list(k) for k in keys], dtype=int).reshape(-1, VOTES[d])
            n = np.array([own[k] for k in keys], dtype=float)
            first = fit(arr, n)
            weight = independence(arr, n, posterior(arr, *first)) if len(arr) else np.ones(VOTES[d])
            model = (*first, weight)
            self.models.append(model)
            self.seen.append((posterior(arr, *model), n))
        self.missed: dict[str, float] = {}
        self.cutoffs = self._validated(pairs)

    def posteriors(self, pattern: bytes) -> list[float]:
        return [float(posterior(np.array([list(v)]), *m)[0]) for v, m in zip(_parts(pattern), self.models)]

    def _validated(self, broken: Broken) -> list[float]:
        """The cutoff with the best F1; ``missed`` keeps the part of broken pairs below it.

        Precision is that of what the cutoff flags among all pairs, by their
        posteriors; recall is that on the pairs broken on purpose, or, where
        there are none, by the posteriors too.
        """
        out = []
        for d, name in enumerate(DEFECTS):
            own = broken.of(name)
            bad = np.array(list(own.values()), dtype=float)
            chance = posterior(np.array([list(v) for v in own], dtype=int).reshape(-1, VOTES[d]), *self.models[d])
            post, n = self.seen[d]
            best, at = -1.0, CUTOFFS[0]
            for c in CUTOFFS:
                over = post > c
                flagged, right = n[over].sum(), (n * post)[over].sum()
                recall = bad[chance > c].sum() / bad.sum() if len(bad) else right / max(1e-9, (n * post).sum())
                precision = right / flagged if flagged else 1.0
                f1 = 2 * precision * recall / max(1e-9, precision + recall)
                if f1 > best + 1e-3:
                    best, at = f1, c
            out.append(at)
            self.missed[name] = float(bad[chance <= at].sum() / bad.sum()) if len(bad) else 0.0
        return out

    def labels(self, pattern: bytes) -> list[str]:
        return [n for n, p, c in zip(DEFECTS, self.posteriors(pattern), self.cutoffs) if p > c]


# ---- operators ----

_VOTES_SCHEMA = "delivery_id bigint, pattern binary, kind string, n bigint"


def _vote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a pair, without kind; then what the partition counted of all its pairs broken on purpose."""
    broken = Broken()
    for b in batches:
        at = [xxhash.xxh32_intdigest(str(0 if i != i else int(i))) / 2**32 for i in b["delivery_id"]]
        yield pd.DataFrame({"delivery_id": b["delivery_id"], "pattern": [votes(p, r, broken, k) for p, r, k in zip(b["prompt"], b["raw_text"], at)], "kind": None, "n": 1})
    rows = broken.rows()
    yield pd.DataFrame({"delivery_id": pd.array([None] * len(rows), dtype="Int64"), "pattern": [x for _, x, _ in rows], "kind": [k for k, _, _ in rows], "n": [n for _, _, n in rows]})


def labelled_pairs(predictions: DataFrame) -> DataFrame:
    """``delivery_id``, ``labels`` (all kept, in order), ``defect`` (first, or null) and ``posteriors``.

    Each delivered row stands for itself. A null answer is empty; a null or blank
    prompt has neither copy nor other_language. Very long answers are read
    whole. The label model is fitted on the counts of all vote patterns, whose
    number does not grow with the rows, and so are the cutoffs: every pair with
    words on both sides is broken where it is read, and only counts are kept. An empty table gives an empty result.
    """
    spark = predictions.sparkSession
    rows = predictions.select("delivery_id", "prompt", "raw_text")
    voted = cut(spread(rows).mapInPandas(_vote_rows, _VOTES_SCHEMA))
    tallies = voted.groupBy("kind", "pattern").agg(F.sum("n")).collect()
    counts = {bytes(r[1]): r[2] for r in tallies if r[0] is None}
    model = LabelModel(counts, Broken.of_rows([(r[0], bytes(r[1]), r[2]) for r in tallies if r[0] is not None]))
    known = [(bytearray(p), (labels := model.labels(p)), labels[0] if labels else None, model.posteriors(p)) for p in counts]
    table = spark.createDataFrame(known, "pattern binary, labels array<string>, defect string, posteriors array<double>")
    return voted.where("kind is null").join(F.broadcast(table), "pattern", "left").select("delivery_id", "labels", "defect", "posteriors")


def _sums(pattern: bytes) -> list[int]:
    return [sum(v) - len(v) for v in _parts(pattern)]


def defective_pairs(predictions: DataFrame) -> DataFrame:
    """``delivery_id`` and ``defect`` of every defective pair."""
    return labelled_pairs(predictions).where("defect is not null").select("delivery_id", "defect")


def defect_rates(predictions: DataFrame) -> DataFrame:
    """Pairs per defect, with how many carry each label beside the one chosen."""
    done = labelled_pairs(predictions)
    first = done.groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("n_pairs"))
    some = done.select(F.explode("labels").alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("n_labels"))
    return first.join(some, "defect", "left").select("defect", "n_pairs", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))
