"""Abusive, hateful or sexual content: a convolutional classifier in numpy.

Sentences become hashed words; their embeddings go through filters of several
widths, each filter keeps its maximum over the sentence, and a logistic layer
joins them. A text scores as its worst sentence. Training uses the seed
sentences and a bounded sample of reviewed documents; the threshold of each
language is calibrated on all reviewed documents that are held out, scored whole
where they lie. A trained model is kept in the shared folder under a hash of what
it was trained on, and used again.

Scoring is cheap, since a filter of width w over words is a sum of w table rows:
the products of all embeddings and filters are made once after training.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.cluster import broadcast_if_small, checkpoint_dir, cut, spread
from pairlight.llm import seeds
from pairlight.llm.defects import language, script

# ---- parameters ----

#: Reviewed documents used for fitting, at most.
MAX_REVIEWED = 20_000
#: Sentences of one reviewed document used for fitting, at most, chosen by hash over the whole text; scoring reads all.
MAX_SENTENCES = 200
#: Words, or characters without a blank, in which a longer sentence is divided for fitting.
RUN_WORDS, RUN_CHARS = 64, 400
#: Tokens of a training batch, padding included.
BATCH_TOKENS = 10_240
#: Clean sentences of reviewed documents used for fitting, at most.
MAX_CLEAN = 24_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 20, 16, (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 12, 128, 0.1
#: Part of the epochs after which the states of the network are averaged.
AVERAGED_FROM = 0.6
#: Networks trained apart, whose logits are averaged: what one takes for abuse by chance the other rarely does.
NETWORKS = 2
#: One reviewed document in so many is held out for the thresholds.
HELD_OUT = 4
#: A trigram points to abuse if it is so many times as frequent in abusive documents.
LIFT = 4.0
#: Weight of sentences in which words are made unknown.
BLURRED = 0.4
#: Thresholds that are tried.
GRID = (0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8)
#: Threshold without reviews; above one half, as texts of fields without reviews score a little higher.
PRIOR_THRESHOLD = 0.6
#: Reviewed abusive documents of a language from which its own threshold counts fully.
ENOUGH = 30

# ---- fixed values ----

#: Letters that look like Latin ones.
_LOOKS = {ord(a): b for a, b in zip("аеорсухіјѕԁһկոցυνοαρικτηΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhknguvoapikthABEZHIKMNOPTYXABEKMHOPCTYXIJS")}
#: Digits and signs that stand for letters.
_LEET = {ord(a): b for a, b in zip("013457@$€", "oieastase")}

_UNSEEN = re.compile("[­​-‏‪-‮⁠-⁤﻿️᠎͏ᅟᅠㅤﾠ]")
_SPLIT = re.compile(r"\s(?:(?<=[\w)\]%\"”’»]\.\s)(?<!\b[A-Z]\.\s)(?<!\b(?:Mr|Ms|Dr|St|Sr)\.\s)(?<!\bMrs\.\s)|(?<=[!?…]\s)|(?<=\w\.[\"”’»“)]\s)|(?<=[!?…][\"”’»“)]\s))\s*(?![\"“„«(]*[a-z])|\n\s*\n\s*|(?<=[。！？।؟])|(?<=[A-Z][A-Z]\n)")
_ANY = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿]|[^\W_฀-๿぀-ヿ㐀-䶿一-鿿]+(?:[*@$€'’][^\W_]+|\*+[^\W_]*)*|[*$@€]+[^\W_]+|[“”„«»\"]|!")
_ODD = re.compile(r"[*@$€]|[A-Za-zÀ-ɏ]\d|\d[A-Za-zÀ-ɏ]|(.)\1\1|(?<!\w)\w(?:[ \-._]\w){3,}(?!\w)")
_APART = re.compile(r"(?<!\w)\w(?:([ \-._])\w)(?:\1\w){2,}(?!\w)")
_RUN = re.compile(r"(\w)\1{2,}")
_STARS = re.compile(r"[^\W\d_]\*+[^\W\d_]?$")
_LATIN = re.compile(r"[a-zA-ZÀ-ɏ]")
_OTHER = re.compile(r"[Ͱ-֏]")
_UNKNOWN = "zq9zq"  # no word, for it holds a digit
_QUOTES = frozenset("“”„«»\"")
CAP, UNK, NUM, STARS, QUOTE, BANG, JOIN = range(1, 8)
SPECIAL = 8


def fold(word: str) -> str:
    """Lower case without accents, look-alikes as Latin letters where Latin ones stand beside them."""
    if word.isascii():
        return word.lower()
    word = word.replace("’", "'")
    if _OTHER.search(word) and _LATIN.search(word):
        word = word.translate(_LOOKS)
    w = unicodedata.normalize("NFKD", word)
    return "".join(c for c in w if not unicodedata.combining(c)).casefold()


def readings(word: str) -> list[str]:
    """The plain word first, then what it may stand for."""
    out = [word]
    runs = _RUN.sub(r"\1", word)
    if runs != word:
        out += [runs, _RUN.sub(r"\1\1", word)]
    if any(not c.isalpha() for c in word):
        for x in list(out):
            out.append(x.translate(_LEET).replace("*", ""))
            out.append(x.replace("1", "l").translate(_LEET).replace("*", ""))
    return out


class Vocabulary:
    """Known words; every token becomes a bucket, or one of the special ids."""

    def __init__(self, known: set[str]):
        self.known = known
        self.kept: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        return SPECIAL + xxhash.xxh32_intdigest(word) % (BUCKETS - SPECIAL)

    def id(self, token: str) -> int:
        i = self.kept.get(token)
        if i is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            i = self.kept[token] = self._id(token)
        return i

    def _id(self, token: str) -> int:
        if token in _QUOTES:
            return QUOTE
        if token == "!":
            return BANG
        if token.isdigit():
            return NUM
        if _STARS.match(token):
            return STARS
        w = fold(token)
        for x in readings(w):
            if x in self.known:
                return self.bucket(x)
        for part in re.split(r"['’]", w):
            if part in self.known and len(part) > 2:
                return self.bucket(part)
        return CAP if token[:1].isupper() else UNK

    def ids(self, sentence: str) -> list[int]:
        return [self.id(t) for t in tokens(sentence, self.known)]


def tokens(sentence: str, known: set[str] | None = None) -> list[str]:
    """Tokens of a sentence, with letters that stand apart joined; one in capitals only is read in small letters, since its words are no names."""
    if sentence.isupper():
        sentence = sentence.lower()
    if not sentence.isascii():
        sentence = _UNSEEN.sub("", sentence)
        if not sentence:
            return []
        if any(c > "＀" or "℀" <= c < "←" for c in sentence) or "\U0001d400" <= max(sentence) < "\U0001d800":
            sentence = unicodedata.normalize("NFKC", sentence)
    if _ODD.search(sentence):
        sentence = _APART.sub(lambda m: _joined(m, known), sentence)
    return _TOKEN.findall(sentence)


def _joined(m: re.Match, known: set[str] | None) -> str:
    letters = m.group(0).replace(m.group(1), "")
    if known is not None and fold(letters) not in known and fold(letters[1:]) in known:
        return f"{letters[0]} {letters[1:]}"
    return letters


def chunks(text: str) -> list[str]:
    """The sentences of a text, roughly; a single line break does not divide."""
    return [s for s in _SPLIT.split(text) if s and _ANY.search(s)]


def runs(sentence: str) -> list[str]:
    """A sentence in runs of at most RUN_WORDS words and RUN_CHARS signs without a blank, for fitting."""
    words = sentence.split()
    if len(words) <= RUN_WORDS and len(sentence) <= 8 * RUN_CHARS:
        return [sentence]
    words = [w[i : i + RUN_CHARS] for w in words for i in range(0, len(w), RUN_CHARS)]
    return [" ".join(words[i : i + RUN_WORDS]) for i in range(0, len(words), RUN_WORDS)]


def fitting_parts(text: str) -> list[str]:
    """What fitting reads of a text: all its sentences, or MAX_SENTENCES of them chosen by hash, in order."""
    parts = [r for s in chunks(text) for r in runs(s)]
    if len(parts) <= MAX_SENTENCES:
        return parts
    chosen = sorted(sorted(range(len(parts)), key=lambda i: (xxhash.xxh64_intdigest(parts[i]), i))[:MAX_SENTENCES])
    return [parts[i] for i in chosen]


# ---- model ----


@dataclass
class Model:
    vocabulary: Vocabulary
    rows: np.ndarray  # bucket to row of the tables
    tables: list[np.ndarray]  # one a width: (rows, width * filters)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    abusive: list[str] = field(default_factory=list)  # the sentences that reviews pointed to

    def score(self, sentences: list[str]) -> np.ndarray:
        """Probability of each sentence; all filters over all sentences at once."""
        if not sentences:
            return np.zeros(0, dtype=np.float32)
        pad = [0] * (max(WIDTHS) - 1)
        flat: list[int] = []
        starts = np.empty(len(sentences), dtype=np.int64)
        ends = np.empty(len(sentences), dtype=np.int64)
        ids = self.vocabulary.ids
        for k, s in enumerate(sentences):
            starts[k] = len(flat)
            flat += ids(s) or [0]
            ends[k] = len(flat)
            flat += pad
        padding = (ends[:, None] + np.arange(len(pad))).ravel()
        rows = self.rows[np.array(flat + pad, dtype=np.int64)]
        n = len(flat)
        logit = np.full(len(sentences), self.bias, dtype=np.float32)
        filters = len(self.biases[0])
        for w, table, b, o in zip(WIDTHS, self.tables, self.biases, self.out.reshape(len(WIDTHS), filters)):
            near = table[rows]
            total = near[:n, :filters].copy()
            for k in range(1, w):
                total += near[k : n + k, k * filters : (k + 1) * filters]
            total[padding] = -1e9  # no window begins behind its sentence
            logit += np.maximum(np.maximum.reduceat(total, starts, axis=0) + b, 0) @ o
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def threshold(self, text: str) -> float:
        return self.thresholds.get(text_language(text), self.thresholds[""])

    def score_texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Score of each text (its worst sentence) and that sentence; 0 and '' for null and blank.

        A sentence that several of the texts hold is scored once.
        """
        seen: dict[str, int] = {}
        parts: list[list[int]] = []
        for t in texts:
            parts.append([seen.setdefault(s, len(seen)) for s in chunks(t)] if t else [])
        sentences = list(seen)
        scores = np.concatenate([self.score(sentences[i : i + 4000]) for i in range(0, len(sentences), 4000)] or [np.zeros(0, np.float32)])
        out, worst = np.zeros(len(texts)), []
        for k, p in enumerate(parts):
            best = max(p, key=scores.__getitem__) if p else -1
            worst.append(sentences[best] if p else "")
            out[k] = scores[best] if p else 0.0
        return out, worst


def joined(models: list[Model]) -> Model:
    """One network whose logit is the mean of those of several trained on the same examples: their filters side by side."""
    n, first = len(models), models[0]
    tables = [np.concatenate([m.tables[i][:, k * FILTERS : (k + 1) * FILTERS] for k in range(w) for m in models], axis=1) for i, w in enumerate(WIDTHS)]
    biases = [np.concatenate([m.biases[i] for m in models]) for i in range(len(WIDTHS))]
    out = np.concatenate([m.out.reshape(len(WIDTHS), FILTERS) for m in models], axis=1).ravel() / np.float32(n)
    return Model(first.vocabulary, first.rows, tables, biases, out, sum(m.bias for m in models) / n)


def text_language(text: str) -> str:
    """Script, or for Latin letters the language by function words, of the whole text; '' if unknown."""
    s = script(text)
    return language(re.findall(r"[^\W\d_]+", text.lower()))[0] if s == "latin" else s


def train(examples: list[tuple[str, float, float]], seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Fits the network on (sentence, label, weight). Words seen once in one sentence stay unknown."""
    rng = np.random.default_rng(seed)
    split = [tokens(s) for s, _, _ in examples]
    often = Counter(w for t in split for w in {fold(x) for x in t if x[0].isalpha()})
    capital = Counter(fold(x) for t in split for k, x in enumerate(t) if k and x[0].isupper())
    plain = Counter(fold(x) for t in split for x in t if x[0].islower())
    # a word that is always written large and is rare is a name
    known = {w for w, n in often.items() if n >= 2 and (plain[w] or n >= 40 or capital[w] == 0) and not any(c.isdigit() or c == "*" for c in w)}
    vocabulary = Vocabulary(known)
    ids = [np.array([vocabulary.id(t) for t in ts] or [0]) for ts in split]
    used = np.unique(np.concatenate([*ids, np.arange(SPECIAL)]))
    rows = np.zeros(BUCKETS, dtype=np.int32)
    rows[used] = np.arange(len(used))  # 0 is the padding
    ids = [rows[x] for x in ids]
    y = np.array([l for _, l, _ in examples], dtype=np.float32)
    weight = np.array([w for _, _, w in examples], dtype=np.float32)
    emb = rng.normal(0, 0.3, (len(used), DIM)).astype(np.float32)
    emb[0] = 0
    conv = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    last = np.float32(-1.0)
    state = [np.full_like(x, 0.1) for x in (emb, *conv, *bias, out)]
    s_last = np.float32(0.1)
    kept = [np.zeros_like(x, dtype=np.float64) for x in (emb, *conv, *bias, out)]
    n_kept, last_kept = 0, 0.0
    longest = np.array([len(x) for x in ids])
    widest = max(WIDTHS)
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(ids))
        order = order[np.argsort(longest[order] // 8, kind="stable")]
        batches, begin = [], 0
        while begin < len(order):  # by length, so the last of a batch tells its size but for a few tokens
            size = BATCH
            while size > 1 and longest[order[begin : begin + size]].max() * size > BATCH_TOKENS:
                size //= 2
            batches.append(order[begin : begin + size])
            begin += size
        for k in rng.permutation(len(batches)):
            b = batches[k]
            length = int(longest[b].max()) + widest - 1
            x = np.zeros((len(b), length), dtype=np.int64)
            for i, j in enumerate(b):
                x[i, : len(ids[j])] = ids[j]
            e = emb[x]
            keep = (rng.random((len(b), length, 1)) > 0.1).astype(np.float32)
            e = e * keep  # word dropout
            steps = length - widest + 1
            outside = np.where(np.arange(steps)[None, :] < longest[b][:, None], np.float32(0), np.float32(-1e9))[:, :, None]
            feats, args, wins = [], [], []
            for w, c, bb in zip(WIDTHS, conv, bias):
                win = np.concatenate([e[:, k2 : k2 + steps] for k2 in range(w)], axis=2)
                h = win @ c + outside
                a = h.argmax(axis=1)
                feats.append(np.take_along_axis(h, a[:, None, :], axis=1)[:, 0] + bb)
                args.append(a)
                wins.append(win)
            raw = np.concatenate(feats, axis=1)
            drop = (rng.random(raw.shape) > 0.3).astype(np.float32) / 0.7
            act = np.maximum(raw, 0) * drop
            p = 1 / (1 + np.exp(-np.clip(act @ out + last, -30, 30)))
            g = (p - y[b]) * weight[b] / len(b)
            g_out = act.T @ g + 1e-4 * out
            g_raw = (g[:, None] * out) * drop * (raw > 0)
            grads_c, grads_b = [], []
            at, back_at = [], []
            who = np.arange(len(b))[:, None]
            for m, (w, c) in enumerate(zip(WIDTHS, conv)):
                gf = g_raw[:, m * FILTERS : (m + 1) * FILTERS]
                picked = wins[m][who, args[m]]  # (batch, filters, w * dim)
                grads_c.append(np.einsum("bfk,bf->kf", picked, gf) + 1e-5 * c)
                grads_b.append(gf.sum(axis=0))
                back = gf[:, :, None] * c.T[None]
                for k2 in range(w):
                    place = args[m] + k2
                    at.append(x[who, place].ravel())
                    back_at.append((back[:, :, k2 * DIM : (k2 + 1) * DIM] * keep[who, place]).reshape(-1, DIM))
            flat = np.concatenate(at)
            by = np.argsort(flat, kind="stable")
            flat = flat[by]
            begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            u = flat[begins]
            g_u = np.add.reduceat(np.concatenate(back_at)[by], begins, axis=0)
            g_u[u == 0] = 0
            state[0][u] += g_u * g_u
            emb[u] -= rate * g_u / np.sqrt(state[0][u])
            for q, (param, grad) in enumerate(zip((*conv, *bias, out), (*grads_c, *grads_b, g_out)), 1):
                state[q] += grad * grad
                param -= rate * grad / np.sqrt(state[q])
            s_last += g.sum() ** 2
            last -= rate * g.sum() / np.sqrt(s_last)
            step += 1
            if epoch >= AVERAGED_FROM * epochs and step % 10 == 0:
                for x, param in zip(kept, (emb, *conv, *bias, out)):
                    x += param
                n_kept, last_kept = n_kept + 1, last_kept + float(last)
    if n_kept:  # the mean of the last states strays less than the last one
        emb, *rest = [(x / n_kept).astype(np.float32) for x in kept]
        conv, bias, out, last = rest[: len(WIDTHS)], rest[len(WIDTHS) : -1], rest[-1], np.float32(last_kept / n_kept)
    tables = []
    for w, c in zip(WIDTHS, conv):
        tables.append(np.concatenate([emb @ c[k * DIM : (k + 1) * DIM] for k in range(w)], axis=1).astype(np.float32))
    unknown = np.setdiff1d(np.arange(BUCKETS), used)
    rows[unknown] = rows[UNK]
    return Model(vocabulary, rows, tables, bias, out, float(last))


# ---- fitting on reviewed documents ----


def disguise(sentence: str, k: int) -> str:
    """The sentence with its longest coarse word written in another way, chosen by k."""
    words = [w for w in re.findall(r"[A-Za-zÀ-ɏ]{4,}", sentence) if any(w.lower() == n.lower() for ns in seeds.NOUN.values() for n in ns)]
    if not words:
        return sentence
    w = words[k % len(words)]
    way = (
        lambda x: x[0] + "*" * (len(x) - 2) + x[-1],
        lambda x: " ".join(x),
        lambda x: x.replace("o", "0").replace("i", "1").replace("e", "3").replace("a", "4"),
        lambda x: x[0] + x[1] * 3 + x[1:],
        lambda x: "".join(c.upper() if i % 2 else c for i, c in enumerate(x)),
        lambda x: x[:2] + "​" + x[2:],
        lambda x: "-".join(x),
    )[k % 7]
    return sentence.replace(w, way(w), 1)


def fragment(sentence: str, k: int) -> str:
    """One to four words of a clean sentence, so that few words alone are no sign of anything."""
    words = sentence.split()
    n = 1 + k % 4
    at = xxhash.xxh32_intdigest(sentence) % max(1, len(words) - n + 1)
    return " ".join(words[at : at + n])


def blurred(sentence: str, kept: frozenset[str] = frozenset()) -> str:
    """A sentence with about a quarter of its longer words unknown, but for those kept, so that a new word says little by itself."""
    return re.sub(r"[^\W\d_]{4,}", lambda m: _UNKNOWN if m.group().lower() not in kept and xxhash.xxh32_intdigest(f"{m.start()} {sentence}") % 4 == 0 else m.group(), sentence)


def trigrams(ids: list[int]) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + 3]) for i in range(max(1, len(ids) - 2))}


def fit(reviewed: list[tuple[str, int]]) -> Model:
    """The model from seeds and reviewed texts (text, 1 or 0); one text in HELD_OUT gives the thresholds."""
    held = [(t, l) for k, (t, l) in enumerate(reviewed) if k % HELD_OUT == 0]
    model = fit_parts([(fitting_parts(t), l) for k, (t, l) in enumerate(reviewed) if k % HELD_OUT])
    counts: Counter = Counter()
    for language_of, label, above in held_out_scores(model, held):
        counts[language_of, label, above] += 1
    model.thresholds = calibrate(counts)
    return model


def fit_parts(used: list[tuple[list[str], int]]) -> Model:
    """The network from seeds and the sentences of reviewed texts (sentences, 1 or 0).

    Texts that nobody reviewed are no examples of anything, however many hold them.

    Reviews are of whole texts and some are mistaken. A first network, of seeds
    and the sentences of clean texts, and word trigrams that clean texts do not
    have, point out the sentence of an abusive text that made it one; NETWORKS
    networks are trained with these and joined.
    """
    seed = seeds.sentences()
    bits = [fragment(s, k) for k, (s, l, _) in enumerate(seed) if not l]
    base = [(s, float(l), 1.0) for s, l, _ in seed] + [(s, 0.0, 1.0) for s in bits] + [(disguise(s, k * way), 1.0, 1.0) for way in (1, 3) for k, (s, l, _) in enumerate(seed) if l and disguise(s, 0) != s]
    # texts without full stops: what stands beside it changes nothing
    shuffled = sorted((s for s, l, _ in seed if not l), key=xxhash.xxh64_intdigest)
    beside = lambda k: shuffled[k * 7919 % len(shuffled)]
    base += [(f"{s.rstrip('.')} {beside(k)}" if k % 2 else f"{beside(k)} {s}", float(l), 1.0) for k, (s, l, _) in enumerate(seed) if k % 3 == 0]
    clean = [s for parts, l in used if not l for s in parts]
    often = Counter(clean)
    clean = sorted(often, key=xxhash.xxh64_intdigest)  # each different sentence, shuffled by hash
    heavy = lambda s, w: (s, 0.0, w * min(4.0, 1.0 + float(np.log(often[s]))))
    first = train(base + [heavy(s, 0.7) for s in clean[: MAX_CLEAN // 3]], epochs=EPOCHS // 2)
    # sentences that only abusive texts have
    plain: Counter = Counter()
    ids = first.vocabulary.ids
    for s in clean[: 4 * MAX_CLEAN]:
        for g in trigrams(ids(s)):
            plain[g] += often[s]
    parts_of = [parts for parts, l in used if l and parts]
    theirs = Counter(g for p in parts_of for s in p for g in trigrams(ids(s)))
    clean_docs = max(1, sum(not l for _, l in used))

    def fresh(g: tuple[int, ...]) -> bool:
        """Far more frequent in abusive documents; some reviews are mistaken, so not only there."""
        return (theirs[g] + 0.5) * clean_docs > LIFT * (plain[g] + 0.5) * max(1, len(parts_of))

    abusive, loose, scored = [], Counter(), []
    for parts in parts_of:
        p = first.score(parts)
        new = np.array([sum(fresh(g) for g in gs) / len(gs) for gs in (trigrams(ids(s)) for s in parts)])
        best = int(np.argmax(0.6 * p + 0.4 * new))
        scored.append((parts[best], float(p[best]), float(new[best])))
        loose.update(trigrams(ids(parts[best])))
    for s, p, new in scored:
        shared = max((loose[g] for g in trigrams(ids(s)) if fresh(g)), default=0)
        if p > 0.5 and new >= 0.25 or new >= 0.5 and len(ids(s)) > 3 and (p > 0.2 or shared > 2):
            abusive.append(s)
    # clean sentences near the border count most
    hard = first.score(clean[: 4 * MAX_CLEAN]) if clean else np.zeros(0)
    order = np.argsort(-hard, kind="stable")
    chosen = [clean[i] for i in order[: MAX_CLEAN // 2]] + clean[: MAX_CLEAN // 2]
    near = {clean[i] for i in order[: MAX_CLEAN // 2] if hard[i] > 0.2}
    again = max(1, min(8, 400 // max(1, len(abusive))))
    more = [(s, 1.0, 1.0) for s in abusive for _ in range(again)] + [(disguise(s, k), 1.0, 1.0) for k, s in enumerate(abusive)]
    bits = [(fragment(s, k), 0.0, 1.0) for k, s in enumerate(clean[: MAX_CLEAN // 6])]
    bits += [(blurred(s), 0.0, BLURRED) for s in [*(s for s, l, _ in seed if not l), *clean[: MAX_CLEAN // 6]]]
    bits += [(blurred(s, coarse), 1.0, BLURRED) for s, l, lang in seed if l for coarse in [seeds.coarse(lang)] if coarse & set(s.lower().replace(",", " ").split())]
    examples = base + bits + more + [heavy(s, 3.0 if s in near else 1.0) for s in dict.fromkeys(chosen)]
    model = joined([train(examples, seed=5 + k) for k in range(NETWORKS)])
    model.thresholds = {"": PRIOR_THRESHOLD}
    model.abusive = abusive
    return model


def held_out_scores(model: Model, held: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(language, label, how many thresholds of GRID the score exceeds) of each text, read whole."""
    scores = model.score_texts([t for t, _ in held])[0] if held else []
    return [(text_language(t), l, int(np.searchsorted(GRID, float(s), "left"))) for s, (t, l) in zip(scores, held)]


def calibrate(counts: dict[tuple[str, int, int], int]) -> dict[str, float]:
    """Threshold per language, and for all others under ''; from counts of :func:`held_out_scores`.

    The best F1 on held-out texts of the language, or the threshold nearest to
    the prior one that is as good within a standard error of that F1, since less
    is a matter of a few mistaken reviews (and within a hundredth in any case); drawn towards the common
    threshold, which is drawn towards one half, by how few abusive texts there are.
    """

    def best(rows: list[tuple[int, int, int]], prior: float) -> float:
        positives = sum(n for l, _, n in rows if l)
        if not positives:
            return prior
        tried = {}
        for k, c in enumerate(GRID):
            tp = sum(n for l, above, n in rows if l and above > k)
            tried[c] = 2 * tp / max(1, positives + sum(n for _, above, n in rows if above > k))
        top = max(tried.values())
        within = max(0.01, float(np.sqrt(top * (1 - top) / positives)))
        at = min((c for c, f1 in tried.items() if f1 >= top - within), key=lambda c: abs(c - prior))
        share = min(1.0, positives / ENOUGH)
        return share * at + (1 - share) * prior

    common = best([(l, above, n) for (_, l, above), n in counts.items()], PRIOR_THRESHOLD)
    out = {"": common}
    for lang in sorted({x for x, _, _ in counts}):
        out[lang] = best([(l, above, n) for (x, l, above), n in counts.items() if x == lang], common)
    return out


# ---- stored models ----


def packed(model: Model) -> bytes:
    """The network without thresholds as plain arrays."""
    out = io.BytesIO()
    words = json.dumps([sorted(model.vocabulary.known), model.abusive]).encode()
    np.savez(out, rows=model.rows, out=model.out, bias=np.array(model.bias), words=np.frombuffer(words, np.uint8), **{f"table{k}": t for k, t in enumerate(model.tables)}, **{f"bias{k}": b for k, b in enumerate(model.biases)})
    return out.getvalue()


def unpacked(data: bytes) -> Model:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        known, abusive = json.loads(z["words"].tobytes())
        n = range(len(WIDTHS))
        return Model(Vocabulary(set(known)), z["rows"], [z[f"table{k}"] for k in n], [z[f"bias{k}"] for k in n], z["out"], float(z["bias"]), {"": PRIOR_THRESHOLD}, abusive)


def network(spark: SparkSession, used: list[tuple[list[str], int]]) -> Model:
    """The network trained on ``used``, from the shared folder if it was trained before."""
    settings = [NETWORKS, AVERAGED_FROM, MAX_CLEAN, BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS, BATCH, BATCH_TOKENS, RATE, LIFT, seeds.sentences()]
    key = hashlib.sha256(json.dumps([settings, used]).encode()).hexdigest()
    path = f"{checkpoint_dir(spark)}/harm-model-{key}"
    try:
        return unpacked(bytes(spark.read.schema("data binary").parquet(path).first()["data"]))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    model = fit_parts(used)
    spark.createDataFrame([(bytearray(packed(model)),)], "data binary").coalesce(1).write.mode("ignore").parquet(path)
    return model


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    """The model with thresholds, from all reviews.

    A document's label is the majority of its raters, ties as abusive. One
    document in HELD_OUT, chosen by hash, is held out: all of these are scored
    whole in the executors, and only counts by language and score come to the
    driver. Of the others at most MAX_REVIEWED, chosen by hash, are used for
    fitting; their sentences are all of the corpus that comes to the driver.
    """
    votes = cut(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label")))
    out = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(HELD_OUT)) == 0
    texts = documents.select("doc_id", "text").where("text is not null")
    sample = broadcast_if_small(cut(votes.where(~out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_REVIEWED)), 32)

    @F.pandas_udf("array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(fitting_parts)

    rows = texts.join(sample, "doc_id").select("doc_id", "label", parts("text").alias("parts")).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["parts"]))
    model = network(documents.sparkSession, [(list(r["parts"]), r["label"]) for r in rows])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(held_out_scores(shared.value, list(zip(b["text"], b["label"]))), columns=["lang", "label", "above"])

    held = spread(texts.join(broadcast_if_small(cut(votes.where(out)), 32), "doc_id").select("text", "label")).mapInPandas(scored, "lang string, label int, above int")
    model.thresholds = calibrate({(r[0], r[1], r[2]): r[3] for r in held.groupBy("lang", "label", "above").count().collect()})
    return model


# ---- operators ----

SCORED = "record_key string, source string, field string, score double, threshold double, worst string"


def scorer(model) -> object:
    """Function for mapInPandas over (record_key, source, one text column a field)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        for b in batches:
            fields = [c for c in b.columns if c not in ("record_key", "source")]
            texts = [t for f in fields for t in b[f]]
            scores, worst = m.score_texts(texts)
            flagged = scores > 0.15
            limit = np.full(len(texts), m.thresholds[""])
            for i in np.flatnonzero(flagged):  # the language matters only near and above the thresholds
                limit[i] = m.threshold(texts[i])
            n = len(b)
            yield pd.DataFrame({
                "record_key": list(b["record_key"]) * len(fields), "source": list(b["source"]) * len(fields),
                "field": [f.replace("__", ".") for f in fields for _ in range(n)], "score": scores, "threshold": limit,
                "worst": [w if x else None for w, x in zip(worst, scores > limit)],
            })

    return run


def score_fields(samples: DataFrame, predictions: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each text of the four fields, with score, threshold and worst sentence.

    ``field`` is samples.prompt, predictions.raw_text, predictions.parsed_analysis
    or documents.text; ``worst`` is null below the threshold. Null and blank
    texts score 0. Every delivered row counts, and texts are read whole.
    """
    spark: SparkSession = documents.sparkSession
    model = spark.sparkContext.broadcast(fitted(documents, labels))
    run = scorer(model)
    parts = [
        samples.select(F.col("sample_id").alias("record_key"), "source", F.col("prompt").alias("samples__prompt")),
        predictions.select(F.col("delivery_id").cast("string").alias("record_key"), "source", F.col("raw_text").alias("predictions__raw_text"), F.col("parsed_analysis").alias("predictions__parsed_analysis")),
        documents.select(F.col("doc_id").cast("string").alias("record_key"), "source", F.col("text").alias("documents__text")),
    ]
    out = None
    for p in parts:
        scored = spread(p).mapInPandas(run, SCORED)
        out = scored if out is None else out.unionByName(scored)
    return out


def abusive_texts(samples: DataFrame, predictions: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``field`` and ``record_key`` of every text above its language's threshold."""
    return score_fields(samples, predictions, documents, labels).where("score > threshold").select("field", "record_key")


def abuse_rates(samples: DataFrame, predictions: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and abusive texts per field and source (trimmed, upper case; missing: unknown)."""
    name = F.coalesce(F.nullif(F.upper(F.trim("source")), F.lit("")), F.lit("unknown"))
    return (
        score_fields(samples, predictions, documents, labels).groupBy("field", name.alias("source"))
        .agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("score") > F.col("threshold")).alias("n_abusive"))
        .withColumn("rate", F.col("n_abusive") / F.col("n_texts"))
    )
