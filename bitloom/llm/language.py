"""The language of each text and of each stretch of a mixed text, by a linear-chain conditional random field."""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.lexicon import LANGUAGES, LEXICON
from bitloom.llm.quality import text_stats

#: Training rows taken for each side and label; the only bounded sample here, and used for nothing but fitting.
SAMPLE_PER_LABEL = 1500
#: Longer texts are not among them, so that what the driver gets is bounded (12 million characters a label and side at most).
LONGEST_FITTED = 4000
FEATURES_LOG2 = 16
#: Words that a stretch needs to count as a language of the text (a shorter text needs all of its words).
LEAST_WORDS = 4
#: Stretches below this confidence are no evidence against a given label.
LEAST_CONFIDENCE = 0.75
# letters and signs that wrongly decoded text shows in place of others; a word around one says nothing about language
_DAMAGE = "�ãăåĺ√≈ƒ\u2500-\u257f\x80-\x9f"
_TOKEN = re.compile(rf"[^\s.!?:;/|()\"“”„—–]*[{_DAMAGE}][^\s.!?:;/|()\"“”„—–]*|[^\W_]+|[.!?:;/|()\n\"“”„—–]")
_DAMAGED = re.compile(f"[{_DAMAGE}]")
_MARKS = '.!?:;/|()\n"“”„—–'
# fixed values: letters that only one of the languages uses
_OWN_LETTERS = {"ő": "hu", "ű": "hu", "ß": "de", "ñ": "es", "ç": "fr", "ê": "fr", "è": "fr"}
K = len(LANGUAGES)


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & ((1 << FEATURES_LOG2) - 1)


def features(word: str) -> list[int]:
    """Hashed features of a word: affixes, letter trigrams, the word itself, which lexicons have it, letters of one language."""
    if word.isdigit() or _DAMAGED.search(word):
        return []
    bounded = f"^{word}$"
    found = [f"w{word}", *(f"p{word[:n]}" for n in (1, 2, 3) if len(word) >= n), *(f"s{word[-n:]}" for n in (1, 2, 3, 4) if len(word) >= n)]
    found += [f"t{bounded[i : i + 3]}" for i in range(len(bounded) - 2)]
    if lexicons := "+".join(lang for lang in LANGUAGES if word in LEXICON[lang]):
        found.append(f"l{lexicons}")
    found += [f"o{_OWN_LETTERS[c]}" for c in sorted(set(word) & _OWN_LETTERS.keys())]
    return [_hash(f) for f in found]


@dataclass
class Model:
    """Weights of the field: features x languages, start, and transitions inside a clause and across a mark."""

    weights: np.ndarray
    start: np.ndarray
    inside: np.ndarray
    across: np.ndarray


def _chains(emit: np.ndarray, lens: np.ndarray, marked: np.ndarray, m: Model) -> Iterator[tuple[np.ndarray, ...]]:
    """Padded blocks of sequences, longest first: (places, alpha, beta, scale, emissions, flags, active counts)."""
    begins = np.cumsum(lens) - lens
    todo = np.argsort(-lens, kind="stable")
    todo = todo[lens[todo] > 0]
    ins, acr, start = np.exp(m.inside), np.exp(m.across), np.exp(m.start)
    at = 0
    while at < len(todo):
        longest = int(lens[todo[at]])
        block = todo[at : at + max(1, min(4096, 400_000 // longest))]
        at += len(block)
        n = lens[block]
        places = begins[block][:, None] + np.minimum(np.arange(longest)[None, :], n[:, None] - 1)
        e = emit[places]
        p = np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -25.0))
        flags = marked[places]
        active = (n[:, None] > np.arange(longest)[None, :]).sum(axis=0)
        alpha, beta = np.zeros_like(p), np.ones_like(p)
        alpha[:, 0] = start * p[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            a = active[t]
            before = alpha[:a, t - 1]
            alpha[:a, t] = np.where(flags[:a, t, None], before @ acr, before @ ins) * p[:a, t]
            alpha[:a, t] /= alpha[:a, t].sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            a = active[t + 1]
            after = beta[:a, t + 1] * p[:a, t + 1]
            after = np.where(flags[:a, t + 1, None], after @ acr.T, after @ ins.T)
            beta[:a, t] = after / after.sum(axis=1, keepdims=True)
        yield places, alpha, beta, p, flags, active, n


def posteriors(emit: np.ndarray, lens: np.ndarray, marked: np.ndarray, m: Model) -> np.ndarray:
    """Probability of each language at each word, by forward-backward."""
    out = np.full((len(emit), K), 1 / K)
    for places, alpha, beta, *_, n in _chains(emit, lens, marked, m):
        g = alpha * beta
        g /= np.maximum(g.sum(axis=2, keepdims=True), 1e-300)
        real = np.arange(places.shape[1])[None, :] < n[:, None]
        out[places[real]] = g[real]
    return out


class Encoder(dict):
    """Token to number; marks come first. New words get their features or emissions when first seen."""

    def __init__(self) -> None:
        super().__init__({c: i for i, c in enumerate(_MARKS)})
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.fresh.append(token)
        return n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts (marks taken out), words of each text, and whether a mark stands before each word."""
        flat: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            own = _TOKEN.findall(t.lower()) if t else []
            flat += map(self.__getitem__, own)
            counts[i] = len(own)
        ids = np.array(flat, dtype=np.int64)
        word = ids >= len(_MARKS)
        total = np.concatenate([[0], np.cumsum(word)])
        lens = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
        marked = np.zeros(len(ids), dtype=bool)
        marked[1:] = ~word[:-1]
        return ids[word], lens, marked[word]


def agrees(tokens: list[str], given: str | None) -> bool:
    """Whether the lexicon says nothing against the upstream label of a text, and something for it.

    The words of the lists and the letters that one language alone has vote, in each clause and in the whole text;
    no clause may have a clear winner other than the label, and the label must win the whole.
    """
    if given not in LANGUAGES:
        return False
    k = LANGUAGES.index(given)
    total, clause = np.zeros(K), np.zeros(K)
    for t in [*tokens, "."]:
        if t in _MARKS:
            others = np.delete(clause, k)
            if others.max() >= 1.5 and others.max() - clause[k] >= 0.75:
                return False
            total += clause
            clause = np.zeros(K)
            continue
        own = [j for j, lang in enumerate(LANGUAGES) if t in LEXICON[lang]]
        clause[own] += 1 / max(1, len(own))
        for c in t:
            if c in _OWN_LETTERS:
                clause[LANGUAGES.index(_OWN_LETTERS[c])] += 1
    return bool(total[k] >= 1 and total[k] - np.delete(total, k).max() >= 0.5)


def examples(texts: list[str], given: list[str | None], seed: int = 7) -> tuple[list[str], list[list[int]]]:
    """Texts to fit to and the language of each of their words.

    The texts whose upstream label the lexicon does not contradict, all words with that label; and, a third as many,
    pairs of such texts in two languages joined by a mark or a blank, so that transitions are learned. Languages take
    turns, so that rare ones are in as many pairs as others.
    """
    tokens = [_TOKEN.findall(t.lower()) for t in texts]
    good = [i for i, t in enumerate(tokens) if agrees(t, given[i])]
    length = [sum(w not in _MARKS for w in t) for t in tokens]
    out = [texts[i] for i in good]
    gold = [[LANGUAGES.index(given[i])] * length[i] for i in good]
    by = [[i for i in good if given[i] == lang] for lang in LANGUAGES]
    kinds = [(a, b) for a in range(K) for b in range(K) if a != b and by[a] and by[b]]
    rng = np.random.default_rng(seed)
    for n in range(len(good) // 3 if kinds else 0):
        a, b = kinds[n % len(kinds)]
        i, j = int(rng.choice(by[a])), int(rng.choice(by[b]))
        out.append(texts[i].strip() + (" ", " / ", "\n", " – ")[n // len(kinds) % 4] + texts[j].strip())
        gold.append([a] * length[i] + [b] * length[j])
    return out, gold


def _prior() -> np.ndarray:
    """Weights to start from: a word of a lexicon, or with a letter of one language only, speaks for it (its rows may be few)."""
    weights = np.zeros((1 << FEATURES_LOG2, K))
    for k, lang in enumerate(LANGUAGES):
        weights[[_hash(f"l{lang}"), _hash(f"o{lang}")], k] = 3.0
    return weights


def fit(texts: list[str], given: list[str | None], epochs: int = 12, seed: int = 7, least_steps: int = 240) -> Model:
    """A field fitted by stochastic gradients of the likelihood to the texts whose upstream labels can be trusted (see examples)."""
    texts, gold = examples(texts, given, seed)
    enc = Encoder()
    ids, lens, marked = enc.encode(texts)
    offset = len(_MARKS)
    lists = [features(w) for w in enc.fresh]
    size = np.array([len(x) for x in lists], dtype=np.int64)
    feats = np.array([f for x in lists for f in x], dtype=np.int64)
    word_of = np.repeat(np.arange(len(lists)), size)
    begins = np.cumsum(lens) - lens
    rng = np.random.default_rng(seed)
    m = Model(_prior(), np.zeros(K), np.eye(K) * 2, np.eye(K))
    usable = np.array([i for i, g in enumerate(gold) if g], dtype=np.int64)
    moments = [np.zeros_like(x) for x in (m.weights, m.start, m.inside, m.across)]
    epochs = max(epochs, -(-least_steps // max(1, -(-len(usable) // 400))))  # a small sample is gone through more often
    for epoch in range(epochs):
        rng.shuffle(usable)
        rate = 0.3 * (1 - epoch / epochs) + 0.02
        for b in range(0, len(usable), 400):
            pick = usable[b : b + 400]
            n = lens[pick]
            places = np.concatenate([np.arange(begins[i], begins[i] + lens[i]) for i in pick])
            own, flags = ids[places] - offset, marked[places]
            y = np.array([k for i in pick for k in gold[i]], dtype=np.int64)
            table = np.zeros((len(lists), K))
            for k in range(K):
                table[:, k] = np.bincount(word_of, weights=m.weights[feats, k], minlength=len(lists))
            emit = table[own]
            first = np.cumsum(n) - n
            wanted = np.zeros((len(own), K))
            wanted[np.arange(len(own)), y] = 1
            guess = np.full((len(own), K), 0.0)
            g_in, g_acr, g_start = np.zeros((K, K)), np.zeros((K, K)), np.zeros(K)
            for at, alpha, beta, p, fl, active, ln in _chains(emit, n, flags, m):
                g = alpha * beta
                g /= np.maximum(g.sum(axis=2, keepdims=True), 1e-300)
                real = np.arange(at.shape[1])[None, :] < ln[:, None]
                guess[at[real]] = g[real]
                g_start -= g[:, 0].sum(axis=0)
                for t in range(1, at.shape[1]):
                    a = active[t]
                    right = beta[:a, t] * p[:a, t]
                    for across, grad, mat in ((False, g_in, m.inside), (True, g_acr, m.across)):
                        s = fl[:a, t] == across
                        if s.any():
                            joint = alpha[:a, t - 1][s][:, :, None] * np.exp(mat)[None] * right[s][:, None, :]
                            grad -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(g_start, y[first], 1)
            inner = np.setdiff1d(np.arange(len(own)), first)
            np.add.at(g_in, (y[inner - 1][~flags[inner]], y[inner][~flags[inner]]), 1)
            np.add.at(g_acr, (y[inner - 1][flags[inner]], y[inner][flags[inner]]), 1)
            by_word = np.stack([np.bincount(own, weights=(wanted - guess)[:, k], minlength=len(lists)) for k in range(K)], axis=1)
            g_w = np.stack([np.bincount(feats, weights=by_word[word_of, k], minlength=1 << FEATURES_LOG2) for k in range(K)], axis=1)
            grads = [g_w / len(pick), g_start / len(pick), g_in / len(pick), g_acr / len(pick)]
            for x, g, v in zip((m.weights, m.start, m.inside, m.across), grads, moments, strict=True):
                g = g - 1e-6 * x
                v += g * g
                x += rate * g / np.sqrt(v + 1e-6)
    return Model(m.weights.astype(np.float32), m.start, m.inside, m.across)


def training_rows(records: DataFrame, id_col: str, sides: dict[str, tuple[str, str]], per_label: int = SAMPLE_PER_LABEL) -> tuple[list[str], list[str | None]]:
    """The bounded sample that the field is fitted to: the rows of each side and label with the smallest hash."""
    one = [F.struct(F.lit(side).alias("side"), F.col(text).alias("t"), F.col(label).alias("l"), F.xxhash64(F.lit(side), F.col(id_col)).alias("h")) for side, (text, label) in sides.items()]
    long = records.select(F.inline(F.array(*one))).where(F.col("l").isin(*LANGUAGES) & (F.length("t") <= LONGEST_FITTED))
    counts = long.groupBy("side", "l").agg(F.count(F.lit(1)).alias("n")).collect()  # one number a side and language
    if not counts:
        return [], []
    # a hash below twice the share that is needed: the ranking then sees about 2 * per_label rows a group
    near = F.lit(False)
    for c in counts:
        limit = min((1 << 63) - 1, round(2 * per_label / c["n"] * (1 << 64)) - (1 << 63))
        near |= (F.col("side") == c["side"]) & (F.col("l") == c["l"]) & (F.col("h") <= limit)
    order = Window.partitionBy("side", "l").orderBy("h", "t")
    rows = long.where(near).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_label).orderBy("side", "l", "_r").select("t", "l").collect()
    return [r["t"] for r in rows], [r["l"] for r in rows]


class Labeller:
    """Inference over batches of texts with one model; emissions of words seen before are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.encoder, self.known = Encoder(), np.zeros((1 << 12, K))

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of all texts, and the number of words of each text."""
        if len(self.encoder) > 1_000_000:
            self.reset()
        ids, lens, marked = self.encoder.encode(texts)
        fresh, self.encoder.fresh = self.encoder.fresh, []
        need = len(self.encoder)
        while need > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        lists = [features(w) for w in fresh]
        if lists:
            size = np.array([len(x) for x in lists])
            flat = self.model.weights[np.array([f for x in lists for f in x], dtype=np.int64)].astype(np.float64)
            total = np.concatenate([np.zeros((1, K)), np.cumsum(flat, axis=0)])
            ends = np.cumsum(size)
            self.known[need - len(fresh) : need] = total[ends] - total[ends - size]
        return posteriors(self.known[ids], lens, marked, self.model), lens


def segments(post: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int, float]]:
    """(first word, words, language, confidence) of the stretches of one text, in order.

    Stretches of fewer than ``least`` words join the longer of their neighbours (the one before, if these are equal),
    shortest and earliest first; so a text has one stretch at least if it has a word. Stretches are kept in a linked
    list and a heap, so a text of n stretches takes about n log n steps.
    """
    if not len(post):
        return []
    best = post.argmax(axis=1)
    cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    first, end = cut[:-1], cut[1:]
    lang = [int(best[a]) for a in first]
    n = len(first)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(end[i] - first[i], first[i], i) for i in range(n)]
    heapq.heapify(heap)
    left = n
    while left > 1 and heap:
        size, _, i = heapq.heappop(heap)
        if not alive[i] or size != end[i] - first[i]:
            continue
        if size >= least:
            break
        sides = [k for k in (before[i], after[i]) if k >= 0]
        lang[i] = lang[max(sides, key=lambda k: end[k] - first[k])]
        for k in sides:
            if lang[k] == lang[i]:  # one with the neighbour
                first[i], end[i] = min(first[i], first[k]), max(end[i], end[k])
                alive[k] = False
                left -= 1
                if k == before[i]:
                    before[i] = before[k]
                    if before[i] >= 0:
                        after[before[i]] = i
                else:
                    after[i] = after[k]
                    if after[i] >= 0:
                        before[after[i]] = i
        heapq.heappush(heap, (end[i] - first[i], first[i], i))
    rest = sorted((first[i], end[i], lang[i]) for i in range(n) if alive[i])
    return [(a, b - a, k, float(post[a:b, k].mean())) for a, b, k in rest]


def fit_on(records: DataFrame, id_col: str, sides: dict[str, tuple[str, str]], per_label: int = SAMPLE_PER_LABEL) -> Model:
    """The field fitted to the bounded sample of the records."""
    return fit(*training_rows(records, id_col, sides, per_label))


_labellers: dict[str, Labeller] = {}


def language_segments(records: DataFrame, id_col: str, sides: dict[str, tuple[str, str]], model: Model, only_mislabelled: bool = False) -> DataFrame:
    """``id``, ``side``, ``given``, ``segment``, ``first_word``, ``n_words``, ``lang``, ``confidence``: the stretches of each text.

    sides: name of a side to its text and label columns. A text without words (null, blank, signs only) has no row.
    With only_mislabelled: only running prose whose label is null or is not the one language of all its stretches.
    confidence is the mean posterior of the stretch. A map over the records, no shuffle.
    """
    columns = [F.col(id_col).alias("id")]
    for k, (text, label) in enumerate(sides.values()):
        columns += [F.col(text).alias(f"t{k}"), F.col(label).alias(f"l{k}")]
    base = records.select(*columns)
    id_type, names = dict(base.dtypes)["id"], list(sides)
    shared = records.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    schema = f"id {id_type}, side string, given string, segment int, first_word int, n_words int, lang string, confidence double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _labellers:
            _labellers.clear()
            _labellers[name] = Labeller(shared.value)
        labeller = _labellers[name]
        for batch in batches:
            for k, side in enumerate(names):
                texts, given = batch.column(1 + 2 * k).to_pylist(), batch.column(2 + 2 * k).to_pylist()
                post, lens = labeller.label(texts)
                begins = np.cumsum(lens) - lens
                rows, out = [], []
                top = post.argmax(axis=1) if len(post) else np.zeros(0, dtype=np.int64)
                for i, (n, b, g) in enumerate(zip(lens.tolist(), begins.tolist(), given, strict=True)):
                    if not n:
                        continue
                    if only_mislabelled:
                        own = top[b : b + n]
                        if g is not None and LANGUAGES[own[0]] == g and (own == own[0]).all():
                            continue
                    found = segments(post[b : b + n])
                    if only_mislabelled:
                        sure = [s for s in found if s[3] >= LEAST_CONFIDENCE]
                        found = sure or ([] if g is not None else found)
                        if not found or {LANGUAGES[s[2]] for s in found} == {g} or not text_stats(texts[i]).is_prose:
                            continue
                    for j, s in enumerate(found):
                        rows.append(i)
                        out.append((g, j, s[0], s[1], LANGUAGES[s[2]], s[3]))
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([side] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    ["id", "side", "given", "segment", "first_word", "n_words", "lang", "confidence"],
                )

    return base.mapInArrow(label, schema)


def wrong_labels(records: DataFrame, id_col: str, sides: dict[str, tuple[str, str]], model: Model) -> DataFrame:
    """``id``, ``side``, ``lang``: the languages of each prose text whose label is null or not its one language."""
    return language_segments(records, id_col, sides, model, only_mislabelled=True).select("id", "side", "lang").distinct()
