"""Texts that were decoded with a wrong character encoding: finding and restoring them."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.words import words
from bitloom.operators.skew import union_all
from bitloom.scratch import materialise

# fixed values: single-byte encodings as which UTF-8 is misread
CHANNELS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "mac-roman", "cp437", "cp850", "cp852", "cp1251", "cp1257")
# fixed values: letters that one single-byte encoding shows where another was meant (central European read as western)
SINGLE = str.maketrans("õûÕÛ", "őűŐŰ")
LOST = "�"
ACCENTED = "áéíóöőúüű"
# fixed values: signs of running text outside ASCII, the most usual first
USUAL_SIGNS = "”“„’‘–—…"
#: What damaged text may decode to, also half-way: the upper halves of Latin-1 and cp1252, Latin Extended-A, usual signs.
ALLOWED = frozenset([chr(c) for c in (*range(0x80, 0x180), *range(0x2009, 0x203B))] + list("€™•−ƒˆ˜‚„†‡‰‹›"))
_PLAIN = r"\x00-\x7fáéíóöőúüűÁÉÍÓÖŐÚÜŰ„“”–…\xa0\xad"
_ODD = re.compile(f"[^{_PLAIN}]")
_CONTROL = re.compile("[\x80-\x9f]")
# a token ends at plain white space only: no-break blanks and control characters may be bytes of a misread letter
_WORDISH = re.compile(r"[^ \t\n\r\f\v]+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: Words and tokens that a task counts before it hands them on.
COUNTED_AT_ONCE = 500_000
#: Log-odds against a byte sequence that is valid UTF-8 by chance, for each sequence that a reading joins.
CHANCE = 10.0
#: No word of a natural language has more letters; of longer runs that are still open only the best reading goes on.
LONGEST_WORD = 64
LONG = " "
#: Words that the driver fetches and broadcasts at most at once (about 250 MB); damage that asks for more is restored in parts.
MAX_ASKED = 5_000_000


@lru_cache(maxsize=32)
def byte_of(channel: str) -> dict[str, int]:
    """Character to byte of an encoding, for the upper half; bytes that it leaves undefined are their own control."""
    table = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(channel)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=1)
def _by_bytes() -> dict[tuple[int, ...], str]:
    return {tuple(c.encode()): c for c in ALLOWED}


@lru_cache(maxsize=4096)
def _matching(pattern: tuple[int, ...]) -> tuple[str, ...]:
    """Allowed characters whose UTF-8 bytes fit a pattern in which -1 is a lost byte."""
    return tuple(sorted(c for b, c in _by_bytes().items() if len(b) == len(pattern) and all(p in (-1, x) for p, x in zip(pattern, b, strict=True))))


@lru_cache(maxsize=32)
def undefined(channel: str) -> frozenset[int]:
    """The bytes that an encoding does not know, which a reader of it loses."""
    return frozenset(b for b in range(0x80, 0x100) if not bytes([b]).decode(channel, "ignore"))


@lru_cache(maxsize=4096)
def _readings(pattern: tuple[int, ...], channel: str) -> str | tuple[str, ...]:
    """The character of a byte sequence, or the choices where bytes were lost.

    If none of these is a letter, it is the most usual sign whose lost bytes the channel does not know, if there is one.
    """
    fits = _matching(pattern)
    if len(fits) == 1:
        return fits[0]
    if not any(map(str.isalpha, fits)):
        lost = [k for k, b in enumerate(pattern) if b == -1]
        for sign in USUAL_SIGNS:
            if sign in fits and all(sign.encode()[k] in undefined(channel) for k in lost):
                return sign
    return fits


Part = str | tuple[str, ...]
Edge = tuple[int, Part, int]


def lattice(token: str, channel: str) -> list[list[Edge]]:
    """The byte lattice of a token under a channel: for each place the edges (next place, character or choices, sequences joined).

    Every place has an edge for the character as it stands (stretches of plain letters and digits have one for all),
    and one for each way to join bytes from it into a character. A lost byte (U+FFFD) is a wildcard: inside of a
    sequence it stands for any byte, alone for any accented letter. Empty if nothing can be read in another way.
    """
    table = byte_of(channel)
    codes = [table.get(c, -1 if c == LOST else ord(c) if c < "\x80" else -2) for c in token]
    if not any(x == -1 or 0xC2 <= x <= 0xEF for x in codes):
        return []
    shout = token.isupper() and len(token) > 2
    edges: list[list[Edge]] = [[] for _ in token]
    other = False
    plain = 0  # where the stretch of plain characters began that ends here
    for i, c in enumerate(token):
        b, own = codes[i], edges[i]
        for n in (2,) if 0xC2 <= b <= 0xDF else (3,) if 0xE0 <= b <= 0xEF else (2, 3) if b == -1 else ():
            seq = tuple(codes[i : i + n])
            if len(seq) == n and all(x == -1 or 0x80 <= x <= 0xBF for x in seq[1:]) and any(x >= 0 for x in seq):
                fits = _readings(seq, channel)
                if fits:
                    own.append((i + n, fits, 1))
        if c == LOST and not (i == 0 and token[1:2].isupper() and not shout):  # else rather a quotation mark
            own.append((i + 1, tuple(ACCENTED.upper() if shout else ACCENTED + ACCENTED.upper() if i == 0 else ACCENTED), 0))
        other = other or bool(own)
        if own or c >= "\x80" or not c.isalnum():
            own.append((i + 1, c, 0))
            if plain < i:
                edges[plain] = [(i, token[plain:i], 0)]
            plain = i + 1
    if plain < len(token):
        edges[plain] = [(len(token), token[plain:], 0)]
    return edges if other else []


def skeleton(word: str) -> str:
    """The word with every character outside ASCII as ``?``: the same for all spellings between which a lattice chooses."""
    return _NOT_ASCII.sub("?", word)


def _key(skeletons: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in skeletons]


class Vocabulary:
    """Words of the corpus with their exact counts, found by their skeletons; all others count 0.

    Columns in the order of the hashes of the skeletons, so that a worker needs no table of Python strings.
    """

    def __init__(self, hashes: np.ndarray, names: pa.Array, counts: np.ndarray, total: int):
        self.hashes, self.names, self.counts, self.total = hashes, names, counts, max(1, total)
        self.groups: dict[str, dict[str, int]] = {}
        self.costs: dict[str, float] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> Vocabulary:
        names, keys = list(counts), np.array(_key([skeleton(w) for w in counts]), dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], pa.array([names[i] for i in order], pa.large_string()), np.array(list(counts.values()), dtype=np.int64)[order], sum(counts.values()))

    def alike(self, shape: str) -> dict[str, int]:
        """The words with a skeleton."""
        found = self.groups.get(shape)
        if found is None:
            if len(self.groups) > 300_000:
                self.groups.clear()
            h = _key([shape])[0]
            a, b = (int(np.searchsorted(self.hashes, h, side)) for side in ("left", "right"))
            names = self.names[a:b].to_pylist()
            found = self.groups[shape] = {w: int(n) for w, n in zip(names, self.counts[a:b], strict=True) if skeleton(w) == shape}
        return found

    def count(self, word: str) -> int:
        return self.alike(skeleton(word)).get(word, 0)

    def evidence(self, word: str) -> float:
        """How often the word occurs, or, as a compound, the rarer of its two best pieces (at least 2 letters each)."""
        own = self.count(word)
        pieces = max((min(self.count(word[:i]), self.count(word[i:])) for i in range(2, len(word) - 1)), default=0) if 5 <= len(word) <= LONGEST_WORD else 0
        return max(own, pieces)

    def score(self, text: str) -> float:
        """Log-likelihood of the words of a text; unknown words cost by their length (as of 20 letters at most: damaged
        words are themselves words of the corpus), odd characters extra."""
        s = -9.0 * len(_ODD.findall(text)) - 12.0 * text.count(LOST)
        for w in words(text):
            cost = self.costs.get(w)
            if cost is None:
                if len(self.costs) > 300_000:
                    self.costs.clear()
                n = self.count(w)
                cost = self.costs[w] = math.log(n / self.total) if n else math.log(1 / self.total) - 1.5 - 0.5 * min(len(w), 20)
            s += cost
        return s


class AskingVocabulary(Vocabulary):
    """Notes in ``asked`` the skeletons that were looked up."""

    def __init__(self, *columns: Any):
        super().__init__(*columns)
        self.asked: set[str] = set()

    def alike(self, shape: str) -> dict[str, int]:
        if shape not in self.groups:
            self.asked.add(shape)
        return super().alike(shape)


class Decoder:
    """Noisy-channel decoder of texts."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.closed: dict[tuple[Part, ...], tuple[str, float]] = {}
        self.tokens: dict[tuple[str, str], tuple[str, int]] = {}

    def _fit(self, letters: tuple[Part, ...]) -> tuple[str, int]:
        """The most frequent word of the corpus that fits fixed letters and choices, with its count; ("", 0) if there is none."""
        shape = "".join("?" if isinstance(p, tuple) else skeleton(p.lower()) for p in letters)
        best, most = "", 0
        for word, n in self.known.alike(shape).items():
            if n > most and all(c in p or c.upper() in p if isinstance(p, tuple) else c == p.lower() for c, p in zip(word, letters, strict=True)):
                best, most = word, n
        loud = [p for p in letters if isinstance(p, str) and p.isalpha()]
        upper = len(loud) > 1 and all(map(str.isupper, loud))
        cased = (c.upper() if isinstance(p, tuple) and c.upper() in p and (upper or c not in p) else c if isinstance(p, tuple) else p for c, p in zip(best, letters, strict=False))
        return "".join(cased), most

    def _close(self, parts: tuple[Part, ...]) -> tuple[str, float]:
        """The best word for a run of letters and choices, as a whole or of two known pieces, and its score."""
        found = self.closed.get(parts)
        if found is not None:
            return found
        if not any(isinstance(p, tuple) for p in parts):
            word = "".join(parts)
        elif len(parts) == 1:
            word = LOST  # a single letter by itself says nothing
        else:
            letters = tuple(x for p in parts for x in ([p] if isinstance(p, tuple) else p))
            word, n = self._fit(letters) if len(letters) <= LONGEST_WORD else ("", 0)
            if n < 2 and 5 <= len(letters) <= LONGEST_WORD:
                for i in range(2, len(letters) - 1):
                    (a, x), (b, y) = self._fit(letters[:i]), self._fit(letters[i:])
                    if min(x, y) > n and min(x, y) >= 2:
                        word, n = a + b, min(x, y)
            word = word or "".join(LOST if isinstance(p, tuple) else p for p in parts)
        if len(self.closed) > 200_000:
            self.closed.clear()
        self.closed[parts] = (word, self.known.score(word))
        return self.closed[parts]

    def read(self, edges: list[list[Edge]]) -> tuple[str, int]:
        """The best path through a lattice and the sequences that it joins, by Viterbi search.

        A state is a place and the shape of the word that is open there; its value is the score of what is closed:
        frequencies of words, costs of odd and lost characters, and CHANCE for each joined sequence. The reading in
        which nothing is joined is one of the paths.
        """
        states: list[dict[str, tuple]] = [{} for _ in range(len(edges) + 1)]
        states[0][""] = (0.0, 0, "", ())
        for i, own in enumerate(edges):
            for shape, (score, joined, text, parts) in states[i].items():
                word, cost = self._close(parts) if parts else ("", 0.0)
                for to, part, n in own:
                    letters = tuple(c for c in part if c.isalpha()) if isinstance(part, tuple) else part if part.isalnum() else ""
                    if letters:
                        key = shape + ("?" if isinstance(letters, tuple) else skeleton(letters[: LONGEST_WORD + 1]))
                        key = LONG if shape == LONG or len(key) > LONGEST_WORD else key
                        new = (score + CHANCE * n, joined + n, text, (*parts, letters[0] if isinstance(letters, tuple) and len(letters) == 1 else letters))
                    else:
                        sign = LOST if isinstance(part, tuple) else part
                        odd = 21.0 if sign == LOST else 9.0 if _ODD.match(sign) else 0.0
                        key, new = "", (score + cost + CHANCE * n - odd, joined + n, text + word + sign, ())
                    if key not in states[to] or states[to][key][:2] < new[:2]:
                        states[to][key] = new
            states[i] = {}
        ends = [(s + c, j, t + w) for s, j, t, w, c in ((s, j, t, *(self._close(p) if p else ("", 0.0))) for s, j, t, p in states[-1].values())]
        _, joined, text = max(ends, key=lambda e: e[:2])
        return text, joined

    def decode(self, token: str, channel: str) -> tuple[str, int]:
        """A token as the channel would have it, repeated while it still decodes; and the sequences joined."""
        if (token, channel) in self.tokens:
            return self.tokens[token, channel]
        now, joined = token, 0
        for turn in range(3):
            edges = lattice(now, channel)
            new, n = self.read(edges) if edges else (now, 0)
            if new == now or not (n or (LOST in now and turn == 0)):
                break
            now, joined = new, joined + n
        if len(self.tokens) > 200_000:
            self.tokens.clear()
        self.tokens[token, channel] = (now, joined)
        return now, joined

    def single(self, token: str) -> str:
        """A token with central European letters put back, where the corpus says that these were meant."""
        fixed = token.translate(SINGLE)
        if fixed == token:
            return token
        for old, new in zip(words(token), words(fixed), strict=True):
            if old != new and self.known.evidence(new) < max(3, 3 * self.known.count(old)):
                return token
        return fixed

    def restore(self, text: str) -> tuple[str, str, int]:
        """(restored text, channels used, damaged tokens). Without damage the text itself, "" and 0.

        Tokens with odd characters are decoded under each channel; the best sequence of channels is found by Viterbi,
        where changing the channel costs, the words score by their frequency in the corpus, and joined sequences by
        CHANCE. To leave a token as it stands is one of the choices.
        """
        if not _ODD.search(text):
            return text, "", 0
        spans = [m for m in _WORDISH.finditer(text) if _ODD.search(m[0])]
        options = []
        for m in spans:
            token = m[0]
            own: dict[str, tuple[str, bool, int]] = {"": (token, False, 0)}
            for c in CHANNELS:
                new, joined = self.decode(token, c)
                if joined or (new != token and LOST in token):
                    own[c] = (new, True, joined)
            one = self.single(token)
            if one != token:
                own["single"] = (one, True, 0)
            options.append(own)
        states = sorted({c for o in options for c in o})
        best: dict[str, tuple[float, tuple]] = {s: (0.0, ()) for s in states}
        for own in options:
            scored = {s: self.known.score(own[s][0]) + CHANCE * own[s][2] if s in own else None for s in states}
            stay = scored[""]
            step = {}
            for s in states:
                emit, took = (scored[s], s) if scored[s] is not None else (stay - 1.0, "")
                prev = max(states, key=lambda q: best[q][0] - 4.0 * (q != s))
                step[s] = (best[prev][0] - 4.0 * (prev != s) + emit, (took, best[prev][1]))
            best = step
        path = max(best.values(), key=lambda x: x[0])[1] if states else ()
        chosen: list[str] = []
        while path:
            took, path = path
            chosen.append(took)
        chosen.reverse()
        out, at, used, damaged = [], 0, [], 0
        for m, own, took in zip(spans, options, chosen, strict=True):
            new, changed, _ = own[took]
            if LOST in m[0][:2] and new[0] in ACCENTED and text[: m.start()].rstrip(" ")[-1:] in ("", ".", "!", "?", "\n", "–", "-"):
                new = new[0].upper() + new[1:]
            out += [text[at : m.start()], new]
            at = m.end()
            if changed or LOST in m[0] or _CONTROL.search(m[0]):
                damaged += 1
                used.append(took or "lost")
        out.append(text[at:])
        return "".join(out), "+".join(sorted(set(used))), damaged


_decoders: dict[str, Decoder] = {}


def _words_and_odd_tokens(texts: DataFrame) -> DataFrame:
    """``odd, word, n``: all words of all columns with their counts, and (odd) the tokens with unusual characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        odd: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            flags = pa.array([False] * len(found) + [True] * len(odd), pa.bool_())
            out = pa.RecordBatch.from_arrays([flags, pa.array([*found, *odd], pa.string()), pa.array([*found.values(), *odd.values()], pa.int64())], ["odd", "word", "n"])
            found.clear()
            odd.clear()
            return out

        for batch in batches:
            for column in batch.columns:
                for t in column.to_pylist():
                    found.update(words(t))
                    if t and _ODD.search(t):
                        odd.update(w for w in _WORDISH.findall(t) if _ODD.search(w))
            if len(found) + len(odd) > COUNTED_AT_ONCE:
                yield part()
        yield part()

    return texts.mapInArrow(count, "odd boolean, word string, n bigint").groupBy("odd", "word").agg(F.sum("n").alias("n"))


def _columns(rows: DataFrame) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Hashes of the skeletons in ascending order, with the words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(b.column(0).to_pylist()), pa.int64()), *b.columns[1:]], ["h", "word", "n"])

    found = materialise(rows.select("skeleton", "word", "n").mapInArrow(run, "h bigint, word string, n bigint"))
    if found.count() > MAX_ASKED:
        raise TooManyWords
    table = found.toArrow().combine_chunks()
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    names = pa.concat_arrays([pa.array([], pa.large_string()), *(c.cast(pa.large_string()) for c in table.column("word").chunks)])
    return table.column("h").to_numpy(), names, table.column("n").to_numpy()


class TooManyWords(Exception):
    """The damaged tokens ask for more words than the driver may fetch."""


def counted_words(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(odd tokens, words with counts and skeletons, number of words) of all texts; written once."""
    counted = materialise(_words_and_odd_tokens(texts).withColumn("skeleton", F.regexp_replace("word", r"[^\x00-\x7f]", "?")))
    vocabulary = counted.where("not odd")
    return counted.where("odd").select("word"), vocabulary, int(vocabulary.agg(F.sum("n")).first()[0] or 0)


def asked_words(tokens: DataFrame, vocabulary: DataFrame, total: int) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """The columns of a Vocabulary: all corpus words for which the damaged tokens ask, with exact counts.

    The distinct tokens are decoded with the words known so far; the skeletons they look up are joined with the
    counted words of all rows. What is decoded in one round may ask for more in the next (twice damaged texts); it
    ends when no round asks for anything new, so every count that decoding uses is then exact.
    """
    spark = tokens.sparkSession
    columns = (np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64))
    answered = spark.createDataFrame([], "skeleton string")
    while True:
        shared = spark.sparkContext.broadcast((*columns, total))

        def ask(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = AskingVocabulary(*shared.value)
            decoder = Decoder(known)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    decoder.restore(t)
                yield pa.RecordBatch.from_arrays([pa.array(list(known.asked), pa.string())], ["skeleton"])
                known.asked.clear()

        new = materialise(tokens.mapInArrow(ask, "skeleton string").distinct().join(answered, "skeleton", "left_anti"))
        if new.isEmpty():
            return *columns, total
        answered = answered.unionByName(new)
        columns = _columns(vocabulary.join(answered, "skeleton", "left_semi"))


def restored_texts(records: DataFrame, id_col: str, sides: dict[str, str]) -> DataFrame:
    """``id``, ``side``, ``restored``, ``channels``, ``n_damaged``, ``complete``: the damaged texts of each record.

    sides: name of a side to its column. Damage is: characters that are misread UTF-8 (also twice, also where bytes
    were lost), replacement characters, stray control characters, and western letters in place of central European
    ones where the corpus knows the other word. Names and signs that fit none of these are left alone. complete: no
    lost or odd sequence is left in the restored text. Null and empty texts are no cases; repeated rows are repeated.

    Words are counted exactly over all rows; those for which damaged tokens ask are broadcast with their counts. If
    they are more than MAX_ASKED, the texts with unusual characters are halved by a hash of their ids until the words
    for each part are few enough, and the parts are restored one after the other with the same counts, so the result
    is the same. Texts without an unusual character are passed over by one search. No shuffle beside those of words
    and distinct tokens.
    """
    base = records.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"t{k}") for k, c in enumerate(sides.values())))
    texts = [f"t{k}" for k in range(len(sides))]
    tokens, vocabulary, total = counted_words(base.select(*texts))
    try:
        return _restore(base, asked_words(tokens, vocabulary, total), list(sides))
    except TooManyWords:
        odd = F.lit(False)
        for t in texts:
            odd = odd | F.coalesce(F.col(t).rlike(_ODD.pattern), F.lit(False))
        return union_all(_restore_halves(materialise(base.where(odd)), texts, vocabulary, total, list(sides), 0))


def _restore_halves(rows: DataFrame, texts: list[str], vocabulary: DataFrame, total: int, names: list[str], bit: int) -> list[DataFrame]:
    """The restored texts of both halves of the rows by a bit of the hash of their ids, halved again where needed."""
    if bit > 40:
        raise ValueError(f"one record asks for more than {MAX_ASKED} words")
    out = []
    for side in (0, 1):
        half = rows.where(F.getbit(F.xxhash64("id"), F.lit(bit)) == side)
        tokens = materialise(_words_and_odd_tokens(half.select(*texts)).where("odd").select("word"))
        try:
            out.append(_restore(half, asked_words(tokens, vocabulary, total), names))
        except TooManyWords:
            out += _restore_halves(half, texts, vocabulary, total, names, bit + 1)
    return out


def _restore(base: DataFrame, columns: tuple, names: list[str]) -> DataFrame:
    """The damaged texts of the rows (``id`` and a column for each name), with a vocabulary for their tokens."""
    shared, name = base.sparkSession.sparkContext.broadcast(columns), uuid.uuid4().hex
    id_type = dict(base.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _decoders:
            _decoders.clear()
            _decoders[name] = Decoder(Vocabulary(*shared.value))
        decoder = _decoders[name]
        for batch in batches:
            for k, side in enumerate(names):
                rows, out = [], []
                for i, t in enumerate(batch.column(1 + k).to_pylist()):
                    if t is None:
                        continue
                    new, channels, n = decoder.restore(t)
                    if n:
                        rows.append(i)
                        out.append((new, channels, n, LOST not in new and not _CONTROL.search(new)))
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([side] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    ["id", "side", "restored", "channels", "n_damaged", "complete"],
                )

    return base.mapInArrow(run, f"id {id_type}, side string, restored string, channels string, n_damaged int, complete boolean")
