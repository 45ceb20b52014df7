"""Records of evaluation splits that stand again, exactly or almost, in the training split."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.words import has_letter, mixed, word_hashes, words
from bitloom.llm.fm_index import FMIndex
from bitloom.operators.skew import many_to_many_join
from bitloom.scratch import materialise

#: Distinct evaluation sets of one shard of the index (about 40 MB for sentences).
SHARD = 150_000
#: Places that one step of the search looks up at once.
STEP = 3_000_000
#: Pairs of neighbours beyond the least number that are searched; a candidate needs as many matches more.
EXTRA = 2
#: Distinct evaluation sets beyond which sets without any possible match are dropped before the search.
FILTERED = 20_000
#: Pairs of neighbours in one part of the filter (about 8 MB).
PART = 400_000
#: Pairs that the filter compares at once; small enough for a cache.
NEAR_STEP = 200_000
#: Of a key of the filter the low bits are the size of the set, at most LARGEST; of larger sets only the pair counts.
LARGEST = (1 << 12) - 1
#: A pair of neighbours in the filter: hash and size of its set, sketch of the set, hash of the record or the set.
PAIR = np.dtype([("key", "<u8"), ("sketch", "<u8"), ("tag", "<i4")])
#: Cells of the table that says how common words are among the evaluation records: 4 MB, whatever the corpus.
LEVEL_BITS = 22
HASH_BITS = 57
PAD = np.int64(-1)


def breakable(n: np.ndarray, share: float) -> np.ndarray:
    """How many pairs of neighbours of a set of n words a match may lack at most.

    The words of all sets stand in one order. If a set has e words that the other lacks, and the other f words that
    this one lacks, each of the e spoils two pairs of neighbours at most and each of the f one (the gap it falls
    into). A Jaccard value of at least t means e + f <= (1/t - 1) * (n - e) and e <= (1 - t) * n. The result is the
    largest 2e + f.
    """
    ratio, most = 1 / share - 1, np.floor((1 - share) * n + 1e-9).astype(np.int64)
    out = np.zeros(len(n), dtype=np.int64)
    for e in range(int(most.max(initial=0)) + 1):
        out = np.where(e <= most, np.maximum(out, e + np.floor(ratio * (n - e) + 1e-9).astype(np.int64)), out)
    return out


def word_sets(left: list[str | None], right: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each record as hashes, flat; their number; and the rows with a letter in both texts."""
    rows = np.flatnonzero([has_letter(a) and has_letter(b) for a, b in zip(left, right, strict=True)])
    flat: list[int] = []
    counts = np.zeros(len(rows), dtype=np.int64)
    for k, i in enumerate(rows):
        own = set(words(left[i]))
        own.update(words(right[i]))
        flat += word_hashes(own)
        counts[k] = len(own)
    return np.array(flat, dtype=np.int64), counts, rows


def sorted_sets(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values with those of each set in ascending order."""
    return values[np.lexsort((values, np.repeat(np.arange(len(counts)), counts)))]


def word_numbers(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers that sort words by how common they are among the evaluation records (absent ones first), then by hash."""
    return levels[mixed(hashes, LEVEL_BITS)].astype(np.int64) << HASH_BITS | hashes & ((1 << HASH_BITS) - 1)


def prefix_length(counts: np.ndarray, share: float) -> np.ndarray:
    """Of two sets with a Jaccard value of at least ``share`` the first common word is among so many first words of each."""
    return np.minimum(counts, np.floor((1 - share) * counts + 1e-9).astype(np.int64) + 1)


def buckets(numbers: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each word."""
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def routes(values: np.ndarray, counts: np.ndarray, share: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, bucket) of the different buckets of the first words of each set, without words that no evaluation record has."""
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = (place < prefix_length(counts, share)[row]) & (values >> HASH_BITS > 0)
    key = np.unique(row[first] * n + buckets(values[first], n))
    return key // n, key % n


def padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets with a pad after each single word, so that every set has a pair of neighbours."""
    ends = np.cumsum(counts)
    return np.insert(values, ends[counts == 1], PAD), counts + (counts == 1)


def common_words(t: np.ndarray, e: np.ndarray, train: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of common words of train set t[i] and held-out set e[i], and the first of them (0 if none).

    Sets as (flat codes, begins); codes are those of the index (below 2^31), in ascending order of the words.
    """
    values, begins = train
    keys = np.repeat(np.arange(len(begins) - 1, dtype=np.int64), np.diff(begins)) << 32 | values
    sizes = np.diff(held[1])[e]
    starts = np.repeat(held[1][:-1][e], sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = held[0][starts + at].astype(np.int64)
    wanted = np.repeat(t.astype(np.int64), sizes) << 32 | codes
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    hit = (keys[place] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)
    pair, first_hit, n = np.unique(np.repeat(np.arange(len(t)), sizes)[hit], return_index=True, return_counts=True)
    common, first = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
    common[pair], first[pair] = n, codes[hit][first_hit]
    return common, first


def most_different(n: np.ndarray, m: np.ndarray, share: float) -> np.ndarray:
    """How many words at most only one of two sets of n and m words has, if they have a Jaccard value of ``share``."""
    return np.floor((n + m) * (1 - share) / (1 + share) + 1e-9).astype(np.int64)


def sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 parities of each set, of at least one word; two sets differ in no more parities than words."""
    bits = np.uint64(1) << ((values.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, np.cumsum(counts) - counts) if len(counts) else bits


def neighbours(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, hash, whether evaluation records may have both words) of all pairs of neighbours."""
    pattern, size = padded(values, counts)
    row = np.repeat(np.arange(len(counts)), size)
    front = np.flatnonzero(row[1:] == row[:-1])
    known = (pattern >> HASH_BITS > 0) | (pattern == PAD)
    a, b = pattern[front].astype(np.uint64), pattern[front + 1].astype(np.uint64)
    mix = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    mix = (mix ^ (mix >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return row[front], mix ^ (mix >> np.uint64(31)), known[front] & known[front + 1]


def rarest(row: np.ndarray, rank: np.ndarray, counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The places of the ``most`` pairs of each set with the lowest rank (0 .. 63)."""
    order = np.argsort(row << 6 | rank, kind="stable")
    return order[np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(most, counts)]


def filter_pairs(values: np.ndarray, counts: np.ndarray, tags: np.ndarray, levels: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
    """The pairs of neighbours of each set, or the ``most`` rarest of them by the table, as far as an evaluation record may have them."""
    row, mix, known = neighbours(values, counts)
    if levels is not None:
        chosen = rarest(row, np.where(known, levels[mixed(mix, LEVEL_BITS)], 0), counts - (counts > 1), most)
        row, mix, known = row[chosen], mix[chosen], known[chosen]
    row, mix = row[known], mix[known]
    out = np.empty(len(row), dtype=PAIR)
    out["key"] = mix & ~np.uint64(LARGEST) | np.minimum(counts, LARGEST).astype(np.uint64)[row]
    out["sketch"] = sketches(values, counts)[row]
    out["tag"] = tags[row]
    return out


def parts_of(pairs: np.ndarray, n_parts: int) -> tuple[list[int], list[bytes]]:
    """The pairs of each part of the filter, by the hash of the pair alone."""
    part = ((pairs["key"] >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    some, begins = np.unique(part[order], return_index=True)
    ordered = pairs[order]
    return some.tolist(), [ordered[i:j].tobytes() for i, j in zip(begins, [*begins[1:], len(ordered)], strict=True)]


def near_sets(asked: np.ndarray, held: np.ndarray, share: float) -> np.ndarray:
    """(tag, tag) of sets that have a pair of neighbours in common and may have a Jaccard value of ``share``; held: by key."""
    keys, marks, tags = (np.ascontiguousarray(held[c]) for c in ("key", "sketch", "tag"))
    asked = asked[np.argsort(asked["key"])]  # places in order are found several times as fast
    n = (asked["key"] & np.uint64(LARGEST)).astype(np.int64)
    pair = asked["key"] & ~np.uint64(LARGEST)
    least = np.ceil(n * share - 1e-9).astype(np.uint64)
    largest = np.where(n == LARGEST, LARGEST, np.minimum(LARGEST, np.floor((n + 1e-9) / share))).astype(np.uint64)
    low = np.searchsorted(keys, pair | least)
    width = np.searchsorted(keys, pair | largest, side="right") - low
    some = np.flatnonzero(width)
    low, width, n, mark, tag = low[some], width[some], n[some], asked["sketch"][some], asked["tag"][some]
    out, before = [np.empty((0, 2), dtype=np.int32)], np.concatenate([[0], np.cumsum(width)])
    begin = 0
    while begin < len(low):
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + NEAR_STEP, side="right")) - 1)
        w = width[begin:end]
        at = np.repeat(low[begin:end] - (before[begin:end] - before[begin]), w) + np.arange(before[end] - before[begin])
        apart = np.bitwise_count(np.repeat(mark[begin:end], w) ^ marks[at])
        near = np.flatnonzero(apart <= np.repeat(np.minimum(64, most_different(n[begin:end], np.minimum(LARGEST, np.floor(n[begin:end] / share + 1e-9)), share)), w))
        one, at, apart = np.repeat(np.arange(begin, end), w)[near], at[near], apart[near]
        m = (keys[at] & np.uint64(LARGEST)).astype(np.int64)
        fit = (apart <= most_different(n[one], m, share)) | (n[one] == LARGEST) | (m == LARGEST)
        out.append(np.unique(np.stack([tag[one[fit]], tags[at[fit]]], axis=1), axis=0))
        begin = end
    return np.concatenate(out)


class Shard:
    """One shard: the index over its sets and their keys; it answers for the pairs whose first common word is in its bucket."""

    def __init__(self, index: FMIndex, keys: list[bytes], bucket: int, n_buckets: int):
        self.index, self.keys, self.bucket, self.n_buckets = index, keys, bucket, n_buckets
        real = (index.text > 0) & ((index.symbols[np.maximum(index.text, 1) - 1] != PAD) if len(index.symbols) else False)
        total = np.concatenate([[0], np.cumsum(real)])
        self.sets = index.text[real]
        self.begins = np.append(total[index.first], total[-1])
        self.sizes = np.diff(self.begins)

    @classmethod
    def build(cls, packed: list[bytes], keys: list[bytes], bucket: int = 0, n_buckets: int = 1) -> Shard:
        counts = np.array([len(p) // 8 for p in packed], dtype=np.int64)
        return cls(FMIndex.build(*padded(np.frombuffer(b"".join(packed), dtype=np.int64), counts)), keys, bucket, n_buckets)

    def dumps(self) -> bytes:
        out, i = io.BytesIO(), self.index
        np.savez_compressed(out, symbols=i.symbols, text=i.text, suffixes=i.suffixes, places=i.places, keys=np.frombuffer(b"".join(self.keys), dtype=np.uint8), bucket=[self.bucket, self.n_buckets])
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        z = np.load(io.BytesIO(data))
        keys = z["keys"].tobytes()
        return cls(FMIndex(z["symbols"], z["text"], z["suffixes"], z["places"]), [keys[k : k + 16] for k in range(0, len(keys), 16)], *map(int, z["bucket"]))

    def search(self, values: np.ndarray, counts: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(train row, held-out set, common words, maximal matches, words in them) of all pairs at or above ``share``."""
        index = self.index
        pattern, size = padded(values, counts)
        row = np.repeat(np.arange(len(counts)), size)
        codes = index.encode(pattern)
        # backward search: each word is a pattern, then the word before it is put in front
        front = np.flatnonzero(row[1:] == row[:-1])
        low, high = index.start(codes[front + 1])
        low, high = index.extend(codes[front], low, high)
        width = high - low
        # of all pairs of a set only the rarest are located, as many as a match cannot lack, and a few more
        pairs_of = size - 1
        lacking = breakable(counts, share)
        extra = np.minimum(EXTRA, pairs_of - lacking)
        order = np.lexsort((width, row[front]))
        place = np.arange(len(order)) - np.repeat(np.cumsum(pairs_of) - pairs_of, pairs_of)
        chosen = np.sort(order[(place < np.repeat(lacking + extra, pairs_of)) & (width[order] > 0)])
        low, width, front = low[chosen], width[chosen], front[chosen]
        if not len(low):
            return
        own = codes[pattern != PAD]
        known = own > 0
        train = (own[known], np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(counts)])])
        # rows in steps of bounded size; a row is never divided
        found = np.bincount(row[front], weights=width.astype(np.float64), minlength=len(counts)).cumsum()
        step_of = (found[row[front]] // STEP).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(step_of)) + 1), len(front)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            w = width[begin:end]
            at = np.repeat(low[begin:end], w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            here, there = np.repeat(front[begin:end], w), index.suffixes[at].astype(np.int64)
            seed = row[here].astype(np.int64) << 32 | index.owner[there]
            key, back, pairs = np.unique(seed, return_inverse=True, return_counts=True)
            t, e = key >> 32, key & 0xFFFFFFFF
            n, m = counts[t], self.sizes[e]
            fit = (pairs >= extra[t]) & (m >= share * n - 1e-9) & (n >= share * m - 1e-9)
            if not fit.any():
                continue
            number = np.cumsum(fit) - 1
            t, e, n, m = t[fit], e[fit], n[fit], m[fit]
            kept = fit[back]
            spans, inside = self._maximal(codes, row, here[kept], there[kept], number[back[kept]], len(t))
            common, first = common_words(t, e, train, (self.sets, self.begins))
            # in whole numbers where the share is a decimal: common / (n + m - common) >= share
            good = common * 1_000_000 >= round(share * 1_000_000) * (n + m - common)
            good &= buckets(index.symbols[np.maximum(first, 1) - 1], self.n_buckets) == self.bucket
            yield t[good], e[good], common[good], spans[good], inside[good]

    def _maximal(self, codes: np.ndarray, row: np.ndarray, here: np.ndarray, there: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Matches extended to both sides as far as they go, those that became the same merged: their number and words for each pair."""
        text = self.index.text

        def grow(at: np.ndarray, to: np.ndarray, step: int) -> np.ndarray:
            moved, active = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
            while len(active):
                x, y = at[active] + step * (moved[active] + 1), to[active] + step * (moved[active] + 1)
                inside = (x >= 0) & (x < len(codes)) & (y >= 0) & (y < len(text))
                active, x, y = active[inside], x[inside], y[inside]
                same = (row[x] == row[at[active]]) & (codes[x] > 0) & (codes[x] == text[y])
                active = active[same]
                moved[active] += 1
            return moved

        back, ahead = grow(here, there, -1), grow(here + 1, there + 1, 1)
        begin, length = here - back, back + ahead + 2
        _, first = np.unique(pair * (len(codes) + 1) + begin, return_index=True)
        pads = (self.index.symbols[codes[begin[first] + length[first] - 1] - 1] == PAD).astype(np.int64)
        spans = np.bincount(pair[first], minlength=n)
        return spans, np.bincount(pair[first], weights=length[first] - pads, minlength=n).astype(np.int64)


def _payload(uri: str) -> bytes:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri else (pyarrow.fs.LocalFileSystem(), uri)
    return pyarrow.parquet.read_table(path, filesystem=fs, columns=["payload"]).column(0)[0].as_py()


_loaded: dict[str, Shard] = {}


def load_shard(uri: str) -> Shard:
    """A shard from the shared folder; the last one is kept by the worker."""
    if uri not in _loaded:
        _loaded.clear()
        _loaded[uri] = Shard.loads(_payload(uri))
    return _loaded[uri]


def _levels(held: DataFrame, hashes_of: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda values, counts: values) -> np.ndarray:
    """How common the words of each cell (or other hashes) are among the evaluation records: 0 for none, else 1 + 1.5 log2 of their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << LEVEL_BITS, dtype=np.int64)
        for batch in batches:
            np.add.at(total, mixed(hashes_of(*_flat(batch.column(0).to_pylist())), LEVEL_BITS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    table = held.select("words").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    out[table.column("cell").to_numpy()] = np.minimum(63, 1 + 1.5 * np.log2(table.column("n").to_numpy()))
    return out


def _flat(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(packed), dtype=np.int64), np.array([len(p) // 8 for p in packed], dtype=np.int64)


def _packed(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts)
    return [values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]


_part: dict[str, np.ndarray] = {}


def load_part(uri: str) -> np.ndarray:
    """A part of the filter from the shared folder; the last one is kept by the worker."""
    if uri not in _part:
        _part.clear()
        _part[uri] = np.frombuffer(_payload(uri), dtype=PAIR)
    return _part[uri]


def possible(training: DataFrame, distinct: DataFrame, numbers: Callable[[list, list], tuple[np.ndarray, np.ndarray, np.ndarray]], renumbered: Callable[[np.ndarray, np.ndarray], np.ndarray], n_pairs: int, share: float) -> tuple[DataFrame, DataFrame]:
    """``training`` and ``distinct`` without sets that cannot have a match, and a few more by chance of 32-bit hashes.

    A match lacks at most K pairs of neighbours (see breakable), so any K + 1 pairs of a training set do as keys: those
    that are rarest in a table of fixed size. They meet all pairs of the evaluation sets, by the hash of the pair; each
    brings 64 parities of its set along, in which similar sets cannot differ more than in words. Each pair is looked up
    once, in one part of about PART pairs, so the cost of the keys grows with training alone; that of the comparisons
    grows also with the number of evaluation sets that share a rare pair. The training records are read once more.
    """
    sc = training.sparkSession.sparkContext
    n_parts = -(-n_pairs // PART)
    pair_levels = sc.broadcast(_levels(distinct.select("words"), lambda values, counts: neighbours(renumbered(values, counts), counts)[1].view(np.int64)))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = _flat(batch.column(1).to_pylist())
            part, pairs = parts_of(filter_pairs(renumbered(values, counts), counts, batch.column(0).to_numpy()), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(pairs, pa.binary())], ["part", "pairs"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = np.frombuffer(b"".join(pdf["pairs"]), dtype=PAIR)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "payload": [pairs[np.argsort(pairs["key"])].tobytes()]})

    parts = distinct.select(F.hash("set_key").alias("tag"), "words").mapInArrow(held, "part bigint, pairs binary").groupBy("part").applyInPandas(build, "part bigint, payload binary")
    index = materialise(parts, "part", partitions=n_parts, rows_a_file=1)
    places = sc.broadcast({r["part"]: r["f"] for r in index.select("part", F.input_file_name().alias("f")).collect()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts, rows = numbers(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            tags = batch.column(0).to_numpy()[rows]
            part, pairs = parts_of(filter_pairs(values, counts, tags, pair_levels.value, breakable(counts, share) + 1), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(pairs, pa.binary())], ["part", "pairs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin < end and runs[begin] in places.value:
                    asked = np.frombuffer(b"".join(batch.column(1).slice(begin, end - begin).to_pylist()), dtype=PAIR)
                    found = near_sets(asked, load_part(places.value[runs[begin]]), share)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["of_train", "of_held"])

    asked = training.select(F.hash("id").alias("tag"), "a", "b").mapInArrow(ask, "part bigint, pairs binary")
    near = materialise(asked.hint("rebalance", "part").sortWithinPartitions("part").mapInArrow(meet, "of_train int, of_held int"))
    kept = [df.join(F.broadcast(near.select(F.col(c).alias("tag")).distinct()), F.hash(k) == F.col("tag"), "left_semi") for df, k, c in ((training, "id", "of_train"), (distinct, "set_key", "of_held"))]
    return kept[0], materialise(kept[1])


def split_overlap(records: DataFrame, id_col: str, left: str, right: str, split_col: str, train: str = "train", share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near-copies of evaluation records in training: (matches, members).

    matches: ``train_id``, ``set_key``, ``common`` (words), ``jaccard``, ``n_spans``, ``span_words``: one row for each
    training record and each *distinct* evaluation word set that has at least ``share`` of the words of either in
    common. members: ``set_key``, ``eval_id``: the evaluation records of each set; copies are thus not expanded.
    Records without a letter in one of the texts, or with a null split, take part in nothing. The result is exact.

    The evaluation splits are the stated query set. Words stand in the order of their frequency there (rare first, by
    a table of fixed size) and hash. The distinct sets are put into Burrows-Wheeler indexes of about SHARD sets,
    written to the shared folder. Training is streamed through backward search: of the pairs of neighbouring words of
    a training set the rarest in the index are located, as many as every match must share some of (see breakable). For
    the evaluation sets with enough of them, matches are extended to maximal ones, merged into spans and counted
    (``n_spans``, ``span_words``), and both sets are compared in full. Maximal matches alone would not do: a set that
    shares a shorter run than another one is found through the pairs only.

    Beyond FILTERED distinct sets those of both sides that cannot have a match are dropped first (see possible), so that
    the indexes and the search take in little more than the matches; nothing is decided there.

    One shard needs no shuffle of training sets. Where there are more, a set stands in the buckets of its first (rarest)
    words, since two similar sets share one of those (see prefix_length); a bucket of more than SHARD sets is divided.
    Training sets are shuffled to the shards of their own first words that occur in the evaluation records at all, so
    the cost grows with training and not with training times shards, a task reads each of its shards once, and large
    partitions are divided by Spark (rebalance). A pair counts in the bucket of its first common word.
    """
    base = records.select(F.col(id_col).alias("id"), F.col(left).alias("a"), F.col(right).alias("b"), (F.col(split_col) == train).alias("is_train")).where("is_train is not null")
    id_type = dict(base.dtypes)["id"]
    sc = records.sparkSession.sparkContext

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts, rows = word_sets(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            packed = _packed(sorted_sets(values, counts), counts)
            keys = [xxhash.xxh3_128_digest(p) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["id", "set_key", "words"])

    held = materialise(base.where("not is_train").select("id", "a", "b").mapInArrow(keyed, f"id {id_type}, set_key binary, words binary"))
    members = held.select("set_key", F.col("id").alias("eval_id"))
    levels = sc.broadcast(_levels(held))
    distinct = materialise(held.groupBy("set_key").agg(F.first("words").alias("words")))
    training = base.where("is_train").select("id", "a", "b")

    def renumbered(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sorted_sets(word_numbers(values, levels.value), counts)

    def numbers(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, counts, rows = word_sets(a, b)
        return renumbered(values, counts), counts, rows

    size = (F.count(F.lit(1)), F.sum(F.floor(F.octet_length("words") / 8 * (1 - share) + 1e-9) + 1), F.sum(F.octet_length("words") / 8).cast("bigint"))
    sized = distinct.agg(*size).first()
    if sized[0] > FILTERED:
        training, distinct = possible(training, distinct, numbers, renumbered, sized[2], share)
        sized = distinct.agg(*size).first()
    n_buckets = 1 if sized[0] <= SHARD else -(-sized[1] // SHARD)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = _flat(batch.column(1).to_pylist())
            values = renumbered(values, counts)
            own, bucket = routes(values, counts, share, n_buckets) if n_buckets > 1 else (np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))
            packed = _packed(values, counts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0).take(pa.array(own)), pa.array([packed[i] for i in own], pa.binary())], ["bucket", "set_key", "words"])

    routed = materialise(distinct.select("set_key", "words").mapInArrow(route, "bucket bigint, set_key binary, words binary"))
    full = {r["bucket"]: -(-r["n"] // SHARD) for r in routed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).collect()} if n_buckets > 1 else {}
    parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in full.items() for x in p)), "bucket"), F.lit(1)) if full else F.lit(1)
    sharded = routed.withColumn("part", F.pmod(F.xxhash64("set_key"), parts.cast("bigint")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("set_key")
        bucket, part = int(pdf["bucket"].iloc[0]), int(pdf["part"].iloc[0])
        return pd.DataFrame({"bucket": [bucket], "part": [part], "payload": [Shard.build(list(pdf["words"]), list(pdf["set_key"]), bucket, n_buckets).dumps()]})

    shards = sharded.groupBy("bucket", "part").applyInPandas(build, "bucket bigint, part bigint, payload binary")
    index = materialise(shards, "bucket", "part", partitions=n_buckets + sum(full.values()), rows_a_file=1)
    files: dict[int, list[str]] = {}
    for r in index.select("bucket", F.input_file_name().alias("f")).orderBy("bucket", "f").collect():
        files.setdefault(r["bucket"], []).append(r["f"])
    places = sc.broadcast(files)  # a path for each shard of SHARD sets
    columns = ["train_id", "set_key", "common", "jaccard", "n_spans", "span_words"]

    def found(shard: Shard, ids: pa.Array, values: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, e, common, spans, inside in shard.search(values, counts, share):
            jaccard = common / np.maximum(1, counts[t] + shard.sizes[e] - common)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(t)), pa.array([shard.keys[i] for i in e], pa.binary()), *(pa.array(x.astype(np.int64)) for x in (common,)), pa.array(jaccard.astype(np.float64)), pa.array(spans.astype(np.int64)), pa.array(inside)], columns
            )

    def numbers_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        values, counts, rows = numbers(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        return values, counts, batch.column(0).take(pa.array(rows))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts, ids = numbers_of(batch)
            for uri in places.value.get(0, ()):
                yield from found(load_shard(uri), ids, values, counts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts, ids = numbers_of(batch)
            packed = _packed(values, counts)
            row, bucket = routes(values, counts, share, n_buckets)
            uris = [places.value.get(b, ()) for b in bucket.tolist()]
            many = np.repeat(row, [len(u) for u in uris])
            yield pa.RecordBatch.from_arrays([pa.array([f for u in uris for f in u], pa.string()), ids.take(pa.array(many)), pa.array([packed[i] for i in many], pa.binary())], ["uri", "id", "words"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin < end:
                    packed = batch.column(2).slice(begin, end - begin).to_pylist()
                    counts = np.array([len(p) // 8 for p in packed], dtype=np.int64)
                    yield from found(load_shard(runs[begin]), batch.column(1).slice(begin, end - begin), np.frombuffer(b"".join(packed), dtype=np.int64), counts)

    schema = f"train_id {id_type}, set_key binary, common bigint, jaccard double, n_spans bigint, span_words bigint"
    if n_buckets == 1:
        return training.mapInArrow(stream, schema), members
    placed = training.mapInArrow(spread, f"uri string, id {id_type}, words binary").hint("rebalance", "uri").sortWithinPartitions("uri")
    return placed.mapInArrow(search, schema), members


def overlap_pairs(records: DataFrame, id_col: str, left: str, right: str, split_col: str, share: float = 0.8) -> DataFrame:
    """Every pair of a training and an evaluation record at or above ``share``, the smaller id first.

    The matches are written once; sets with very many records on both sides are joined by a grid of tasks.
    """
    matches, members = split_overlap(records, id_col, left, right, split_col, share=share)
    pairs = many_to_many_join(materialise(matches), members, ["set_key"])
    return pairs.select(F.least("train_id", "eval_id").alias("pair_id_a"), F.greatest("train_id", "eval_id").alias("pair_id_b"), "train_id", "eval_id", "common", "jaccard", "n_spans", "span_words").distinct()


def overlap_report(records: DataFrame, id_col: str, left: str, right: str, split_col: str, source_col: str, share: float = 0.8) -> DataFrame:
    """For each evaluation split and source: its records, how many overlap with training, and the overlapping pairs."""
    pairs = materialise(overlap_pairs(records, id_col, left, right, split_col, share).select("eval_id"))
    per = pairs.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"))
    own = records.where(F.col(split_col) != "train").select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return (
        own.join(per, "eval_id", "left")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    )
