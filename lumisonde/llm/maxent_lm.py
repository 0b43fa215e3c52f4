"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

*Factors.* A word's class is a hash of its last three bytes. The probability of a word is
that of its class given the two words before it, times that of the word within the class
given the word before it. The most frequent words (``HOT``) are outcomes of their own;
the others of a class share one outcome, within which they keep their smoothed share of the counts.
*Class factor.* A softmax over the classes and the end, whose hashed features are the word
before, the word before that (a skip feature), and both together. Texts are dealt into shards
by a hash of each, and ordered by it; a shard follows the gradient over its texts in numpy batches, all
starting from the same weights; the changes are averaged, each feature's by how often the shard has seen it. Shards and their order
depend on the texts alone, so files, partitions and cluster do not change a score.
*Word factor.* A feature for each pair of a word and the outcome after it that the
training texts have; their number grows with the corpus. Pairs are keyed by a hash of the word
before and the class (32 bits), and the outcome. Pairs of one key make one softmax, so
parts of the range of keys are trained apart from each other: gradient steps over all
pairs of a part at once, with a Gaussian prior.
*Scoring.* Tasks turn texts into sparse batches: the keys that a batch needs, with the number
of the text, packed by part. They meet the part's pairs and the counts of rarer words in one
shuffle, are answered by sums per text, and go back to their batch in a second one.

Defined cases: null text counts as empty; an empty text is the end token alone; repeated
rows each get their score; without training texts all counts are zero; a null doc_id
is a training row; an empty table gives an empty table; other columns are ignored. Words
outside the HOT most frequent are looked up by 64 bits of hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.llm.common import cleaned, most_frequent, packed, unpacked, words, written

CLASSES = 32
#: The class of the start and the end of a text.
EDGE = CLASSES
OUT = CLASSES + 1
#: Words that are outcomes of their own, held by every task; words that are class features of their own, the others of a class being one.
HOT, CONTEXTS = 262_144, 8192
#: Hashed features of two words, for the class.
PAIRS = 1 << 13
#: Rounds over the texts for the classes; rounds over the pairs of a part; precision of the prior on a pair's weight.
ROUNDS, STEPS, PENALTY = 1, 20, 0.5
#: Weight of a class feature's start, in words, and share of a word's curvature that one of its features answers for.
START, CURVE = 4.0, 0.5
#: Different words that a counting task holds, words of one numpy batch, and of one step of the gradient.
HELD_WORDS, BATCH_WORDS, STEP_WORDS = 250_000, 1_000_000, 50_000
#: Targets whose class probabilities are worked out at a time, so that they stay in a core's cache; logarithms that float32 can raise as they are.
BLOCK, SAFE = 4096, 60
#: Training tokens whose pairs make one part.
PART_TOKENS = 2_000_000
#: Training tokens of a shard, on average.
SHARD_TOKENS = 2_000_000
EDGE_HASH, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ROWS = "part int, kind int, chunk long, keys binary, more binary"
#: What a row of ROWS holds: counts of pairs, counts of words, keys of pairs or words that texts ask for, the texts.
PAIR_COUNTS, WORD_COUNTS, PAIR_KEYS, WORD_KEYS, TEXTS = range(5)


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether the identifier's fold is the one kept from learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def classes_of(ws: list[bytes]) -> np.ndarray:
    """The class of each word, from its last three bytes."""
    if not ws:
        return np.empty(0, np.int64)
    raw = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(ws), np.uint8)
    end = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 3) - 1
    a, b, c = (raw[end - k].astype(np.uint32) for k in range(3))
    h = (a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ c * np.uint32(3266489917)) * np.uint32(668265263)
    return (h >> np.uint32(27)).astype(np.int64)


def hashes_of(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


class Held:
    """The words that a task holds, by number, and how many there may be."""

    def __init__(self, ws: list[bytes], most: int):
        self.most = most
        self.number = {w: i for i, w in enumerate(ws)}.get
        # the last one is that of no word, which number -1 finds
        self.hashes, self.classes = np.append(hashes_of(ws), EDGE_HASH), np.append(classes_of(ws), EDGE)


class Batch:
    """Texts as arrays of places: two edges before each text, its words, and one edge, its end. Targets are words and ends."""

    def __init__(self, texts: list[list[bytes]], held: Held):
        ws = list(chain.from_iterable(texts))
        n = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(n + 3) - n - 1
        is_word = np.ones(int((n + 3).sum()), bool)
        is_word[first - 2] = is_word[first - 1] = is_word[first + n] = False
        target = is_word.copy()
        target[first + n] = True
        self.at, self.most = np.flatnonzero(target), held.most
        self.word_at = np.flatnonzero(is_word[self.at])  # among targets
        self.lengths, self.owner = n + 1, np.repeat(np.arange(len(n)), n + 1)
        own = np.fromiter(map(held.number, ws, repeat(-1)), np.int64, len(ws))
        hashed, cls = held.hashes[own], held.classes[own]
        cold = np.flatnonzero(own < 0)
        rare = [ws[i] for i in cold.tolist()]
        hashed[cold], cls[cold] = hashes_of(rare), classes_of(rare)
        self.number, self.cls, self.hash = np.full(len(is_word), -1), np.full(len(is_word), EDGE), np.full(len(is_word), EDGE_HASH)
        self.number[is_word], self.cls[is_word], self.hash[is_word] = own, cls, hashed

    @property
    def outcome(self) -> np.ndarray:
        """Of each word target: its number, or that of the rest of its class."""
        at = self.at[self.word_at]
        return np.where(self.number[at] >= 0, self.number[at], self.most + self.cls[at])

    def features(self) -> np.ndarray:
        """Rows of the class weights for each target, besides row 0, the bias."""
        ctx = np.where((self.number >= 0) & (self.number < CONTEXTS), self.number, CONTEXTS + self.cls)
        one, two = ctx[self.at - 1], ctx[self.at - 2]
        both = (one.astype(np.uint64) * EDGE_HASH + two.astype(np.uint64) * ODD) >> np.uint64(40)
        return np.stack((1 + one, 1 + CONTEXTS + OUT + two, 1 + 2 * (CONTEXTS + OUT) + (both % np.uint64(PAIRS)).astype(np.int64)))

    def keys(self) -> np.ndarray:
        """Of each word target: 32 bits of hash of the word before and the class, then the outcome."""
        at = self.at[self.word_at]
        group = (self.hash[at - 1] ^ (self.cls[at].astype(np.uint64) * ODD)) * EDGE_HASH >> np.uint64(32)
        return group << np.uint64(32) | self.outcome.astype(np.uint64)


def batched(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[tuple[list, Batch]]:
    """(doc_ids, Batch) of about BATCH_WORDS words; a text is never cut."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"].to_pylist(), b["text"]):
            ids.append(i)
            texts.append(words(t.as_py()))
            size += len(texts[-1])
            if size >= BATCH_WORDS or len(texts) >= 20_000:
                yield ids, Batch(texts, held)
                ids, texts, size = [], [], 0
    if texts:
        yield ids, Batch(texts, held)


# -- packed arrays, dealt by parts ----------------------------------------------------------


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def dealt(keys: np.ndarray, more: np.ndarray, parts: int, kind: int, chunk: int) -> pa.RecordBatch:
    """Sorted keys, and a number for each, as rows of ROWS, one a part."""
    part = part_of(keys, parts)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(keys) else np.empty(0, np.int64)
    rows = [(int(part[a]), kind, chunk, packed(np.diff(keys[a:z], prepend=np.uint64(0))), packed(more[a:z])) for a, z in zip(at, np.append(at[1:], len(keys)))]
    return pa.RecordBatch.from_pylist([dict(zip(("part", "kind", "chunk", "keys", "more"), r)) for r in rows], SCHEMA)


SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys))).astype(np.uint64)


# -- counting and training --------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, n); the number of texts has a null word."""
    held: Counter = Counter()
    texts = 0

    def sent(ws: list[bytes | None], cls: np.ndarray, n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array(cls.astype(np.int32)), pa.array(n, pa.int64())], names=["word", "cls", "n"])

    for b in batches:
        for t in b["text"]:
            held.update(words(t.as_py()))
            if len(held) > HELD_WORDS:
                yield sent(list(held), classes_of(list(held)), list(held.values()))
                held = Counter()
        texts += b.num_rows
    if held:
        yield sent(list(held), classes_of(list(held)), list(held.values()))
    yield sent([None], np.array([EDGE]), [texts])


def class_powers(w: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, OUT) logarithms of the classes' probabilities up to a number for each target, their powers, and the powers' sums."""
    z = w[features[0]]
    for f in features[1:]:
        z += w[f]
    z += w[0]
    if z.size and not (z.max() < SAFE and z.min() > -SAFE):
        z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], e.dtype)


def class_log(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural logarithms of the classes' probabilities: (targets, OUT)."""
    z, _, total = class_powers(w, features)
    return z - np.log(total)[:, None]


def class_log_of(w: np.ndarray, features: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each target's own class."""
    found = np.empty(len(out))
    for a in range(0, len(out), BLOCK):
        z, _, total = class_powers(w, features[:, a : a + BLOCK])
        found[a : a + BLOCK] = z[np.arange(len(z)), out[a : a + BLOCK]] - np.log(total)
    return found


def follow(w: np.ndarray, seen: np.ndarray, b: Batch) -> None:
    """Gradient steps over a batch; w are the weights, seen how often each feature has occurred. Both are changed."""
    features, out = b.features(), b.cls[b.at]
    for a in range(0, len(out), STEP_WORDS):
        f, o = features[:, a : a + STEP_WORDS], out[a : a + STEP_WORDS]
        d = np.empty((len(o), w.shape[1]), w.dtype)
        for i in range(0, len(o), BLOCK):
            _, e, total = class_powers(w, f[:, i : i + BLOCK])
            np.divide(e, total[:, None], out=d[i : i + BLOCK])
        d[np.arange(len(o)), o] -= 1
        w[0] -= d.sum(0) / (CURVE * (seen[0] + len(o)) + START)
        seen[0] += len(o)
        by_class = np.ascontiguousarray(d.T, float)
        for x in f:
            low = x.min()
            n = np.bincount(x - low)
            rows = np.flatnonzero(n)
            moved = np.stack([np.bincount(x - low, c)[rows] for c in by_class], 1)
            seen[low + rows] += n[rows]
            w[low + rows] -= moved / (CURVE * seen[low + rows] + START)[:, None]


def train_classes(docs: DataFrame, ws: list[bytes], most: int, start: np.ndarray, rounds: int, groups: int, shards: int) -> np.ndarray:
    """Class weights after rounds over all texts, dealt into shards; the shards' changes are added up in so many groups."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    dealt_ = docs.withColumn("h", F.xxhash64("doc_id", "text")).repartition(shards, "h").sortWithinPartitions("h").select("doc_id", "text")
    w = np.zeros((1 + 2 * (CONTEXTS + OUT) + PAIRS, OUT), np.float32)
    w[0] = np.log(start + 0.5)
    seen = np.zeros(len(w), np.float32)
    for _ in range(rounds):
        sent = sc.broadcast((ws, w, seen))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ws, w, before = sent.value
            own, seen = w.copy(), before.copy()
            for _, b in batched(batches, Held(ws, most)):
                follow(own, seen, b)
            n = seen - before
            shard = TaskContext.get().partitionId()
            rows = np.flatnonzero(n).astype(np.int32)
            if len(rows):
                d = ((own - w) * n[:, None])[rows]
                cols = [pa.array([shard % groups]), pa.array([shard]), pa.array([packed(rows)]), pa.array([packed(n[rows])]), pa.array([packed(d.ravel())])]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "shard", "rows", "n", "d"])

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, d, tasks = np.zeros(len(seen), np.float32), np.zeros(w.shape, np.float32), 0
            for b in batches:
                tasks += b.num_rows
                for r in b.to_pylist():
                    rows = unpacked(r["rows"], np.int32)
                    n[rows] += unpacked(r["n"], np.float32)
                    d[rows] += unpacked(r["d"], np.float32).reshape(-1, OUT)
            if tasks:
                yield pa.RecordBatch.from_arrays([pa.array([tasks]), pa.array([n.tobytes()]), pa.array([d.tobytes()])], names=["tasks", "n", "d"])

        moved = dealt_.mapInArrow(run, "i long, shard long, rows binary, n binary, d binary").repartition(groups, "i").sortWithinPartitions("i", "shard")
        with cleaned(spark):
            sums = moved.mapInArrow(together, "tasks long, n binary, d binary").collect()  # at most groups rows, each of the model's size
        n = sum((np.frombuffer(r["n"], np.float32) for r in sums), np.zeros(len(w), np.float32))
        d = sum((np.frombuffer(r["d"], np.float32).reshape(w.shape) for r in sums), np.zeros_like(w))
        w, seen = w + d / np.maximum(n, 1)[:, None], seen + n / max(1, sum(r["tasks"] for r in sums))
        sent.destroy()
    return w


def train_pairs(keys: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct sorted keys with counts: by how much each pair's logarithm differs from its share's; then the groups, and that of other outcomes.

    share: of each outcome within its class. Groups, which do not touch each other, are trained some at a time.
    """
    group = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    cuts = at[np.unique(np.searchsorted(at, np.arange(0, len(keys), 8 * BLOCK)).clip(max=len(at) - 1))].tolist()
    found = [_train_groups(keys[a:z], n[a:z], share, at[slice(*np.searchsorted(at, (a, z)))] - a) for a, z in zip(cuts, [*cuts[1:], len(keys)])]
    return np.concatenate([x for x, _ in found]), group[at], np.concatenate([x for _, x in found])


def _train_groups(keys: np.ndarray, n: np.ndarray, share: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some groups, which begin at these places: all pairs step at once, by a bound of the curvature."""
    sizes = np.diff(np.append(at, len(keys)))
    wide = lambda x: np.repeat(x, sizes)
    p0 = share[(keys & np.uint64(2**32 - 1)).astype(np.int64)]
    total, other = wide(np.add.reduceat(n, at).astype(float)), np.maximum(1 - np.add.reduceat(p0, at), 0)
    theta = np.zeros(len(keys))
    for _ in range(STEPS):
        e = p0 * np.exp(theta)
        z = other + np.add.reduceat(e, at)
        p = e / wide(z)
        theta += np.clip((n - total * p - PENALTY * theta) / (total * p + PENALTY), -2, 2)
    z = np.log(other + np.add.reduceat(p0 * np.exp(theta), at))
    return theta - wide(z), -z


@dataclass
class Model:
    """Counts and weights. Small parts are arrays; words and pairs are tables."""

    table: DataFrame  # word, cls, c
    pairs: DataFrame  # rows of ROWS
    parts: int
    tokens: int
    vocabulary: int
    ends: int
    words: list[bytes]
    counts: np.ndarray  # of words
    share: np.ndarray  # of each outcome within its class
    rest: np.ndarray  # log10 of the smoothed counts of the rest of each class
    weights: np.ndarray  # of the class features


def fit(docs: DataFrame, rounds: int = ROUNDS, most: int = HOT) -> Model:
    """Counts and weights from all rows of docs (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    sc = slim.sparkSession.sparkContext
    table = written(slim.mapInArrow(_count_words, "word binary, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n")), "words")
    by_class = {r["cls"]: (r["c"], r["v"]) for r in table.groupBy("cls").agg(F.sum("n").alias("c"), F.count("word").alias("v")).collect()}  # OUT rows
    start, sizes = (np.array([by_class.get(i, (0, 0))[k] for i in range(OUT)], float) for k in (0, 1))
    ends = int(start[EDGE])
    table = table.where("word is not null")
    hot = most_frequent(table, most)[0].toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # at most so many rows
    ws, counts, cls = hot["word"].to_pylist(), hot["n"].to_numpy(), hot["cls"].to_numpy()
    rest = start[:CLASSES] - np.bincount(cls, counts, CLASSES) + 0.5 * (sizes[:CLASSES] - np.bincount(cls, minlength=CLASSES) + 1)
    total = np.bincount(cls, counts, CLASSES) + rest
    share = np.zeros(most + CLASSES)
    share[: len(ws)], share[most:] = counts / total[cls], rest / total
    tokens = int(start.sum())
    parts = 1 + tokens // PART_TOKENS
    weights = train_classes(slim, ws, most, start, rounds, 1 + math.isqrt(parts), 1 + tokens // SHARD_TOKENS)
    sent = sc.broadcast(ws)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in batched(batches, Held(sent.value, most)):
            yield dealt(*counted(b.keys()), parts, PAIR_COUNTS, -1)

    return Model(table, slim.mapInArrow(count_pairs, ROWS), parts, tokens, int(sizes.sum()) + (ends > 0), ends, ws, counts, share, np.log10(rest), weights)


# -- scoring ----------------------------------------------------------------------------------


def _answers(parts: int, share: np.ndarray, rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of ROWS in order of part and kind to answers (chunk, kind, keys, more): texts' numbers and sums."""
    part, held, pairs, counts = None, {}, None, None
    for r in rows:
        if r["part"] != part:
            part, held, pairs, counts = r["part"], {PAIR_COUNTS: [], WORD_COUNTS: []}, None, None
        if r["kind"] == TEXTS:
            yield r
            continue
        keys = np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64)
        if r["kind"] in held:
            same = held[r["kind"]]
            same.append((keys, unpacked(r["more"], np.uint64)))
            if sum(len(k) for k, _ in same[1:]) > max(PART_TOKENS, len(same[0][0])):
                held[r["kind"]] = [summed(*map(np.concatenate, zip(*same)))]  # so that a heavy key takes no more room than its pairs
            continue
        none = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        texts, owner = np.unique(unpacked(r["more"], np.uint32), return_inverse=True)
        if r["kind"] == PAIR_KEYS:
            if pairs is None:
                k, n = summed(*map(np.concatenate, zip(*(held[PAIR_COUNTS] or none))))
                held[PAIR_COUNTS] = []
                pairs = (k, *train_pairs(k, n, share)) if len(k) else (k, np.empty(0), np.empty(0, np.int64), np.empty(0))
            k, r_pair, groups, r_group = pairs
            value = np.zeros(len(keys))
            if len(k):
                g = (keys >> np.uint64(32)).astype(np.int64)
                j = np.minimum(np.searchsorted(groups, g), len(groups) - 1)
                value = np.where(groups[j] == g, r_group[j], 0.0)
                i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                value = np.where(k[i] == keys, r_pair[i], value) / np.log(10)
            sums = [np.bincount(owner, value)]
        else:
            if counts is None:
                counts = summed(*map(np.concatenate, zip(*(held[WORD_COUNTS] or none))))
                held[WORD_COUNTS] = []
            k, n = counts
            c = np.zeros(len(keys))
            if len(k):
                i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                c = np.where(k[i] == keys, n[i], 0).astype(float)
            sums = [np.bincount(owner, np.log10(c + 0.5)), np.bincount(owner, c > 0)]
        yield {"chunk": r["chunk"], "kind": r["kind"], "keys": packed(texts), "more": packed(np.concatenate(sums))}


def _row_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row of docs.

    docs must come in the same partitions and order if it is read again, as a table does.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.counts, model.share, model.rest, model.weights, model.ends))
    parts = model.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, counts, share, rest, weights, ends = sent.value
        hot_log, share_log = np.log10(np.append(counts, 0) + 0.5), np.log10(np.maximum(share, 1e-300))
        chunk = TaskContext.get().partitionId() << 32
        for ids, b in batched(batches, Held(ws, len(share) - CLASSES)):
            n, own, cls = len(b.at), b.number[b.at[b.word_at]], b.cls[b.at[b.word_at]]
            base, known = np.full(n, np.log10(ends + 0.5)), np.full(n, ends > 0)
            base[b.word_at], known[b.word_at] = np.where(own >= 0, hot_log[own], 0.0), own >= 0
            full = class_log_of(weights, b.features(), b.cls[b.at]) / np.log(10)
            full[b.word_at] += share_log[b.outcome] - np.where(own >= 0, 0.0, rest[cls])
            base, full, known = (np.bincount(b.owner, x, len(ids)) for x in (base, full, known))
            null = np.array([i is None for i in ids])
            doc = np.array([i or 0 for i in ids], np.int64)
            texts = np.concatenate([doc, null.astype(np.int64), b.lengths, known.astype(np.int64), base.view(np.int64), full.view(np.int64)])
            yield pa.RecordBatch.from_pylist([{"part": chunk % parts, "kind": TEXTS, "chunk": chunk, "keys": b"", "more": packed(texts)}], SCHEMA)
            owner = b.owner[b.word_at].astype(np.uint32)
            cold = np.flatnonzero(own < 0)
            for kind, keys, text in ((PAIR_KEYS, b.keys(), owner), (WORD_KEYS, b.hash[b.at[b.word_at]][cold], owner[cold])):
                order = np.argsort(keys, kind="stable")
                yield dealt(keys[order], text[order], parts, kind, chunk)
            chunk += 1

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((hashes_of(b["word"].to_pylist()), b["n"].to_numpy().astype(np.uint64)))
            if len(held) == 100:
                yield dealt(*summed(*map(np.concatenate, zip(*held))), parts, WORD_COUNTS, -1)
                held = []
        if held:
            yield dealt(*summed(*map(np.concatenate, zip(*held))), parts, WORD_COUNTS, -1)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _answers(parts, sent.value[2], _row_stream(batches)):
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("chunk", "kind", "keys", "more")}], pa.schema([SCHEMA.field(k) for k in ("chunk", "kind", "keys", "more")]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in _row_stream(batches):
            if r["kind"] != TEXTS:
                held.append(r)
                continue
            doc, null, lengths, known, base, full = unpacked(r["more"], np.int64).reshape(6, -1)
            base, full, known = base.copy().view(float), full.copy().view(float), known.copy()
            for h in held:
                at, sums = unpacked(h["keys"], np.uint32), unpacked(h["more"], np.float64)
                full[at] += sums[: len(at)]
                if h["kind"] == WORD_KEYS:
                    base[at] += sums[: len(at)]
                    known[at] += sums[len(at) :].astype(np.int64)
            held = []
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null > 0), pa.array(lengths), pa.array(known), pa.array(base), pa.array(full)], names=["doc_id", "n_tokens", "n_known", "base", "full"])

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    rows = model.pairs.unionByName(model.table.mapInArrow(word_counts, ROWS)).unionByName(slim.mapInArrow(ask, ROWS))
    answers = rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(answer, "chunk long, kind int, keys binary, more binary")
    out = answers.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(total, "doc_id long, n_tokens long, n_known long, base double, full double")
    norm = float(np.log10(model.tokens + 0.5 * (model.vocabulary + 1)))
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        F.col("full").alias("score"),
    )
