"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are dealt to tasks by a hash of their identifier, text and place. Each task sorts its
documents by that hash and cuts their stream into groups of a bounded number of tokens and packs every group by itself:

1. Whole sequences are cut off the front of documents that exceed the capacity.
2. The rests are placed by first-fit decreasing. The tree's leaves are the bins' free
   space and each inner node the larger of its children, so the first bin with enough
   room is found in logarithmic time.
3. The last bins are cut to fill the gaps of the first ones; at most one bin of a group
   stays short. It is cut into sequences of powers of two, which need no padding.

Only a group's token ids are held at a time. Sequence numbers combine the task and a
counter, so tasks need not know of each other.

Defined cases: a null or empty text is a document of the end token alone; a null
doc_id is carried through; repeated rows are packed as often as they occur; an empty
table gives an empty table; other columns are ignored. A document longer than a group
is a group of its own; memory then grows with that document only.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 4096
END_ID = 2
#: Tokens of a group, about: 4 bytes each in memory.
GROUP_TOKENS = 1 << 21
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: How a tokenizer file may prepare text so that Latin-1 text can be cut here: the same words, lower case by character.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The words of that split in lower-cased Latin-1 text, which NFC leaves as it is.
LATIN_WORD = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\x09-\x0D\x20\x85\xA0]+")
#: Words and chunks whose ids a task keeps, twice at most: those met lately, and those met before. A worker keeps the first between tasks.
CACHED_CHUNKS = 200_000


class Tournament:
    """Free space of bins in opening order; first(n) is the first bin with room for n, opened if there is none."""

    def __init__(self, capacity: int):
        self.capacity, self.size, self.bins = capacity, 1, 0
        self.best = [0, 0]

    def _grow(self) -> None:
        old = self.best[self.size : 2 * self.size]
        self.size *= 2
        self.best = [0] * self.size + old + [0] * (self.size - len(old))
        for i in range(self.size - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def _set(self, bin_: int, room: int) -> None:
        i = self.size + bin_
        self.best[i] = room
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def place(self, n: int) -> int:
        if self.best[1] < n:
            if self.bins == self.size:
                self._grow()
            self.bins += 1
            self._set(self.bins - 1, self.capacity - n)
            return self.bins - 1
        i = 1
        while i < self.size:
            i = 2 * i if self.best[2 * i] >= n else 2 * i + 1
        self._set(i - self.size, self.best[i] - n)
        return i - self.size


Piece = tuple[int, int, int]  # document, start, length


def fill(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Fills the gaps of the first bins from the last ones, which are cut where needed."""
    bins = sorted(bins, key=lambda b: -sum(x[2] for x in b))
    room = [capacity - sum(x[2] for x in b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if not room[i]:
            i += 1
        elif not bins[j]:
            j -= 1
        else:
            doc, start, n = bins[j].pop()
            take = min(n, room[i])
            if take < n:
                bins[j].append((doc, start, n - take))
            bins[i].append((doc, start + n - take, take))
            room[i] -= take
            room[j] += take
    return [b for b in bins if b]


def split_powers(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Cuts a short sequence into sequences whose lengths are powers of two."""
    total = sum(x[2] for x in pieces)
    if total == capacity:
        return [pieces]
    out, todo = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        need, seq = total & (1 << bit), []
        while need:
            doc, start, n = todo.pop(0)
            take = min(n, need)
            seq.append((doc, start, take))
            if take < n:
                todo.insert(0, (doc, start + take, n - take))
            need -= take
        if seq:
            out.append(seq)
    return out


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of (document, start, length) that hold every token of the documents once."""
    done, rests = [], []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        done += [[(doc, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            rests.append((doc, whole * capacity, n % capacity))
    rests.sort(key=lambda x: (-x[2], x[0]))
    tree, bins = Tournament(capacity), []
    for piece in rests:
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    bins = fill(bins, capacity)
    return done + bins[:-1] + (split_powers(bins[-1], capacity) if bins else [])


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Found(dict):
    """What a function gives for each key, kept; a key that is not here is looked up in those kept before."""

    def __init__(self, find: Callable[[str], bytes], before: dict[str, bytes]):
        self.find, self.before = find, before

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        self[key] = ids = self.find(key) if ids is None else ids
        return ids


def cut_by_latin(tokenizer: Tokenizer) -> bool:
    """Whether LATIN_WORD cuts lower-cased Latin-1 text into the words that the tokenizer merges one by one."""
    plan = json.loads(tokenizer.to_str())
    steps = plan["normalizer"], plan["pre_tokenizer"], plan["post_processor"]
    return steps == (NORMALIZER, {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}, None) and all(t["special"] for t in plan["added_tokens"])


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


Encoder = tuple[Callable[[str | None], bytes], Callable[[], None]]
_encoders: dict[str, Encoder] = {}


def chunk_encoder(path: str) -> Encoder:
    """Text to little-endian 32-bit ids, by a tokenizer file that drops white space; and what a task calls at its end.

    Words of Latin-1 text go to the file's merge rules, if it cuts such text as LATIN_WORD does. Other chunks between
    white space go to the whole tokenizer. The ids of both are kept for reuse.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    merged, as_letters = tokenizer.model.tokenize, byte_letters()

    def whole(chunk: str) -> bytes:
        return little(tokenizer.encode(chunk, add_special_tokens=False).ids)

    def by_rules(word: str) -> bytes:
        plain = word.isascii() and word.isalnum()  # stands for itself
        return little([t.id for t in merged(word if plain else word.encode().decode("latin-1").translate(as_letters))])

    probes = ["straightforwardly", "einverständnis", "français", "corazón", "ßÿñ", "q", "7", "½", "...", "'ll"]
    latin = cut_by_latin(tokenizer) and all(whole(x) == by_rules(x) for x in probes)
    words, chunks = Found(by_rules, {}), Found(lambda c: b"".join(map(words.__getitem__, LATIN_WORD.findall(c.lower()))) if latin and is_latin(c) else whole(c), {})

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if latin and is_latin(text):
            out = b"".join(map(words.__getitem__, LATIN_WORD.findall(text.lower())))
        else:
            out = b"".join(map(chunks.__getitem__, CHUNK.findall(text)))
        for kept in (words, chunks):
            if len(kept) > CACHED_CHUNKS:
                kept.before = dict(kept)
                kept.clear()
        return out

    def end() -> None:
        for kept in (words, chunks):
            kept.before = {}
        pa.default_memory_pool().release_unused()

    _encoders[path] = encode, end
    return encode, end


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row per piece of a document in a sequence; tokenizer_file must be readable at that path on every executor."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done = chunk_encoder(tokenizer_file)
        part, made = TaskContext.get().partitionId() << 40, 0
        held, ids, tokens = [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for seq in pack([len(x) // 4 for x in ids], capacity):
                offset = 0
                for doc, start, n in seq:
                    crc = zlib.crc32(ids[doc][4 * start : 4 * (start + n)])
                    rows.append((held[doc], start, n, crc, len(ids[doc]) // 4, part + made, offset))
                    offset += n
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=ARROW)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                x = encode(text.as_py()) + end
                if held and tokens + len(x) // 4 > group_tokens:
                    yield emit()
                    held, ids, tokens = [], [], 0
                held.append(doc_id)
                ids.append(x)
                tokens += len(x) // 4
        if held:
            yield emit()
        done()

    # rows that repeat are dealt by where they stand; sorted, so that a task that is done again packs the same sequences
    key = F.xxhash64(F.lit("pack"), "doc_id", F.xxhash64("text"), F.spark_partition_id())
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", key).repartition("key").sortWithinPartitions("key", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(run, PIECES)
