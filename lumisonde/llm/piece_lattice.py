"""SentencePiece encoding and decoding as joins.

*Lexicon.* Texts are cut where no piece can reach across: before a run of spaces, around
line ends and, if the vocabulary allows it, where letters meet other characters. A task
numbers the different units of a chunk of its texts and asks for their pieces; what all
chunks ask for is the lexicon.
*Lattice.* Each unit of the lexicon is exploded into its substrings of at most the longest
piece's length; an equi-join to the piece table turns them into edges, which are grouped by
unit. Single characters without a piece are edges that stand for their UTF-8 bytes.
*Fold.* ``aggregate`` folds the edges of a unit. For unigram models they come in the order
of their ends and the state is the best path so far (Viterbi). A model of merges (BPE)
does not mean the path with the best sum of scores but the one its merges lead to. There
the edges come by rank, then place, and the state is the set of boundaries left: an edge
that spans exactly two neighbours takes the boundary between them away. After a piece
that may be part of one with a better rank the fold begins again, so the order is
that of the library of that name; a Viterbi fold over such a model gives other pieces for many words.
*Texts.* Chunks' requests meet the lexicon part by part, and the answers go back to the chunks'
numbers, which are kept in a table bucketed by chunk. A unit that a third of all texts have is
asked for once by each chunk.

Defined cases: null counts as empty; an empty text has no pieces; repeated rows each get
their pieces; a null doc_id is kept; units over MAX_UNIT characters, whose boundaries no
number holds, are merged by a heap in the task that meets them, with the same result; a
text that contains the character that stands for a space decodes to a space there; an
empty table gives an empty table; other columns are ignored by ``encode`` and carried by
``decode``, whose new column gets a fresh name if its own is taken.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisonde.llm.common import fresh, packed, shared_dir, unpacked, written

SPACE = "▁"


def letter_ranges() -> list[tuple[str, str]]:
    """First and last of each run of letters among the characters of two bytes."""
    marks = [i for i in range(2, 1 << 16) if chr(i).isalpha() != chr(i - 1).isalpha()]
    return [(chr(a), chr(z - 1)) for a, z in zip(marks[::2], marks[1::2])]


#: Where texts are cut: always, and if no piece mixes letters, digits and other characters.
COARSE = r"\n| *[^ \n]+| +"
_ALPHA = "".join(f"{a}-{z}" for a, z in letter_ranges())
FINE = rf"\n| *(?:[{_ALPHA}]+|[0-9]|[^{_ALPHA}0-9 \n]+)| +"
MAX_UNIT = 60
#: Units of a chunk of texts, about, and units of one numpy batch.
CHUNK, BATCH = 1_500_000, 400_000
#: Parts of the lexicon for each of the session's shuffle partitions.
SPLIT = 6
#: Most pieces a table may have to be broadcast whole.
MOST_PIECES = 1_000_000
#: The key of an edge of a model of merges is one number: rank, start, end, whether to begin again, id + 1 (0: no piece).
ID_BITS, PLACE_BITS = 20, 6
AGAIN = 1 << ID_BITS
END_AT, START_AT, RANK_AT = ID_BITS + 1, ID_BITS + 1 + PLACE_BITS, ID_BITS + 1 + 2 * PLACE_BITS
#: The bit of a fold's state that says to go on; the lower ones are boundaries.
ON = 1 << 62


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: pieces in order of their ids, their scores, ids of the 256 bytes, whether it is one of merges, and where texts are cut."""

    pieces: tuple[str | None, ...]  # None for ids that no text is cut into
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    merges: bool
    cut: str = COARSE

    @property
    def longest(self) -> int:
        return max(len(p) for p in self.pieces if p)

    @property
    def ranks(self) -> dict[str, int]:
        """The rank of each piece, best score first."""
        order = {s: r for r, s in enumerate(sorted(set(self.scores), reverse=True))}
        return {p: order[s] for p, s in zip(self.pieces, self.scores, strict=True) if p}

    def units(self, text: str | None) -> list[str]:
        """The units of a text, with one more space in front."""
        return re.findall(self.cut, " " + text.replace(SPACE, " ")) if text else []

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score), or (piece, code) for a model of merges: as many rows as the vocabulary, whose size is fixed and checked."""
        if len(self.pieces) > MOST_PIECES:
            raise ValueError("the vocabulary is too large to broadcast")
        if not self.merges:
            return spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True)) if p], "piece string, id int, score double")
        ranks, again = self.ranks, parts_of_better(self.ranks)
        return spark.createDataFrame([(p, (ranks[p] << RANK_AT) + AGAIN * (p in again) + i + 1) for i, p in enumerate(self.pieces) if p], "piece string, code long")


def parts_of_better(ranks: dict[str, int]) -> set[str]:
    """Pieces that begin or end a longer piece whose rank is as good or better."""
    return {p for q, r in ranks.items() for k in range(2, len(q)) for p in (q[:k], q[-k:]) if ranks.get(p, -1) >= r}


def load(path: str, merges: bool = True) -> Pieces:
    """Reads a model file. Pieces must not have a line end, nor a space mark after another character, and all bytes must have one."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
    pieces = tuple(m.id_to_piece(i) if ok else None for i, ok in enumerate(plain))
    byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    if len(byte_ids) < 256:
        raise ValueError("a model without pieces for all bytes")
    whole = lambda cut: all(re.fullmatch(cut, p.replace(SPACE, " ")) and len(re.findall(cut, p.replace(SPACE, " "))) == 1 for p in pieces if p)
    cut = next((c for c in (FINE, COARSE) if whole(c)), None)
    if cut is None:
        raise ValueError("pieces reach across units")
    return Pieces(pieces, tuple(m.get_score(i) for i in range(n)), tuple(byte_ids[b] for b in range(256)), merges, cut)


def named(units: list[str]) -> bytes:
    """Strings as one compressed binary: their sizes, then all their bytes."""
    raw = [u.encode("utf-8", "surrogatepass") for u in units]
    sizes = packed(np.fromiter(map(len, raw), np.uint32, len(raw)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(raw), 1)


def names_of(raw: bytes) -> list[str]:
    z = 4 + int.from_bytes(raw[:4], "little")
    ends = np.concatenate(([0], np.cumsum(unpacked(raw[4:z], np.uint32), dtype=np.int64))).tolist()
    text = zstandard.decompress(raw[z:])
    return [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])]


def part_of(units: list[str], parts: int) -> np.ndarray:
    """The part of the lexicon that a unit belongs to."""
    return (np.fromiter((xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass")) for u in units), np.uint64, len(units)) % np.uint64(parts)).astype(np.int64)


def lexicon(asked: DataFrame, parts: int) -> DataFrame:
    """(unit) for each different unit that some chunk asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()  # one part
        for b in batches:
            for raw in b["units"]:
                held.update(names_of(raw.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["unit"])

    units = asked.where("part >= 0").select("part", "units").repartitionById(parts, "part").mapInArrow(run, "unit string")
    # parts so small that the edges of one need no disk
    return units.repartition(parts, "unit")


def lattice(words: DataFrame, vocabulary: Pieces) -> DataFrame:
    """(unit, edges): edges (end, start, score, id) in the order of their ends; id -1 marks a character without a piece.

    For a model of merges (unit, chars, joins): edges of one character and of more, the latter by rank and place. With its key an edge has
    what folds ask of it, in bits: what a state must have (its boundaries, and to go on), the boundaries within it, and what it leaves of a state.
    """
    marked = F.translate("unit", " ", SPACE)
    starts = F.sequence(F.lit(0), F.char_length("unit") - 1)
    each = words.select("unit", marked.alias("m"), F.explode(starts).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.char_length("m") - F.col("start")))
    each = each.select("unit", "m", "start", F.explode(sizes).alias("size"))
    each = each.select("unit", "start", "size", F.substring("m", F.col("start") + 1, F.col("size")).alias("piece"))
    met = each.join(F.broadcast(vocabulary.table(words.sparkSession)), "piece", "left")
    end = F.col("start") + F.col("size")
    if not vocabulary.merges:
        edge = F.struct(end.alias("end"), "start", F.coalesce("score", F.lit(-1e6)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
        return met.where("id is not null or size = 1").groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    key = F.coalesce("code", F.lit(0)) + F.col("start").cast("long") * (1 << START_AT) + end.cast("long") * (1 << END_AT)
    needs, inner = _bit(F.col("start")).bitwiseOR(_bit(end)).bitwiseOR(F.lit(ON)), _bit(end) - _bit(F.col("start"), 2)
    leaves = F.bitwise_not(F.when(key.bitwiseAND(AGAIN) > 0, inner.bitwiseOR(F.lit(ON))).otherwise(inner))
    about = F.struct(key.alias("key"), needs.alias("needs"), inner.alias("inner"), leaves.alias("leaves"))
    # a column of its own, which both lists name, so that it is made where rows are and not within the aggregate
    edges = met.where("code is not null or size = 1").select("unit", (F.col("size") == 1).alias("one"), about.alias("edge"))
    lists = edges.groupBy("unit").agg(F.collect_list(F.when(F.col("one"), F.col("edge"))).alias("chars"), F.collect_list(F.when(~F.col("one"), F.col("edge"))).alias("joins"))
    return lists.withColumn("joins", F.sort_array("joins"))


def viterbi(edges: Column, length: Column) -> Column:
    """Ids of the path with the best sum of scores; -1 - start for characters without a piece. A fold over edges sorted by end."""
    none = F.struct(F.lit(float("-inf")).alias("score"), F.array().cast("array<int>").alias("ids"))
    first = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))
    start = F.concat(F.array(first), F.array_repeat(none, length.cast("int")))

    def better(state: Column, e: Column) -> Column:
        come = F.get(state, e["start"])
        score = come["score"] + e["score"]
        made = F.struct(score.alias("score"), F.concat(come["ids"], F.array(F.when(e["id"] < 0, -1 - e["start"]).otherwise(e["id"]))).alias("ids"))
        return F.transform(state, lambda x, i: F.when((i == e["end"]) & (score > x["score"]), made).otherwise(x))

    return F.aggregate(edges, start, better, lambda s: F.element_at(s, -1)["ids"])


def _bit(place: Column, of: int = 1) -> Column:
    return F.call_function("shiftleft", F.lit(of).cast("long"), place.cast("int"))


def merging(chars: Column, joins: Column, length: Column) -> Column:
    """Ids after merging neighbours, best rank first and leftmost of equal ones; -1 - start for characters without a piece.

    The state is a bit for each boundary left, and one for whether to go on. Each fold that ends early has merged something, so
    as many folds as there are characters are enough; they are skipped once one has run to its end.
    """

    def join(s: Column, e: Column) -> Column:
        fits = (s.bitwiseAND(e["needs"]) == e["needs"]) & (F.bit_count(s.bitwiseAND(e["inner"])) == 1)
        return F.when(fits, s.bitwiseAND(e["leaves"])).otherwise(s)

    def fold(s: Column, _: Column) -> Column:
        return F.when(s < ON, F.aggregate(joins, s + ON, join)).otherwise(s)

    def names(s: Column) -> Column:
        places = 2**PLACE_BITS - 1 << START_AT
        left = F.filter(F.concat(chars, joins), lambda e: (s.bitwiseAND(e["needs"]) == e["needs"]) & (s.bitwiseAND(e["inner"]) == 0))
        found = F.sort_array(F.transform(left, lambda e: e["key"].bitwiseAND(places + AGAIN - 1)))
        return F.transform(found, lambda e: (F.when(e.bitwiseAND(AGAIN - 1) == 0, -1 - F.shiftright(e, START_AT)).otherwise(e.bitwiseAND(AGAIN - 1) - 1)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), length), _bit(length + 1) - 1, fold, names)


def merged_long(unit: str, known: dict[str, tuple[int, int]]) -> list[int]:
    """The same for a unit of any length, with a heap of candidate merges and a linked list of what is left."""
    n = len(unit)
    end, back, on = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and on[i] >= 0 and (found := known.get(unit[i : end[on[i]]])):
            heapq.heappush(heap, (found[0], i, end[on[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = on[i]
        if end[i] < 0 or j < 0 or end[j] != e:
            continue
        end[i], on[i], end[j] = e, on[j], -1
        if on[i] >= 0:
            back[on[i]] = i
        offer(back[i])
        offer(i)
    out, i = [], 0
    while 0 <= i < n:
        found = known.get(unit[i : end[i]])
        out.append(found[1] if found else -1 - i)
        i = on[i]
    return out


def with_bytes(ids: Column, unit: Column, byte_ids: tuple[int, ...]) -> Column:
    """Ids with each mark -1 - start replaced by the ids of that character's bytes."""
    named = F.array(*map(F.lit, byte_ids))

    def spelled(start: Column) -> Column:
        raw = F.hex(F.encode(F.substring(unit, start + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda k: F.element_at(named, F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int") + 1))

    full = F.flatten(F.transform(ids, lambda i: F.when(i < 0, spelled(-1 - i)).otherwise(F.array(i))))
    return F.when(F.exists(ids, lambda i: i < 0), full).otherwise(ids)


def encode_lexicon(words: DataFrame, vocabulary: Pieces) -> DataFrame:
    """(unit, ids) for each unit of a lexicon."""
    edges = lattice(words, vocabulary)
    length = F.char_length("unit")
    path = merging(F.col("chars"), F.col("joins"), length) if vocabulary.merges else viterbi(F.col("edges"), length)
    return edges.select("unit", path.alias("ids")).select("unit", with_bytes(F.col("ids"), F.col("unit"), vocabulary.byte_ids).alias("ids"))


def _numbers(ks: np.ndarray) -> bytes:
    """Numbers as bytes of seven bits each, the lowest first, a set top bit where more follow; compressed."""
    size = np.ones(len(ks), np.int8)
    for j in (1, 2, 3):
        size += ks >= 1 << 7 * j
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    for j in range(4):
        has = size > j
        out[at[has] + j] = (ks[has] >> 7 * j & 127) | np.where(size[has] > j + 1, 128, 0)
    return zstandard.compress(out.tobytes(), 3)


def _of_numbers(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.decompress(raw), np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    ks = np.zeros(len(ends), np.int32)
    for j in range(4):
        has = starts + j <= ends
        ks[has] |= (b[starts[has] + j] & 127).astype(np.int32) << 7 * j
    return ks


#: A chunk's row has part -1, its texts' identifiers and numbers of units, the part of each unit, and units too long for the lexicon;
#: its other rows have the units that it asks a part for.
ASKED = "chunk long, part int, units binary, docs binary, parts binary, stream binary"


def ask(docs: DataFrame, vocabulary: Pieces, parts: int, text: str, most: int) -> DataFrame:
    """Texts as numbers of the units of their chunk, the most frequent ones first, written by chunk: rows of ASKED."""
    spark = docs.sparkSession
    fields = [(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in ASKED.split(", ")]

    def rows_of(chunk: int, ids: list, texts: list[np.ndarray], seen: list[str]) -> pa.RecordBatch:
        ks = np.concatenate(texts)
        order = np.argsort(-np.bincount(ks, minlength=len(seen)), kind="stable")
        rank = np.empty(len(seen), np.int32)
        rank[order] = np.arange(len(seen))
        units = [seen[i] for i in order.tolist()]
        part = part_of(units, parts)
        part[[i for i, u in enumerate(units) if len(u) > MAX_UNIT]] = parts
        null = np.array([i is None for i in ids], np.int64)
        about = np.concatenate([np.array([i or 0 for i in ids], np.int64), null, np.array([len(t) for t in texts], np.int64)])
        by_part = np.argsort(part, kind="stable")
        at = np.searchsorted(part[by_part], np.arange(parts + 2)).tolist()
        mine = [[units[i] for i in by_part[a:z].tolist()] for a, z in zip(at, at[1:])]
        first = (chunk, -1, named(mine[parts]), packed(about), packed(part.astype(np.int32)) if len(part) else b"", _numbers(rank[ks]))
        rows = [first, *((chunk, p, named(us), None, None, None) for p, us in enumerate(mine[:parts]) if us)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        number, ids, texts, size = defaultdict(count().__next__), [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), b["text"]):
                us = vocabulary.units(t.as_py())
                ids.append(i)
                texts.append(np.fromiter(map(number.__getitem__, us), np.int32, len(us)))
                size += len(us)
                if size >= most:
                    yield rows_of(chunk, ids, texts, list(number))
                    chunk, number, ids, texts, size = chunk + 1, defaultdict(count().__next__), [], [], 0
        if ids:
            yield rows_of(chunk, ids, texts, list(number))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a bucketed table: what a chunk gets back is brought to its texts, which are not shuffled
    name = f"units_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim.mapInArrow(run, ASKED).write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def answers(asked: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, sizes, ids): the pieces of all units that a chunk asks a part for, in their order."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sizes, ids = [], [], []
        for b in batches:
            units += b["unit"].to_pylist()
            sizes.append(b["ids"].value_lengths().to_numpy())
            ids.append(b["ids"].flatten().to_numpy())
        if not units:
            return
        part = part_of(units, parts)
        size, flat = np.concatenate(sizes).astype(np.int32), np.concatenate(ids).astype(np.int32)
        at = np.cumsum(size) - size
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cut[p] : cut[p + 1]]
            if len(mine):
                own = np.concatenate([flat[a : a + n] for a, n in zip(at[mine].tolist(), size[mine].tolist())])
                cols = [pa.array([p], pa.int32()), pa.array([-1], pa.int64()), pa.array([named([units[i] for i in mine.tolist()])]), pa.array([packed(size[mine])]), pa.array([packed(own)])]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "units", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # one part; its pieces come before the chunks
        for b in batches:
            for r in b.to_pylist():
                us = names_of(r["units"])
                if r["chunk"] < 0:
                    flat, ends = unpacked(r["ids"], np.int32), np.cumsum(unpacked(r["sizes"], np.int32)).tolist()
                    known.update(zip(us, (flat[a:z] for a, z in zip([0, *ends], ends))))
                    continue
                found = list(map(known.__getitem__, us))
                cols = [pa.array([r["chunk"]]), pa.array([r["part"]], pa.int32()), pa.array([packed(np.fromiter(map(len, found), np.int32, len(found)))]), pa.array([packed(np.concatenate(found))])]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "part", "sizes", "ids"])

    kept = table.mapInArrow(dealt, "part int, chunk long, units binary, sizes binary, ids binary")
    wanted = asked.where("part >= 0").select("part", "chunk", "units", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("binary").alias("ids"))
    met = kept.unionByName(wanted).repartitionById(parts, "part").sortWithinPartitions("part", "chunk")
    return met.mapInArrow(run, "chunk long, part int, sizes binary, ids binary")


def digests(ids: np.ndarray, cut: np.ndarray) -> list[int]:
    """The CRC-32 of each run of ids between two cuts."""
    raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]


def encode(docs: DataFrame, vocabulary: Pieces, text: str = "text", most: int = CHUNK, digest: bool = False) -> DataFrame:
    """doc_id, ids per row of docs; most is the number of units after which a chunk of texts ends.

    With digest, n_pieces and ids_crc32 (of the ids as little-endian numbers of 32 bits) come from the task that has the ids: asked
    of a function of its own, all ids would go through a second Python worker for each task.
    """
    spark = docs.sparkSession
    parts = SPLIT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = ask(docs, vocabulary, parts, text, most)
    table = written(encode_lexicon(lexicon(asked, parts), vocabulary), "lexicon")
    ranks = vocabulary.ranks
    known = spark.sparkContext.broadcast({p: (ranks[p], i) for i, p in enumerate(vocabulary.pieces) if p})

    def long_ids(unit: str) -> list[int]:
        marked = unit.replace(" ", SPACE)
        return [j for i in merged_long(marked, known.value) for j in ([i] if i >= 0 else [vocabulary.byte_ids[x] for x in marked[-1 - i].encode()])]

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                doc, null, counts = unpacked(r["docs"], np.int64).reshape(3, -1)
                part = unpacked(r["parts"], np.int32) if r["parts"] else np.empty(0, np.int32)
                found = sorted(r["found"] or [], key=lambda x: x["part"])
                far = [np.array(long_ids(u), np.int32) for u in names_of(r["units"])]
                sizes = np.concatenate([*(unpacked(x["sizes"], np.int32) for x in found), np.fromiter(map(len, far), np.int32, len(far))]).astype(np.int64)
                flat = np.concatenate([*(unpacked(x["ids"], np.int32) for x in found), *far, np.empty(0, np.int32)]).astype(np.int32)
                if len(sizes) != len(part):
                    raise RuntimeError("pieces of a unit are missing")
                order = np.argsort(part, kind="stable")
                size, at = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
                size[order], at[order] = sizes, np.cumsum(sizes) - sizes
                ks = _of_numbers(r["stream"])
                ends = np.cumsum(counts)
                a = 0
                while a < len(doc):  # some texts at a time
                    z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH, "right")))
                    own = ks[ends[a] - counts[a] : ends[z - 1]]
                    total = np.concatenate(([0], np.cumsum(size[own])))
                    ids = flat[np.arange(total[-1]) + np.repeat(at[own] - total[:-1], size[own])]
                    cut = total[np.concatenate(([0], np.cumsum(counts[a:z])))]
                    cols = {"doc_id": pa.array(doc[a:z], mask=null[a:z] > 0), "ids": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))}
                    if digest:
                        cols |= {"n_pieces": pa.array(np.diff(cut)), "ids_crc32": pa.array(digests(ids, cut), pa.int64())}
                    yield pa.RecordBatch.from_pydict(cols)
                    a = z

    found = answers(asked, table, parts).groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("part", "sizes", "ids")).alias("found"))
    texts = asked.where("part = -1").select("chunk", "units", "docs", "parts", "stream")
    both = texts.join(found, texts["chunk"] == found["c"], "left").select("units", "docs", "parts", "stream", "found")
    return both.mapInArrow(assembled, "doc_id long, ids array<int>" + ", n_pieces long, ids_crc32 long" * digest)


def text_of(ids: list[int] | None, vocabulary: Pieces) -> str:
    """The text that a list of ids stands for."""
    names, of_byte = vocabulary.pieces, {i: b for b, i in enumerate(vocabulary.byte_ids)}
    raw = b"".join(bytes([of_byte[i]]) if i in of_byte else (names[i] or "").encode() for i in (ids if ids is not None else ()))
    return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def decode(rows: DataFrame, vocabulary: Pieces, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with the text of an array of ids, in a column of that name, or a fresh one if rows have it already."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.StringType())
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([text_of(x, sent.value) for x in lists], dtype=object)

    return rows.withColumn(fresh(rows, into)[0], run(F.col(ids)))
