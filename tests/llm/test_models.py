"""Quality rules, language model and pieces: held-out accuracy, plain counts, the public library."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from compare import SF
from lumisonde.llm import maxent_lm, piece_lattice, queries, rule_quality

BIG = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = queries.op3_quality(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_takes_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, None), (6, 0), (7, 0), (2, 1)], "doc_id long, quality int")
    model = rule_quality.fit(odd, labels)
    out = rule_quality.score_with(model, odd)
    assert out.columns == [*odd.columns, "score_"] and all(0 <= r.score_ <= 1 for r in out.collect())
    assert rule_quality.fit(odd, labels.where("quality = 1")).rules == ()
    assert rule_quality.fit(none, labels).intercept == 0.0 and rule_quality.keep_good(none, labels).count() == 0


def test_rules_are_paths():
    text = "Tree 0 (weight 1.0):\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    a, b = rule_quality.STATISTICS[:2]
    assert rule_quality.paths(text) == [((a, True, 1.5),), ((a, True, 1.5), (b, True, 2.0)), tuple(sorted([(a, True, 1.5), (b, False, 2.0)])), ((a, False, 1.5),)]


def lm(spark, rows, most=maxent_lm.HOT):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return maxent_lm.score(frame, maxent_lm.fit(frame.where(~maxent_lm.held_out()), most=most))


def test_base_score_is_that_of_the_counts(spark, texts):
    rows = [*list(texts.items())[:60], (-1, None), (-2, ""), (-3, "Of of OF unseenword")]
    got = {r.doc_id: r for r in lm(spark, rows, 300).collect()}
    count, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = count.total() + ends, len(count) + 1
    for i, t in rows:
        w = (t or "").encode().lower().split()
        want = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(count[x] for x in w), ends])
        assert got[i].base_score == pytest.approx(want) and got[i].n_known == sum(count[x] > 0 for x in w) + 1
        assert got[i].n_tokens == len(w) + 1 and got[i].train_tokens == n and got[i].score < 0
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


class PlainScore:
    """The model's score, word by word: class weights as fitted, pairs counted and fitted here."""

    def __init__(self, m, texts):
        self.m, self.number, self.count = m, {w: i for i, w in enumerate(m.words)}, Counter(w for t in texts for w in t)
        self.most, self.pairs = len(m.share) - maxent_lm.CLASSES, {}
        for t in texts:
            for before, w in zip([None, *t], t):
                self.pairs.setdefault((before, self.cls(w)), Counter())[self.outcome(w)] += 1
        self.theta = {}
        for key, seen in self.pairs.items():
            th, total = dict.fromkeys(seen, 0.0), sum(seen.values())
            for _ in range(500):
                z = self.z(th)
                for o, c in seen.items():
                    p = m.share[o] * math.exp(th[o]) / z
                    th[o] += 0.3 * (c - total * p - maxent_lm.PENALTY * th[o]) / (total * p * (1 - p) + maxent_lm.PENALTY)
            self.theta[key] = th

    def z(self, th):
        return max(0.0, 1 - sum(self.m.share[o] for o in th)) + sum(self.m.share[o] * math.exp(x) for o, x in th.items())

    def cls(self, w):
        return int(maxent_lm.classes_of([w])[0])

    def outcome(self, w):
        return self.number.get(w, self.most + self.cls(w))

    def ctx(self, w):
        if w is None:
            return maxent_lm.CONTEXTS + maxent_lm.EDGE
        i = self.number.get(w, maxent_lm.CONTEXTS)
        return i if i < maxent_lm.CONTEXTS else maxent_lm.CONTEXTS + self.cls(w)

    def __call__(self, t):
        out, side = 0.0, maxent_lm.CONTEXTS + maxent_lm.OUT
        for two, one, w in zip([None, None, *t], [None, *t], [*t, None]):
            a, b = self.ctx(one), self.ctx(two)
            both = ((a * int(maxent_lm.EDGE_HASH) + b * int(maxent_lm.ODD)) % 2**64 >> 40) % maxent_lm.PAIRS
            z = sum(self.m.weights[i].astype(float) for i in (0, 1 + a, 1 + side + b, 1 + 2 * side + both))
            c = maxent_lm.EDGE if w is None else self.cls(w)
            out += (z[c] - math.log(np.exp(z).sum())) / math.log(10)
            if w is not None:
                o, th = self.outcome(w), self.theta.get((one, c), {})
                out += math.log10(self.m.share[o]) + (th.get(o, 0.0) - math.log(self.z(th))) / math.log(10)
                if o >= self.most:
                    out += math.log10(self.count[w] + 0.5) - self.m.rest[c]
        return out


def test_score_is_that_of_a_plain_model(spark, texts):
    rows = [*list(texts.items())[:12], (-2, ""), (-3, "Of of OF unseenword of")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    train = frame.where(~maxent_lm.held_out())
    model = maxent_lm.fit(train, most=200)
    plain = PlainScore(model, [(r.text or "").encode().lower().split() for r in train.collect()])
    got = {r.doc_id: r.score for r in maxent_lm.score(frame, model).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(plain((t or "").encode().lower().split()), rel=2e-3)
    z = maxent_lm.class_log(model.weights, np.array([[1], [2 + maxent_lm.CONTEXTS], [3]]))
    assert np.exp(z).sum() == pytest.approx(1, abs=1e-5)


def test_model_is_better_than_its_base_on_held_out_text(spark):
    r = queries.op4_lm_score(spark, BIG).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    assert (r.score - r.base) / r.n > 0.1


def test_lm_gathers_more_from_more_text(spark, docs):
    pairs = [sum(len(maxent_lm.unpacked(r.keys, np.uint64)) for r in maxent_lm.fit(docs.where(f"doc_id < {n}")).pairs.collect()) for n in (40, 160)]
    assert pairs[1] > 2 * pairs[0] > 0


def test_lm_on_odd_rows(spark, odd, none):
    assert lm(spark, []).count() == 0
    out = maxent_lm.score(odd.select("doc_id", "text"), maxent_lm.fit(none.select("doc_id", "text"))).collect()
    assert len(out) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in out)
    out = lm(spark, [(1, "a b " * 200_000), (2, "z" * 300_000), (3, "tie"), (3, "tie")], 2).collect()
    assert sorted(r.n_tokens for r in out) == [2, 2, 2, 400_001]


def test_pieces_are_the_librarys(spark, docs, odd, none, texts):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib, vocabulary = sentencepiece.SentencePieceProcessor(model_file=file), piece_lattice.load(file)
    for frame, most in ((docs, 5000), (odd, 2)):
        by = {}
        for r in frame.collect():
            by.setdefault(r.doc_id, []).append(lib.encode(r.text or ""))
        for r in piece_lattice.encode(frame, vocabulary, most=most).collect():
            assert list(r.ids) in by[r.doc_id]
    back = piece_lattice.decode(piece_lattice.encode(docs, vocabulary), vocabulary)
    assert {r.doc_id: r.text for r in back.collect()} == texts
    assert piece_lattice.encode(none, vocabulary).count() == 0


def scanned(unit, known):
    """Ids after merging neighbours, by looking at all of them before each merge; known maps a string to (rank, id)."""
    at = list(range(len(unit) + 1))
    while True:
        found = [(known[unit[a:z]][0], k) for k, (a, z) in enumerate(zip(at, at[2:])) if unit[a:z] in known]
        if not found:
            return [known[unit[a:z]][1] if unit[a:z] in known else -1 - a for a, z in zip(at, at[1:])]
        del at[min(found)[1] + 1]


def test_fold_and_heap_merge_like_scans(spark):
    rng = random.Random(1)
    for trial in range(4):
        pieces = sorted({"a", "b"} | {"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))) for _ in range(12)})
        scores = [float(rng.randint(-12, 0)) for _ in pieces]
        vocabulary = piece_lattice.Pieces(tuple(pieces), tuple(scores), tuple(range(1000, 1256)), merges=True)
        known = {p: (vocabulary.ranks[p], i) for i, p in enumerate(pieces)}
        units = {"".join(rng.choice("aabbbcé") for _ in range(rng.randint(1, 14))) for _ in range(150)} | {"ab" * 30, "a" * 60}
        frame = spark.createDataFrame([(u, 1) for u in units], "unit string, n long")
        got = {r.unit: list(r.ids) for r in piece_lattice.encode_lexicon(frame, vocabulary).collect()}
        for u in units:
            want = scanned(u, known)
            assert piece_lattice.merged_long(u, known) == want
            assert got[u] == [j for i in want for j in ([i] if i >= 0 else [1000 + x for x in u[-1 - i].encode()])]


def test_units_end_where_no_piece_reaches_across():
    vocabulary = piece_lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert vocabulary.cut == piece_lattice.FINE
    text = "  a1 b, (c)²\t٣x_y\n\n  \nend"
    assert "".join(vocabulary.units(text)) == " " + text and vocabulary.units("don't 12")[:4] == [" don", "'", "t", " 1"]


def test_long_texts_and_clashing_columns(spark):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib, vocabulary = sentencepiece.SentencePieceProcessor(model_file=file), piece_lattice.load(file)
    rows = [(1, "word " * 60_000 + "x" * 5000 + " " * 3000 + "漢" * 300), (2, "\n".join("ab cd" for _ in range(40_000)))]
    out = piece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, most=100_000)
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: lib.encode(t) for i, t in rows}
    back = piece_lattice.decode(out.withColumn("text", F.lit("own")), vocabulary)
    assert {r.doc_id: (r.text, r.text_) for r in back.collect()} == {i: ("own", t) for i, t in rows}


def test_digests_need_no_python_of_their_own(spark, docs, odd, monkeypatch):
    """A task that assembles ids and one function more would hold two Python workers, and all ids twice."""
    monkeypatch.setattr(piece_lattice, "BATCH", 3000)
    vocabulary = piece_lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    for frame in (docs, odd):
        rows = piece_lattice.encode(frame, vocabulary, most=5000, digest=True).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert (r.n_pieces, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<i4").tobytes()))
    out = queries.QUERIES["op2_pieces"](spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>"), ("n_pieces", "bigint"), ("ids_crc32", "bigint")]
    last = out._jdf.queryExecution().sparkPlan().toString()
    assert "ArrowEvalPython" not in last


def test_viterbi_is_the_best_path(spark):
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "aba": -4.2, "▁a": -3.9, "ba": -4.0, "bb": -9.0}
    v = piece_lattice.Pieces(tuple(pieces), tuple(pieces.values()), tuple(range(1000, 1256)), merges=False)
    units = [" ab", " abab", " bba", " a", "bb", " axb"]
    got = {r.unit: list(r.ids) for r in piece_lattice.encode_lexicon(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), v).collect()}
    names = list(pieces)
    for u in units:
        m, best = u.replace(" ", "▁"), None
        for cuts in itertools.product([0, 1], repeat=len(m) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(m)]
            parts = [m[a:b] for a, b in zip(at, at[1:])]
            if all(p in pieces or len(p) == 1 for p in parts):
                s = sum(pieces.get(p, -1e6) for p in parts)
                if best is None or s > best[0] + 1e-9:
                    best = (s, [i for p in parts for i in ([names.index(p)] if p in pieces else [1000 + b for b in p.encode()])])
        assert got[u] == best[1]


def test_sf_is_there():
    assert SF


def test_scores_do_not_depend_on_files(spark, docs, tmp_path, monkeypatch):
    """One, four and sixteen files of the same rows, several shards."""
    monkeypatch.setattr(maxent_lm, "SHARD_TOKENS", 20_000)
    rows = docs.select("doc_id", "text")
    found = []
    for k in (1, 4, 16):
        rows.repartition(k).write.parquet(str(tmp_path / str(k)))
        frame = spark.read.option("openCostInBytes", "1").parquet(str(tmp_path / str(k)))
        got = maxent_lm.score(frame, maxent_lm.fit(frame.where(~maxent_lm.held_out()))).collect()
        found.append({r.doc_id: (r.base_score, r.score) for r in got})
    assert found[0].keys() == found[1].keys() == found[2].keys()
    for other in found[1:]:
        assert all(abs(a - b) <= 1e-6 * abs(a) for i in other for a, b in zip(found[0][i], other[i]))


def test_a_batch_works_out_only_the_words_it_does_not_hold(monkeypatch):
    texts = [[b"of", b"the", b"of", b"rareword"], [], [b"the", b"other"]]
    want = maxent_lm.Batch(texts, maxent_lm.Held([], 10))
    held, asked, find = maxent_lm.Held([b"the", b"of"], 10), [], maxent_lm.classes_of
    monkeypatch.setattr(maxent_lm, "classes_of", lambda ws: asked.extend(ws) or find(ws))
    got = maxent_lm.Batch(texts, held)
    assert asked == [b"rareword", b"other"]
    assert (got.cls == want.cls).all() and (got.hash == want.hash).all() and got.number[got.at].tolist() == [1, 0, 1, -1, -1, -1, 0, -1, -1]


def test_class_powers_and_pairs_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    f, out = rng.integers(1, 50, (3, 1000)), rng.integers(0, maxent_lm.OUT, 1000)
    keys = np.unique(rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 200, 3000).astype(np.uint64))
    n, share = rng.integers(1, 9, len(keys)).astype(np.uint64), np.full(200, 0.005)
    whole = maxent_lm.train_pairs(keys, n, share)
    monkeypatch.setattr(maxent_lm, "BLOCK", 7)
    for scale in (1, 100):
        w = (scale * rng.standard_normal((50, maxent_lm.OUT))).astype(np.float32)
        z = w[f].astype(float).sum(0) + w[0]
        z -= z.max(1, keepdims=True)
        want = z[np.arange(1000), out] - np.log(np.exp(z).sum(1))
        assert np.allclose(maxent_lm.class_log_of(w, f, out), want, rtol=1e-4, atol=1e-4)
    assert all((a == b).all() for a, b in zip(whole, maxent_lm.train_pairs(keys, n, share)))


def test_edges_are_made_outside_the_aggregate(spark):
    """Expressions within collect_list are interpreted for each row; those of a projection before it are compiled."""
    vocabulary = piece_lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    edges = piece_lattice.lattice(spark.createDataFrame([(" word",), (" other",)], "unit string"), vocabulary)
    lines = edges._jdf.queryExecution().executedPlan().toString().split("\n")
    grouped = [x for x in lines if "collect_list" in x]
    assert grouped and not any("shiftleft" in x or "coalesce" in x for x in grouped)
