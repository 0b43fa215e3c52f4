"""Personal data, exact dedup and packing against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisonde.llm import ffd_packing, lsm_dedup, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The four patterns as they are written, with their validators."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base(text: str) -> list[tuple[str, int, int]]:
    return [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB.@-_ 019+()5", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == plain_spans(text)


def test_base_spans_of_documents(texts):
    for t in texts.values():
        assert base(t or "") == plain_spans(t or "")


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [x[0] for x in pii.find_spans(t)]
    assert kinds("DE89370400440532013000") == ["iban"] and kinds("DE88370400440532013000") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == ["secret"]
    assert pii.mask("mail a@b.co now +1 (555) 010-9999") == "mail <email> now <phone>"
    assert pii.find_spans("a" * 200_000 + "@") == [] and pii.find_spans("1" * 200_000) == []  # linear in long runs


def test_account_numbers_before_words():
    de, gb, no = "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"
    found = lambda t: [t[s:e] for k, s, e, _ in pii.find_spans(t) if k == "iban"]
    for before in ("", "IBAN ", "REF ", "NR12 "):
        for after in ("", " BIC COBADEFFXXX", " 12 EUR", " I did", " Ich", ".", " 1", " A B C D E F G H I J K L M N"):
            for x in (de, gb, no, "DE89 3704 0044 0532 0130 00", de.lower()):
                assert found(before + x + after) == [x]
    assert found(f"{no} {no} {de} {gb}") == [no, no, de, gb]
    assert found("DE88370400440532013000 BIC COBADEFFXXX") == [] and found("x" + de) == [] and found(de + "x") == []
    assert pii.mask(f"IBAN {de} BIC COBADEFFXXX") == "IBAN <iban> BIC COBADEFFXXX"


def test_long_secrets():
    for x in ("sk-" + "aB3" * 60, "ghp_" + "aB3" * 20, "xoxb-" + "1234-" * 30 + "a"):
        assert pii.mask(f"see {x} there") == "see <secret> there"
    assert pii.mask("token: " + "aB3_" * 50 + " there") == "<secret> there"


def test_pii_of_odd_rows(spark, odd, none):
    rows = pii.digest(odd).collect()
    assert len(rows) == odd.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    out = pii.redact(odd)
    assert out.columns == odd.columns and [r.text for r in out.collect()] == [r.text for r in odd.collect()]
    assert pii.annotate(odd.withColumnRenamed("host", "spans")).columns[-1] == "spans_"
    assert pii.digest(none).count() == 0


def groups(rows, keep):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    pick = {t: (max if keep == "largest" else min)([i for i in v if i is not None], default=None) for t, v in by.items()}
    return sorted((str(i), str(pick[t or ""]), len(by[t or ""]), i == pick[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_exact_dedup(spark, odd, none, docs):
    for frame in (odd, docs):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        for keep in ("largest", "smallest"):
            out = lsm_dedup.dedup(frame, keep=keep)
            assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in out.collect()) == groups(rows, keep)
    assert lsm_dedup.dedup(none).count() == 0


def test_equal_digests_are_told_apart_by_bytes(spark, odd, monkeypatch):
    monkeypatch.setattr(lsm_dedup, "_digest", lambda text: F.unhex(F.lit("00")))
    out = lsm_dedup.dedup(odd)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out.collect())
    assert got == [x[:3] for x in groups([(r.doc_id, r.text) for r in odd.collect()], "largest")]


def test_filters_lose_no_copy_and_settle_most_rows(spark, docs, monkeypatch):
    from lumisonde.llm import common

    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    for most in (1 << 28, 1 << 12):  # roomy, and too full to tell
        monkeypatch.setattr(common, "MOST_BITS", most)
        may, cannot = common.split_by(spark.range(3000), F.xxhash64("id"), common.filter_of(keys, F.col("k")))
        assert may.where("id % 3 = 0").count() == 1000 and may.count() + cannot.count() == 3000
        assert cannot.count() > (1900 if most > 1 << 12 else 0)
    monkeypatch.setattr(common, "MOST_BITS", 1 << 12)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in lsm_dedup.dedup(docs).collect()) == groups(rows, "largest")


def test_index_takes_more_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(lsm_dedup, "FANOUT", 2)
    index = lsm_dedup.Index(spark, "digest binary, id bigint, n bigint", "smallest")
    for k in range(5):
        index.flush(docs.where(f"doc_id % 5 = {k}"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    want = {r.h: (r.i, r.n) for r in docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("i"), F.count("*").alias("n")).collect()}
    got = index.lookup([bytes.fromhex(h) for h in list(want)[:20]]).collect()
    assert {bytes(r.digest).hex(): (r.id, r.n) for r in got} == {h: want[h] for h in list(want)[:20]}
    runs = index.read(index.levels[2]).select("digest", F.spark_partition_id().alias("p")).collect()
    assert all(a.digest < b.digest for a, b in zip(runs, runs[1:]) if a.p == b.p)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_packing_of_lengths(lengths):
    seqs = ffd_packing.pack(lengths, 64)
    seen = defaultdict(set)
    for seq in seqs:
        total = sum(n for *_, n in seq)
        assert 0 < total <= 64 and (total == 64 or total & (total - 1) == 0)
        for doc, start, n in seq:
            assert n > 0 and not seen[doc] & set(range(start, start + n))
            seen[doc] |= set(range(start, start + n))
    assert [len(seen[i]) for i in range(len(lengths))] == lengths


def test_tournament_finds_the_first_bin():
    import random

    rng, tree, room = random.Random(1), ffd_packing.Tournament(50), []
    for _ in range(500):
        n = rng.randint(1, 50)
        want = next((i for i, r in enumerate(room) if r >= n), len(room))
        if want == len(room):
            room.append(50)
        room[want] -= n
        assert tree.place(n) == want


def test_packed_documents(spark, odd, none, docs):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    for frame in (odd, docs):
        ids = defaultdict(list)
        for r in frame.collect():
            ids[r.doc_id].append(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4"))
        rows = ffd_packing.packed(frame, file, group_tokens=20_000).collect()
        assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
        for r in rows:
            assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id])
        at = defaultdict(list)
        for r in rows:
            at[r.sequence_id].append((r.offset, r.length))
        for v in at.values():
            v.sort()
            assert all(o == sum(n for _, n in v[:k]) for k, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 4096
    assert ffd_packing.packed(none, file).count() == 0


def test_encoder_is_the_tokenizer(texts):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(file), ffd_packing.chunk_encoder(file)[0]
    t.encode_special_tokens = True
    odd = ["It's 'S it's, a.b. ÉCOLE, école. ÀÉ́ é, İ ΣΑΣ. <|endoftext|> x</w> a b, ,a .a A..", "ﬁn. ½ 12,5. don't.  x,y", "ŒUVRE. ǅ, ß. ẞ,"]
    for x in [*texts.values(), *odd]:
        assert encode(x) == np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_is_the_tokenizer_on_all_latin_characters():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(file), ffd_packing.chunk_encoder(file)[0]
    t.encode_special_tokens = True
    every = [chr(i) for i in range(256)]
    for x in ["".join(every), *(f"a{c}b{c}{c} {c}'s'{c} 1{c}É{c}œ" for c in every), *(f"a{c}b'{c}LL" for c in every)]:
        assert encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_word_is_merged_once_whatever_stands_by_it(monkeypatch):
    merged = []

    class Counted(ffd_packing.Found):
        def __missing__(self, key):
            merged.append(key)
            return super().__missing__(key)

    monkeypatch.setattr(ffd_packing, "Found", Counted, raising=False)
    monkeypatch.setattr(ffd_packing, "_encoders", {})
    encode = ffd_packing.chunk_encoder(public_tokenizers.path("word_bpe_49k.json"))[0]
    for end in ("", ",", ".", "###", ",%%%", "!!", "&&&", "***."):
        encode(f"Über{end} über{end} ÜBER{end} plain{end} 12{end} Plain{end}")
    assert sorted(merged) == sorted({"über", "plain", "1", "2", ",", ".", "###", ",%%%", "!!", "&&&", "***."})
