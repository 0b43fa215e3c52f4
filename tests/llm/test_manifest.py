"""The manifest of documents against a plain tree of digests."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from lumisonde.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for x in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(x[run:i]), "".join(x[i + 1 : run + 16])))
        i //= 16
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        leaf = changed = h("".join(map(field, r)))
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            changed = h("".join(map(field, (*r[:4], low))))
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, changed))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(groups[s])]) for s in sources}
    top = tree_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, leaf, changed) in enumerate(sorted(groups[s])):
            path, folded = path_of(trees[s], i) + path_of(top, k), changed
            for left, right in path:
                folded = h(left + folded + right)
            root = top[-1][0]
            out.append((doc_id if known else None, leaf, trees[s][-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return out


def same(df, rows: list[tuple]) -> None:
    got = [tuple(r) for r in merkle_manifest.manifest(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_documents_and_broken_proofs(docs):
    rows = [tuple(r) for r in docs.select(*merkle_manifest.FIELDS).collect()]
    same(docs, rows)
    got = merkle_manifest.manifest(docs).select("verified").collect()
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_runs_of_every_kind(spark):
    """Sources of 1, 2, 16, 17, 256, 257 and 273 rows, more than 16 sources, nulls, repeats, sources that share their first bytes."""
    rows = [(i, f"common-{k}", "en", 1, f"Text {i}") for k, n in enumerate((1, 2, 16, 17, 256, 257, 273)) for i in range(n)]
    rows += [(7, f"é{k}", None, None, "A") for k in range(12)] + [(None, None, None, None, None), (None, None, "x", 0, ""), (5, None, "a", 2, "B" * 300_000)]
    rows += [(9, "twice", "a", 1, "same")] * 3 + [(9, "", "a", 1, "SAME"), (-4, "", "a", 1, "漢😀")]
    same(spark.createDataFrame(rows, SCHEMA).repartition(7), rows)


def test_one_row_and_none(spark):
    one = [(3, "a", "b", 4, "c")]
    same(spark.createDataFrame(one, SCHEMA), one)
    got = merkle_manifest.manifest(spark.createDataFrame(one, SCHEMA)).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == h("")
    assert merkle_manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_do_not_count(spark):
    rows = [(i, "s", "l", 1, "t") for i in range(20)]
    wide = spark.createDataFrame([(*r, 1, "z", 2, 3, "q") for r in rows], SCHEMA + ", at int, tree string, n int, range_ int, leaf string")
    same(wide, rows)
