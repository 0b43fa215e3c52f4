"""SimHash tries, line winnowing, top-k search and url templates against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from compare import SF
from lumisonde.llm import hamming_topk, line_winnow, simhash_trie, url_templates


def plain_code(text: str | None, k: int = 3) -> int:
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = np.zeros(64, int)
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        bits += np.array([(h >> b) & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(sh))


def closure(codes: list[int], budget: int) -> list[int]:
    """label[i]: the smallest index reachable by steps of at most budget bits."""
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def check(frame, **more):
    rows = frame.collect()
    codes = [plain_code(r.text) for r in rows]
    label = closure(codes, 2)
    least = {c: min((rows[i].doc_id for i in range(len(rows)) if label[i] == c and rows[i].doc_id is not None), default=None) for c in set(label)}
    want = sorted((str(r.doc_id), f"{c:016x}", str(least[k])) for r, c, k in zip(rows, codes, label))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_trie.components(frame, **more).collect())
    assert got == want


def test_components(docs, odd, none):
    check(docs)
    check(odd)
    assert simhash_trie.components(none).count() == 0


def test_heavy_keys_are_dealt_out(spark):
    """Codes around one centre: far more than a task may hold of one key, so they go over pairs of child nodes."""
    rng = random.Random(5)
    centre, codes = rng.getrandbits(64), set()
    while len(codes) < 250:
        c = centre
        for _ in range(rng.randint(0, 6)):
            c ^= 1 << rng.randrange(40)
        codes.add(c)
    codes = sorted(codes)
    frame = spark.createDataFrame([(bytearray(c.to_bytes(8, "big")),) for c in codes], "code binary")
    label = closure(codes, 2)
    for heavy in (8, 10**6):
        edges = simhash_trie.links(frame, simhash_trie.covering_anchors(64, 2, 4), 2, heavy=heavy)
        pairs = [(int.from_bytes(r.u, "big"), int.from_bytes(r.v, "big")) for r in edges.collect()]
        found = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in simhash_trie.connected(edges).collect()}
        assert pairs
        assert [found.get(c, c) for c in codes] == [codes[k] for k in label]


@pytest.mark.parametrize("budget", [0, 1, 3, 9])
def test_trie_join(budget):
    rng = np.random.default_rng(budget)
    codes = np.unique(rng.integers(0, 2**12, 400).astype(np.uint64) * np.uint64(2**50 + 1))
    label = simhash_trie.trie_links(codes[:, None], np.array([[0, len(codes), 0, len(codes)]]), budget)
    assert label.tolist() == closure([int(c) for c in codes], budget)


def test_near_copies_go(spark, docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, n = [], 0
    for _ in range(30):
        w = [word() for _ in range(300)]
        rows.append((n, " ".join(w)))
        v = list(w)
        v[rng.randrange(300)] = word()  # shares 0.97 of its shingles
        rows += [(n + 1, " ".join(v)), (n + 2, " ".join(w)), (n + 3, " ".join(word() for _ in range(300)))]
        n += 4
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash_trie.drop_near_copies(frame).collect()}
    assert kept == {i for i in range(n) if i % 4 in (0, 3)}


def test_near_copies_of_odd_rows(odd, none):
    out = simhash_trie.drop_near_copies(odd)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "6", "7", "None"]  # texts without words are copies of each other
    assert simhash_trie.drop_near_copies(none).count() == 0


def sets_of(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_by_exact_similarity(spark):
    """Pairs around the threshold, long and short: those at 0.8 or more lose a document, and no others do."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for n, aim in [(300, 0.75), (300, 0.79), (300, 0.8), (300, 0.81), (300, 0.85), (300, 0.9), (30, 0.75), (30, 0.8), (30, 0.9)] * 12:
        w = [word() for _ in range(n)]
        v, near = list(w), sets_of(" ".join(w))
        while jaccard(near, sets_of(" ".join(v))) > aim + 0.01:  # the last step may fall on either side
            v[rng.randrange(n)] = word()
        i = 2 * len(want)
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
        want[i + 1] = jaccard(near, sets_of(" ".join(v))) >= 0.8
    for _ in range(20):  # four shingles and five: 0.8 exactly
        w = [word() for _ in range(9)]
        i = 2 * len(want)
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:8]))]
        want[i + 1] = True
    assert 30 < sum(want.values()) < len(want) - 30
    kept = {r.doc_id for r in simhash_trie.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    assert {i for i in want if i not in kept} == {i for i, near in want.items() if near}


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_passages_go_but_for_the_first(spark):
    rng = random.Random(4)
    one, many = passage(rng, 60), "\n".join(passage(rng, 9) for _ in range(7))
    rows = [(i, "\n".join([passage(rng, 12), p, passage(rng, 15)])) for i, p in enumerate([one, many, one, many, many + "\n" + one, passage(rng, 70)])]
    rows.append((9, "\n".join([one, passage(rng, 5), one])))
    out = {r.doc_id: r for r in line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count_into="n").collect()}
    was = dict(rows)
    assert [out[i].n for i in (0, 1, 5)] == [0, 0, 0] and all(out[i].text == was[i] for i in (0, 1, 5))
    assert [out[i].n for i in (2, 3, 4, 9)] == [1, 7, 8, 2]
    assert all(one not in out[i].text and many not in out[i].text for i in (2, 3, 4, 9))
    assert out[2].text == "\n".join(was[2].split("\n")[::2])


def test_runs_go_but_for_a_bounded_rest(spark):
    """Against all pairs of lines: of each run of 50 words that stands earlier, under 50 words stay; what goes stands earlier in a run of 25 words."""
    rng = random.Random(8)
    pool = [[passage(rng, rng.choice([3, 8, 20, 60])) for _ in range(rng.choice([6, 30, 200]))] for _ in range(6)]
    rows = []
    for i in range(14):
        parts = []
        for _ in range(3):
            src = rng.choice(pool)
            a = rng.randrange(len(src))
            parts += [passage(rng, 7), *src[a : a + rng.choice([2, 6, 150])], ""]
        rows.append((i, "\n".join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {(r.id, r.pos) for r in line_winnow.repeated(line_winnow.lines(frame)).collect()}
    docs = [[(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x] for _, t in rows]
    in_run = set()
    for i, mine in enumerate(docs):
        for j, other in enumerate(docs[: i + 1]):
            for diag in range(-len(other) + 1, len(mine)):
                if i == j and diag <= 0:
                    continue
                run = []
                for k in range(max(0, diag), min(len(mine), len(other) + diag) + 1):
                    if k < min(len(mine), len(other) + diag) and mine[k][1] == other[k - diag][1]:
                        run.append(mine[k])
                        continue
                    size = sum(n for *_, n in run)
                    if size >= 25:
                        in_run |= {(i, pos) for pos, *_ in run}
                    if size >= 50:
                        assert sum(n for pos, _, n in run if (i, pos) not in gone) < 50
                    run = []
    assert gone and gone <= in_run


def test_matches_extend_through_long_runs(spark):
    rng = random.Random(9)
    base = [passage(rng, 6) for _ in range(900)]
    early = [(i, "\n".join(base[5 * i + 1 : 5 * i + 7])) for i in range(170)]  # the first places of all grams
    rows = [*early, (1000, "\n".join(base)), (1001, "\n".join(base))]
    gone = {(r.id, r.pos) for r in line_winnow.repeated(line_winnow.lines(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len({p for i, p in gone if i == 1001}) >= 840


def test_copies_that_end_with_a_block_settle(spark):
    """Matches that reach the last line of a document, at the border of a block, ask for nothing beyond."""
    rng = random.Random(10)
    base = [passage(rng, 8) for _ in range(2 * line_winnow.EXTEND)]
    rows = [(i, "\n".join(base)) for i in range(3)] + [(9, "\n".join(base[: line_winnow.EXTEND]))]
    gone = {(r.id, r.pos) for r in line_winnow.repeated(line_winnow.lines(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert gone == {(i, p) for i in (1, 2) for p in range(len(base))} | {(9, p) for p in range(line_winnow.EXTEND)}


def test_count_keeps_a_column_of_its_name(spark):
    out = line_winnow.dedup_lines(spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, n int"), count_into="n")
    assert out.columns == ["doc_id", "text", "n", "n_"] and out.first().n == 7 and out.first().n_ == 0


def test_short_lines_stay(spark):
    rows = [(i, f"line {i} of its own\nAll rights reserved.") for i in range(5)]
    out = line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows


def test_lines_of_odd_rows(odd, none):
    out = line_winnow.dedup_lines(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert line_winnow.dedup_lines(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=70).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(7, rows[9][1]), (None, rows[1][1]), (300, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    codes = {}
    for i, v in rows:
        if i is not None and v is not None:
            codes.setdefault(i, []).append(np.array(v) > 0)
    want = []
    for q in sorted(i for i in codes if i % 10 == 0):
        near = sorted((min(int((a != b).sum()) for a in codes[q] for b in v), i) for i, v in codes.items() if i != q)
        want += [(q, r, i, d) for r, (d, i) in enumerate(near[:5], 1)]
    got = hamming_topk.top_k(frame, frame.where("vec_id % 10 = 0"), k=5, bits=70).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert hamming_topk.top_k(frame.where("false"), frame.where("false")).count() == 0
    assert hamming_topk.top_k(frame.where("vec_id < 3"), frame.where("vec_id < 3"), k=5, bits=70).count() == 6


def test_top_k_broadcasts_neither_side_of_its_join(spark, monkeypatch):
    """Probes are thousands for each query, entries four for each vector; near and far neighbours have searches end at every table of a radius."""
    rng = np.random.default_rng(8)
    bits = rng.random((400, 64)) < 0.5
    for i in range(0, 400, 10):
        for j in range(1, 6):
            bits[i + j] = bits[i] ^ (rng.random(64) < (i % 70 + 5) / 300)
    rows = [(i, np.where(b, 1.0, -1.0).tolist()) for i, b in enumerate(bits)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans, kept = [], hamming_topk.written
    monkeypatch.setattr(hamming_topk, "written", lambda df, name: (name == "found" and plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    monkeypatch.setattr(hamming_topk, "PROBES", 1000, raising=False)
    got = hamming_topk.top_k(frame, frame.where("vec_id % 10 = 0"), k=4).collect()
    want = []
    for q in range(0, 400, 10):
        near = sorted((int((bits[q] != b).sum()), i) for i, b in enumerate(bits) if i != q)
        want += [(q, r, i, d) for r, (d, i) in enumerate(near[:4], 1)]
    assert sorted(map(tuple, got)) == want and len({d // 4 for *_, d in want}) > 3
    assert len(plans) > 3 and all("SortMergeJoin [seg" in p for p in plans)  # the codes that ask, a few for each round, may be broadcast


def test_parts_of_urls(spark):
    cases = {
        "http://A.Example.com/en/7?x#y": ("a.example.com", "/en/7"),
        "https://x.org?q=/a": ("x.org", ""),
        "x://h#/p?": ("h", ""),
        "nothing here": ("", ""),
        "a://b://c/d": ("b:", "//c/d"),
        None: ("", ""),
        "": ("", ""),
        "://": ("", ""),
        "http://É.COM/É": ("É.com", "/É"),
    }
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "")]
    out = url_templates.judge(frame, rules)
    rows = {r.url: r for r in out.collect()}
    assert {u: (r.host_, r.path) for u, r in rows.items()} == cases and out.columns[:3] == frame.columns
    assert (rows["http://A.Example.com/en/7?x#y"].rule, rows["http://A.Example.com/en/7?x#y"].verdict) == ("example.com/en/7", "allow")
    assert rows["https://x.org?q=/a"].verdict == "block" and rows[None].rule is None and rows[None].verdict == "allow"
    assert url_templates.judge(frame.where("false"), rules).count() == 0


def test_templates_and_purity(spark):
    rows = [(i, f"http://site.org/{'good' if i % 2 else 'bad'}/{i}/view.html", i % 2 == 0) for i in range(200)]
    rows += [(1000 + i, f"http://other.org/{''.join(random.Random(i).choices('abcdefgh', k=8))}", False) for i in range(100)]
    frame = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 3 == 0], "page_id long, y int")
    got = {r.page_id: r for r in url_templates.judge(frame, [], labels).collect()}
    assert all((got[i].verdict == "block") == bad for i, _, bad in rows)
    assert got[0].template == "/bad/<n>/view.html" and got[1000].template == "/*"


def plain_templates(rows):
    """host, segments and label of each url to (template, rate, labels of the branch), by recursion."""
    out, tree = {}, {}

    def grow(host, some, depth, parent, template):
        more = [r for r in some if len(rows[r][1]) > depth]
        for r in set(some) - set(more):
            tree.setdefault((host, parent), {}).setdefault(template, []).append(r)
        if len(some) < url_templates.LEAST:
            for r in more:
                tree.setdefault((host, template), {}).setdefault(template + "/**", []).append(r)
            return
        count = Counter(rows[r][1][depth] for r in more)
        kept = {x for x, c in count.items() if c >= url_templates.LEAST and c >= url_templates.SHARE * len(some)}
        for x in {x if x in kept else "*" for x in count}:
            grow(host, [r for r in more if (rows[r][1][depth] if rows[r][1][depth] in kept else "*") == x], depth + 1, template, f"{template}/{x}")

    for host in {h for h, _, _ in rows.values()}:
        grow(host, [r for r, (h, _, _) in rows.items() if h == host], 0, "", "")
    rate = lambda b, n: (b + 0.5) / (n + 1)
    tally = lambda some: (sum(rows[r][2] is not None for r in some), sum(rows[r][2] or 0 for r in some))
    whole = tally(rows)
    for (host, _), children in tree.items():
        mine = tally([r for r, (h, _, _) in rows.items() if h == host])
        prior = (mine[1] + url_templates.PRIOR * rate(whole[1], whole[0])) / (mine[0] + url_templates.PRIOR)
        found = []
        for _, name, n, b in sorted((rate(b, n), t, n, b) for t, some in children.items() for n, b in [tally(some)]):
            if found:
                n0, b0, names = found[-1]
                pooled = (b0 + b + 1) / (n0 + n + 2)
                if abs(rate(b, n) - rate(b0, n0)) <= url_templates.ALIKE * (pooled * (1 - pooled) * (1 / (n0 + 1) + 1 / (n + 1))) ** 0.5:
                    found[-1] = (n0 + n, b0 + b, names + [name])
                    continue
            found.append((n, b, [name]))
        for n, b, names in found:
            for name in names:
                for r in children[name]:
                    out[r] = (name, (b + url_templates.PRIOR * prior) / (n + url_templates.PRIOR), n)
    return out


def test_tree_is_a_plain_one(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "news", "item7", "x/y", "deep/er/and/er/still/more/of/it"]
    urls = [(i, f"http://h{rng.randint(0, 3)}.org/" + "/".join(rng.choices([*words, str(rng.randint(0, 99)), f"once{i}"], k=rng.randint(0, 4)))) for i in range(600)]
    urls += [(1000 + i, "http://tie.org/a/b") for i in range(9)]  # urls that repeat
    labels = [(i, rng.randint(0, 1) if "b" in u else 0) for i, u in urls if rng.random() < 0.6]
    given = dict(labels)
    plain = plain_templates({i: (u.split("/")[2], [re.sub("[0-9]+", "<n>", x) for x in u.split("/")[3:] if x], given.get(i)) for i, u in urls})
    frame = spark.createDataFrame(urls, "page_id long, url string")
    got = url_templates.judge(frame, [], spark.createDataFrame(labels, "page_id long, y int")).collect()
    assert len(got) == len(urls)
    for r in got:
        name, rate, n = plain[r.page_id]
        assert (r.template, r.rate) == (name, pytest.approx(rate))
        assert r.verdict == ("block" if rate >= url_templates.REJECT and n >= url_templates.LABELS else "allow")


def test_rules_label_urls_and_long_paths_pass(spark):
    rows = [(i, f"http://s.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(40)] + [(50, "http://s.com/" + "p/" * 100_000), (51, "http://s.com/en/x" + "y" * 1_000_000)]
    rules = [("block", "s.com", "/en/1"), ("allow", "s.com", "/fr/"), ("allow", "com", "/en/11"), ("block", "com", "/fr/99")]
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[3].rule is None and got[3].verdict == "block"  # most of its template is blocked by a rule
    assert got[11].verdict == "block" and got[2].verdict == "allow" and {got[50].verdict, got[51].verdict} <= {"allow", "block"}


def test_anchors_cover():
    anchors = simhash_trie.covering_anchors(64, 2, 4)
    for a in range(64):
        for b in range(64):
            assert any(a not in x and b not in x for x in map(set, anchors))
    assert len(simhash_trie.sampled_anchors(256, 16, 40)) == 40 and SF


def test_very_deep_urls_with_copies(spark):
    """Five copies each of paths of a thousand segments: a few steps, and the templates of a tree built segment by segment."""
    import time

    from lumisonde.llm import url_templates

    name = lambda k: "".join(chr(97 + k // b % 26) for b in (676, 26, 1))  # noqa: E731  without digits
    deep = ["/" + "/".join(name(k) + ("x" if k == turn else "") for k in range(1000)) for turn in (-1, 500, 990)]
    rows = [(i, f"http://h.example{p}") for i, p in enumerate(deep * 5)] + [(100, "http://h.example/aaa"), (101, "http://h.example/aaa/aab")]
    started = time.time()
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), []).collect()}
    assert time.time() - started < 120 and len(got) == len(rows)
    assert all(got[i].template == deep[i % 3] for i in range(15)) and got[100].template == "/aaa" and got[101].template == "/aaa/aab"


def test_bounds_of_similarity_lose_no_pair():
    """Sets with a common core: pairs at the similarity or more always pass, and of those around 0.6 hardly any do."""
    import time

    from lumisonde.llm import simhash_trie as st

    rng = np.random.default_rng(7)
    core = rng.integers(0, 1 << 63, 225).astype(np.uint64)

    def family(n, common, own):
        out = np.empty(n, object)
        for k in range(n):
            out[k] = np.unique(np.concatenate([core[:common], rng.integers(0, 1 << 63, own).astype(np.uint64)]))
        return out

    mixed = np.concatenate([family(20, c, 240 - c) for c in (225, 215, 200, 180, 60)] + [family(3, 0, 0)])
    i, j = np.triu_indices(len(mixed), 1)
    may = st.may_be_alike(i, j, np.array([len(s) for s in mixed]), st.histograms(mixed), 0.8)
    alike = np.array([st._alike(mixed[a], mixed[b], 0.8) for a, b in zip(i, j)])
    assert alike.any() and not (alike & ~may).any()
    huge = np.empty(2, object)
    huge[:] = [np.arange(70_000, dtype=np.uint64) * np.uint64(st.BINS)] * 2  # more in one bin than is counted
    assert st.may_be_alike(np.array([0]), np.array([1]), np.array([70_000] * 2), st.histograms(huge), 0.8).all()
    far = family(3000, 225, 75)  # all pairs near 0.6
    i, j = np.triu_indices(len(far), 1)
    started = time.time()
    may = st.may_be_alike(i, j, np.array([len(s) for s in far]), st.histograms(far), 0.8)
    assert time.time() - started < 60 and may.mean() < 0.01
