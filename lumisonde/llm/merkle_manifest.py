"""Merkle manifest of a dataset: a tree of digests for each source, a root over all, and a proof for every row.

A row's leaf is the digest of its fields. Within a source leaves are ordered by identifier; every
``RUN`` consecutive nodes become the digest of their digests, until one is left, the source's
subroot. Subroots, ordered by source, make the last tree in the same way.

Proofs are coordinate lookups. From its index and the size of its level a node works out which
coordinates it needs, those of the others of its run; these rows meet the table of nodes in an
equi-join, are ordered and concatenated. What lies above a run is the same for all its nodes, so
it is looked up once for their parent and inherited: n leaves ask for 15 n coordinates and all
levels above for n more, no coordinate is asked for by more than 15 nodes, and no group holds
more than a run. Levels are logarithmic in the rows (``RUN`` to the 16th is more than 2 to the 63rd).

Defined cases: a null field is ``-``; a null doc_id comes first, null sources are a source of
their own and the first one; equal doc_ids are ordered by leaf, so repeated rows are leaves of
their own; an empty table gives an empty table; other columns are not part of a leaf; texts of
any length are one digest; a lone leaf is its source's subroot and a lone subroot the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.llm.common import ascii_lower, written
from lumisonde.operators.ranks import ranked

#: Nodes of a run, as a power of 2.
RUN_BITS = 4
RUN = 1 << RUN_BITS
#: Pieces that the order of a source is cut into, so that no source is one task.
RANGES = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    """The 32 bytes of a string's sha256."""
    return F.unhex(F.sha2(c, 256))


def as_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def joined(digests: Column) -> Column:
    """An array of digests as one string."""
    return F.array_join(F.transform(digests, as_hex), "")


def leaf_of(**fields: Column) -> Column:
    """The digest of FIELDS, each with its length before it; fields given here replace columns."""
    value = lambda c: fields.get(c, F.col(c)).cast("string")
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in FIELDS]))


def tampered() -> Column:
    """Whether the check of the proofs tampers with a row."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _ordered(name: Column) -> Column:
    """A number that orders strings as their first 6 bytes do, null for null."""
    return F.conv(F.rpad(F.hex(F.substring(name.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tree, at, n, digest, changed): every row's leaf and its place; changed is the leaf after tampering. And (source, tree, n): the trees."""
    changed = F.when(tampered(), leaf_of(text=ascii_lower(F.col("text")))).otherwise(F.col("digest"))
    rows = docs.select(*FIELDS).withColumn("digest", leaf_of()).select("doc_id", "source", "digest", changed.alias("changed"))
    placed = ranked(written(rows, "leaves"), ["source"], ["doc_id", "digest"], into="at", ranges=RANGES)
    placed = written(placed.withColumn("at", F.col("at").cast("long") - 1), "placed")
    sources = placed.groupBy("source").agg(F.max("n").alias("n"))
    trees = ranked(sources.withColumn("first", _ordered(F.col("source"))), [], ["first", "source"], into="tree", size="sources", ranges=RANGES)
    trees = written(trees.select("source", F.col("tree").cast("long"), "n"), "trees")
    found = placed.drop("n").join(trees, placed.source.eqNullSafe(trees.source)).select("doc_id", "tree", "at", "n", "digest", "changed")
    return written(found, "leaves"), trees


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, at, n, digest) of every level, from nodes up, which may have more columns; a tree is in the levels up to the one where it has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("at", "digest")))
        above = out[-1].where("n > 1").groupBy("tree", "n", F.shiftright("at", RUN_BITS).alias("up")).agg(run.alias("run"))
        size = (F.shiftright(F.col("n") - 1, RUN_BITS) + 1).alias("n")
        out.append(written(above.select("tree", F.col("up").alias("at"), size, digest(joined(F.col("run.digest"))).alias("digest")), "level"))
        most = (most + RUN - 1) // RUN
    return out


def coordinates() -> Column:
    """The places of the others in the run of the node at ``at``, where its level has n nodes."""
    first = F.shiftleft(F.shiftright("at", RUN_BITS), RUN_BITS)
    return F.filter(F.sequence(first, F.least(first + RUN - 1, F.col("n") - 1)), lambda x: x != F.col("at"))


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, up, at, own, step): nodes whose level has more than theirs, with all their columns as own, the place of their parent, and the digests left and right of them in their run.

    Coordinates meet the nodes in one join; what they found and the nodes' own rows are then grouped where the runs are, so that parents can be joined there.
    """
    up = F.shiftright("at", RUN_BITS).alias("up")
    inner = nodes.where("n > 1")
    found = inner.select("tree", up, "at", F.explode(coordinates()).alias("other")).join(nodes.select("tree", F.col("at").alias("other"), "digest"), ["tree", "other"])
    own = F.struct(*nodes.columns)
    kind = nodes.select(own.alias("own")).schema["own"].dataType
    rows = found.select("tree", "up", "at", F.struct("other", "digest").alias("s"), F.lit(None).cast(kind).alias("own"))
    none = "struct<other: bigint, digest: binary>"
    rows = rows.unionByName(inner.select("tree", up, "at", F.lit(None).cast(none).alias("s"), own.alias("own"))).repartition("tree", "up")
    run = rows.groupBy("tree", "up", "at").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("s")).alias("run"))
    part = lambda keep: F.aggregate(F.filter("run", keep), F.lit(b""), lambda x, y: F.concat(x, y["digest"]))
    step = F.struct(part(lambda x: x["other"] < F.col("at")).alias("left"), part(lambda x: x["other"] > F.col("at")).alias("right"))
    return run.select("tree", "up", "at", "own", step.alias("step"))


def paths(tree: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The nodes of the lowest level with path, their steps to the root, and subroot. above: (tree, path, subroot) of what each tree's root has; by default it has no step and is none."""
    none = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
    found = None
    for k, nodes in reversed(list(enumerate(tree))):
        roots = nodes.where("n = 1")
        roots = roots.join(above, "tree") if above is not None else roots.withColumns({"path": none, "subroot": F.lit(None).cast("string")})
        if found is not None:
            parents = found.select("tree", F.col("at").alias("up"), F.col("path").alias("rest"), "subroot")
            inner = siblings(nodes).join(parents.hint("merge"), ["tree", "up"])  # files of paths are far smaller than paths, so no broadcast by their size
            roots = inner.select(*[f"own.{c}" for c in nodes.columns], F.concat(F.array("step"), "rest").alias("path"), "subroot").unionByName(roots)
        found = written(roots, "paths") if k else roots
    return found


def proof_of(path: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(as_hex(s["left"]), as_hex(s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, as_hex(leaf), lambda x, s: F.sha2(F.concat(as_hex(s["left"]), x, as_hex(s["right"])), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs."""
    rows, trees = leaves(docs)
    every = levels(rows)
    tops = every[0].where("n = 1").select("tree", "digest")
    for nodes in every[1:]:
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
    one = tops.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("at"), F.lit(trees.count()).cast("long").alias("n"), "digest")
    last = levels(written(one, "subroots"))
    top = last[-1].select(as_hex(F.col("digest")).alias("r")).first()  # of one row, if any
    upper = paths(last).select((F.col("at") + 1).alias("tree"), "path", as_hex(F.col("digest")).alias("subroot"))
    out = paths(every, written(upper, "upper"))
    # paths go no further than here
    out = out.select("doc_id", as_hex(F.col("digest")).alias("leaf"), "subroot", F.lit(top["r"] if top else None).cast("string").alias("root"), proof_of(F.col("path")).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
