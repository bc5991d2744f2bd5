"""A Merkle manifest of a table: one tree for each group of rows, one tree over the groups' roots, a proof for each row.

Leaves get their place by a range partition and prefix sums over the partitions' counts. Then trees are built by
events: a node tells its parent its digest and place; a partial parent gathers such children until it has as many as
the tree's size says, and is an event of its own then. Tasks hold a block of consecutive leaves and resolve all
ancestors that lie within; what waits for a child elsewhere is the frontier, which is shuffled by wider blocks, until
only roots remain. Proofs come down the same links: a block gets the way up from each node it handed on, and gives its
own events their ways.

Scale: a task holds BLOCK leaves of one tree, or the frontiers of BLOCK such blocks, whatever a tree's size, so a group
with a third of all rows is many tasks. Rounds: the logarithm of the largest tree to the base BLOCK. Texts are read once,
for their digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import Scratch

ARITY = 2
#: Leaves that a task builds a tree of at a time (a power of the arity is taken, this one at most).
BLOCK = 8192
#: Leaves in a part of the range partition.
PART_ROWS = 1_000_000

Node = tuple[int, int]


def field(value: Column) -> Column:
    """A value as text that no other value has: its UTF-8 byte count, a colon, and itself; `-` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values in their order, in lower-case hex."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def siblings(steps: Column) -> Column:
    """A proof's digests, level by level and left to right, in one string."""
    return F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def _combine(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(size: int, arity: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // arity), h + 1
    return h


def children(size: int, node: Node, arity: int) -> range:
    """Places of a node's children in the level below, in a tree of ``size`` leaves."""
    level, i = node
    return range(i * arity, min((i + 1) * arity, -(-size // arity ** (level - 1))))


def climb(events: Iterable[tuple[Node, str]], size: int, arity: int = ARITY) -> tuple[dict[Node, str], list[Node]]:
    """Digests of all nodes that the events resolve, themselves included, and the nodes without a resolved parent."""
    known: dict[Node, str] = {}
    partial: dict[Node, dict[int, str]] = {}
    todo, top = list(events), height(size, arity)
    while todo:
        node, digest = todo.pop()
        known[node] = digest
        if node[0] == top:
            continue
        parent = (node[0] + 1, node[1] // arity)
        got = partial.setdefault(parent, {})
        got[node[1]] = digest
        if len(got) == len(children(size, parent, arity)):
            del partial[parent]
            todo.append((parent, _combine(d for _, d in sorted(got.items()))))
    return known, [n for n in known if n[0] == top or (n[0] + 1, n[1] // arity) not in known]


def ways(known: dict[Node, str], above: dict[Node, list[dict]], starts: Iterable[Node], size: int, arity: int = ARITY) -> dict[Node, list[dict]]:
    """Steps up to the root for each start: those among the known nodes, then those from above."""
    found = dict(above)
    for start in starts:
        chain, node = [], start
        while node not in found:
            chain.append(node)
            node = (node[0] + 1, node[1] // arity)
        for node in reversed(chain):
            parent = (node[0] + 1, node[1] // arity)
            row = children(size, parent, arity)
            step = {"left": "".join(known[node[0], j] for j in row if j < node[1]), "right": "".join(known[node[0], j] for j in row if j > node[1])}
            found[node] = [step, *found[parent]]
    return found


_STEPS = "array<struct<left: string, right: string>>"
_STEPS_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _placed(leaves: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``leaves`` (tree and others) with size (of its tree) and place (in it, from 0) by ``order``. Rows that are equal
    there get places of their own."""
    parts = -(-leaves.count() // PART_ROWS)
    parts = max(parts, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = leaves.withColumn("_salt", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, "tree", *order, "_salt").sortWithinPartitions("tree", *order, "_salt").drop("_salt")
    numbered = scratch.save(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), f"{name}-ranged")
    # One row for each tree in each part: as many as there are parts and trees together.
    counts = numbered.groupBy("tree", "_part").agg(F.min("_at").alias("low"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("tree", "_part", (before - F.col("low")).alias("base"), F.sum("n").over(whole).alias("size"))
    return numbered.join(bases, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("base")).drop("_at", "_part", "base")


class _Forest:
    """All trees of a table (tree, size, place, digest, kept columns): the way up, kept for the way down."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str, arity: int):
        self.scratch, self.name, self.arity = scratch, name, arity
        self.span = arity
        while self.span * arity <= BLOCK:
            self.span *= arity
        self.rounds = [scratch.save(self._blocks(leaves.withColumn("level", F.lit(0)), 0), f"{name}-0")]
        most = self.rounds[0].agg(F.max("size")).first()[0] or 0
        roots = []
        while True:
            k = len(self.rounds)
            up = self._up(self.rounds[-1])
            if self.span**k >= most:
                roots.append(scratch.save(up.filter("root"), f"{name}-roots{k}"))
                break
            both = scratch.save(up, f"{name}-up{k}")
            roots.append(both.filter("root"))
            self.rounds.append(scratch.save(self._blocks(both.filter("not root").drop("root"), k), f"{name}-{k}"))
        self.roots = roots

    def _blocks(self, nodes: DataFrame, k: int) -> DataFrame:
        """Nodes with the block that they belong to in round k. A block has ``span`` leaves in round 0."""
        width = F.lit(float(self.span)) ** (k + 1)
        leaves = F.col("place") * F.pow(F.lit(float(self.arity)), F.col("level"))
        return nodes.withColumn("block", F.floor(leaves / width).cast("long"))

    def _up(self, events: DataFrame) -> DataFrame:
        arity = self.arity

        def run(table: pa.Table) -> pa.Table:
            size = table["size"][0].as_py()
            known, tops = climb(zip(zip(table["level"].to_pylist(), table["place"].to_pylist()), table["digest"].to_pylist()), size, arity)
            top = height(size, arity)
            cols = [pa.array(c, t) for c, t in zip(([table["tree"][0].as_py()] * len(tops), [size] * len(tops), [n[0] for n in tops], [n[1] for n in tops], [known[n] for n in tops], [n[0] == top for n in tops]), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))]
            return pa.Table.from_arrays(cols, ["tree", "size", "level", "place", "digest", "root"])

        return events.select("tree", "size", "level", "place", "digest", "block").groupBy("tree", "block").applyInArrow(run, "tree string, size long, level int, place long, digest string, root boolean")

    def down(self, above: Callable[[DataFrame], DataFrame], keep: list[str]) -> DataFrame:
        """A row for each leaf: its kept columns, digest, place, size, and what ``above`` says of its tree: that gives
        for root rows (tree, level, place, digest) the columns tree, subroot, root and steps."""
        ways_up = None
        for k in range(len(self.rounds) - 1, -1, -1):
            seeds = self.roots[k].select("tree", "level", "place", "digest").join(above(self.roots[k]), "tree").select("tree", "level", "place", "subroot", "root", "steps")
            ways_up = self._blocks(seeds if ways_up is None else seeds.unionByName(ways_up), k)
            ways_up = self._down(self.rounds[k], ways_up, keep if k == 0 else [])
            if k:
                ways_up = self.scratch.save(ways_up.drop("digest"), f"{self.name}-down{k}")
        return ways_up

    def _down(self, events: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
        arity = self.arity
        kept = [f for f in events.schema.fields if f.name in keep]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            nodes = list(zip(left["level"].to_pylist(), left["place"].to_pylist()))
            size = left["size"][0].as_py() if nodes else 0
            known, _ = climb(zip(nodes, left["digest"].to_pylist()), size, arity)
            over = dict(zip(zip(right["level"].to_pylist(), right["place"].to_pylist()), right["steps"].to_pylist()))
            found = ways(known, over, nodes, size, arity)
            n = len(nodes)
            same = [pa.array([right[c][0].as_py()] * n if n else [], pa.string()) for c in ("subroot", "root")]
            return pa.Table.from_arrays(
                [left["tree"], left["level"], left["place"], left["digest"], *same, pa.array([found[x] for x in nodes], _STEPS_ARROW), *[left[f.name] for f in kept]],
                ["tree", "level", "place", "digest", "subroot", "root", "steps", *[f.name for f in kept]],
            )

        plain = StructType.fromDDL(f"tree string, level int, place long, digest string, subroot string, root string, steps {_STEPS}")
        schema = StructType([*plain.fields, *kept])
        return events.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def manifest(docs: DataFrame, digest: Column, group: Column, order: Column, keep: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """A row for each row of ``docs``: the columns of ``keep``, digest, place (in its tree, from 0), subroot, root, and
    steps: its proof, an array from the leaf up to the root of (left, right), the siblings' digests, concatenated.

    Rows with equal ``group`` (a string) are leaves of one tree, by ``order``, then by digest; null is a group and an
    ``order`` of its own and comes first, and equal rows are leaves of their own. Every ``arity`` nodes in a row have one
    parent, the last of a level fewer, even one; a single leaf is its tree's root. The groups' roots, by group in bytewise
    order, are the leaves of the tree whose root is the manifest's. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    # A key that is never null and sorts as the group does; the kept columns lie in one struct, so that no name clashes.
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    keep = keep or {}
    kept = F.struct(*[c.alias(n) for n, c in keep.items()], F.lit(0).alias("_"))
    leaves = scratch.save(docs.select(tree.alias("tree"), order.alias("_order"), digest.alias("digest"), kept.alias("_kept")), "leaves")
    forest = _Forest(_placed(leaves, ["_order", "digest"], scratch, "rows").select("tree", "size", "place", "digest", "_kept"), scratch, "rows", arity)
    subroots = forest.roots[0]
    for more in forest.roots[1:]:
        subroots = subroots.unionByName(more)
    # The groups' tree has one name; a group's key is a kept column there.
    tops = scratch.save(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "digest"), "subroots")
    crown = _Forest(_placed(tops, ["_group"], scratch, "groups").select("tree", "size", "place", "digest", "_group"), scratch, "groups", arity)
    own = F.lit(None).cast(_STEPS)
    roots = crown.down(lambda r: r.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.coalesce(own, F.array().cast(_STEPS)).alias("steps")), ["_group"])
    above = scratch.save(roots.select(F.col("_group").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"), "above")
    out = forest.down(lambda r: above, ["_kept"])
    scratch.keep_only("above", *[n for n in scratch.saved if n.startswith("rows-") and not n.startswith("rows-ranged")])
    return out.select(*[F.col(f"_kept.`{n}`") for n in keep], "digest", "place", "subroot", "root", "steps")


def document_digests(docs: DataFrame) -> DataFrame:
    """The manifest of documents, one tree for each language, held against rows of which some were tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A leaf is made of doc_id, source, lang,
    n_chars and text. Where 7 divides the crc32 of the decimal doc_id, folded_root is folded from the leaf with 1 added to
    n_chars; rows without n_chars or doc_id stay as they are. Nulls, repeated rows and empty tables: see ``manifest``.
    """
    doc_id, n_chars = F.col("doc_id"), F.col("n_chars")
    changed = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, n_chars.cast("decimal(38,0)") + 1)
    first, last = (F.col("source"), F.col("lang")), F.col("text")
    tampered = F.when(changed.isNotNull(), leaf(doc_id, *first, changed, last))
    found = manifest(docs, leaf(doc_id, *first, n_chars, last), F.col("lang"), doc_id, {"doc_id": doc_id, "tampered": tampered})
    folded = fold(F.coalesce("tampered", "digest"), F.col("steps"))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
