"""Prefix trie of conversations from sorted neighbours.

Every conversation becomes one key: the 16-byte digests of its turns, one after
the other. Keys are range-sorted, so conversations that share a prefix are
neighbours, and a trie node of depth d is a run of rows whose neighbours have d
turns or more in common (LCP).

1. A task takes its sorted rows in blocks of bounded size. Union-find over the
   edges between neighbours, in descending LCP: a component is the rows below one
   node, and two components that merge at depth L make a branching node there;
   the unary nodes between are filled in on the way up.
2. Nodes that neither the block's first nor its last row runs through lie wholly in
   the block: they are finished. The others are contracted to two paths, with what
   hangs on each of their nodes summed up.
3. The contracted paths of all blocks, two per block, are merged the same way
   across the boundaries; finished nodes below them then get their parent's name.
4. Who ends at a node is hashed in order of ids, streamed; of nodes that cross a
   boundary the blocks hand over pieces of the joined ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import delete_folder, ship_package, store

NAME = 16                 # bytes of a turn's digest
GROUP = 5                 # conversations that share the first one's beginning
SHARED = 9                # .. of fewer than so many turns
BLOCK_TURNS = 1 << 17     # turns of the rows that a worker merges together
PIECE_IDS = 512           # ids in a piece of a joined list


# --- keys -------------------------------------------------------------------------

def conversation_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<place, name, size>> of every conversation, in
    order of turn (null first), role and text; null roles and texts are empty.
    Rows without a conv_id take no part."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).filter("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    name = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    named = rows.select("conv_id", F.struct(
        place.alias("place"), name.alias("name"), F.octet_length("text").alias("size")).alias("t"))
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(keys: DataFrame) -> DataFrame:
    """The conversations with their first turns taken from the first one of their
    group: the first h = crc32(conv_id) % SHARED turns of conv_id - conv_id % GROUP."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    first = keys.filter(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head"))
    own = keys.select("conv_id", "turns", base.alias("base"), (
        F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"))
    turns = F.expr("""concat(case when head is null then slice(turns, 1, 0) else slice(head, 1, h) end,
        slice(turns, h + 1, size(turns)))""")
    return own.join(first, "base", "left").select("conv_id", turns.alias("turns"))


# --- union-find over neighbours ---------------------------------------------------

@dataclass
class Hung:
    """What hangs on a node beside its children in the forest at hand."""
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    row: int = -1  # the row that ends here, if any

    def add(self, other: Hung) -> None:
        self.n += other.n
        if other.least is not None:
            self.least = other.least if self.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.row = max(self.row, other.row)


@dataclass
class Row:
    """A path down from the root, and what hangs on its nodes, by depth."""
    key: bytes
    sizes: list[int]
    hung: dict[int, Hung]


@dataclass
class Node:
    depth: int
    total: Hung       # of its subtree; children: its own; row: the one that ends here
    parent: int = -1


@dataclass
class _Component:
    row: int
    top: int                      # the depth above which nothing is finished
    below: Hung = field(default_factory=Hung)  # the finished subtrees
    waiting: list[int] = field(default_factory=list)  # nodes without a parent
    hung: dict[int, Hung] = field(default_factory=dict)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    if a == b:
        return len(a) // NAME
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    at = int(x.argmax()) if n else 0
    return (at if n and x[at] else n) // NAME


def forest(rows: list[Row]) -> list[Node]:
    """All nodes of the trie of sorted rows with distinct keys, children before
    their parents. A row's ``hung`` holds an entry for its own end."""
    nodes: list[Node] = []
    up = list(range(len(rows)))
    parts = [_Component(i, len(r.key) // NAME + 1, hung=r.hung) for i, r in enumerate(rows)]

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def finish(part: _Component, depth: int) -> None:
        """Finish the component's nodes from the bottom up to ``depth``."""
        sizes = rows[part.row].sizes
        for d in range(part.top - 1, depth - 1, -1):
            own = part.below
            own.row = -1
            if d in part.hung:
                own.add(part.hung.pop(d))
            if not own.children:
                own.leaves += 1
            if d:
                own.saved += (own.n - 1) * sizes[d - 1]
            for child in part.waiting:
                nodes[child].parent = len(nodes)
            part.waiting = [len(nodes)]
            nodes.append(Node(d, replace(own)))
            own.children = 1
        part.top = min(part.top, depth)

    edges = [common(rows[i].key, rows[i + 1].key) for i in range(len(rows) - 1)]
    for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
        a, b = root(i), root(i + 1)
        x, y = parts[a], parts[b]
        for part in (x, y):
            finish(part, edges[i] + 1)
        if len(x.waiting) + len(x.hung) < len(y.waiting) + len(y.hung):
            a, b, x, y = b, a, y, x
        up[b] = a
        x.below.add(y.below)
        x.waiting += y.waiting
        for d, h in y.hung.items():
            if d in x.hung:
                x.hung[d].add(h)
            else:
                x.hung[d] = h
    if rows:
        finish(parts[root(0)], 0)
    return nodes


def path_to(nodes: list[Node], at: int) -> list[int]:
    """The nodes from the root down to ``at``."""
    out = [at]
    while nodes[out[-1]].parent >= 0:
        out.append(nodes[out[-1]].parent)
    return out[::-1]


# --- blocks -----------------------------------------------------------------------

_HUNG = [("depth", "long"), ("n", "long"), ("least", "long"), ("children", "long"), ("leaves", "long"), ("saved", "long")]
_HUNG_SQL = f"array<struct<{', '.join(f'{n}: {t}' for n, t in _HUNG)}>>"
_FOREST = f"""block long, conv_id long, depth long, parent_conv_id long, side int, parent_depth int, n_convs long,
    n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece long, ids string,
    first_key binary, last_key binary, first_sizes array<int>, last_sizes array<int>,
    first_hung {_HUNG_SQL}, last_hung {_HUNG_SQL}"""
_EMPTY = hashlib.sha256(b"").hexdigest()


def _packed(hung: dict[int, Hung]) -> list[dict]:
    return [{"depth": d, "n": h.n, "least": h.least, "children": h.children, "leaves": h.leaves, "saved": h.saved}
            for d, h in sorted(hung.items())]


def contract(block: int, keys: list[bytes], sizes: list[list[int]], ids: list[list[int]]) -> Iterator[dict]:
    """Finished nodes of a block of sorted distinct keys, whose conversations'
    ``ids`` ascend; pieces of the ids that end at unfinished ones; and one row with
    the contracted rest. ``side`` 0 is the path to the first row, 1 to the last."""
    rows = [Row(k, z, {len(z): Hung(len(i), i[0], row=r)}) for r, (k, z, i) in enumerate(zip(keys, sizes, ids, strict=True))]
    nodes = forest(rows)
    end = {node.total.row: number for number, node in enumerate(nodes) if node.total.row >= 0}
    sides: dict[int, int] = {}
    for side, row in ((0, 0), (1, len(rows) - 1)):
        for number in path_to(nodes, end[row]):
            sides.setdefault(number, side)
    hung: list[dict[int, Hung]] = [{}, {}]
    for side, row in ((0, 0), (1, len(rows) - 1)):
        if sides[end[row]] == side:
            hung[side][len(sizes[row])] = Hung()
    for number, node in enumerate(nodes):
        own = node.total
        if number in sides:
            if own.row >= 0:
                here = ids[own.row]
                hung[sides[number]].setdefault(node.depth, Hung()).add(Hung(len(here), here[0]))
                for piece in range(0, len(here), PIECE_IDS):
                    yield {"block": block, "side": sides[number], "depth": node.depth, "piece": piece,
                           "ids": ",".join(map(str, here[piece:piece + PIECE_IDS]))}
            continue
        ends = hashlib.sha256(",".join(map(str, ids[own.row])).encode()).hexdigest() if own.row >= 0 else _EMPTY
        out = {"block": block, "conv_id": own.least, "depth": node.depth, "n_convs": own.n, "n_children": own.children,
               "n_leaves": own.leaves, "saved_tokens": own.saved, "ends_sha256": ends}
        above = nodes[node.parent]
        if node.parent in sides:
            side = sides[node.parent]
            hung[side].setdefault(above.depth, Hung()).add(Hung(own.n, own.least, 1, own.leaves, own.saved))
            yield out | {"side": side, "parent_depth": above.depth}
        else:
            yield out | {"parent_conv_id": above.total.least}
    yield {"block": block, "first_key": keys[0], "last_key": keys[-1], "first_sizes": sizes[0], "last_sizes": sizes[-1],
           "first_hung": _packed(hung[0]), "last_hung": _packed(hung[1])}


def _batches(rows: Iterator[dict], schema: pa.Schema, n: int = 4096):
    kept: list[dict] = []
    for row in rows:
        kept.append(row)
        if len(kept) == n:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def forests(keyed: DataFrame) -> DataFrame:
    """What ``contract`` gives for blocks of range-sorted conv_id, key, sizes, stored."""
    spark = keyed.sparkSession
    schema = _arrow(spark, _FOREST)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        def blocks():
            part, turns, number = TaskContext.get().partitionId(), 0, 0
            keys: list[bytes] = []
            sizes: list[list[int]] = []
            ids: list[list[int]] = []
            for batch in batches:
                for conv, key, size in zip(*(batch[c].to_pylist() for c in ("conv_id", "key", "sizes")), strict=True):
                    if turns >= BLOCK_TURNS:
                        yield from contract(part << 32 | number, keys, sizes, ids)
                        number, turns, keys, sizes, ids = number + 1, 0, [], [], []
                    if keys and keys[-1] == key:
                        ids[-1].append(conv)
                    else:
                        keys.append(key)
                        sizes.append(size)
                        ids.append([conv])
                        turns += len(size)
                    turns += 1
            if keys:
                yield from contract(part << 32 | number, keys, sizes, ids)

        yield from _batches(blocks(), schema)

    dealt = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return store(dealt.mapInArrow(work, _FOREST))[0]


# --- across blocks ----------------------------------------------------------------

_MERGED = """node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,
    saved_tokens long, block long, first_nodes array<long>, last_nodes array<long>, first_convs array<long>, last_convs array<long>"""


def merge(blocks: list[dict]) -> Iterator[dict]:
    """The nodes that cross blocks, from the contracted rows of all blocks in
    order, and for every block the names of those on its two paths."""
    rows: list[Row] = []
    places: list[int] = []
    for block in blocks:
        for key, sizes, hung in (("first_key", "first_sizes", "first_hung"), ("last_key", "last_sizes", "last_hung")):
            if not rows or rows[-1].key != block[key]:
                rows.append(Row(block[key], block[sizes], {len(block[sizes]): Hung(row=len(rows))}))
            places.append(len(rows) - 1)
            for h in block[hung]:
                rows[-1].hung.setdefault(h["depth"], Hung()).add(
                    Hung(h["n"], h["least"], h["children"], h["leaves"], h["saved"]))
    nodes = forest(rows)
    end = {node.total.row: number for number, node in enumerate(nodes) if node.total.row >= 0}
    for number, node in enumerate(nodes):
        own = node.total
        yield {"node": number, "conv_id": own.least, "depth": node.depth, "n_convs": own.n, "n_children": own.children,
               "parent_conv_id": nodes[node.parent].total.least if node.parent >= 0 else None,
               "n_leaves": own.leaves, "saved_tokens": own.saved}
    for block, first, last in zip(blocks, places[::2], places[1::2], strict=True):
        both = [path_to(nodes, end[row]) for row in (first, last)]
        names = [[nodes[n].total.least for n in path] for path in both]
        yield {"block": block["block"], "first_nodes": both[0], "last_nodes": both[1],
               "first_convs": names[0], "last_convs": names[1]}


def _ends(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256 of node, block, piece, ids: the joined ids are streamed."""

    def work(batches):
        node, running = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for n, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if n == node:
                    running.update(b",")
                else:
                    if running:
                        done.append((node, running.hexdigest()))
                    node, running = n, hashlib.sha256()
                running.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"node": [n for n, _ in done], "ends_sha256": [h for _, h in done]})
        if running:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [running.hexdigest()]})

    return pieces.repartition("node").sortWithinPartitions("node", "block", "piece").select("node", "ids").mapInArrow(
        work, "node long, ends_sha256 string"
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conv_id, turns (``conversation_keys``), one row per node:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    A conversation without turns ends at the root; an empty table gives no row.
    A conversation's digests are one row; its texts never are. The boundaries of
    all blocks, two keys each, are merged by one task: a block holds about
    ``BLOCK_TURNS`` turns or a partition, so their number is known beforehand.
    """
    spark = turns.sparkSession
    ship_package(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), ""))
    keyed, keyed_path = store(turns.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    found = forests(keyed)
    delete_folder(spark, keyed_path)
    schema = _arrow(spark, _MERGED)

    def work(batches):
        blocks = [row for batch in batches for row in batch.to_pylist()]
        yield from _batches(merge(blocks), schema)

    contracted = found.filter("first_key is not null").select(
        "block", "first_key", "last_key", "first_sizes", "last_sizes", "first_hung", "last_hung")
    merged, _ = store(contracted.repartition(1).sortWithinPartitions("block").mapInArrow(work, _MERGED))
    blocks = merged.filter("block is not null").select("block", "first_nodes", "last_nodes", "first_convs", "last_convs")

    pieces = found.filter("ids is not null").select("block", "side", "depth", "piece", "ids").join(blocks, "block").select(
        F.expr("get(case when side = 0 then first_nodes else last_nodes end, cast(depth as int))").alias("node"),
        "block", "piece", "ids")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    crossing = merged.filter("node is not null").drop("block").join(_ends(pieces), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).select(columns)
    inner = found.filter("conv_id is not null")
    below = inner.filter("side is not null").drop("parent_conv_id").join(blocks, "block").withColumn(
        "parent_conv_id", F.expr("get(case when side = 0 then first_convs else last_convs end, parent_depth)")).select(columns)
    return inner.filter("side is null").select(columns).unionByName(below).unionByName(crossing)
