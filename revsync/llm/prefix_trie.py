"""A trie of conversations' turns, by double arrays over shards of sorted conversations.

Equal conversations are one, with their number. The distinct ones are sorted by their turns
and dealt by range, and each task takes its range in shards of a bounded number of turns.
A shard's turns get dense ids, and its trie is packed into two arrays: the child of the node
in slot s by turn t is in slot BASE[s] + t if CHECK of that slot is s. Nodes with many
children are placed first, and those with one fill the holes. The shard's conversations walk
the arrays to count and to collect what ends where; CHECK, which holds every node's parent,
leads back up for what is summed over subtrees.

As a shard is a range, other shards can have a node of it only if the node is a prefix of the
shard's first or last conversation. All other nodes are final. The shared ones come out with
what their shard has apart from other shared ones, and are merged for all shards: counts by
node, then sums over subtrees along each shard's two paths, to which a shared node itself is
added by its first shard only, then by node again. So a first turn that a third of all
conversations have makes shards, not one large group.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revsync.llm.common import batched, digest_runs, small, stage, workspace

#: Turns of a shard, and characters of a turn's key.
SHARD, KEY = 50_000, 32
#: Free slots that are tried for the children of a node before they go to the end.
TRIES = 64
#: Rows of shared nodes up to which they are broadcast.
BROADCAST_ROWS = 100_000


class DoubleArray:
    """A trie of sorted, distinct sequences of dense ids."""

    def __init__(self, sequences: list[list[int]]):
        children: list[list[int]] = [[]]  # per node, its children in order
        code = [0]
        path, last = [0], []
        for s in sequences:
            same = next((k for k, (a, b) in enumerate(zip(s, last)) if a != b), min(len(s), len(last)))
            del path[same + 1 :]
            for c in s[same:]:
                children[path[-1]].append(len(code))
                path.append(len(code))
                code.append(c)
                children.append([])
            last = s
        self._pack(children, code)

    def _pack(self, children: list[list[int]], code: list[int]) -> None:
        used, free = bytearray(b"\1"), 1
        slot, base_of = array("q", [0]) * len(code), array("q", [0]) * len(code)
        for node in sorted(range(len(code)), key=lambda x: -len(children[x])):
            codes = [code[c] for c in children[node]]
            if not codes:
                break
            while free < len(used) and used[free]:
                free += 1
            at, tries = free, TRIES
            while at < len(used) and any(at + c - codes[0] < len(used) and used[at + c - codes[0]] for c in codes):
                tries -= 1
                at = used.find(0, at + 1) if tries else len(used)
                at = len(used) if at < 0 else at
            base_of[node] = at - codes[0]
            used.extend(bytes(max(0, base_of[node] + codes[-1] + 1 - len(used))))
            for child, c in zip(children[node], codes):
                slot[child] = base_of[node] + c
                used[slot[child]] = 1
        self.base, self.check = (array("q", [x]) * len(used) for x in (0, -1))
        for node, some in enumerate(children):
            self.base[slot[node]] = base_of[node]
            for child in some:
                self.check[slot[child]] = slot[node]

    def step(self, s: int, turn: int) -> int:
        """The child of slot s by a turn, or -1."""
        t = self.base[s] + turn
        return t if 0 < t < len(self.check) and self.check[t] == s else -1

    def walk(self, turns: list[int]) -> list[int]:
        """The slots from the root by these turns, as far as they go."""
        out = [0]
        for x in turns:
            if (t := self.step(out[-1], x)) < 0:
                break
            out.append(t)
        return out


def node_id(path: str, depth: int) -> str:
    return hashlib.md5(path[: KEY * depth].encode()).hexdigest()


def shard_nodes(shard: int, rows: list[tuple]):
    """The nodes of a shard's trie; `rows` are (path, chars, conv, n, ends), sorted by distinct paths.

    Yields shard, node, parent, parent_conv, depth, conv, n, children, leaves, saved, chars,
    ends, on_first, on_last. `node` is set for nodes that other shards may have; these come
    with sums over their children that no other shard has, and without themselves. `parent`
    is set where the parent is such a node, else `parent_conv`.
    """
    paths = [[r[0][k : k + KEY] for k in range(0, len(r[0]), KEY)] for r in rows]
    dense = {key: i for i, key in enumerate(sorted(set().union(*paths)))}
    codes = [[dense[key] for key in p] for p in paths]
    trie = DoubleArray(codes)
    size = len(trie.check)
    n, low, depth, length, children, leaves, saved = (array("q", [0]) * size for _ in range(7))
    ends, order = {}, []
    for (_, chars, conv, count, digest), turns in zip(rows, codes):
        way = trie.walk(turns)
        for d, s in enumerate(way):
            if not n[s]:
                low[s], depth[s], length[s] = conv, d, chars[d - 1] if d else 0
                order.append(s)
            n[s] += count
            if conv < low[s]:
                low[s] = conv
        ends[way[-1]] = digest
    first, last = trie.walk(codes[0]), trie.walk(codes[-1])
    names = {s: node_id(row[0], d) for row, way in ((rows[0], first), (rows[-1], last)) for d, s in enumerate(way)}
    for s in reversed(order):
        if s not in names:
            leaves[s] += not children[s]
            saved[s] += (n[s] - 1) * length[s]
            p = trie.check[s]
            children[p] += 1
            leaves[p] += leaves[s]
            saved[p] += saved[s]
    on_first, on_last = set(first), set(last)
    for s in order:
        p = trie.check[s]
        parent = names.get(p)
        yield (
            shard, names.get(s), parent, low[p] if parent is None and s else None, depth[s], low[s], n[s],
            children[s], leaves[s], saved[s], length[s], ends.get(s), s in on_first, s in on_last,
        )


SHARD_ROWS = """shard long, node string, parent string, parent_conv long, depth long, conv long, n long,
    children long, leaves long, saved long, chars long, ends string, on_first boolean, on_last boolean"""


def shards(classes: DataFrame) -> DataFrame:
    """`shard_nodes` over all distinct conversations, sorted and dealt by range."""
    kind = T.StructType.fromDDL(SHARD_ROWS)
    schema = to_arrow_schema(kind)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 40

        def packed():
            nonlocal shard
            rows, turns = [], 0
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    rows.append(r)
                    turns += len(r[1])
                    if turns >= SHARD:
                        yield from shard_nodes(shard, rows)
                        rows, turns, shard = [], 0, shard + 1
            if rows:
                yield from shard_nodes(shard, rows)

        yield from batched(packed(), schema)

    dealt = classes.repartitionByRange("path").sortWithinPartitions("path")
    return dealt.select("path", "chars", "conv", "n", "ends").mapInArrow(run, kind)


def merge(parts: DataFrame, put) -> DataFrame:
    """All nodes from the shards' rows: those that shards share as one, with their whole subtrees."""
    spine = parts.where("node is not null")
    merged = spine.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"),
        F.sum("n").alias("n"), F.sum("children").alias("other_children"), F.first("chars").alias("chars"),
        F.max("ends").alias("ends"), F.min("shard").alias("owner"),
    )
    merged = put(merged, "merged")
    kids = merged.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"))
    counted = merged.join(kids.withColumnRenamed("parent", "node"), "node", "left").withColumn(
        "n_children", F.col("other_children") + F.coalesce("kids", F.lit(0))
    )
    counted = put(counted, "counted")
    known = small(counted, BROADCAST_ROWS)

    # what is below each shared node on its shard's two paths
    own = spine.select("shard", "node", "depth", "on_first", "on_last", "leaves", "saved").join(
        known.select("node", "owner", "n_children", "n", "chars"), "node"
    )
    is_owner = (F.col("shard") == F.col("owner")).cast("long")
    own = own.select(
        "shard", "node", "depth", "on_first", "on_last",
        (F.col("leaves") + is_owner * (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + is_owner * (F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    below = (
        Window.partitionBy("shard").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def on_paths(c):
        both, one, other = (
            F.sum(F.when(on, F.col(c)).otherwise(0)).over(below)
            for on in (F.lit(True), F.col("on_first"), F.col("on_last"))
        )
        return F.when(F.col("on_first") & F.col("on_last"), both).when(F.col("on_first"), one).otherwise(other)

    totals = own.select("node", on_paths("leaves").alias("leaves"), on_paths("saved").alias("saved")).groupBy("node")
    totals = totals.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    up = known.select(F.col("node").alias("parent"), F.col("conv").alias("up"))
    shared = counted.join(totals, "node").join(up, "parent", "left").select(
        "conv", "depth", F.col("up").alias("parent_conv"), "n", "n_children", "n_leaves", "saved", "ends"
    )
    inner = parts.where("node is null").join(up, "parent", "left").select(
        "conv", "depth", F.coalesce("parent_conv", "up").alias("parent_conv"), "n",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved", "ends",
    )
    return shared.unionAll(inner)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, from `conv, place, key, chars` per turn.

    `convs` has every conversation's `conv`, a long and not null; one without turns is a
    member of the root alone. `key` names a turn in KEY characters, `chars` is its length,
    and turns stand by `place`. Per node: conv (its smallest member), depth, parent_conv, n
    (members), n_children, n_leaves, saved and ends (the digest of the members that end
    there, null for none). Without conversations there are no nodes.

    One conversation's keys are together in a row. The ids that end at a node pass through
    one task as a stream, since their digest is a chain.
    """
    spark = turns.sparkSession
    with workspace(spark) as put:
        listed = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "key", "chars"))).alias("t"))
        paths = convs.join(listed, "conv", "left").select(
            "conv", F.coalesce(F.array_join("t.key", ""), F.lit("")).alias("path"),
            F.coalesce(F.col("t.chars"), F.array().cast("array<long>")).alias("chars"),
        ).withColumn("same", F.md5("path"))
        paths = put(paths, "paths")
        ids = paths.select("same", "conv", F.col("conv").cast("string").alias("id"))
        ends = digest_runs(ids, "same", "conv", "id", ",").select("same", F.col("sha256").alias("ends"))
        classes = paths.groupBy("path", "same").agg(
            F.first("chars").alias("chars"), F.min("conv").alias("conv"), F.count("*").alias("n")
        )
        parts = put(shards(put(classes.join(ends, "same"), "classes")), "shards")
        return stage(merge(parts, put), "trie")


def rebuilt(
    conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, span: int = 100, most: int = 6
) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their hundred's first one: the turns for `trie`, and the ids.

    Conversation c has the first h turns of c - c mod `span`, then its own after its first
    h, with h = crc32(c) mod `most`. Turns stand by number, nulls first, then by role and
    text. A null role or text is empty; rows without a conversation are left out; rows that
    repeat are turns each.
    """
    filled = [F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), *filled
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select(
        "conv", (F.row_number().over(order) - 1).alias("place"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("key"),
        F.length("text").cast("long").alias("chars"),
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = rows.select("conv").distinct()
    first = placed.where((F.col("place") < most - 1) & (F.col("conv") % span == 0)).withColumnRenamed("conv", "base")
    taken = convs.select("conv", h, (F.col("conv") - F.col("conv") % span).alias("base"))
    begun = taken.join(first, "base").where("place < h").select("conv", "place", "key", "chars")
    own = placed.select("*", h).where("place >= h").select("conv", "place", "key", "chars")
    return begun.unionAll(own), convs


def rebuilt_nodes(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The trie of the rebuilt conversations."""
    found = trie(*rebuilt(conversations, conv_id, turn, role, text))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
