"""Operator 13: the prefix trie of conversations, by z-fast tries.

A conversation is the sequence of its turns (role, text); every distinct sequence of
first d turns is a node.  A turn counts as a 256-bit digest of its role and text, a node's
key is the 128-bit chain of its turns' digests.

Each task builds compacted tries of bounded size (TRIE) as z-fast tries: a compacted node covers the depths (top, end] of one path; its handle is the
prefix at the two-fattest depth of that interval, and a table from handles to nodes lets a
conversation find its exit node by fat binary search, in as many look-ups as the logarithm of
its length.  Conversations come in batches: a batch is located as a whole, then inserted
by exit node, which splits edges and adds leaves.  A full trie is written with its
edges expanded to nodes, and a new one is begun.  Equal nodes of several tries meet by
key in an aggregate with map-side partials, so a first turn, or a whole conversation, that a
third of all rows share costs one row per trie.

Sums over subtrees: each node is counted by one of the tries that hold it (its owner); a trie
sums its own nodes bottom-up, and the sums of a node's tries are added.  Conversations longer
than a layer (LAYER turns) are cut into layers; a layer's trie starts at the key of the node where
the layer before ends, and its sums are carried up layer by layer.

Turns are ordered by turn (null first), then role, then text; null role or text reads as
empty.  Rows without a conv_id take no part.  Rows that repeat are turns that repeat.  An empty
table gives no node; conversations without turns are members of the root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import arrow_schema, columns_as, materialize, over, release, ship, small_batches, written
from marquee.plans.ids import assign_ids

TRIE = 1 << 17  # keys that a task's tries refer to, after which they are written
ROWS = 1 << 14
LAYER = 4096
ROOT = b"\0" * 16
CHUNK = 1 << 20  # bytes of a chunk of joined ids


def two_fattest(a: int, b: int) -> int:
    """The number of (a, b] that the largest power of two divides."""
    return b & -1 << (a ^ b).bit_length() - 1


class Node:
    """Depths (top, end] of ``path``, the keys of one conversation from the layer's start."""

    __slots__ = ("path", "lens", "top", "end", "children", "ended", "least", "count")

    def __init__(self, path, lens, top, end):
        self.path, self.lens, self.top, self.end = path, lens, top, end
        self.children: dict[bytes, Node] = {}
        self.ended, self.least, self.count = 0, None, 0

    def handle(self) -> bytes:
        return self.path[two_fattest(self.top, self.end)]


class ZFastTrie:
    """A compacted trie over key paths; ``handles`` finds nodes by the prefix at their two-fattest depth."""

    def __init__(self):
        self.handles: dict[bytes, Node] = {}
        self.roots: dict[bytes, Node] = {}
        self.held = 0  # keys of the paths that nodes refer to

    def locate(self, path) -> Node:
        """The deepest node whose whole extent is a prefix of ``path`` (its exit node's parent, or the node itself)."""
        found = self.roots.get(path[0])
        if found is None:
            found = self.roots[path[0]] = Node(path, None, 0, 0)
        a, b = 0, len(path) - 1
        while a < b:
            f = two_fattest(a, b)
            node = self.handles.get(path[f])
            if node is None:
                b = f - 1
            elif node.end < len(path) and node.path[node.end] == path[node.end]:
                a, found = node.end, node
            else:  # the path leaves inside this node: go on above it
                b = node.top
        return found

    def insert(self, path, lens, conv: int, least: int, times: int, at: Node) -> None:
        """``times`` conversations of one path, ``at``: the node that ``locate`` found, or one above."""
        n = len(path) - 1
        while at.end < n and (child := at.children.get(path[at.end + 1])) is not None:
            if child.end <= n and child.path[child.end] == path[child.end]:
                at = child
                continue
            low, high = child.top + 1, min(child.end, n)  # the last depth at which both agree
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if child.path[mid] == path[mid] else (low, mid - 1)
            at = self._split(at, child, low)
            break
        if at.end < n:
            leaf = Node(path, lens, at.end, n)
            at.children[path[at.end + 1]] = leaf
            self.handles[leaf.handle()] = leaf
            self.held += len(path)
            at = leaf
        at.ended += times
        at.least = least if at.least is None else min(at.least, least)

    def _split(self, parent: Node, child: Node, depth: int) -> Node:
        del self.handles[child.handle()]
        above = Node(child.path, child.lens, child.top, depth)
        child.top = depth
        above.children[child.path[depth + 1]] = child
        parent.children[above.path[above.top + 1]] = above
        for node in (above, child):
            self.handles[node.handle()] = node
        return above

    def insert_batch(self, conversations) -> None:
        """conversations: (path, lens, conv_id). Equal ones go in once; each is located before any is inserted."""
        same: dict[tuple, list] = {}
        for path, lens, conv in conversations:
            known = same.setdefault((path[0], path[-1], len(path)), [path, lens, conv, conv, 0])
            known[3] = min(known[3], conv)
            known[4] += 1
        for at, own in [(self.locate(x[0]), x) for x in same.values()]:
            self.insert(*own, at)

    def expand(self):
        """(key, parent key, depth in the layer, members, smallest member, code points of the last turn) of every node."""
        for root in self.roots.values():
            order, stack = [], [root]
            while stack:
                node = stack.pop()
                order.append(node)
                stack.extend(node.children.values())
            for node in reversed(order):
                node.count = node.ended + sum(c.count for c in node.children.values())
                below = [x for x in (node.least, *(c.least for c in node.children.values())) if x is not None]
                node.least = min(below)
            yield root.path[0], None, 0, root.count, root.least, 0
            for node in order[1:]:
                for d in range(node.top + 1, node.end + 1):
                    yield node.path[d], node.path[d - 1], d, node.count, node.least, node.lens[d - 1]


def layer_key(start: bytes, digest: bytes) -> bytes:
    """The key of the node at which a whole layer ends: it follows from the layer's digest alone."""
    return hashlib.blake2b(start + digest, digest_size=16, person=b"layer").digest()


def chain(start: bytes, digests: list[bytes], layer_size: int) -> list[bytes]:
    """The keys of a layer's nodes on one path, from its start."""
    out = [start]
    for x in digests:
        out.append(hashlib.blake2b(out[-1] + x, digest_size=16).digest())
    if len(digests) == layer_size:
        out[-1] = layer_key(start, hashlib.sha256("".join(x.hex() for x in digests).encode()).digest())
    return out


BUILT = "kind int, trie long, layer int, key binary, parent binary, depth int, n long, least long, len long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _build(schema: pa.Schema, layer_size: int, limit: int):
    """(conv, layer, start key, last layer?, digests, lens) -> nodes of tries (kind 0), ends of conversations (kind 1)."""
    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        tries: dict[int, ZFastTrie] = {}

        def flush():
            nonlocal name
            while tries:
                layer, trie = tries.popitem()
                name += 1
                rows = [(0, name, layer, key, parent, layer * layer_size + d, n, least, size) for key, parent, d, n, least, size in trie.expand()]
                for a in range(0, len(rows), ROWS):
                    yield _batch(rows[a:a + ROWS], schema)

        try:
            for batch in batches:
                todo: dict[int, list] = {}
                ends = []
                for conv, layer, start, final, digests, lens in zip(*(c.to_pylist() for c in batch.columns)):
                    path = chain(start, digests, layer_size)
                    todo.setdefault(layer, []).append((path, lens, conv))
                    if final:
                        ends.append((1, 0, layer, path[-1], None, 0, 1, conv, 0))
                if ends:
                    yield _batch(ends, schema)
                for layer, own in todo.items():
                    tries.setdefault(layer, ZFastTrie()).insert_batch(own)
                if sum(t.held for t in tries.values()) >= limit:
                    yield from flush()
            yield from flush()
        finally:
            release()

    return run


def _sums(batches):
    """Nodes sorted by (trie, depth descending) with their weights -> the sums of each trie over its subtrees."""
    schema = pa.schema([("key", pa.binary()), ("start", pa.bool_()), ("saved", pa.int64()), ("leaves", pa.int64())])
    now, held = None, {}
    for batch in batches:
        out = []
        for trie, key, parent, saved, leaves in zip(*(c.to_pylist() for c in batch.columns)):
            if trie != now:
                now, held = trie, {}
            below = held.pop(key, (0, 0))
            saved, leaves = saved + below[0], leaves + below[1]
            out.append((key, parent is None, saved, leaves))
            if parent is not None:
                up = held.get(parent, (0, 0))
                held[parent] = (up[0] + saved, up[1] + leaves)
        if out:
            yield _batch(out, schema)


def _starts(batch):
    """(conv, digests of its whole layers in order) -> (conv, layer, key at which the layer starts)."""
    out = []
    for conv, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        key = ROOT
        for layer, digest in enumerate(digests, 1):
            key = layer_key(key, digest)
            out.append((conv, layer, key))
    yield [list(x) for x in zip(*out)] if out else [[], [], []]


def _chunks(batches):
    """(key, conv) in order -> (key, first conv, ids joined by commas), of CHUNK bytes or so."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids = None, []
    for batch in batches:
        out = []
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or len(ids) == CHUNK // 16):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(conv)
        if out:
            yield _batch(out, schema)
    if ids:
        yield _batch([(key, ids[0], ",".join(map(str, ids)))], schema)


def _digests(batches):
    """Chunks in order of (key, first) -> (key, SHA-256 of all of them)."""
    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])
    key, sha = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        if out:
            yield _batch(out, schema)
    if key is not None:
        yield _batch([(key, sha.hexdigest())], schema)


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, len): the turns by place from 0, without a window over a conversation."""
    rows = columns_as(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    framed = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select("conv", F.col("turn").isNotNull().cast("int").alias("told"), "turn", "role", "text", F.unhex(F.sha2(framed, 256)).alias("digest"), F.char_length("text").cast("long").alias("len"))
    order = ["conv", "told", "turn", "role", "text"]
    numbered = written(assign_ids(rows, order, 0, "idx").select("conv", "idx", "digest", "len"), "trie-turns")
    first = numbered.groupBy("conv").agg(F.min("idx").alias("first"))
    return numbered.join(first, "conv").select("conv", (F.col("idx") - F.col("first")).alias("pos"), "digest", "len")


def shared_openings(turns: DataFrame, block: int = 100, choices: int = 6) -> DataFrame:
    """Every conversation c after its first h = crc32(c) % choices turns, led by the first h turns of
    conversation c - c % block: (conv, pos, digest, len), and one row with pos null for each conversation."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({
        "base": F.col("conv") - F.col("conv") % block,
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % choices})
    opening = turns.where(F.col("pos") < choices - 1).select(F.col("conv").alias("base"), "pos", "digest", "len")
    led = convs.join(opening, "base").where("pos < h").select("conv", "pos", "digest", "len")
    sizes = convs.select("base", "conv", "h").join(turns.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("has")), "base", "left")
    shift = sizes.select("conv", "h", F.least(F.coalesce("has", F.lit(0)), "h").alias("lead"))
    rest = turns.join(shift, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "len")
    none = convs.select("conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("len"))
    return led.unionByName(rest).unionByName(none)


def prefix_trie(turns: DataFrame, layer_size: int = LAYER, limit: int = TRIE) -> DataFrame:
    """The nodes of the trie of (conv, pos, digest, len) rows; a row with pos null makes its conversation a member of the root.

    key, parent (null: root), depth, least (smallest member), n_convs, n_children, n_leaves, saved, ends_sha256."""
    spark = turns.sparkSession
    ship(spark)
    small_batches(spark)
    layer = F.when(F.col("pos").isNull(), F.lit(0)).otherwise(F.floor(F.col("pos") / layer_size)).cast("int").alias("layer")
    told = F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "len"))
    cut = turns.groupBy("conv", layer).agg(F.array_sort(F.collect_list(told)).alias("turns"))  # layer_size turns at most
    cut = written(cut.select("conv", "layer", F.col("turns.digest").alias("digests"), F.col("turns.len").alias("lens")), "trie-layers")
    top = cut.agg(F.max("layer")).first()[0] or 0
    paths = _placed(cut) if top else cut.select("conv", "layer", F.lit(ROOT).alias("start"), F.lit(True).alias("final"), "digests", "lens")
    built = written(paths.mapInArrow(_build(arrow_schema(spark, BUILT), layer_size, limit), BUILT), "trie-built")
    local = built.where("kind = 0").withColumn("again", F.expr("parent is null and depth > 0"))  # a layer's start: a node of the layer before
    nodes = local.where("not again").groupBy("key", "parent", "depth", "len").agg(F.min("least").alias("least"), F.sum("n").alias("n_convs"), F.min("trie").alias("owner"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")

    counted = (F.col("owner") == F.col("trie")) & ~F.col("again")
    weights = local.select("trie", "layer", "key", "parent", "depth", "again").join(nodes.select("key", "owner", "n_convs", "n_children", "len"), "key").select(
        "trie", "layer", "key", "parent", "depth", counted.alias("counted"),
        F.when(counted, (F.col("n_convs") - 1) * F.col("len")).otherwise(0).alias("saved"),
        F.when(counted & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"))
    weights = written(weights, "trie-weights") if top else weights
    sums = None
    for k in range(top, -1, -1):
        mine = weights.where(F.col("layer") == k)
        if sums is not None:  # what the layer below adds to the nodes where it starts
            more = found.where("start").select("key", F.col("saved").alias("s"), F.col("leaves").alias("l"))
            mine = mine.join(more, "key", "left").withColumns({
                x: F.col(x) + F.when(F.col("counted"), F.coalesce(y, F.lit(0))).otherwise(0) for x, y in (("saved", "s"), ("leaves", "l"))})
        dealt = mine.repartition("trie").sortWithinPartitions("trie", F.desc("depth")).select("trie", "key", "parent", "saved", "leaves")
        found = dealt.mapInArrow(_sums, "key binary, start boolean, saved long, leaves long").groupBy("key", "start").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        if top:
            found = materialize(found, "trie-sums")
        own = found.where("not start") if k else found
        sums = own if sums is None else sums.unionByName(own)
    ends = _ends(built.where("kind = 1").select("key", F.col("least").alias("conv")))
    return nodes.join(sums, "key").join(ends, "key", "left").select(
        "key", "parent", "depth", "least", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _placed(cut: DataFrame) -> DataFrame:
    """Layers with the key at which they start, and whether their conversation ends there."""
    last = cut.groupBy("conv").agg(F.max("layer").alias("last"))
    digest = F.unhex(F.sha2(F.array_join(F.transform("digests", lambda x: F.lower(F.hex(x))), ""), 256))
    whole = cut.join(last, "conv").where("layer < last").select("conv", "layer", digest.alias("digest"))
    lists = whole.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("layer", "digest"))).alias("d")).select("conv", "d.digest")  # a digest per layer
    starts = over(lists, _starts, "conv long, layer int, start binary")
    return cut.join(last, "conv").join(starts, ["conv", "layer"], "left").select(
        "conv", "layer", F.coalesce("start", F.lit(ROOT)).alias("start"), (F.col("layer") == F.col("last")).alias("final"), "digests", "lens")


def _ends(ends: DataFrame) -> DataFrame:
    """(key, ends): a node's conversations, in order, are joined in chunks by many tasks; one streams the chunks."""
    chunks = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digests, "key binary, ends string")
