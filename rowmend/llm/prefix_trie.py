"""Trie of conversation prefixes, from ternary search trees over ranges of conversations.

A turn (role, text) becomes a 60-bit code; that no two different turns share one is
checked on all distinct turns, against 60 further bits of their digest.  A conversation
is then a row of codes.  These rows are put in order and cut into ranges; each range
becomes a ternary search tree, its distinct rows inserted from the median outwards, so
that the alternatives at each turn are a balanced tree.  A traversal without recursion
gives members, leaves and savings of all nodes below.  Only nodes on the paths of the
first and the last row of a range can go on in another range: for those, ranges give
partial sums, which are merged by the hash of the node's path.  A sum over the
subtree of such a boundary node is a sum over the paths that run through it, so it
takes no loop over depths.  Copies of one conversation may fill many ranges.

Turns are ordered by turn (null first), then role, then text.  A null role or text is
an empty one.  Rows without a conv_id belong to no conversation and are left out.
Repeated rows are turns of their own.  An empty table gives no nodes, not even a root.
Columns other than conv_id, turn, role and text are not looked at.  Texts may be of
any length; of one conversation, 16 bytes a turn have to fit into memory.  What is
hashed of the conversations that end at a node runs through one task, as such a hash
has to, as ready pieces of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.core import stable

SHARD_TURNS = 100_000
LEAST_SHARD_TURNS = 2_000  # smaller inputs are not spread over more cores
PIECE = 8_192  # ids in a piece of what is hashed
NOTHING = hashlib.sha256(b"").hexdigest()

NODE, PART, ENDS = 0, 1, 2  # kinds of rows that a range gives
FIELDS = [
    ("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("shard", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("code", pa.int64()), ("size", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
]
SCHEMA = (
    "kind int, key binary, parent binary, shard long, first boolean, last boolean, depth long, conv_id long, parent_conv_id long, "
    "code long, size long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


def _turns(conversations: DataFrame) -> DataFrame:
    given = conversations.where("conv_id is not null")
    return given.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def encode(conversations: DataFrame) -> tuple[DataFrame, int]:
    """conv_id, turn, tie (place among rows of equal turn), code, size (UTF-8 bytes of the text), and the salt of the codes."""
    turns = _turns(conversations)
    salt = 0
    while True:
        rows = coded(turns, salt)
        narrow = stable(rows.select("conv_id", "turn", "code", "check", F.octet_length("text").cast("long").alias("size")))
        twice = narrow.groupBy("code").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b")
        if twice.isEmpty():
            break
        salt += 1
    narrow = narrow.drop("check")
    tied = stable(narrow.groupBy("conv_id", "turn").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a != b"))
    if tied.isEmpty():
        return narrow.withColumn("tie", F.lit(0)), salt
    # only turns whose order is open are compared by their texts
    same = lambda left, right: (left.conv_id == right.conv_id) & left.turn.eqNullSafe(right.turn)
    open_ = rows.join(tied, same(rows, tied), "left_semi").select("conv_id", "turn", "role", "text", "code").distinct()
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    ties = open_.select("conv_id", "turn", "code", place.alias("tie"))
    found = narrow.join(ties, same(narrow, ties) & (narrow.code == ties.code), "left")
    return found.select(*[narrow[c] for c in narrow.columns], F.coalesce(ties.tie, F.lit(0)).alias("tie")), salt


def coded(turns: DataFrame, salt: int) -> DataFrame:
    """Adds code and check: two times 60 bits of the digest of a turn's role and text."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return turns.withColumns({"code": part(1), "check": part(16)})


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, codes, sizes: one row per conversation, its turns in order."""
    one = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "tie", "code", "size")
    row = F.array_sort(F.collect_list(one))
    rows = turns.groupBy("conv_id").agg(row.alias("row"))
    return rows.select("conv_id", F.col("row.code").alias("codes"), F.col("row.size").alias("sizes"))


def rebuilt(seqs: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every (none if there is no such), h being crc32
    of c in decimals modulo ``heads``, and goes on with its own turns after its first h."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    of = lambda c: F.slice(c, 1, heads - 1)
    starts = seqs.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("base"), of("codes").alias("c"), of("sizes").alias("s"))
    rows = seqs.withColumns({"base": base, "h": h}).join(starts, "base", "left")
    joined = lambda own, head: F.concat(
        F.slice(F.coalesce(head, F.array().cast("array<bigint>")), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own))
    )
    return rows.select("conv_id", joined("codes", "c").alias("codes"), joined("sizes", "s").alias("sizes"))


def _median_order(n: int) -> Iterator[int]:
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(mid + 1, hi), (lo, mid)]


class Ternary:
    """Ternary search tree over rows of codes.  Node 0 is the root of the trie; any other node
    is a prefix: ``low`` and ``high`` lead to its alternatives, ``equal`` to what follows it."""

    def __init__(self):
        self.code, self.size = [0], [0]
        self.low, self.equal, self.high = [-1], [-1], [-1]
        self.ends: dict[int, list[int]] = {}

    def _new(self, code: int, size: int) -> int:
        self.code.append(code)
        self.size.append(size)
        for side in (self.low, self.equal, self.high):
            side.append(-1)
        return len(self.code) - 1

    def insert(self, codes: list[int], sizes: list[int], convs: list[int]) -> list[int]:
        """The nodes of its path, the root's first."""
        path = [0]
        code, low, equal, high = self.code, self.low, self.equal, self.high
        for c, size in zip(codes, sizes):
            side, at = equal, path[-1]
            while True:
                to = side[at]
                if to < 0:
                    to = side[at] = self._new(c, size)
                    break
                if code[to] == c:
                    break
                side, at = (low, to) if c < code[to] else (high, to)
            path.append(to)
        self.ends[path[-1]] = convs
        return path

    def downwards(self) -> tuple[list[int], list[int], list[int]]:
        """All nodes, each after its parent; parents and depths by node."""
        n = len(self.code)
        parent, depth, order = [-1] * n, [0] * n, [0]
        todo = [(self.equal[0], 0)]
        while todo:
            at, above = todo.pop()
            if at < 0:
                continue
            parent[at], depth[at] = above, depth[above] + 1
            order.append(at)
            todo += [(self.low[at], above), (self.high[at], above), (self.equal[at], at)]
        return order, parent, depth


def _path_keys(codes: list[int]) -> list[bytes]:
    keys = [b"root"]
    for c in codes:
        keys.append(hashlib.blake2b(keys[-1] + c.to_bytes(8, "little"), digest_size=16).digest())
    return keys


def _shard(shard: int, rows: list[tuple[list[int], list[int], list[int]]]) -> Iterator[tuple]:
    """Rows of FIELDS for distinct sequences in order, each with the conversations that it is."""
    tree, edges = Ternary(), {}
    for i in _median_order(len(rows)):
        path = tree.insert(*rows[i])
        if i in (0, len(rows) - 1):
            edges[i] = path
    order, parent, depth = tree.downwards()
    first, last = set(edges[0]), set(edges[len(rows) - 1])
    keys = {at: k for i, path in edges.items() for at, k in zip(path, _path_keys(rows[i][0]))}
    n = len(order)
    members, kids, leaves, saved, least = [0] * n, [0] * n, [0] * n, [0] * n, [None] * n
    for at in reversed(order):
        for_ends = tree.ends.get(at)
        if for_ends:
            members[at] += len(for_ends)
            least[at] = for_ends[0] if least[at] is None else min(least[at], for_ends[0])
        above = parent[at]
        if above >= 0:
            members[above] += members[at]
            if least[above] is None or least[at] < least[above]:
                least[above] = least[at]
        if at in keys:
            continue  # leaves and savings are whole only when all ranges have been merged
        leaves[at] += not kids[at]
        saved[at] += (members[at] - 1) * tree.size[at]
        kids[above] += 1
        leaves[above] += leaves[at]
        saved[above] += saved[at]
    for at in order:
        convs, above = tree.ends.get(at, []), parent[at]
        own = (depth[at], least[at], None, tree.code[at], tree.size[at], members[at], kids[at], leaves[at], saved[at])
        if at in keys:
            yield (PART, keys[at], keys.get(above), shard, at in first, at in last, *own, None)
            for lo in range(0, len(convs), PIECE):
                some = ",".join(map(str, convs[lo : lo + PIECE]))
                yield (ENDS, keys[at], None, shard, None, None, lo, *[None] * 8, some)
        else:
            ends = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest() if convs else NOTHING
            on_edge = above in keys
            own = (*own[:2], None if on_edge else least[above], *own[3:])
            yield (NODE, None, keys[above] if on_edge else None, shard, None, None, *own, ends)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[list[int], list[int], list[int]]] = []
    for batch in batches:
        for conv, codes, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "sizes"))):
            if rows and rows[-1][0] == codes:
                rows[-1][2].append(conv)
            else:
                rows.append((codes, sizes, [conv]))
    if not rows:
        return
    out = []

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*some), FIELDS)], [f for f, _ in FIELDS])

    for row in _shard(TaskContext.get().partitionId(), rows):
        out.append(row)
        if len(out) == 20_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of pieces that come node by node in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])


NUMBERS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def trie(seqs: DataFrame) -> DataFrame:
    """NUMBERS, ends_sha256 and code (of the node's last turn; 0 for the root) of each node of the trie over seqs (conv_id, codes, sizes).

    conv_id has to be unique."""
    seqs = stable(seqs.select("conv_id", "codes", "sizes"))
    turns = seqs.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    cores = seqs.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-turns // SHARD_TURNS), min(cores, turns // LEAST_SHARD_TURNS))
    ordered = seqs.repartitionByRange(shards, "codes", "conv_id").sortWithinPartitions("codes", "conv_id")
    made = stable(ordered.mapInArrow(_ranges, SCHEMA))

    parts = made.where(F.col("kind") == PART)
    chain = F.col("shard") * 2
    edge = stable(
        parts.groupBy("key").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("code").alias("code"),
            F.max("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"), F.min(F.when(F.col("first"), chain).otherwise(chain + 1)).alias("owner"),
        )
    )
    below = edge.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("on_edge"))
    whole = edge.join(below, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("on_edge", F.lit(0)))
    whole = whole.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))
    whole = stable(whole.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size")))
    # each boundary node counts on one of the paths that it is on; what is below a place of a path is a sum along that path
    paths = parts.select("key", F.explode(F.array(F.when(F.col("first"), chain), F.when(F.col("last"), chain + 1))).alias("chain")).where("chain is not null")
    own = lambda c: F.when(F.col("owner") == F.col("chain"), F.col(c)).otherwise(0)
    deeper = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    placed = paths.join(whole.select("key", "depth", "owner", "leaves", "saved"), "key")
    sums = placed.select("key", F.sum(own("leaves")).over(deeper).alias("l"), F.sum(own("saved")).over(deeper).alias("s"))
    sums = sums.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    pieces = made.where(F.col("kind") == ENDS).select("key", "shard", "depth", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard", "depth").drop("shard", "depth").mapInArrow(_hashed, "key binary, ends_sha256 string")
    up = edge.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    cols = [*NUMBERS, "ends_sha256", "code"]
    merged = (
        whole.join(sums, "key").join(ends, "key", "left").join(up, "parent", "left")
        .withColumns({"parent_conv_id": F.col("up"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))})
    )
    inner = made.where(F.col("kind") == NODE).join(up, "parent", "left")
    inner = inner.withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "up"), "ends_sha256": F.col("ends")})
    return merged.select(*cols).unionByName(inner.select(*cols))


def prefix_trie(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(sequences(encode(conversations)[0]), every, heads))


def with_turns(nodes: DataFrame, conversations: DataFrame, salt: int = 0) -> DataFrame:
    """Adds role and text of each node's last turn (null for the root); ``salt`` is what ``encode`` gave."""
    words = coded(_turns(conversations), salt).groupBy("code").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(words, "code", "left")


def nodes_sql() -> str:
    """The same nodes for the default parameters, from whole lists of turns."""
    return """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT i, c FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
walk(conv_id, s, p, c) AS (
  SELECT conv_id, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT w.conv_id, w.s, w.p + 1, xor(t.c, w.c >> 8)
  FROM walk w JOIN tab t ON t.i = xor(w.c, ascii(substr(w.s, w.p + 1, 1))::BIGINT) & 255 WHERE w.p < length(w.s)),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, 4294967295) % 9 AS h FROM walk WHERE p = length(s)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
rows_ AS (
  SELECT h.conv_id, 0 AS part, t.r, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.r <= h.h
  UNION ALL SELECT h.conv_id, 1, t.r, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.r > h.h),
made AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY part, r) AS q FROM rows_ GROUP BY conv_id),
seqs AS (SELECT i.conv_id, coalesce(q, []) AS q, coalesce(len(q), 0) AS n FROM ids i LEFT JOIN made USING (conv_id)),
prefixes AS (
  SELECT conv_id, n, d, to_json(q[1:d])::VARCHAR AS k, CASE WHEN d > 0 THEN to_json(q[1:d - 1])::VARCHAR END AS up,
    CASE WHEN d > 0 THEN strlen(q[d].text) ELSE 0 END AS size
  FROM (SELECT conv_id, q, n, unnest(range(0, n + 1)) AS d FROM seqs)),
nodes AS (
  SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.k, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM nodes v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.depth LEFT JOIN kids c ON c.k = v.k GROUP BY p.k)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.k = v.up LEFT JOIN kids c ON c.k = v.k JOIN below b ON b.k = v.k"""
