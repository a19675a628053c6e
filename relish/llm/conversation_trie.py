"""The trie of all conversation prefixes, with totals of every subtree, by time-forward processing.

Positions and keys.  Turns are range-sorted by conversation and turn, so a
conversation of any length lies in as many pieces as it needs; running counts
and running keys of a piece start from the totals of the pieces before it.  The
key of a prefix is the exclusive-or of 128-bit hashes of its (depth, turn)
pairs, so it can be summed up piece by piece; a node is a depth and a key, and
its counts are an aggregate that is combined before the shuffle.

Shards.  Nodes with more members than a 4,096th of all rows are the crown: at
most 4,096, plus the root.  What hangs below the crown is cut into shards, one
for each child of a crown node and each band of BAND levels, so no shard is
large, whatever prefix a third of all conversations share.

Totals.  In a shard Spark sorts the nodes by reverse level order (its external
sort); one pass reads them and sends each node's subtree totals forward, through
a priority queue that spills sorted runs, to the parent, which comes later.
What leaves a shard is summed up by parent and enters the shards of the band
above, from the deepest band to the first, and at last the crown, which is
processed in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relish.llm.arrow import per_batches
from relish.session import stage

CROWN = 4096
BAND = 1 << 16  # levels of a shard
IN_MEMORY = 200_000  # messages of a priority queue
CHUNK_IDS = 4096  # ids of a text that is hashed at once
NODE = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, piece, turn, digest, chars)``, staged: pieces are ranges of (conv_id, turn, digest)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"))
    return stage(rows.filter("conv_id IS NOT NULL").repartitionByRange("conv_id", "turn", "digest").withColumn("piece", F.spark_partition_id()))


def rebuild(conversations: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the head of their family's first one.

    Returns ``convs(conv_id, total)`` and ``turns(conv_id, piece, depth, digest,
    chars, last)``, both staged: conversation c has the first h turns of
    conversation c - c % family, h = crc32 of c in decimal modulo ``heads``,
    and then its own from h on.
    """
    rows = ordered_turns(conversations)
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stage(rows.groupBy("conv_id", "piece").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads)
    convs = convs.join(first, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stage(convs.withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "head", "total"))
    placed = rows.join(pieces.join(convs, "conv_id"), ["conv_id", "piece"]).withColumn(
        "pos", F.col("before") + F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("turn", "digest")))
    own = placed.filter("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("head"))
    starts = placed.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "chars")
    heading = convs.filter("head > 0").join(starts, "base").filter("depth <= head").withColumn("piece", F.lit(-1))
    columns = ["conv_id", "piece", "depth", "digest", "chars", (F.col("depth") == F.col("total")).alias("last")]
    return convs.select("conv_id", "total"), stage(own.select(*columns).unionByName(heading.select(*columns)))


def members(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2, p1, p2, chars, last)``, staged: the node of every prefix of every conversation, and its parent's key."""
    z = turns.withColumn("z1", F.xxhash64(F.lit(1), "depth", "digest")).withColumn("z2", F.xxhash64(F.lit(2), "depth", "digest"))
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = z.groupBy("conv_id", "piece").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    sums = sums.select("conv_id", "piece", *[F.coalesce(F.bit_xor(s).over(ahead), F.lit(0)).alias(o) for s, o in (("s1", "o1"), ("s2", "o2"))])
    upto = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = z.join(sums, ["conv_id", "piece"])
    for i in "12":
        keyed = keyed.withColumn(f"k{i}", F.col(f"o{i}").bitwiseXOR(F.bit_xor(f"z{i}").over(upto))).withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")))
    return stage(keyed.select("conv_id", "depth", "k1", "k2", "p1", "p2", "chars", "last"))


# A message: the parent's place in reverse level order, then children, leaves and saved tokens below.
MESSAGE = struct.Struct("<6q")


class SpillingQueue:
    """Priority queue of messages that keeps a bounded number in memory and the later ones in sorted runs of a scratch file.

    The file is unlinked and lies with Spark's own spill files; a lost task
    loses nothing, since its next attempt starts anew.
    """

    def __init__(self, most: int = IN_MEMORY, block: int = 1024):
        self.most, self.block = most, block
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # first message of each run, and what comes after it
        self.file = None
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
            self.file = tempfile.TemporaryFile(dir=folders[0] if folders[0] and os.path.isdir(folders[0]) else None)
        self.heap.sort()
        half = len(self.heap) // 2
        start = self.file.seek(0, os.SEEK_END)
        for message in self.heap[half:]:
            self.file.write(MESSAGE.pack(*message))
        self.spilled += len(self.heap) - half
        run = self._read(start, self.file.tell())
        del self.heap[half:]  # a sorted list is a heap
        heapq.heappush(self.heads, (next(run), self.spilled, run))

    def _read(self, at: int, end: int) -> Iterator[tuple]:
        while at < end:
            self.file.seek(at)
            data = self.file.read(min(end - at, self.block * MESSAGE.size))
            at += len(data)
            yield from MESSAGE.iter_unpack(data)

    def pop(self, place: tuple) -> Iterator[tuple]:
        """Takes out all messages for ``place``, which must be the first one that has any."""
        while True:
            if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
                message, number, run = self.heads[0]
                if message[:3] != place:
                    return
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.heads)
                else:
                    heapq.heapreplace(self.heads, (following, number, run))
                yield message
            elif self.heap and self.heap[0][:3] == place:
                yield heapq.heappop(self.heap)
            else:
                return


ROW = ("a1 long, a2 long, a_depth long, depth long, k1 long, k2 long, p1 long, p2 long, is_node boolean, conv_id long, n_convs long, chars long, "
       "n_children long, n_leaves long, saved_tokens long")
ROW_TYPES = {"long": pa.int64(), "boolean": pa.bool_()}
ROW_SCHEMA = pa.schema([(c.split()[0], ROW_TYPES[c.split()[1]]) for c in ROW.split(", ")])


def time_forward(batches, band: int, most: int = IN_MEMORY):
    """Subtree totals of nodes that come in reverse level order, after the messages from other shards for each of them.

    Gives the nodes back with their totals, and a message (``is_node`` false)
    for every parent that lies in another shard: where the anchor or the first
    level of the band is passed.
    """
    queue, out = SpillingQueue(most), []
    for batch in batches:
        for a1, a2, a_depth, depth, k1, k2, p1, p2, is_node, conv_id, n_convs, chars, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            place = (-depth, k1, k2)
            if not is_node:
                queue.push((*place, children, leaves, saved))
                continue
            children, leaves, saved = 0, 0, (n_convs - 1) * chars
            for message in queue.pop(place):
                children, leaves, saved = children + message[3], leaves + message[4], saved + message[5]
            leaves = leaves or 1
            out.append((a1, a2, a_depth, depth, k1, k2, p1, p2, True, conv_id, n_convs, chars, children, leaves, saved))
            if depth == a_depth or depth % band == 0:
                if depth:
                    out.append((a1, a2, a_depth, depth - 1, p1, p2, None, None, False, None, None, None, 1, leaves, saved))
            else:
                queue.push((1 - depth, p1, p2, 1, leaves, saved))
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ROW_SCHEMA)], schema=ROW_SCHEMA)


def _pass(rows: DataFrame, band: int, most: int, shards: bool = True) -> DataFrame:
    dealt = rows.repartition("a1", "a2") if shards else rows.repartition(1)  # the crown: at most CROWN + 1 nodes and one message for each
    return stage(dealt.select(*ROW_SCHEMA.names).sortWithinPartitions(F.col("depth").desc(), "k1", "k2", "is_node").mapInArrow(
        per_batches(time_forward, band=band, most=most), ROW))


def _summed(messages: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    out = messages.groupBy(*by).agg(*sums).withColumn("is_node", F.lit(False))
    return out.select(*[F.col(f.name) if f.name in out.columns else F.lit(None).cast("long").alias(f.name) for f in ROW_SCHEMA])


def totals(nodes: DataFrame, member: DataFrame, convs: DataFrame, crown_size: int = CROWN, band: int = BAND,
           most: int = IN_MEMORY) -> tuple[DataFrame, DataFrame]:
    """The crown, and all nodes with the totals of their subtrees."""
    rows = nodes.agg(F.sum("n_convs")).first()[0] or 0
    heavy = (F.col("n_convs") > rows // crown_size) & (F.col("n_convs") > 1) | (F.col("depth") == 0)
    crown = stage(nodes.filter(heavy))
    places = F.broadcast(crown.select(*NODE))  # at most crown_size + 1 rows
    parents = F.broadcast(crown.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2")))
    anchors = member.join(parents, ["depth", "p1", "p2"], "left_semi").join(places, NODE, "left_anti").select(
        "conv_id", F.col("depth").alias("a_depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    anchors = anchors.join(convs, "conv_id").withColumn("band", F.explode(F.expr(f"sequence(a_depth div {band}, total div {band})")))
    light = nodes.filter(~heavy).withColumn("band", F.expr(f"depth div {band}")).join(anchors, ["conv_id", "band"])
    blank = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    shape = [c for c in ROW_SCHEMA.names if c not in ("is_node", "n_children", "n_leaves", "saved_tokens")]
    shards = stage(light.select(*shape, "band", F.lit(True).alias("is_node"), *blank))
    deepest = shards.agg(F.max("band")).first()[0]
    done, to_crown, entering = [], [], None
    for b in range(-1 if deepest is None else deepest, -1, -1):
        here = shards.filter(F.col("band") == b).select(*ROW_SCHEMA.names)
        out = _pass(here if entering is None else here.unionByName(entering), band, most)
        done.append(out.filter("is_node"))
        left = out.filter("NOT is_node")
        to_crown.append(left.filter("depth + 1 = a_depth"))
        entering = _summed(left.filter("depth + 1 <> a_depth"), ["a1", "a2", "a_depth", *NODE])
    zero = [F.lit(0).cast("long").alias(c) for c in ("a1", "a2", "a_depth")]
    top = crown.select(*zero, *[c for c in shape if c not in ("a1", "a2", "a_depth")], F.lit(True).alias("is_node"), *blank).select(*ROW_SCHEMA.names)
    for messages in to_crown:
        top = top.unionByName(_summed(messages, NODE))
    # one band of all levels: only the root, at depth 0, sends nothing
    crowned = _pass(top, 1 << 62, most, shards=False).filter("is_node")
    for part in done:
        crowned = crowned.unionByName(part)
    return crown, crowned


def _chunks(batches, size: int = CHUNK_IDS):
    """Ids of each node, sorted, as comma-joined texts."""
    node, ids, out = None, [], []

    def close():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    names = [*NODE, "first", "ids"]
    kinds = [pa.int64()] * 4 + [pa.string()]
    for batch in batches:
        for depth, k1, k2, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, k1, k2) != node or len(ids) >= size:
                close()
                node = (depth, k1, k2)
            ids.append(conv_id)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _digests(batches):
    """SHA-256 of each node's texts in order, joined by commas; one text is in memory at a time."""
    node, sha, out = None, None, []
    names, kinds = [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
    for batch in batches:
        for depth, k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, k1, k2) == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, sha.hexdigest()))
            node, sha = (depth, k1, k2), hashlib.sha256(ids.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out = []
    if node is not None:
        out.append((*node, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of ``ends(depth, k1, k2, conv_id)``: a hash of the ids that end at each node."""
    texts = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id").mapInArrow(
        per_batches(_chunks), "depth long, k1 long, k2 long, first long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        per_batches(_digests), "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, crown_size: int = CROWN, band: int = BAND, most: int = IN_MEMORY) -> DataFrame:
    """Nodes of the trie of ``turns(conv_id, piece, depth, digest, chars, last)`` of ``convs(conv_id, total)``.

    A node is named by its depth and smallest member ``conv_id``.  Besides its
    parent it has the number of members, of children, of leaves in its subtree,
    the tokens that sharing saves there (per node, all members but one times
    the characters of its last text), and a hash of the members that end at it.
    """
    member = members(turns)
    inner = member.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                      F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in NODE], "conv_id", "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    nodes = stage(inner.unionByName(root))
    crown, counted = totals(nodes, member, convs, crown_size, band, most)
    counted = counted.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = member.filter("last").select(*NODE, "conv_id").unionByName(convs.filter("total = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    counted = counted.join(end_digests(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    above = lambda t: t.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                               F.col("conv_id").alias("parent_conv_id"))
    hung = F.broadcast(above(crown))  # at most crown_size + 1 rows; below, a parent has few children
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    others = counted.filter("depth > 0").join(hung.drop("parent_conv_id"), ["depth", "p1", "p2"], "left_anti")
    return counted.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*result).unionByName(
        counted.join(hung, ["depth", "p1", "p2"]).select(*result)).unionByName(
        others.join(above(nodes), ["depth", "p1", "p2"]).select(*result))


def rebuilt_trie(conversations: DataFrame, **options) -> DataFrame:
    """The prefix trie of all rebuilt conversations (``rebuild``).

    Turns are ordered by turn, null first; rows of one turn by the MD5 of role
    and text, so equal rows need no order, and repeated rows are turns of their
    own.  Null and empty roles and texts are the same.  Rows without a conv_id
    belong to no conversation and are left out.  Texts are only hashed and
    measured, one at a time.  An empty table has no conversations, and no
    root.  Other columns are not looked at.
    """
    return prefix_trie(*rebuild(conversations.select("conv_id", "turn", "role", "text")), **options)


SQL = r"""
WITH src AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, t, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos FROM src),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
convs AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM sizes),
headed AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS head FROM convs c LEFT JOIN sizes b ON b.conv_id = c.base),
turns AS (
  SELECT h.conv_id, p.pos - h.h + h.head AS d, t, chars FROM headed h JOIN placed p USING (conv_id) WHERE p.pos > h.h
  UNION ALL SELECT h.conv_id, p.pos, t, chars FROM headed h JOIN placed p ON p.conv_id = h.base WHERE p.pos <= h.head),
member AS (
  SELECT conv_id, 0 AS d, '' AS k, 0 AS chars FROM sizes
  UNION ALL SELECT conv_id, d, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d), chars FROM turns),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM member GROUP BY d, k),
children AS (SELECT left(k, (d - 1) * 32) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT m.d, m.k, sum((c.n IS NULL)::INT) AS leaves, sum((u.n - 1) * u.chars) AS saved
  FROM nodes u LEFT JOIN children c ON c.k = u.k JOIN member m ON m.conv_id = u.conv_id AND m.d <= u.d GROUP BY m.d, m.k),
ends AS (
  SELECT m.k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM member m JOIN (SELECT conv_id, max(d) AS d FROM member GROUP BY conv_id) USING (conv_id, d) GROUP BY m.k)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(c.n, 0) AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v JOIN below b USING (d, k) LEFT JOIN children c ON c.k = v.k LEFT JOIN ends e ON e.k = v.k
LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.k = left(v.k, p.d * 32)
"""
