"""Groups of documents whose word n-gram sets are similar, by a prefix-tree join.

1. Every block sends the beginnings of its sets, in the order of the n-grams'
   hashes, and learns which of those n-grams other sets begin with too.  A set
   similar to another shares several of them; most sets do not and are done.
2. The n-grams of the remaining sets are counted and each set is ordered anew,
   rare n-grams first.  Sets whose beginnings share an n-gram now form clusters
   (a superset of all links), linked through one set per block.
3. Each cluster is joined in a prefix tree (``trie.py``).  A cluster over
   ``PIECE`` sets is cut into pieces: first each piece is joined, then one set of
   every group found, and only groups still apart are compared piece by piece.

Equal sets count once throughout.  Every step is exact; nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.llm.arrow import packed, per_batches, per_group, per_pair
from relish.llm.blocks import stage_blocks, stage_bucketed
from relish.llm.exchange import SENT, answer, bin_bits, count_sorted, deal, is_in, keys_of
from relish.llm.trie import Tree, groups
from relish.llm.words import Words, chunks, gram_hashes, mix
from relish.operators.graph import components
from relish.session import stage

GRAM = 5
PERCENT = 80
PIECE = 1024  # sets in one tree, at most
SETS = "block int, row long, id long, n_shingles long, set_id long, tokens binary"
EDGES = "bin int, a long, b long, token long"


def _least(n, percent):
    """The smallest overlap that a set of n elements needs with any similar one."""
    return -(-percent * n // 100)


def _beginning(n, percent):
    """How many of a set's first elements are compared in step 1, and how many of them any similar set shares."""
    return n - _least(n, percent) + 1 + n // 20, 1 + _least(n, percent) // 20


def document_sets(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all documents, where each document's begin, and an id of each whole set."""
    count = np.diff(words.first)
    hashes, at = gram_hashes(words.hashes(), words.first, gram)
    short = np.flatnonzero((count > 0) & (count < gram))
    if len(short):
        own = words.hashes()
        extra = np.array([gram_hashes(own[words.first[d]:words.first[d + 1]], np.array([0, count[d]]), int(count[d]))[0][0] for d in short], np.uint64)
        hashes, at = np.append(hashes, extra), np.append(at, words.first[short])
    doc = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    starts = np.searchsorted(doc, np.arange(len(count) + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return hashes, starts, mix((total[starts[1:]] - total[starts[:-1]]) + np.diff(starts).astype(np.uint64))


def _beginnings(hashes, starts, set_ids, percent):
    """Entries (element, set) of all beginnings, one set of equal ones, and the documents that stand for a set."""
    n = np.diff(starts)
    ids, stand = np.unique(set_ids, return_index=True)
    stand = stand[n[stand] > 0]
    length, _ = _beginning(n[stand], percent)
    length = np.minimum(length, n[stand])
    first = np.repeat(starts[stand] - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(stand) else stand, length)
    at = first + np.arange(int(length.sum()))
    return mix(hashes[at]), np.repeat(set_ids[stand], length), stand, length  # the smallest are not spread evenly


def _send_beginnings(batches, text: str, gram: int, percent: int, bits: int):
    found: dict[int, list] = {}
    for part, words in chunks(batches, text, lower=True):
        blocks = np.array(part.column("block"))
        for block in np.unique(blocks).tolist():
            own = words if blocks[0] == blocks[-1] == block else next(chunks([part.filter(pa.array(blocks == block))], text, lower=True, limit=1 << 40))[1]
            found.setdefault(block, []).append(_beginnings(*document_sets(own, gram), percent)[:2])
    for block, lists in found.items():
        token, of = (np.concatenate(x) for x in zip(*lists))
        order = np.lexsort((of, token))
        token, of = token[order], of[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = token[1:] != token[:-1]
        starts = np.flatnonzero(fresh)
        several = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts) if len(starts) else np.zeros(0, bool)
        yield deal(block, token[starts], bits, 1 + several.astype(np.uint8))


def _in_several(keys, many, block):
    order, starts, run = count_sorted(keys)
    total = np.add.reduceat(many[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    back = np.zeros(len(keys), bool)
    back[order] = total[run] > 1
    return back, None


def _sets_of_block(key, table: pa.Table, answers: pa.Table, text: str, gram: int, percent: int) -> pa.Table:
    """A row for each document; those that stand for a set which can have similar ones carry its elements."""
    shared, out = keys_of(answers), []
    done: set[int] = set()
    for part, words in chunks(table.to_batches(), text, lower=True):
        hashes, starts, set_ids = document_sets(words, gram)
        token, _, stand, length = _beginnings(hashes, starts, set_ids, percent)
        n = np.diff(starts)
        hits = np.add.reduceat(is_in(token, shared).astype(np.int64), np.concatenate([[0], np.cumsum(length)[:-1]])) if len(stand) else stand
        chosen = stand[hits >= _beginning(n[stand], percent)[1]]
        tokens: list = [None] * part.num_rows
        for d in chosen.tolist():
            if (own := int(set_ids[d])) not in done:
                done.add(own)
                tokens[d] = packed(hashes[starts[d]:starts[d + 1]])
        out.append(pa.table({"block": part.column("block"), "row": part.column("row"), "id": part.column("id"), "n_shingles": pa.array(n, pa.int64()),
                             "set_id": pa.array(set_ids.view(np.int64), mask=n == 0), "tokens": pa.array(tokens, pa.binary())}))
    return pa.concat_tables(out) if out else pa.table({"block": pa.array([], pa.int32()), "row": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "n_shingles": pa.array([], pa.int64()),
                                                       "set_id": pa.array([], pa.int64()), "tokens": pa.array([], pa.binary())})


def _send_all(batches, bits: int):
    """The elements of the remaining sets of each block, and in how many of its sets each is."""
    found: dict[int, list] = {}
    for batch in batches:
        for block, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(block, []).append(np.frombuffer(tokens, np.uint64))
    for block, lists in found.items():
        keys, many = np.unique(np.concatenate(lists), return_counts=True)
        yield deal(block, keys, bits, many.astype(np.uint32))


def _counts(keys, many, block):
    order, starts, run = count_sorted(keys)
    total = np.add.reduceat(many[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    values = np.empty(len(keys), np.int64)
    values[order] = total[run]
    return values > 1, values


def _cluster_edges(key, table: pa.Table, answers: pa.Table, percent: int, bits: int) -> pa.Table:
    """Links between sets of a block whose beginnings, rare elements first, share one; and one set per element for other blocks."""
    if not table.num_rows:
        return pa.table({"bin": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("keys").to_pylist()] or [np.zeros(0, np.uint64)])
    many = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("extra").to_pylist()] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    keys, many = keys[order], many[order]
    ids, tokens = [], []
    for own, blob in zip(table.column("set_id").to_pylist(), table.column("tokens").to_pylist()):
        elements = np.frombuffer(blob, np.uint64)
        at = np.minimum(np.searchsorted(keys, elements), max(0, len(keys) - 1))
        common = keys[at] == elements if len(keys) else np.zeros(len(elements), bool)
        left = len(elements) - _least(len(elements), percent) + 1 - int((~common).sum())  # elements of this set alone come first
        if left > 0:
            some = elements[common]
            some = some[np.lexsort((some, many[at[common]]))[:left]]
            tokens.append(some)
            ids.append(np.full(len(some), own, np.int64))
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    own = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = np.lexsort((own, token))
    token, own = token[order], own[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    first = own[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(own) else own
    pairs = np.unique(np.column_stack([first, own])[own != first], axis=0) if len(own) else np.zeros((0, 2), np.int64)
    bins = (token[fresh] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(int(fresh.sum()), np.int32)
    return pa.table({
        "bin": pa.array(np.concatenate([np.full(len(pairs), -1, np.int32), bins])),
        "a": pa.array(np.concatenate([pairs[:, 0], own[fresh]])), "b": pa.array(np.concatenate([pairs[:, 1], own[fresh]])),
        "token": pa.array(np.concatenate([np.zeros(len(pairs), np.int64), token[fresh].view(np.int64)]))})


def _joined_groups(key, table: pa.Table, percent: int) -> pa.Table:
    """Groups of similar sets within each piece of each cluster of a task; ``root`` is one set of the group."""
    pieces: dict[tuple, dict[int, bytes]] = {}
    for cluster, piece, own, tokens in zip(*(table.column(c).to_pylist() for c in ("cluster", "piece", "set_id", "tokens"))):
        pieces.setdefault((cluster, piece), {})[own] = tokens
    out: list[list] = [[], [], []]
    for (cluster, _), sets in pieces.items():
        ids = sorted(sets)
        root = groups([np.frombuffer(sets[i], np.uint64) for i in ids], percent)
        out[0] += [cluster] * len(ids)
        out[1] += ids
        out[2] += [ids[r] for r in root]
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("cluster", "set_id", "root"), out)})


def _linked_roots(key, table: pa.Table, probes: pa.Table, percent: int) -> pa.Table:
    """Pairs of groups with a similar pair of sets, one in this piece and one among the probes."""
    out: set[tuple[int, int]] = set()
    if table.num_rows and probes.num_rows:
        own = {i: (r, t) for i, r, t in zip(*(table.column(c).to_pylist() for c in ("set_id", "root", "tokens")))}
        ids = sorted(own)
        tree = Tree([np.frombuffer(own[i][1], np.uint64) for i in ids])
        for root, tokens in zip(probes.column("root").to_pylist(), probes.column("tokens").to_pylist()):
            for row in tree.similar(*tree.place(np.frombuffer(tokens, np.uint64)), percent):
                other = own[ids[row]][0]
                if other != root:
                    out.add((min(root, other), max(root, other)))
    return pa.table({"cluster": pa.array([key[0].as_py()] * len(out), pa.int64()), "a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _in_pieces(sets: DataFrame, sizes: DataFrame, piece_size: int) -> DataFrame:
    """``sets`` with ``pieces`` (of its cluster) and ``piece``."""
    pieces = F.ceil(F.col("size") / F.lit(float(piece_size)))
    return sets.join(sizes, "cluster").withColumn("pieces", pieces).drop("size").withColumn("piece", F.pmod(F.xxhash64("set_id"), F.col("pieces")))


def _join_pieces(sets: DataFrame, sizes: DataFrame, percent: int, piece_size: int, tasks: int) -> DataFrame:
    cut = _in_pieces(sets, sizes, piece_size).withColumn("task", F.pmod(F.xxhash64("cluster", "piece"), F.lit(tasks)))
    return stage(cut.select("task", "cluster", "piece", "set_id", "tokens").groupBy("task").applyInArrow(
        per_group(_joined_groups, percent=percent), "cluster long, set_id long, root long").distinct())


def _similar_groups(sets: DataFrame, percent: int, piece_size: int) -> DataFrame:
    """``(set_id, root)``: equal roots for all sets of a cluster linked by similarity.  ``sets(cluster, set_id, tokens)``, with copies."""
    sizes = stage(sets.select("cluster", "set_id").distinct().groupBy("cluster").agg(F.count("*").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total * 2 // piece_size), sets.sparkSession.sparkContext.defaultParallelism)
    found = _join_pieces(sets, sizes, percent, piece_size, tasks)
    large = sizes.filter(F.col("size") > piece_size)
    if large.isEmpty():
        return found.select("set_id", "root")
    # clusters of several pieces: join one set of every group again while that helps
    open_sets = stage(sets.join(large.select("cluster"), "cluster").groupBy("cluster", "set_id").agg(F.first("tokens").alias("tokens")))
    roots = stage(found.join(large.select("cluster"), "cluster"))
    before = None
    while True:
        tops = roots.select("cluster", F.col("root").alias("set_id")).distinct()
        counts = stage(tops.groupBy("cluster").agg(F.count("*").alias("size")))
        many = counts.agg(F.sum("size")).first()[0]
        if before is not None and many * 2 > before:
            break
        before = many
        again = _join_pieces(open_sets.join(tops, ["cluster", "set_id"]), counts, percent, piece_size, tasks)
        up = again.select("cluster", F.col("set_id").alias("root"), F.col("root").alias("top"))
        roots = stage(roots.join(up, ["cluster", "root"]).select("cluster", "set_id", F.col("top").alias("root")))
    # groups still apart: all but a cluster's largest are compared with all its pieces
    weight = roots.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = weight.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    labelled = stage(_in_pieces(open_sets.join(roots, ["cluster", "set_id"]).join(main, "cluster"), large, piece_size))
    minor = labelled.filter("root <> main")
    parts = stage(minor.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(float(piece_size))).alias("parts")))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = labelled.join(parts, "cluster").withColumn("part", number(F.col("parts"))).select("cluster", "piece", "part", "set_id", "root", "tokens")
    probes = stage(minor.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts"))).withColumn(
        "piece", number(F.col("pieces"))).select("cluster", "piece", "part", "root", "tokens"))
    keys = ["cluster", "piece", "part"]
    links = stage(own.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(per_pair(_linked_roots, percent=percent), "cluster long, a long, b long").distinct())
    merged = components(roots.select(F.col("cluster").alias("g"), F.col("root").alias("v")).distinct(), links.select(F.col("cluster").alias("g"), "a", "b"))
    top = merged.select(F.col("g").alias("cluster"), F.col("v").alias("root"), F.col("root").alias("top"))
    rest = roots.join(top, ["cluster", "root"]).select("set_id", F.col("top").alias("root"))
    return found.join(large.select("cluster"), "cluster", "left_anti").select("set_id", "root").union(rest)


def _members(blocks: DataFrame, row_id: str, text: str, gram: int, percent: int, piece_size: int) -> DataFrame:
    """``(block, row, id, n_shingles, root)`` of staged rows; rows with equal roots belong together, a null root to no group."""
    texts = blocks.select("block", "row", F.col(row_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    bits = bin_bits(blocks.select("block").distinct().count())
    sent = texts.select("block", "text").mapInArrow(per_batches(_send_beginnings, text="text", gram=gram, percent=percent, bits=bits), SENT)
    shared = answer(sent, _in_several, np.uint8)
    rows = stage_bucketed(texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        per_pair(_sets_of_block, text="text", gram=gram, percent=percent), SETS), blocks)
    sets = rows.filter("tokens is not null").select("block", "set_id", "tokens")

    counted = answer(sets.select("block", "tokens").mapInArrow(per_batches(_send_all, bits=bits), SENT), _counts, np.uint32)
    edges = stage(sets.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        per_pair(_cluster_edges, percent=percent, bits=bits), EDGES))
    within = edges.filter("bin < 0").select("a", "b")
    stars = edges.filter("bin >= 0")
    first = stars.groupBy("token").agg(F.min("a").alias("first"))
    across = stars.join(first, "token").filter("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b"))
    links = stage(within.union(across).distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().select(F.lit(0).alias("g"), "v")
    clusters = components(nodes, links.select(F.lit(0).alias("g"), "a", "b")).select(F.col("v").alias("set_id"), F.col("root").alias("cluster"))
    grouped = stage(_similar_groups(sets.join(clusters, "set_id").select("cluster", "set_id", "tokens"), percent, piece_size))
    return stage(rows.select("block", "row", "id", "n_shingles", "set_id").join(grouped, "set_id", "left").select(
        "block", "row", "id", "n_shingles", F.coalesce("root", "set_id").alias("root")))


def similar_components(docs: DataFrame, text: str = "text", row_id: str = "doc_id", gram: int = GRAM, percent: int = PERCENT,
                       piece_size: int = PIECE) -> DataFrame:
    """``(<row_id>, n_shingles, component_id)``, one row per row of ``docs``.

    A document's set holds its distinct runs of ``gram`` words, A-Z lower-cased;
    with fewer words, the whole sequence.  Two documents link when their sets'
    Jaccard similarity is at least ``percent`` / 100; ``component_id`` is the
    smallest id reachable by links.

    Null and empty texts have the empty set and link with nothing, so they keep
    their own id.  Equal texts link.  Null ids are not smallest; a component of
    null ids alone has a null id.  Rows that share an id are documents of their
    own.  An empty table gives an empty result; other columns are not read.
    """
    blocks = stage_blocks(docs.select(row_id, text).withColumn("row", F.monotonically_increasing_id()))
    members = _members(blocks, row_id, text, gram, percent, piece_size)
    lowest = members.filter("root is not null").groupBy("root").agg(F.min("id").alias("lowest"))
    return members.join(lowest, "root", "left").select(
        F.col("id").alias(row_id), "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", row_id: str = "doc_id", gram: int = GRAM, percent: int = PERCENT, piece_size: int = PIECE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), of rows that share it the first.

    Rows with null or empty texts all stay.  Columns named block or row are
    left out.  The texts are not shuffled: each block gets the numbers of its
    rows that go.
    """
    names = [c for c in docs.columns if c not in ("block", "row")]
    blocks = stage_blocks(docs.select(*names).withColumn("row", F.monotonically_increasing_id()))
    members = _members(blocks, row_id, text, gram, percent, piece_size).filter("root is not null")
    kept = members.groupBy("root").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("kept"))
    gone = members.join(kept, "root").filter("row <> kept").groupBy("block").agg(F.collect_list("row").alias("_gone"))
    return blocks.join(stage(gone), "block", "left").filter(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("row"))).select(*names)
