"""Exact BM25 top-k search: an inverted index per shard, block-max WAND, exact merge.

Every block of documents is a shard and indexes all its words once; the index
is a row of packed arrays, with postings in order of document id.  One exchange
gives each shard the corpus frequency of its queries' words, so all shards
score with global statistics.  Packed queries meet every shard without a
shuffle.  In a shard a query of few words moves through its words' postings by
WAND: the largest possible scores of words tell which document could still
enter the top k, the largest scores of blocks of postings whether it is worth a
look.  Bounds summed over many words exclude next to nothing, so queries of many
words go together: a product of matrices for the words that many documents
hold, and the postings of the others, give all scores but for rounding; only documents that can be among the k best of the shard, and of the
shards before it in the task, are scored exactly.  The k best of every shard are merged by score.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relish.llm.arrow import packed, per_batches, per_group, per_pair
from relish.llm.blocks import stage_blocks
from relish.llm.exchange import SENT, answer, bin_bits, count_sorted, deal
from relish.llm.words import chunks
from relish.session import stage

K1, B = 1.2, 0.75
POSTINGS = 64  # postings with one common largest score
SHORT = 12  # words up to which a query goes by WAND
STEP = 1 << 18  # postings added up at once
CHUNK = 8 << 20  # bytes of queries that go through a shard together
OFTEN = 24  # words in one of so many documents are common: they come first in queries, and have rows in a shard's matrix
DOCUMENTS = 256  # documents from which a shard is worth a matrix
MATRIX = 1 << 23  # numbers in a matrix; a shard of more has none
CELLS = 1 << 20  # scores of queries and documents held at once
VISITS = 1 << 16  # postings beside the matrix that are added up at once
SHARD_POSTINGS = 1 << 20  # postings of a shard; more only where one text has more words
HELD = 1 << 20  # hits after which those of a task are reduced
INDEX = "block int, docs long, words long, ids binary, rows binary, sizes binary, keys binary, starts binary, at binary, tf binary, asked binary"
QUERIES = "query_ids binary, rows binary, lengths binary, keys binary, weights binary"
HITS = "row long, query_id long, id long, score double"


def _word_table(batches):
    """Distinct (document, word) entries of some rows, by document: row, word hash, count; and words per row."""
    rows, keys, counts, sizes, base = [], [], [], [], 0
    for part, words in chunks(batches, "text", lower=True):
        hashes, n = words.hashes(), np.diff(words.first)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        rows.append((doc[first] + base).astype(np.int32))
        keys.append(hashes[first])
        counts.append(np.diff(np.append(first, len(hashes))).astype(np.int32))
        sizes.append(n)
        base += len(n)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(rows, np.int32), cat(keys, np.uint64), cat(counts, np.int32), cat(sizes, np.int64)


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as hold them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def wide(data, n: int) -> np.ndarray:
    """The ``n`` numbers that ``narrow`` packed."""
    return np.frombuffer(data, f"u{len(memoryview(data)) // n}").astype(np.int32)


def _index_block(key, table: pa.Table, most: int) -> pa.Table:
    """The inverted indexes of the shards of a block: runs of its documents, in order of ids, with a bounded number of postings."""
    table = table.take(pa.array(np.argsort(table.column("id").to_numpy(zero_copy_only=False), kind="stable")))
    all_rows, all_keys, all_counts, all_sizes = _word_table(table.to_batches())
    ends = np.searchsorted(all_rows, np.arange(table.num_rows), "right")
    asked = table.column("is_query").to_numpy(zero_copy_only=False)
    out: list[tuple] = []
    low = 0
    while low < table.num_rows:
        begin = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begin + most, "right")))
        own = slice(begin, int(ends[high - 1]))
        row, keys, counts = all_rows[own] - low, all_keys[own], all_counts[own]
        wanted = np.unique(keys[asked[low:high][row]]) if len(row) else keys
        order = np.argsort(keys, kind="stable")  # rows of one word stay in order
        words, starts = np.unique(keys[order], return_index=True)
        part = table.slice(low, high - low)
        arrays = [part.column("id").to_numpy(zero_copy_only=False), part.column("row").to_numpy(zero_copy_only=False), all_sizes[low:high].astype(np.int32), words,
                  np.append(starts, len(keys)).astype(np.int64), narrow(row[order]), narrow(counts[order]), wanted]
        out.append((key[0].as_py(), part.num_rows, int(all_sizes[low:high].sum()), *(packed(a) for a in arrays)))
        low = high
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = zip(*out) if out else [[] for _ in INDEX.split(", ")]
    return pa.table({c.split()[0]: pa.array(x, kinds[c.split()[1]]) for c, x in zip(INDEX.split(", "), columns)})


def _send_frequencies(batches, bits: int):
    """Document frequencies of a shard's words; the lowest bit marks words of its queries."""
    for batch in batches:
        for block, keys, starts, asked in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "starts", "asked"))):
            keys = np.frombuffer(keys, np.uint64)
            wanted = np.isin(keys, np.frombuffer(asked, np.uint64), assume_unique=True)
            yield deal(block, keys, bits, np.diff(np.frombuffer(starts, np.int64)) * 2 + wanted)


def _frequencies(keys, marked, block):
    order, starts, run = count_sorted(keys)
    total = np.zeros(len(keys), np.int64)
    if len(keys):
        total[order] = np.add.reduceat(marked[order] >> 1, starts)[run]
    return (marked & 1).astype(bool), total


def idf(docs: int, frequency):
    return np.log(1 + (docs - frequency + 0.5) / (frequency + 0.5))


def common(docs: int) -> float:
    """Largest weight of a word in one of OFTEN documents or more."""
    return float(idf(docs, docs / OFTEN))


def _queries_of_block(key, table: pa.Table, answers: pa.Table, docs: int, words: int, terms: int | None) -> pa.Table:
    """The query made from each query document, in one row: the words of the whole text that other documents hold too; with ``terms``, those that weigh most in it."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("keys").to_pylist()] or [np.zeros(0, np.uint64)])
    frequency = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("extra").to_pylist()] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    keys, frequency = keys[order], frequency[order]
    row, own, counts, sizes = _word_table(table.to_batches())
    df = frequency[np.searchsorted(keys, own)] if len(own) else frequency[:0]
    rare = idf(docs, df)
    some = np.flatnonzero(df > 1)
    if terms is not None and len(some):
        weight = rare * counts * (K1 + 1) / (counts + K1 * (1 - B + B * sizes[row] / (words / docs)))
        order = some[np.lexsort((own[some], -weight[some], row[some]))]
        starts = np.searchsorted(row[order], np.arange(table.num_rows))
        some = order[np.arange(len(order)) - starts[row[order]] < terms]
    some = some[np.lexsort((own[some], rare[some] > common(docs), row[some]))]  # the order in which a score is added up
    arrays = [table.column("id").to_numpy(zero_copy_only=False), table.column("row").to_numpy(zero_copy_only=False),
              np.bincount(row[some], minlength=table.num_rows).astype(np.int64), own[some], rare[some]]
    return pa.table({name: pa.array([packed(a)] if table.num_rows else [], pa.binary()) for name, a in zip(("query_ids", "rows", "lengths", "keys", "weights"), arrays)})


def _pack_queries(batches):
    """Rows of queries put together to about CHUNK bytes."""
    names, held = [x.split()[0] for x in QUERIES.split(", ")], []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in zip(*held)], names)
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            held.append(row)
            if sum(len(x) for r in held for x in r) >= CHUNK:
                yield flush()
                held = []
    if held:
        yield flush()


def wand(lists: list[tuple[list[int], list[float], list[float]]], k: int, skip: int, floor: float = 0.0) -> list[tuple[float, int]]:
    """The k best documents as (score, document), best first, ties to the smaller; never document ``skip``.

    Documents that score less than ``floor`` may be left out.  A list holds one word's documents in order, its scores, and the largest score
    of every POSTINGS of them.
    """
    heap: list[tuple[float, int]] = []  # (score, -document): the worst first
    limit = floor
    most = [max(blocks) for _, _, blocks in lists]
    at = [0] * len(lists)
    live = [i for i in range(len(lists)) if lists[i][0]]
    while live:
        live.sort(key=lambda i: lists[i][0][at[i]])
        bound, pivot = 0.0, -1
        for n, i in enumerate(live):
            bound += most[i]
            if bound * (1 + 1e-9) > limit:
                pivot = n
                break
        if pivot < 0:
            break
        document = lists[live[pivot]][0][at[live[pivot]]]
        while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == document:
            pivot += 1
        ahead = live[:pivot + 1]
        # the blocks in which the document would be, and their largest scores
        bound, edge = 0.0, lists[live[pivot + 1]][0][at[live[pivot + 1]]] if pivot + 1 < len(live) else 1 << 62
        for i in ahead:
            documents, _, blocks = lists[i]
            if documents[at[i]] < document:
                at[i] = bisect_left(documents, document, at[i])
            if at[i] < len(documents):
                bound += blocks[at[i] // POSTINGS]
                edge = min(edge, documents[min(len(documents), (at[i] // POSTINGS + 1) * POSTINGS) - 1] + 1)
        if bound * (1 + 1e-9) > limit:
            score = 0.0
            for i in sorted(ahead):
                documents, scores, _ = lists[i]
                if at[i] < len(documents) and documents[at[i]] == document:
                    score += scores[at[i]]
                    at[i] += 1
            if document != skip:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -document))
                elif score > heap[0][0]:
                    heapq.heapreplace(heap, (score, -document))
                limit = max(floor, heap[0][0]) if len(heap) == k else floor
        else:
            target = max(edge, document + 1)
            for i in ahead:
                if at[i] < len(lists[i][0]) and lists[i][0][at[i]] < target:
                    at[i] = bisect_left(lists[i][0], target, at[i])
        live = [i for i in live if at[i] < len(lists[i][0])]
    return [(s, -d) for s, d in sorted(heap, key=lambda x: (-x[0], -x[1]))]


def full(places, weights, starts, at, share, docs: int, k: int, skip: int) -> list[tuple[float, int]]:
    """As ``wand``, by adding up all postings; each document's sum is taken in the order of the words."""
    n = starts[places + 1] - starts[places]
    ends = np.cumsum(n)
    total, a = np.zeros(docs), 0
    while a < len(places):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + STEP, "right")))
        many = n[a:b]
        where = np.repeat(starts[places[a:b]] - (ends[a:b] - many - done), many) + np.arange(ends[b - 1] - done)
        np.add.at(total, at[where].astype(np.intp), share[where] * np.repeat(weights[a:b], many))
        a = b
    if skip >= 0:
        total[skip] = 0.0
    found = np.flatnonzero(total)
    if len(found) > k:
        found = np.flatnonzero(total >= np.partition(total, docs - k)[docs - k])
    found = found[np.lexsort((found, -total[found]))[:k]]
    return list(zip(total[found].tolist(), found.tolist()))


def _spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``firsts`` and have these sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Dense:
    """A shard for queries of many words: a matrix of the words ``often``, beside the postings."""

    def __init__(self, starts, at, share, docs: int, often):
        self.starts, self.sizes, self.share, self.docs = starts, np.diff(starts), share, docs
        self.pairs = np.stack([at.astype(np.int32), share.astype(np.float32).view(np.int32)], axis=1).view(np.int64).ravel()  # side by side: one reach for both
        self.line = np.full(len(self.sizes), -1)
        self.line[often] = np.arange(len(often))
        where = _spread(starts[often], self.sizes[often])
        self.matrix = np.zeros((docs, len(often)))
        self.matrix[at[where], np.repeat(np.arange(len(often)), self.sizes[often])] = share[where]
        self.product = self.matrix.T.astype(np.float32, order="C")

    def best(self, queries, skips, floors, k: int) -> list[list[tuple[float, int]]]:
        """As ``full`` for each of many queries of (places, weights), in which words of the matrix come first and in order.

        Documents that score less than a query's floor may be left out.
        """
        found = []
        for first in range(0, len(queries), step := max(1, CELLS // max(self.docs, len(self.product)))):
            some = queries[first:first + step]
            words = np.array([len(places) for places, _ in some])
            place, weight = (np.concatenate(x) for x in zip(*some))
            query, line = np.repeat(np.arange(len(some)), words), self.line[place]
            heavy = np.zeros((len(some), len(self.product)))
            heavy[query[line >= 0], line[line >= 0]] = weight[line >= 0]
            rough = heavy.astype(np.float32) @ self.product
            rare = np.flatnonzero(line < 0)
            query, place, weight = query[rare], place[rare], weight[rare]
            ends = np.cumsum(np.bincount(query, self.sizes[place], minlength=len(some)))
            a = 0
            while a < len(some):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + VISITS, "right")))
                own = slice(*np.searchsorted(query, [a, b]))
                found += self._finish(rough[a:b], heavy[a:b], query[own] - a, place[own], weight[own], words[a:b],
                                      np.array(skips[first + a:first + b]), np.array(floors[first + a:first + b]), k)
                a = b
        return found

    def _finish(self, rough, heavy, query, place, weight, words, skips, floors, k: int) -> list[list[tuple[float, int]]]:
        """Adds the words that are not in the matrix to rough scores, and scores exactly what can be among the k best."""
        n, cells = self.sizes[place], rough.reshape(-1)
        where = _spread(self.starts[place], n)
        pair = self.pairs.take(where).view(np.int32)
        cell = pair[::2] + np.repeat(query * self.docs, n)
        np.add.at(cells, cell, pair.view(np.float32)[1::2] * np.repeat(weight.astype(np.float32), n))
        cells[(np.arange(len(rough)) * self.docs + skips)[skips >= 0]] = 0.0
        error = (words + 8) * 2.0 ** -23  # nothing is negative, so each rounding adds 2^-24 at most; doubled
        sure = np.partition(rough, -k, axis=1)[:, -k] if self.docs >= k else np.zeros(len(rough))
        low = np.maximum(sure * (1 - 2 * error), floors * (1 - error)).astype(np.float32)
        low = np.maximum(np.nextafter(low, np.float32(0)), np.finfo(np.float32).smallest_subnormal)
        chosen = np.flatnonzero((rough >= low[:, None]).reshape(-1))
        owner, document = np.divmod(chosen, self.docs)
        total, many = np.zeros(len(chosen)), max(1, CELLS // max(1, heavy.shape[1]))
        for a in range(0, len(chosen) if heavy.shape[1] else 0, many):
            part = heavy[owner[a:a + many]] * self.matrix[document[a:a + many]]
            total[a:a + many] = np.cumsum(part, axis=1)[:, -1]  # one after the other, as everywhere: copies of a text tie
        column = np.full(len(cells), -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        target = column.take(cell)
        hit = np.flatnonzero(target >= 0)
        np.add.at(total, target[hit], self.share[where[hit]] * weight[np.searchsorted(np.cumsum(n), hit, "right")])
        order = np.lexsort((document, -total, owner))
        owner, document, total = owner[order], document[order], total[order]
        starts = np.searchsorted(owner, np.arange(len(rough) + 1))
        return [list(zip(total[a:min(b, a + k)].tolist(), document[a:min(b, a + k)].tolist())) for a, b in zip(starts[:-1], starts[1:])]


def _leading(hits: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The k best (row, query, id, score) of each query row; ties to the smaller id."""
    row, query, found, score = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((found, -score, row))
    row, query, found, score = row[order], query[order], found[order], score[order]
    first = np.searchsorted(row, row)
    lead = np.arange(len(row)) - first < k
    return [row[lead], query[lead], found[lead], score[lead]]


def _search_shards(batches, docs: int, words: int, k: int):
    """The best documents of a task's shards for each of its queries, from rows of a shard's index with some queries."""
    shard, hits, held = None, [], 0
    reached: dict[int, list[float]] = {}  # the k best scores so far of a query's row
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
            ids, own_rows, sizes, keys, starts = (get(n, t) for n, t in (
                ("ids", np.int64), ("rows", np.int64), ("sizes", np.int32), ("keys", np.uint64), ("starts", np.int64)))
            if not len(keys):
                continue
            if shard != own_rows[0]:
                at, tf = (wide(batch.column(n)[i].as_buffer(), int(starts[-1])) for n in ("at", "tf"))
                shard, known = int(own_rows[0]), {}
                share = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * sizes / (words / docs)))[at])

            def postings(place: int):
                if place not in known:
                    own = share[starts[place]:starts[place + 1]]
                    known[place] = at[starts[place]:starts[place + 1]].tolist(), own, np.maximum.reduceat(own, np.arange(0, len(own), POSTINGS))
                return known[place]

            terms, weights, ends = get("q_keys", np.uint64), get("q_weights", np.float64), np.cumsum(get("q_lengths", np.int64))
            places = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
            there = keys[places] == terms
            often = np.unique(places[there & (weights <= common(docs))])
            out: list[list] = [[], [], [], []]
            done, many = [], []
            first = 0
            for query, row, end in zip(get("q_query_ids", np.int64).tolist(), get("q_rows", np.int64).tolist(), ends.tolist()):
                some = np.flatnonzero(there[first:end]) + first
                first = end
                if not len(some):
                    continue
                own = np.flatnonzero(own_rows == row)
                skip = int(own[0]) if len(own) else -1
                floor = scores[-1] if len(scores := reached.get(row, [])) == k else 0.0
                if len(some) <= SHORT:
                    lists = [(d, (s * w).tolist(), (m * w).tolist()) for (d, s, m), w in zip(map(postings, places[some].tolist()), weights[some].tolist())]
                    sure = [float(np.partition(known[p][1], -k - 1)[-k - 1]) * w for p, w in zip(places[some].tolist(), weights[some].tolist()) if len(known[p][1]) > k]  # k others score that by one word
                    done.append((query, row, wand(lists, k, skip, max(floor, *sure, 0.0))))
                elif len(ids) < DOCUMENTS or len(often) * len(ids) > MATRIX:
                    done.append((query, row, full(places[some], weights[some], starts, at, share, len(ids), k, skip)))
                else:
                    many.append((query, row, (places[some], weights[some]), skip, floor))
            if many:
                queries, own, *rest = zip(*many)
                done += zip(queries, own, Dense(starts, at, share, len(ids), often).best(*rest, k))
            for query, row, best in done:
                reached[row] = sorted(reached.get(row, []) + [score for score, _ in best], reverse=True)[:k]
                for score, document in best:
                    for column, value in zip(out, (row, query, int(ids[document]), score)):
                        column.append(value)
            hits.append([np.array(x, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.float64))])
            held += len(out[0])
            if held > HELD:
                hits = [_leading(hits, k)]
                held = len(hits[0][0]) // 2  # all of it may be needed: what is held grows with the queries of the task only
    if hits:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _leading(hits, k)], ["row", "query_id", "id", "score"])


def search(docs: DataFrame, is_query, k: int = 10, text: str = "text", row_id: str = "doc_id", terms: int | None = None,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``(query_id, rank, <row_id>, score)``: the k other documents with the largest BM25 scores for each query document.

    Words are lower-cased in A-Z.  The query of a document consists of all
    distinct words of its text that occur in several documents, or, if
    ``terms`` is given, of so many of them with the largest BM25 weight there;
    every document with one of them is a candidate.  Results are exact; ties go to the smaller id.

    Rows with a null id take no part.  Null and empty texts are found by
    nothing and, as queries, find nothing.  Rows that share an id are documents
    and queries of their own; a query leaves out its own row only.  An empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null")
    blocks = stage_blocks(rows.withColumn("is_query", is_query(F.col("id"))).withColumn("row", F.monotonically_increasing_id()))
    index = stage(blocks.groupBy("block").applyInArrow(per_group(_index_block, most=shard_postings), INDEX))
    total = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.count("*").alias("shards")).first()
    sizes = {"docs": total["docs"] or 1, "words": max(1, total["words"] or 1)}
    bits = bin_bits(total["shards"])
    known = answer(index.select("block", "keys", "starts", "asked").mapInArrow(per_batches(_send_frequencies, bits=bits), SENT), _frequencies, np.int64)
    queries = stage(blocks.filter("is_query").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        per_pair(_queries_of_block, terms=terms, **sizes), QUERIES))
    size = queries.agg(F.sum(sum(F.length(x.split()[0]) for x in QUERIES.split(", ")))).first()[0] or 0
    asked = stage(queries.coalesce(-(-size // CHUNK) or 1).mapInArrow(per_batches(_pack_queries), QUERIES))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns)).hint("shuffle_replicate_nl")  # read again for each part of the index: a shuffle would write all queries once per shard
    found = index.select("ids", "rows", "sizes", "keys", "starts", "at", "tf").crossJoin(asked).mapInArrow(per_batches(_search_shards, k=k, **sizes), HITS)
    place = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(row_id), "score")
