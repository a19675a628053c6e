"""Pack token ids into sequences by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are powers of two: as
many of the longest length as fit, then one for every one-bit of the rest.  A
piece is a sequence of its own, in the bucket of its length, so no sequence
crosses documents and nothing is padded.  Each document is cut by itself: one
pass over the table, no shuffle.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relish.llm.arrow import per_batches

MAX_LENGTH = 1024
END_ID = 0
ROWS_AT_ONCE = 64
TWO_SPACES = re.compile(r"\s\s")
LONG_SPACE = re.compile(r"\s{10000}")  # the rank library's pattern runs out of stack on far longer runs
_encoders: dict[tuple, "Encoder"] = {}


class Encoder:
    """Token ids of texts as little-endian 32-bit arrays, equal to the tokenizer's own.

    ``path`` is the tokenizer's file, ``ranks`` (optional) the same byte-level
    vocabulary as merge ranks, which a library reads that is several times as
    fast.  Its split pattern looks ahead only where white space follows white
    space, so texts without such places are split by the pattern without the
    look-ahead.  Texts with the mark of a special token go to the tokenizer
    itself, as do all texts without ``ranks``.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ranks, self.plain = (
                tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
                for pattern in (PATTERN, PATTERN.replace(r"\s+(?!\S)|", "")))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if self.ranks is None:
            return self.whole(texts)
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> bytes:
        spaces = TWO_SPACES.search(text)
        if "<|" in text or spaces and LONG_SPACE.search(text):
            return self.whole([text])[0]
        return np.array((self.ranks if spaces else self.plain)(text), "<u4").tobytes()


def encoder(path: str, ranks: str | None) -> Encoder:
    """The encoder of this worker process, read once."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def piece_lengths(total: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of a document's pieces, longest first."""
    whole, rest = divmod(total, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack_batches(batches, path: str, ranks: str | None, longest: int, end_id: int, schema: pa.Schema):
    tool, end = encoder(path, ranks), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for row in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(row, ROWS_AT_ONCE)
            texts = part.column(1).fill_null("").to_pylist()
            at, start, length, total, ids = [], [], [], [], []
            for i, own in enumerate(tool.encode(texts)):
                own += end
                n, done = len(own) // 4, 0
                for size in piece_lengths(n, longest):
                    at.append(i)
                    start.append(done)
                    length.append(size)
                    total.append(n)
                    ids.append(own[4 * done:4 * (done + size)])
                    done += size
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(ids, pa.binary())], schema=schema)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text", row_id: str = "doc_id", longest: int = MAX_LENGTH,
         end_id: int = END_ID) -> DataFrame:
    """``(row_id, start, length, doc_tokens, ids, bucket, sequence_id, offset)``, one row per piece and sequence.

    ``tokenizer`` and ``ranks`` are paths on every executor, see ``Encoder``.  ``ids``
    holds little-endian unsigned 32-bit values, ``bucket`` the exponent of the
    length, and ``offset`` is always 0.  Every document ends with ``end_id``, so
    null and empty texts make one piece of length 1; null ids and repeated rows
    are packed like others, each with its own ``sequence_id``.  An empty table
    gives no pieces; other columns are not read.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    kind = docs.schema[row_id].dataType
    schema = T.StructType([T.StructField(row_id, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    run = per_batches(_pack_batches, path=tokenizer, ranks=ranks, longest=longest, end_id=end_id, schema=to_arrow_schema(schema))
    pieces = docs.select(F.col(row_id), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
    return pieces.select(
        "*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
