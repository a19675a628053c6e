"""The piece model learns from corpus counts, whatever the partitions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from relish.llm import lm

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "tree", "treetops", "stones", "st", f"x{rng.randrange(50)}"]) for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, eight = ({r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n), PIECES).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and np.allclose([one[i] for i in sorted(one)], [eight[i] for i in sorted(one)], rtol=1e-9)


def test_frequent_words_weigh_more(spark):
    pieces = [b" ", b"a", b"b", b"q", b"z"]
    words = spark.createDataFrame(lm._words_of_block([pa.scalar(0)], pa.table({"text": ["aqaq " * 1000, "bzbz"], "held_out": [False, False]})).to_pandas(), lm.WORDS)
    p = np.exp(lm.fit_pieces(words, pieces, np.log(np.full(5, 0.2)), 1))
    assert p[1] == pytest.approx(1000 * p[2], rel=0.01)
