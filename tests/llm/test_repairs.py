"""Cases that once crashed or gave wrong rows."""

import duckdb
import numpy as np
import public_tokenizers
import pytest

from relish.llm import nearest, packing, preferences
from relish.llm.queries import op3


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n " * 600_000, "a b" + "\t" * 1_200_000 + "c", "-" * 300_000, "x" * 300_000])
def test_long_runs_are_packed(text):
    path, ranks = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    tool = packing.Encoder(path, ranks)
    assert tool.encode([text]) == tool.whole([text])


def test_ranks_give_the_ids_of_the_tokenizer_on_all_documents(spark):
    path, ranks = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tool = packing.Encoder(path, ranks)
    assert tool.encode(texts) == tool.whole(texts)


@pytest.mark.parametrize("large", [1e120, 1e160, 1e308])
def test_large_vectors(spark, large):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 8))
    vectors[7] *= large / np.abs(vectors[7]).max()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest.search(df, lambda i: i % 20 == 0, k=5).collect()}
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (0, 20, 40):
            scores = np.nan_to_num((vectors * vectors[q]).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            order = [i for i in np.lexsort((np.arange(60), -scores)) if i != q][:5]
            assert [got[q, r] for r in range(1, 6)] == order


def test_null_replies_and_ids_as_in_sql(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 1, "assistant", ""), (2, 2, None, "b"), (2, 3, "assistant", None),
            (None, 0, "user", "lost"), (None, 1, "assistant", "too"), (3, None, None, None), (4, 0, "assistant", "x"), (4, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.sql(preferences.SQL).fetchall()
    got = [tuple(r) for r in op3(lambda name: df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 4
