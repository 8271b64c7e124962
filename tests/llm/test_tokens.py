import os

import pytest

from quern.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


def test_counts(spark):
    enc = T.encoder(T.VOCABULARY)
    texts = ["", None, "hello world", "don't  stop\n\n\tx = 5", "<|endoftext|>", "ß日本🙂", "a" * 100_000, " " * 1_000_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    got = {r.doc_id: r.n_tokens for r in T.with_sizes(df, "text", ["doc_id", "extra"]).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2
    for i in (2, 3, 4, 5, 6):
        assert got[i] == len(enc.encode_ordinary(texts[i])) and enc.decode(enc.encode_ordinary(texts[i])) == texts[i]
    assert got[7] > 0
    assert T.with_sizes(df.limit(0), "text", ["doc_id"]).count() == 0
