"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE vocabulary as ranks; the file stays where it is and is read by each worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for NULL and empty text.  Special-token strings count as ordinary text."""
    if not text:
        return 0
    enc = encoder(path)
    try:
        return len(enc.encode_ordinary(text))
    except BaseException as e:  # the native splitter gives up on extreme runs (megabytes of blanks): split here instead
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        import regex

        return sum(len(enc.encode_ordinary(p)) if len(p) < 10_000 else sum(len(enc.encode_ordinary(p[i : i + 10_000])) for i in range(0, len(p), 10_000)) for p in regex.findall(PATTERN, text))


def with_sizes(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``; one map-only Arrow pass over whole texts, NULL and empty texts have 0."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    count: Callable = count_tokens

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count(t, path) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_tokens long"
    return kept.mapInArrow(size, schema)
