"""Token counts by a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Ranks of a byte-level vocabulary; a parameter wherever it is used.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(ranks: bytes):
    """The tokenizer, made once in a worker.

    It is kept with the library: this module may reach a worker by value, anew for each task.
    """
    import tiktoken

    made = vars(tiktoken).setdefault("_by_ranks", {})
    key = hash(ranks)
    if key not in made:
        pairs = (line.split() for line in ranks.splitlines() if line)
        made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return made[key]


def with_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of a text in place of the text; a null text has none.

    The vocabulary is read on the driver, under 1 MB, and goes along with the
    task, so executors need no file. Whole texts are counted.
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], n], names=[*keep, name])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.LongType())]))
