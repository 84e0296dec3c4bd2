"""Token counts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pattern that splits text before the merges of the byte-level rank files; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs of white space longer than this are not given to the splitting pattern, which backtracks over them; same result.
LONGEST_BLANK = 50_000
#: White space as the pattern has it.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary files are."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file; made once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_text(enc, text: str | None, longest: int = LONGEST_BLANK) -> int:
    """Tokens of a whole text; none for null and empty ones.

    The pattern makes one piece of a run of white space, without its last character where a word follows. So texts may be
    cut at either end of that piece, and a run longer than ``longest`` is merged as the piece that it is, whole.
    """
    if not text:
        return 0
    if len(text) <= longest or not (runs := list(re.finditer(f"{_BLANK}{{{longest + 1},}}", text))):
        return len(enc.encode_ordinary(text))
    total = at = 0
    for run in runs:
        end = run.end() - (run.end() < len(text))
        piece = text[run.start() : end]
        total += len(enc.encode_ordinary(text[at : run.start()])) + (len(enc._encode_single_piece(piece)) if piece else 0)
        at = end
    return total + len(enc.encode_ordinary(text[at:]))


def with_token_counts(df: DataFrame, text_col: str, tokens_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the text column replaced by its number of tokens (BIGINT, 0 for null and empty texts).

    Texts go to the Python workers once, in Arrow batches bounded in bytes, and do not come back.
    """
    path = path or vocabulary_path()
    others = [c for c in df.columns if c != text_col]
    source = df.select(text_col, *others)
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(tokens_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            counts = pa.array([count_text(enc, t.as_py()) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], names=[*others, tokens_col])

    return source.mapInArrow(run, schema)
