"""Token counts: the tokenizer's own batch encoding inside Arrow functions, lengths only.

Texts are encoded in batches of about BATCH_BYTES whatever their number, and a text longer than that is split where no
token can span: for byte-level BPE between a character that is not white space and white space after it, or between a
letter and a digit. A text without such a place is encoded whole.

Defined results: null is the empty text, with no bytes and no tokens; null ids, repeated rows and ties are counted like
any row; an empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, text_of

BATCH_BYTES = 1 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: A token of byte-level BPE never spans these: white space begins a token or is one, and letters and digits do not mix.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """The function that counts the tokens of texts; loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def splits(text: str, most: int) -> list[str]:
    """The text in pieces of about `most` characters, cut at safe places only; their counts add up to the text's."""
    out, start = [], 0
    while len(text) - start > most and (at := SAFE.search(text, start + most)):
        out.append(text[start : at.start()])
        start = at.start()
    return [*out, text[start:]]


def _counts(texts: list[str | None], count: Callable[[list[str]], list[int]], split: bool, batch_bytes: int) -> Iterator[int]:
    """The token counts of the texts; whatever their lengths, a call of `count` sees about batch_bytes."""
    totals = [0] * len(texts)
    batch: list[tuple[int, str]] = []
    held = 0

    def flush() -> None:
        for (i, _), n in zip(batch, count([piece for _, piece in batch]), strict=True):
            totals[i] += n

    for i, text in enumerate(texts):
        for piece in splits(text, batch_bytes // 4) if split and len(text) > batch_bytes // 4 else (text,):
            batch.append((i, piece))
            held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= batch_bytes:
                flush()
                batch, held = [], 0
    if batch:
        flush()
    return iter(totals)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text", split: bool | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    tokenizer: the path of a tokenizers .json or a sentencepiece .model file that all executors can read. split: whether
    long texts may be split by the rule above, which holds for byte-level BPE; by default for .json files with a
    ByteLevel pre-tokenizer.
    """
    if split is None:
        split = tokenizer.endswith(".json") and _is_byte_level(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            n = list(_counts(batch.column(1).to_pylist(), count, split, batch_bytes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    body = text_of(docs, text)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes")).mapInArrow(run, SCHEMA)


def _is_byte_level(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        kind = json.load(f).get("pre_tokenizer") or {}
    return kind.get("type") == "ByteLevel" and kind.get("use_regex", True)
