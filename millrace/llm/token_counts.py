"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and long texts are split at safe boundaries: a
space between two characters that are not white space opens a new piece, so
that the counts of the parts add up to the count of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices

_SPACE = re.compile(r"(?<=\S) (?=[^\W_])")
_models: dict[str, tuple] = {}


def _model(path: str) -> tuple:
    """The worker's counter of a list of texts, and whether texts may be split."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            inner = any("▁" in piece.id_to_piece(i).lstrip("▁") for i in range(piece.vocab_size()))
            # a part that begins a word must give the same with and without what stands before it
            split = not inner and piece.encode("a b", out_type=str) == piece.encode("a", out_type=str) + piece.encode("b", out_type=str)
            _models[path] = (lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)], split)
        else:
            from millrace.llm.bpe import encoder

            coder = encoder(path)
            _models[path] = (lambda texts: [len(x) for x in coder.encode_many(texts)], False)
    return _models[path]


def split_text(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters, cut at spaces that open a word.

    The space itself is left out: the model sets one before each part. A text
    without such a space stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most:
        cut = _SPACE.search(text, start + most)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def count_tokens(
    df: DataFrame,
    model_path: str,
    id: str = "doc_id",
    text: str | Column = "text",
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    part_chars: int = 1 << 14,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    No shuffle; memory is bounded by ``batch_bytes`` and the longest text.
    A null text counts as empty, and an empty text has no tokens. Repeated rows
    and null ids come back as they are; other columns are not read, so their
    names cannot clash. An empty table gives an empty result.
    """
    body = F.col(text) if isinstance(text, str) else text
    rows = df.select(F.col(id).alias("doc_id"), F.coalesce(body, F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, split = _model(model_path)
        for batch in batches:
            for part in byte_slices(batch, "text", batch_bytes):
                texts = part.column("text").to_pylist()
                pieces = [split_text(t, part_chars) if split else [t] for t in texts]
                found = iter(counter([p for ps in pieces for p in ps]))
                tokens = [sum(next(found) for _ in ps) for ps in pieces]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.cast(pc.binary_length(part.column("text")), pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
