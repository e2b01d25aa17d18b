"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of
n: as many pieces of the longest length as fit, then one piece for each lower bit
that is set, in falling order.  Every piece is a sequence of its own, and pieces
of one length form a bucket from which whole batches are drawn: no sequence holds
two documents, and none is padded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from assetry.llm.common import map_batches
from assetry.llm.tokens import tokenizer_path, word_encoder

LONGEST = 2048
END_OF_DOCUMENT = 1
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
_TASK_SHIFT = 40  # sequences of one task: 2^40


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens, longest (a power of two) first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_OF_DOCUMENT,
    longest: int = LONGEST,
    whole_texts: bool = False,
) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): its document's id, where it
    starts in the document, its length (the bucket), its ids (unsigned 32-bit,
    little-endian), the document's tokens with the end id, and its sequence.

    A null or empty text is one piece, the end id.  Rows are packed each for
    itself, also those with equal or null ids.  `sequence_id` is unique in the
    result; it numbers the sequences of a task, so no shuffle is needed.  Other
    columns are not read.  An empty table gives none.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        from pyspark import TaskContext

        encoder = word_encoder(path, whole_texts)
        made = TaskContext.get().partitionId() << _TASK_SHIFT

        def turn(batch):
            nonlocal made
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens")}
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(),
                encoder.encode_batch(batch.column("text").to_pylist()),
            ):
                ids += end
                n, at = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    out["doc_id"].append(doc_id)
                    out["start"].append(at)
                    out["length"].append(length)
                    out["ids"].append(ids[at * 4 : (at + length) * 4])
                    out["doc_tokens"].append(n)
                    at += length
            n = len(out["doc_id"])
            out["sequence_id"] = np.arange(made, made + n, dtype=np.int64)
            out["offset"] = np.zeros(n, dtype=np.int64)
            made += n
            return out

        return turn

    return map_batches(docs.select("doc_id", "text"), make, PIECES, encodes=True)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces in one folder per length; a reader that draws batches from
    one folder gets sequences of equal length."""
    pieces.write.partitionBy("length").parquet(path)
