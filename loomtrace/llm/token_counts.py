"""Token counts of whole documents, whatever their length.

Short texts are encoded in batches, each chunk between proven boundaries once (see tokens.py). A text longer than `chunk` is encoded in overlapping chunks with offsets; two chunks
are spliced at a boundary that both have inside their overlap and that is proven (see tokens.py), and where none is found
the overlap is widened, at worst to the whole rest. So counts equal those of the text encoded at once.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated rows; an empty table gives none; a null
doc_id stays null. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow, small_batches
from .tokens import Resync, encoder, in_blocks


def count_tokens(
    docs: DataFrame, limit: int = 512, path: str | None = None, chunk: int = 65_536, overlap: int = 1_024
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chunks of every document. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, long_texts = encoder(path).encode, Resync(path, chunk, overlap)
        for batch in small_batches(batches, 1, 4_000_000):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            short = [k for k, x in enumerate(texts) if len(x) <= chunk + overlap]
            for a, b in in_blocks([texts[k] for k in short], 2_000_000):
                part = short[a:b]
                for k, ids in zip(part, encode([texts[k] for k in part]), strict=True):
                    counts[k] = len(ids) // 4
            for k in set(range(len(texts))).difference(short):
                counts[k] = long_texts.count(texts[k])
            chunks = [1 if len(x) <= chunk + overlap else -(-len(x) // chunk) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(chunks, pa.int32())],
                names=["doc_id", "n_bytes", "n_tokens", "n_chunks"],
            )

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = small_arrow(docs).select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = rows.mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long, n_chunks int")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
