"""Token counts: whole-token chunks count one, only the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import ship
from gaugelake.llm.pretokens import PieceCounter, kept


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for each row: UTF-8 bytes and tokens of the whole text by a sentencepiece model.

    Without begin, end or added special tokens. A null or empty text has 0 of both. Rows are counted one by one: repeated
    rows, null ids and texts of any length come back as they are; an empty table gives an empty result; other columns are not read.
    ``model_path`` names a file that every executor has.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = kept(PieceCounter, model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts = pa.array(counter.counts(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), counts], ["id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
