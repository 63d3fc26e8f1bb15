"""SentencePiece encoding and decoding of whole texts.

No piece of the model has the white-space marker after another character, so a
text falls into chunks that begin with one or more markers. Each task segments a
distinct chunk once (a ``ChunkTable``) and joins the ids back by position; the
library does the segmentation and the decoding.

Results for odd input: null and empty texts have the end id alone and decode to
an empty text; texts of any length are encoded whole; a null id and other
columns pass through; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.chunk_table import ChunkTable
from veilspark.llm.wordbytes import release
from veilspark.session import ship_package

TABLE_CHUNKS, TABLE_KEEP, TASK_KEEP = 250_000, 100_000, 50_000
"""Chunks in a worker's table (some 70 MB), how many stay when it is full, and how many (15 MB) outlive a task."""
_MARKER = "▁"
_WITH_SPACES = re.compile(" +[^ ]*")
BATCH_CHARS = 2 << 20
"""Text whose ids are in memory at once, unless one document is longer."""


@cache
def _model(path: str):
    """Processor, chunk table and end id, once per Python worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(_MARKER in p.lstrip(_MARKER) for p in pieces):
        raise ValueError("a piece of this model crosses a white-space marker")
    lone = sp.encode("a ")[len(sp.encode("a")):]  # a marker at the very end of a text

    def segment(keys: list[str]) -> list[list[int]]:
        return [ids if key else lone for key, ids in zip(keys, sp.encode(keys, num_threads=1), strict=True)]

    return sp, ChunkTable(segment, TABLE_CHUNKS, TABLE_KEEP), sp.eos_id()


def chunks(text: str) -> list[str]:
    """What to give the library, chunk by chunk; it adds the first marker of each itself."""
    if not text:
        return []
    if _MARKER in text:
        return [text]
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _WITH_SPACES.findall(" " + text)]
    return text.split(" ")


def _parts(batch: pa.RecordBatch, at: int):
    """Slices of a batch with about BATCH_CHARS of text each, and their texts."""
    texts = [t or "" for t in batch.column(at).to_pylist()]
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def encode(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text and the end id instead of the text column."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = docs.drop(text_col).selectExpr("*", f"cast(null as array<int>) as {out}").schema

    def run(batches):
        _, table, end = _model(model)
        try:
            for batch in batches:
                for part, texts in _parts(batch, at):
                    flat, counts = table.ids([chunks(t) for t in texts])
                    stops = np.cumsum(counts)
                    ids = np.insert(flat, stops, end)  # one end id after each text
                    offsets = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]).astype(np.int32)
                    arrays = [part.column(i) for i in range(part.num_columns) if i != at]
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        finally:
            table.shrink(TASK_KEEP)
            release()

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with a further column: the library's decode() of the ids (null ids: empty)."""
    ship_package(rows.sparkSession)
    at = rows.columns.index(ids_col)
    schema = rows.selectExpr("*", f"cast(null as string) as {out}").schema

    def run(batches):
        sp, _, _ = _model(model)
        try:
            for batch in batches:
                for begin in range(0, len(batch), 500):
                    part = batch.slice(begin, 500)
                    texts = pa.array([sp.decode(ids or []) for ids in part.column(at).to_pylist()], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)
        finally:
            release()

    return rows.mapInArrow(run, schema)
