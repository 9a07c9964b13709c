"""What the operators share: text rules, Arrow batches in small pieces, row keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handled at once inside a task; a piece of long texts stays small in memory.
PIECE_ROWS = 128
#: Stands in joins for a missing doc_id; it sorts below every other.
NO_ID = -(2**63)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, or one like it that no column of the tables has or starts with."""
    taken = [c.lower() for t in tables for c in t.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def id_key(doc_id: str = "doc_id") -> Column:
    """doc_id as a join key that is never NULL."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def id_of(key: str) -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key))


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none for NULL."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def lower_ascii(value: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key, data``: what Python sees of a document."""
    return docs.select(id_key(doc_id).alias("key"), text_bytes(text).alias("data"))
