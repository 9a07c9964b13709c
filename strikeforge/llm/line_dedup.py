"""Lines that many documents share, kept in one of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.llm.shared import column, fresh, id_key, pieces, text_bytes
from strikeforge.sources.tables import Stage

KEYS = "key long, high long, low long"
MADE = ("n_lines", "n_dropped")


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """128 bits for a line's normal form; None for a line too short to judge.

    The normal form has ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased.
    """
    form = line.strip().lower()
    if len(form) < min_chars or not form.isascii() and len(form.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(form)


def _line_keys(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, counts, found = column(batch, "key"), [], []
            for data in column(batch, "data"):
                own = {line_digest(line, min_chars) for line in data.split(b"\n")} - {None}
                counts.append(len(own))
                found.extend(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            key = np.repeat(np.array(ids, "i8"), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["key", "high", "low"],
            )

    return run


def _clean(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            total, dropped, kept = [], [], []
            for data, drop in zip(column(batch, "data"), column(batch, "drop")):
                lines = (data or b"").split(b"\n")
                total.append(len(lines))
                gone = {np.array([d["high"], d["low"]], "<i8").tobytes() for d in drop or ()}
                left = [x for x in lines if line_digest(x, min_chars) not in gone] if gone else lines
                dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left) if data is not None else None)
            made = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            own = batch.column(batch.schema.get_field_index("own"))
            yield pa.RecordBatch.from_arrays(
                [own, *made, pa.array(kept, pa.binary())], ["own", *MADE, "kept"]
            )

    return run


def shared_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20,
    min_docs: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Line keys per document, and the keys that ``min_docs`` documents hold with their keeper.

    Distinct documents are counted in two steps, both combined before their shuffle, so a
    line that a third of all documents hold is one row per task.
    """
    rows = docs.select(id_key(doc_id).alias("key"), text_bytes(text).alias("data"))
    keys = rows.mapInArrow(_line_keys(min_chars), KEYS)
    stage = Stage(docs.sparkSession)
    stage.write("line-keys", keys)
    keys = stage.read("line-keys")
    held = keys.groupBy("high", "low").agg(
        F.count_distinct("key").alias("n_docs"), F.max("key").alias("keeper")
    )
    # Written, so that the join of both deals a line that very many hold to several tasks.
    stage.write("held", held.filter(F.col("n_docs") >= min_docs))
    return keys, stage.read("held")


def dedup_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Every input row with its kept lines as text, and ``n_lines`` and ``n_dropped``.

    Texts are split at line feeds. A line whose normal form has ``min_chars`` code points or
    more and stands in ``min_docs`` documents or more is dropped everywhere but in the largest
    ``doc_id`` that holds it; there all its copies stay. Other lines stay, in their order.

    A NULL or empty text is one empty line and stays as it is. Rows with one ``doc_id`` are one
    document for the counts; rows without a ``doc_id`` count together as one that sorts below
    all others. Repeated rows are all returned. All other columns are passed on, but for
    columns named like the two made here; an empty table gives an empty result.
    """
    keys, held = shared_lines(docs, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs)
    drop = (
        keys.join(held, ["high", "low"])
        .filter("key != keeper")
        .groupBy("key")
        .agg(F.collect_set(F.struct("high", "low")).alias("drop"))
    )
    names = [c for c in docs.columns if c not in MADE]
    own = F.struct(*(docs[c] for c in names if c != text), F.lit(0).alias(fresh("_", docs)))
    packed = docs.select(
        own.alias("own"), id_key(doc_id).alias("key"), docs[text].cast("binary").alias("data")
    )
    rows = packed.join(drop, "key", "left").select("own", "data", "drop")
    kind = packed.schema["own"].dataType.simpleString()
    cleaned = rows.mapInArrow(
        _clean(min_chars), f"own {kind}, n_lines long, n_dropped long, kept binary"
    )
    kept = {text: F.col("kept").cast("string").alias(text)}
    return cleaned.select(*(kept.get(c, F.col(f"own.`{c}`")) for c in names), *MADE)


def digest_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of ``dedup_lines``."""
    kept = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", *MADE, F.sha2(kept, 256).alias("kept_sha256")
    )


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """The documents with only their kept lines; ``n_chars`` follows, if there is one."""
    cleaned = dedup_lines(docs)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)
