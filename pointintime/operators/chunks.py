"""Citable chunks: table rows as sentences, prose as overlapping windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import looks_like_header, row_sentence, strip
from ..sources.store import Store
from ..vocabulary import CHUNK_DOCUMENTS_PER_RUN, OVERLAP_CHARS, TABULAR_KINDS, WINDOW_CHARS

#: Bytes of texts that are cut at one time.
PIECE_BYTES = 1 << 19


def table_chunks(documents: DataFrame) -> DataFrame:
    """document_id, ordinal, text, section_path of each table row that isn't blank.

    ``documents``: document_id, doc_type, tables (array of struct(index, rows)). Row numbers count the rows below the
    header, blank ones included; ordinals run through all tables of a document.
    """
    t = documents.select("document_id", "doc_type", F.posexplode("tables").alias("place", "t")).where(F.size("t.rows") > 0)
    first = F.col("t.rows")[0]
    header = F.when(looks_like_header(first), first)
    body = F.when(header.isNotNull(), F.slice("t.rows", 2, F.greatest(F.size("t.rows") - 1, F.lit(1)))).otherwise(F.col("t.rows"))
    body = F.when(header.isNotNull() & (F.size("t.rows") == 1), F.array().cast("array<array<string>>")).otherwise(body)
    t = t.withColumn("header", header).withColumn("body", body)
    rows = t.select("document_id", "doc_type", "place", F.col("t.index").alias("index"), "header", F.posexplode("body").alias("row_no", "row"))
    rows = rows.withColumn("text", row_sentence(F.col("header"), F.col("row"))).where(strip(F.col("text")) != "")
    order = Window.partitionBy("document_id").orderBy("place", "row_no")
    path = F.concat(F.col("doc_type"), F.lit(" > table "), F.coalesce("index", F.lit(0)).cast("string"), F.lit(" > row "), F.col("row_no").cast("string"))
    return rows.select("document_id", (F.row_number().over(order) - 1).alias("ordinal"), "text", path.alias("section_path"))


_WINDOW = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("chunk", T.StringType())]))
#: What ends of windows are stripped of: all Unicode white space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _windows(text: str | None) -> list[tuple[int, int, str]]:
    """Begin, end and stripped text of each window: it ends behind the last empty line, line or sentence of its second half."""
    out, at, n = [], 0, len(text or "")
    while at < n:
        end = limit = min(at + WINDOW_CHARS, n)
        if limit < n:
            for sep in ("\n\n", "\n", ". "):
                found = text.rfind(sep, at + WINDOW_CHARS // 2, limit)
                if found >= 0:
                    end = found + len(sep)
                    break
        out.append((at, end, text[at:end].strip(_BLANKS)))
        if end >= n:
            break
        at = max(end - OVERLAP_CHARS, at + 1)
    return out


@F.pandas_udf(_WINDOW)
def windows(text: pd.Series) -> pd.Series:
    """Array of struct(s, e, chunk) of each text, in one pass over it."""
    return text.map(_windows, na_action=None)


def window_spans(text: Column) -> Column:
    """Array of struct(s, e): the windows of a text, as offsets."""
    return F.transform(windows(text), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e")))


def prose_chunks(documents: DataFrame) -> DataFrame:
    """document_id, ordinal, text, section_path, span_start, span_end; ``documents``: document_id, doc_type, text.

    A document is one row, so windows are numbered where they are made: no shuffle. A task holds the windows of a few texts at a time."""
    kept = [documents.schema[c] for c in ("document_id", "doc_type")]
    fields = T.StructType([*kept, T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("span_start", "span_end"))])

    def cut(batches):
        for batch in batches:
            texts, at = batch.column(2), 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes.astype(np.int64)) // PIECE_BYTES
            for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
                out = [(row, ordinal, *w) for row, text in enumerate(texts.slice(at, end - at).to_pylist(), at) for ordinal, w in enumerate(w for w in _windows(text) if w[2])]
                if out:
                    row, ordinal, start, stop, chunk = zip(*out, strict=True)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(ordinal, pa.int32()), pa.array(chunk, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=fields.names)
                at = end

    made = documents.select("document_id", "doc_type", "text").mapInArrow(cut, fields)
    path = F.concat(F.col("doc_type"), F.lit(" > text > chars "), F.col("span_start").cast("string"), F.lit("-"), F.col("span_end").cast("string"))
    return made.select("document_id", "ordinal", "text", path.alias("section_path"), "span_start", "span_end")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Tables where the kind has them and they give a row, prose windows else."""
    tabular = table_chunks(documents.where(F.col("doc_type").isin(*TABULAR_KINDS)))
    rest = documents.join(tabular.select("document_id").distinct(), "document_id", "left_anti")
    return prose_chunks(rest).unionByName(tabular, allowMissingColumns=True)


def rechunk(chunks: DataFrame, records: DataFrame, documents: DataFrame, doc_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with those of the selected documents made anew, and records without the ones that hung on them."""
    chosen = documents if doc_type is None else documents.where(F.col("doc_type") == doc_type)
    ids = chosen.select("document_id")
    kept = chunks.join(ids, "document_id", "left_anti")
    return kept.unionByName(chunk_documents(chosen), allowMissingColumns=True), records.join(ids, "document_id", "left_anti")


def chunk_batch(documents: DataFrame, chunks: DataFrame, limit: int = CHUNK_DOCUMENTS_PER_RUN) -> DataFrame:
    """The next documents to cut: those without a chunk, by id, so many in a run."""
    return documents.join(chunks.select("document_id"), "document_id", "left_anti").orderBy("document_id").limit(limit)


def replace_chunks(store: Store, documents: DataFrame, doc_type: str | None = None) -> int:
    """Makes the chunks of the selected documents anew in a store: the buckets of its tables ``chunks`` and ``records`` that these
    documents stand in are written without their old chunks and the records that hung on them, with the new chunks, and both tables
    change in one commit. A reader sees the old chunks with their records or the new ones, never a mixture."""
    chosen = documents if doc_type is None else documents.where(F.col("doc_type") == doc_type)
    touched = store.touched(chosen, ["document_id"])
    number = store.number()
    if not touched:
        return number
    old, records = store.read("chunks", touched, number), store.read("records", touched, number)
    new = chunk_documents(chosen)
    if old is not None:
        new = old.join(chosen.select("document_id"), "document_id", "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)
    changes = {"chunks": ("replace", new, ["document_id"], touched)}
    if records is not None:
        changes["records"] = ("replace", records.join(chosen.select("document_id"), "document_id", "left_anti").select(*records.columns), ["document_id"], touched)
    return store.commit(changes)
