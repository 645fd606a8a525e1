"""Text chunking for retrieval.

``chunk_recursive``: recursive character splitting (paragraph -> line ->
word -> character) with size and overlap measured in characters, the
public algorithm used by common RAG tool kits; runs per document inside
``mapInArrow`` (documents are independent, Spark spreads them over tasks).

``chunk_fixed``: a JVM-only variant with fixed windows of ``size``
characters every ``size - overlap`` characters.
"""
from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import ship_package

# Chunk size, overlap and separator order.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
SEPARATORS = ("\n\n", "\n", " ", "")

# Documents taken out of an Arrow batch together, and characters of chunks sent together; a chunk's other columns count as so many.
DOCS_AT_ONCE, BATCH_CHARS, ROW_CHARS = 16, 1 << 20, 100

CHUNK_SCHEMA = "doc_id long, source string, file_type string, supplier_name string, " \
               "chunk_index int, start long, text string"


def _pieces(text: str, sep: str) -> Iterator[str]:
    """Split on ``sep`` keeping each separator at the start of the piece that
    follows it; empty pieces are dropped."""
    if sep == "":
        yield from text
        return
    start, cut = 0, text.find(sep)
    while cut >= 0:
        if cut > start:
            yield text[start:cut]
        start, cut = cut, text.find(sep, cut + len(sep))
    if start < len(text):
        yield text[start:]


def _clean(window: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    """The stripped text of consecutive pieces with its place, if anything is left."""
    if window:
        s = "".join(x for _, x in window)
        left = s.lstrip()
        if left:
            yield window[0][0] + len(s) - len(left), left.rstrip()


def iter_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators=SEPARATORS, at: int = 0) -> Iterator[tuple[int, str]]:
    """Chunks with their place in the whole text (``at`` is the place of
    ``text``), one by one: besides the text only one chunk's pieces are held.

    Consecutive pieces are greedily joined into chunks of at most ``size``
    characters; each new chunk starts with the trailing pieces of the previous
    one that fit in ``overlap`` characters. A longer piece ends the chunk and
    is split by the finer separators."""
    seps = list(separators)
    # the first separator present in the text (the empty one always is)
    level = next(i for i, s in enumerate(seps) if s == "" or s in text)
    sep, finer = seps[level], seps[level + 1:]
    window: list[tuple[int, str]] = []
    width = 0
    for piece in _pieces(text, sep):
        n = len(piece)
        if n < size:
            if width + n > size and window:
                yield from _clean(window)
                while window and (width > overlap or width + n > size):
                    width -= len(window.pop(0)[1])
            window.append((at, piece))
            width += n
        else:
            yield from _clean(window)
            window, width = [], 0
            if finer:
                yield from iter_spans(piece, size, overlap, finer, at)
            else:
                yield at, piece
        at += n
    yield from _clean(window)


def recursive_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=SEPARATORS, at: int = 0) -> list[tuple[int, str]]:
    """``iter_spans`` as a list."""
    return list(iter_spans(text, size, overlap, separators, at))


def recursive_split(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators=SEPARATORS) -> list[str]:
    return [c for _, c in recursive_spans(text, size, overlap, separators)]


def _chunk_batches(size: int, overlap: int):
    """mapInArrow body: documents are taken a few at a time out of the Arrow
    batch, and chunks leave in batches of about ``BATCH_CHARS`` characters, so
    a task holds the batch as Spark sends it (bounded by its settings), a
    document and a bounded number of chunks, however many documents it has."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    names = ["doc_id", "source", "file_type", "supplier_name", "chunk_index", "start", "text"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for first in range(0, b.num_rows, DOCS_AT_ONCE):
                for d in b.slice(first, DOCS_AT_ONCE).to_pylist():
                    if d["raw_text"] is None or not d["raw_text"].strip():
                        continue
                    for i, (at, c) in enumerate(iter_spans(d["raw_text"], size, overlap)):
                        rows.append((d["doc_id"], d["source"], d["file_type"], d["supplier_name"], i, at + 1, c))
                        held += len(c) + ROW_CHARS
                        if held >= BATCH_CHARS:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)
    return run


def _meta(docs: DataFrame) -> DataFrame:
    def opt(c, default):
        return F.coalesce(F.col(c), F.lit(default)) if c in docs.columns else F.lit(default)
    sup = F.col("supplier_name") if "supplier_name" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "raw_text",
                       opt("source", "unknown").alias("source"),
                       opt("file_type", "unknown").alias("file_type"),
                       sup.cast("string").alias("supplier_name"))


def chunk_recursive(docs: DataFrame, size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``docs(doc_id, raw_text[, source, file_type, supplier_name])`` ->
    ``chunks`` (``start`` counts characters from 1); blank texts are skipped."""
    ship_package(docs.sparkSession)
    return _meta(docs).mapInArrow(_chunk_batches(size, overlap), CHUNK_SCHEMA)


def chunk_fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows (JVM only): start positions 1, 1+step, ... below the
    text length, window ``size`` characters; blank texts skipped."""
    step = size - overlap
    d = _meta(docs).filter(strip("raw_text") != "")
    starts = F.sequence(F.lit(1), F.greatest(F.length("raw_text"), F.lit(1)), F.lit(step))
    return (d.select("doc_id", "source", "file_type", "supplier_name", "raw_text",
                     F.posexplode(starts).alias("chunk_index", "start"))
             .select("doc_id", "source", "file_type", "supplier_name", "chunk_index", "start",
                     F.substring("raw_text", F.col("start"), F.lit(size)).alias("text")))
