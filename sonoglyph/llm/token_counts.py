"""Operator 7, token counts: a separator scan of flat, unindexed token files.

A token file is nothing but 16-bit ids, high byte first; a document is its doc_id in ID_TOKENS ids of 14 bits each, its
tokens and an end-of-document id, which no other token equals. Blocks of a file are searched for that id with vector
operations, each on its own; a prefix scan over the blocks' summaries (where the last end was, and whose document began
there) gives the counts of documents that reach over blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoglyph.llm import text as T
from sonoglyph.llm.store import new_path, table
from sonoglyph.llm.tokens import vocabulary, word_encoder

VOCABULARY = "word_bpe_49k.json"
#: Above every id of the vocabulary; its two bytes are one character of UTF-8, so a text writer can end a record with them.
END_ID = 0xC280
#: Ids that hold a document's doc_id, of 14 bits each, from FIRST_ID on.
ID_TOKENS, ID_BITS, FIRST_ID = 5, 14, 0x4000
#: Tokens of a block, and documents of a file at most.
BLOCK = 1 << 18
FILE_DOCS = 100_000


def _records(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        if encoder.tokenizer.get_vocab_size() > END_ID:
            raise ValueError(f"the vocabulary has ids from {END_ID} on")
        shifts = np.arange(ID_TOKENS - 1, -1, -1, dtype=np.uint64) * ID_BITS
        for batch in batches:
            for s in T.slices(batch.column("text")):
                ids, bounds = encoder.encode(s)
                doc = np.array(batch.column("doc_id").slice(s.first, s.n_docs), np.int64).view(np.uint64)
                heads = ((doc[:, None] >> shifts) & np.uint64((1 << ID_BITS) - 1)).astype(">u2") + FIRST_ID
                flat = ids.astype(">u2")
                yield pa.RecordBatch.from_arrays([pa.array([heads[i].astype(">u2").tobytes() + flat[bounds[i] : bounds[i + 1]].tobytes() for i in range(s.n_docs)], pa.binary())], ["tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, *, vocabulary_path: str | None = None) -> None:
    """Writes ``docs`` (doc_id, text) as flat token files of up to FILE_DOCS documents through Spark's own file committer.

    A null text has no token. Null doc_ids are left out: the format has no place for them.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_records(vocabulary_path or vocabulary(VOCABULARY)), "tokens binary")
    rows.select(F.col("tokens").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_DOCS).option("lineSep", bytes([END_ID >> 8, END_ID & 255]).decode("utf-8")).text(path)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summary of each block: its first and last end, the document that the last end is followed by, and the counts of
    the documents that begin and end in it. ``tokens`` goes ID_TOKENS ids beyond the block."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("first_end", "last_end", "next_id", "doc_ids", "counts")}
        for at, size, tokens in zip(batch.column("at").to_pylist(), batch.column("size").to_pylist(), batch.column("tokens"), strict=True):
            ids = np.frombuffer(tokens.as_buffer(), ">u2")
            ends = np.flatnonzero(ids[:size] == END_ID)
            # what follows each end, and at the file's start what is there
            begins = np.concatenate([[0], ends + 1]) if at == 0 else ends + 1
            begins = begins[begins + ID_TOKENS <= len(ids)]
            shifts = np.arange(ID_TOKENS - 1, -1, -1, dtype=np.uint64) * ID_BITS
            heads = ids[begins[:, None] + np.arange(ID_TOKENS)].astype(np.uint64) - np.uint64(FIRST_ID) if len(begins) else np.zeros((0, ID_TOKENS), np.uint64)
            docs = (heads << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)
            closed = ends[0 if at == 0 else 1 :]
            inner = begins[: len(closed)]
            rows["first_end"].append(at + int(ends[0]) if len(ends) else None)
            rows["last_end"].append(at + int(ends[-1]) if len(ends) else (-1 if at == 0 else None))
            rows["next_id"].append(int(docs[-1]) if len(docs) > len(closed) else None)
            rows["doc_ids"].append(docs[: len(closed)])
            rows["counts"].append(closed - inner - ID_TOKENS)
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), *(pa.array(rows[k], kind) for k, kind in zip(rows, kinds, strict=True))], ["path", "at", *rows])


def scan_token_files(spark: SparkSession, path: str, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every document of the token files in ``path``, each once for each time it is there.

    Files may be up to 2 GB; what follows a file's last end-of-document id is no document. No files or empty ones, no rows.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content", F.expr("length div 2").alias("n"))
    at = files.select("path", "content", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("at"))
    size = F.least(F.lit(block).cast("long"), F.col("n") - F.col("at"))
    blocks = at.select("path", "at", size.alias("size"), F.expr(f"substring(content, cast(2 * at + 1 as int), cast(2 * ({block} + {ID_TOKENS}) as int))").alias("tokens"))
    found = blocks.mapInArrow(_scan, "path string, at long, first_end long, last_end long, next_id long, doc_ids array<long>, counts array<long>")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("*", F.last("last_end", True).over(before).alias("open_end"), F.last("next_id", True).over(before).alias("open_id"))
    # a document that an earlier block began ends at the first end of this one
    stitched = F.when(F.col("first_end").isNotNull() & F.col("open_end").isNotNull(), F.array(F.struct(F.col("open_id").alias("doc_id"), (F.col("first_end") - F.col("open_end") - 1 - ID_TOKENS).alias("n_tokens"))))
    own = F.zip_with("doc_ids", "counts", lambda d, c: F.struct(d.alias("doc_id"), c.alias("n_tokens")))
    return scanned.select(F.explode(F.concat(F.coalesce(stitched, F.expr("array()").cast("array<struct<doc_id:long,n_tokens:long>>")), own)).alias("d")).select("d.doc_id", "d.n_tokens")


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return scan_token_files(spark, path)


QUERIES = {"op7_separator_scan": op7_separator_scan}
ORACLE_SQL: dict[str, str] = {}
