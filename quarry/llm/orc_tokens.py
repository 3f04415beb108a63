"""Token ids as ORC files: integer run-length encoded stripes with row indexes
and Bloom filters on the document id.

Documents are range-partitioned by doc_id on their text, sorted inside each
partition and tokenised after the exchange, so ids are never shuffled: each
task writes its files, whose stripes readers take independently. A row-group
index (and a Bloom filter) on doc_id lets a lookup skip stripes by metadata.

Row: doc_id, n_tokens, ids array<int> (end id included), part (the file's
place in the doc_id order). Defined cases: a null text is the end id alone;
rows with a null doc_id come first; repeated doc_ids lie next to each other in
any order; an empty table writes no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.llm import jobs, tokens

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 10_000
BLOOM_FPP = 0.01


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) in the order of the input's partitions."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokens.public_path(tokenizer))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raws = [raw + end for raw in enc.encode_all(part.column(1).to_pylist())]
                sizes = np.array([len(r) // 4 for r in raws], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, pa.py_buffer(b"".join(raws))])
                yield pa.record_batch([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds), ids)],
                                      names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> None:
    """Write the documents' ids in ascending doc_id order."""
    spark = docs.sparkSession
    jobs.prepare(spark)
    ordered = (docs.select("doc_id", "text").repartitionByRange(jobs.partitions(spark), "doc_id")
               .sortWithinPartitions("doc_id"))
    (tokenised(ordered, tokenizer, end_id).withColumn("part", F.spark_partition_id())
     .write.option("orc.compress", "SNAPPY").option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP)).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; a filter on doc_id is pushed to the stripe metadata."""
    return spark.read.orc(path)


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of stored rows. ``start`` adds the
    sizes of the files before to the running sum inside the file; only one sum
    per file is ordered in one place."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4")).view(np.uint8))
            crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                                  names=["doc_id", "part", "n_tokens", "ids_crc32"])

    rows = jobs.table(stored.select("doc_id", "part", "ids").mapInArrow(
        crc, f"doc_id {kind}, part int, n_tokens long, ids_crc32 long"), "digests")
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("doc_id", "ids_crc32").rowsBetween(W.unboundedPreceding, -1))
    return (rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
