"""Token counts of whole texts, remembered by content and tokenizer version.

A cache is a Parquet folder of (content digest, tokens), partitioned by the digest of the
tokenizer's file and library. Documents shrink to (id, bytes, digest); the distinct
digests that the cache lacks are the misses, and only their texts are moved and encoded,
each once. The counts are appended to the cache and joined back from it, so a run that
loses executors or ends early costs the next one what it had not appended.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlake.llm.common import batches
from seasonlake.llm.copies import spread_join
from seasonlake.session import ensure_checkpoint_dir, pinned

BATCH_BYTES = 4 << 20
BROADCAST_MISSES = 100_000
CACHE = "digest binary, n_tokens long, version string"


def version_of(tokenizer: str) -> str:
    """Digest of all that decides a count: the file, its kind and the library's version."""
    kind = os.path.splitext(tokenizer)[1]
    library = sentencepiece.__version__ if kind == ".model" else tokenizers.__version__
    with open(tokenizer, "rb") as file:
        return hashlib.sha256(f"{kind} {library} ".encode() + file.read()).hexdigest()


def normalised(text: Column, tokenizer: str) -> Column:
    """Content that has one count: null is empty, and for a sentencepiece model, which
    reads a blank as U+2581, the two are one character."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    return F.replace(body, F.lit("▁"), F.lit(" ")) if tokenizer.endswith(".model") else body


def counter(kind: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of a batch of texts by the library that reads the file."""
    if kind == ".model":
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = tokenizers.Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of (digest, body)."""
    kind = os.path.splitext(tokenizer)[1]
    with open(tokenizer, "rb") as file:
        data = texts.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(kind, data.value)
        for part in parts:
            for some in batches(part, BATCH_BYTES, "body"):
                tokens = pa.array(count(some.column("body").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("digest").cast(pa.binary()), tokens], ["digest", "n_tokens"])

    return texts.select("digest", "body").mapInArrow(run, "digest binary, n_tokens long")


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for one tokenizer, each digest once."""
    found = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, cache: str, version: str) -> None:
    counts.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)


def count_tokens(
    documents: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each document.

    ``cache`` is a folder that all executors share, made when it is not there; two calls
    may append the same digest, which is read once. Without it the counts are kept for
    this call alone, in the shared folder. A null or empty text has no bytes and no
    tokens. Repeated rows and ids and null ids stay as they are; an empty table gives no
    rows; other columns are ignored. Texts are encoded whole, without special tokens.

    Few misses are broadcast, so that no text of a hit is moved; beyond
    ``BROADCAST_MISSES`` the distinct texts are shuffled by digest, copies combined before.
    """
    spark = documents.sparkSession
    if cache is None:
        ensure_checkpoint_dir(spark)
        cache = f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"
    version = version_of(tokenizer)
    append(spark.range(0).select(F.lit(b"").alias("digest"), "id").withColumnRenamed("id", "n_tokens"), cache, version)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(normalised(F.col(text), tokenizer), 256))
    rows = pinned(
        documents.select(
            F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), digest.alias("digest")
        )
    )
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    missing = pinned(copies.select("digest").join(cached(spark, cache, version), "digest", "left_anti"))
    misses = missing.count()
    if misses:
        texts = documents.select(digest.alias("digest"), body.alias("body"))
        if misses <= BROADCAST_MISSES:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("body").alias("body"))
        if misses > BROADCAST_MISSES:
            texts = texts.join(missing, "digest", "left_semi")
        append(encoded(texts, tokenizer), cache, version)
    values = pinned(copies.join(cached(spark, cache, version), "digest"))
    return spread_join(rows, values, "digest", "copies").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
