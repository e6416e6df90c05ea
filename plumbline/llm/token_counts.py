"""Token counts through a digest cache.

A text is known by the SHA-256 of its content (null reads as empty; nothing else
may be normalised, as white space and case change the tokens) and a tokenizer by
the SHA-256 of its file and library version. Counts that the cache holds for both digests are
joined; each distinct text it lacks is encoded once and appended as Parquet, so
that runs which meet the text again only read its count.

Digests are joined before any text moves. Each digest that is missing has one owner,
the row of least id that holds it. Few owners (`BROADCAST_ROWS`) are sent to where the texts
are; only where there are more, all texts are dealt by id to meet them, so copies
neither meet in one task nor get encoded again; without a miss no text is read twice. Counts go back to the rows by `spread_join`, as one text may be a third of all. Appending uses Spark's committed
writes: a lost executor's task is done again, and a count that two runs (or two tasks with rows
of one id and text) append is read once.

Defined results: null text has no bytes and no tokens; repeated rows and ids each
get their row; very long texts are encoded whole; no documents give no rows; special strings inside texts count as
the library counts them by default (one token in the .json vocabularies); extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BROADCAST_ROWS, cut, scratch, spread_join, utf8_size

CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


@functools.cache
def tokenizer_digest(name: str) -> str:
    import public_tokenizers

    library = {"json": "tokenizers", "model": "sentencepiece", "tiktoken": "tiktoken"}[name.rpartition(".")[2]]
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


#: Characters of texts that are encoded at once; a longer text is encoded alone.
BATCH = 1 << 18


@functools.cache
def counter(name: str):
    """A function from a list of texts to their numbers of tokens, without begin, end or added tokens, by the library of the file's kind."""
    import public_tokenizers

    kind = name.rpartition(".")[2]
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda texts: [len(model.encode(s)) for s in texts]
    if kind == "tiktoken":
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(plain.encode_ordinary(s)) for s in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(name))
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _counts(count, texts: list[str]) -> list[int]:
    """The counts of some texts, in batches of bounded size."""
    out, held, size = [], [], 0
    for s in texts:
        if held and size + len(s) > BATCH:
            out += count(held)
            held, size = [], 0
        held.append(s)
        size += len(s)
    return out + (count(held) if held else [])


def _digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, or nothing where there is none yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def digests(docs: DataFrame) -> DataFrame:
    """(content, owner, n) of every distinct text: its digest, the least id of its rows, and their number."""
    return cut(docs.select("doc_id", _digest().alias("content")).groupBy("content").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")))


def fill(docs: DataFrame, tokenizer: str, cache: str, distinct: DataFrame | None = None) -> None:
    """Append the counts of every distinct text that the cache lacks. distinct: what `digests` gives."""
    spark, version_ = docs.sparkSession, tokenizer_digest(tokenizer)
    keyed = docs.select(F.col("doc_id").alias("doc_id"), _digest().alias("content"), "text")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version_).select("content")
    owners = (digests(docs) if distinct is None else distinct).select("content", "owner").join(known, "content", "left_anti")
    n = owners.count()
    if not n:
        return
    owners = F.broadcast(owners) if n <= BROADCAST_ROWS else owners.hint("shuffle_hash")
    misses = keyed.alias("d").join(owners.alias("o"), (F.col("d.doc_id").eqNullSafe(F.col("o.owner"))) & (F.col("d.content") == F.col("o.content"))).select("d.content", "d.text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer), set()
        for batch in batches:
            new: dict[bytes, str] = {}
            for content, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if content not in seen:
                    seen.add(content)
                    new[content] = text.as_py() or ""
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([version_] * len(new), pa.string()), pa.array(_counts(count, list(new.values())), pa.int64())], names=["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. Without a cache folder a new one in the shared folder is used."""
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-cache")
    distinct = digests(docs)
    fill(docs, tokenizer, cache, distinct)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == tokenizer_digest(tokenizer)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = cut(distinct.drop("owner").join(counts, "content"))
    keyed = docs.select("doc_id", utf8_size(F.col("text")).alias("n_bytes"), _digest().alias("content"))
    return spread_join(keyed, counts, ["content"], "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
