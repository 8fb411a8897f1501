"""Token counts through a digest cache.

The cache is a table (content, n_tokens) in a folder of its own for each tokenizer version, which is the digest of the
tokenizer's file. It stays in the shared folder, so that later runs find the counts of earlier ones. Digests of
normalised contents are joined to it; of the misses each distinct content is encoded once, wherever its copies are, and
appended. Normalisation only turns null into the empty text, as any other would change counts.

Each append is a folder of its own, so that runs side by side don't disturb each other, and a digest that two of them add
is read once. A failed append leaves nothing or counts that are right.

Counts equal those of the `tokenizers` library for the .json file. A text whose characters are all of the common kinds
is counted by `tiktoken` with the same vocabulary (about four times as fast; the two split such texts alike), any other
and any text with a special token's string or very long white space (on which `tiktoken` gives up) by `tokenizers` itself.
Where the faster form of the vocabulary is not given, `tokenizers` counts everything.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; an empty table gives an
empty one and leaves the cache as it is. `_n_bytes` and `_n_tokens` take the place of columns of these names; all other
columns stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, shared_dir, stored, table, text_of

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: How byte-level BPE of this vocabulary splits a text before merging; published with the vocabulary.
PATTERN = public_tokenizers.PATTERN
LIMIT = 512
CACHE_SCHEMA = "content string, n_tokens long"
#: Missing digests that are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Characters that both libraries surely class alike: printable ASCII, tab, line ends, and letters of Latin scripts.
_COMMON = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ɏ]*")
_BLANKS, LONG_BLANKS = re.compile(r"\s+"), 100_000


class Counter:
    """Numbers of tokens of texts, without begin or end."""

    def __init__(self, tokenizer: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            lines = (line.split() for line in Path(ranks).read_bytes().splitlines() if line)
            self.fast = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})

    def __call__(self, text: str) -> int:
        if self.fast and _COMMON.fullmatch(text) and not any(s in text for s in self.special):
            if len(text) < LONG_BLANKS or all(m.end() - m.start() < LONG_BLANKS for m in _BLANKS.finditer(text)):
                return len(self.fast.encode_ordinary(text))
        return len(self.exact.encode(text, add_special_tokens=False).ids)


@lru_cache(2)
def counter(tokenizer: str, ranks: str | None) -> Counter:
    """One a process: loading takes as long as some thousand texts."""
    return Counter(tokenizer, ranks)


class DigestCache:
    """The stored counts below one folder that all executors see; appends add files and rewrite none."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/chronoset/token-counts"

    def append(self, version: str, counted: DataFrame) -> None:
        counted.select("content", "n_tokens").write.option("compression", "zstd").parquet(f"{self.path}/{version}/batch=b{uuid.uuid4().hex}")

    def read(self, version: str) -> DataFrame:
        """(content, n_tokens), each content once."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{version}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(f"{self.path}/{version}")
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, cache: DigestCache | None = None, text: str = "text") -> DataFrame:
    """docs with `_n_bytes` and `_n_tokens`. Only digests are joined; of the texts, misses alone are shuffled, copies combined before."""
    cache, version, digest = cache or DigestCache(docs.sparkSession), tokenizer_digest(tokenizer), F.sha2(text_of(text), 256)
    missing = stored(docs.select(digest.alias("content")).distinct().join(cache.read(version), "content", "left_anti"), "missing")
    n = missing.count()
    if n:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = counter(tokenizer, ranks)
            for batch in batches:
                counts = [count(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

        texts = docs.select(digest.alias("content"), text_of(text).alias("text"))
        texts = texts.join(F.broadcast(missing) if n <= BROADCAST_ROWS else missing, "content", "left_semi").dropDuplicates(["content"])
        cache.append(version, texts.mapInArrow(run, "content string, n_tokens long"))
    docs = docs.drop(*(c for c in ("_n_bytes", "_n_tokens") if c != text))
    key = free_name("content", docs)
    counts = cache.read(version).select(F.col("content").alias(key), F.col("n_tokens").alias("_n_tokens"))
    return docs.withColumn(key, digest).withColumn("_n_bytes", F.octet_length(text_of(text)).cast("long")).join(counts, key).drop(key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")
    return count_tokens(keyed).select("doc_id", "n_bytes", F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > LIMIT).alias("over_limit"))
