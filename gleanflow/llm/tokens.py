"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file. Counts that the
cache holds under both are joined; the rest is reduced to distinct texts, encoded once, and appended to the cache.
Counting must not change, so the only normalisation is what the tokenizer does itself: nothing for byte-level files.

Defined cases: a null text is empty and has 0 tokens; equal texts are encoded once; an empty table gives no rows and
appends nothing; other columns of the input are not looked at. Texts of any length are counted whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanflow.llm.common import shared_folder, table, text_of

LIMIT = 512
# Words whose counts a task remembers, at most; then it starts anew.
REMEMBERED = 400_000
CACHE = "digest binary, n_tokens long"


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def json_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts by the ``tokenizers`` file at ``path``, special strings in texts handled as its default.

    A byte-level file never joins a space to what stands before it. So a text in which no white space stands before a space
    may be cut before each space, and a task encodes each word once. Other texts, and those with added tokens, go whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    byte_level = '"type":"ByteLevel"' in re.sub(r"\s", "", str(tokenizer.pre_tokenizer.__getstate__().decode()))
    whole = re.compile("|".join([r"\s(?= )", *map(re.escape, added)]))
    known: dict[str, int] = {}

    def encoded(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(text: str) -> int:
        if not text:
            return 0
        if not byte_level or whole.search(text):
            return encoded([text])[0]
        first, *words = text.split(" ")
        pieces = [first, *[" " + w for w in words]] if first else [" " + w for w in words]
        fresh = [p for p in set(pieces) if p not in known]
        if fresh:
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = list(set(pieces))
            known.update(zip(fresh, encoded(fresh), strict=True))
        return sum(map(known.__getitem__, pieces))

    return lambda texts: [count(t) for t in texts]


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts by the ``sentencepiece`` model at ``path``."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)] if texts else []


def counter(path: str) -> Callable[[list[str]], list[int]]:
    return piece_counter(path) if path.endswith(".model") else json_counter(path)


def cached(spark, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version."""
    try:
        rows = spark.read.schema(f"{CACHE}, version string").parquet(cache).where(F.col("version") == version)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; ``cache`` is a folder that grows by what was not in it.

    ``tokenizer`` is a path that every executor has. A batch is one folder in the cache, so a repeated or
    double entry changes nothing.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    body = text_of(text)
    texts = docs.select(digest(body).alias("digest"), body.alias("text"))
    # Copies meet in the task first, so a text that many rows share is sent once by each task.
    misses = (
        texts.join(cached(spark, cache, version), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": count(batch["text"].tolist())})

    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(f"{cache}/version={version}")
    rows = docs.select("doc_id", digest(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    return rows.join(cached(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens")


def op2_digest_cache_tokens(spark, sf_dir):
    import public_tokenizers

    found = token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{shared_folder(spark)}/tokens"
    )
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
