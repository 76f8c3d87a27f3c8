"""Cached, batched enrichment with a client that can be exchanged; the default is a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of one request.
BATCH = 40

Client = Callable[[str, list[str]], dict[str, str]]


def mock_client(prompt: str, keys: list[str]) -> dict[str, str]:
    """A repeatable answer for each key."""
    return {k: f"{prompt}:{k}" for k in keys}


def cached(cache: DataFrame, prompt: str) -> DataFrame:
    """(item, v) of the last answer to each key of a prompt; ``cache`` has k, v and seq."""
    last = cache.groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    return last.where(F.startswith("k", F.lit(f"{prompt}|"))).select(F.substring("k", len(prompt) + 2, 1 << 20).alias("item"), "v")


def run_stage(items: DataFrame, prompt: str, answers: DataFrame, client: Client = mock_client, requests: int = 1) -> DataFrame:
    """(item, v, source) for each distinct item: from the cache, else asked in batches of ``BATCH``.

    Answers to keys that were not asked are dropped; items without an answer get null. ``requests`` is the number of
    tasks that ask at once, which is what bounds the load on the service.
    """
    wanted = items.select("item").where("item IS NOT NULL").distinct()
    have = wanted.join(answers, "item").select("item", "v", F.lit("cache").alias("source"))
    todo = wanted.join(answers, "item", "left_anti").repartition(requests)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[str] = []

        def flush() -> pa.RecordBatch:
            got = client(prompt, pending)
            return pa.RecordBatch.from_arrays([pa.array(pending), pa.array([got.get(k) for k in pending], pa.string())], ["item", "v"])

        for batch in batches:
            for item in batch.column(0).to_pylist():
                pending.append(item)
                if len(pending) == BATCH:
                    yield flush()
                    pending = []
        if pending:
            yield flush()

    asked = todo.mapInArrow(ask, "item string, v string").select("item", "v", F.lit("asked").alias("source"))
    return have.unionByName(asked)


def two_stage(generated: DataFrame, sane: Column, grade: Column) -> DataFrame:
    """Adds ``verdict``: kept, insane or rejected; only what is sane is graded and only a true grade keeps."""
    return generated.withColumn("verdict", F.when(~F.coalesce(sane, F.lit(False)), "insane").when(F.coalesce(grade, F.lit(False)), "kept").otherwise("rejected"))


def word_ends(phonemes: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """(keys, word, phonemes, end) of a phoneme stream: blanks and begin and end marks close words, as do chunk ends.

    Needs chunk_no, ord, phoneme and num_samples; ``end`` is in seconds.
    """
    w = Window.partitionBy(*keys).orderBy("chunk_no", "ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("phoneme").isin(" ", "^", "$")
    opens = ~mark & (F.coalesce(F.lag(mark).over(w), F.lit(True)) | (F.col("chunk_no") != F.coalesce(F.lag("chunk_no").over(w), F.lit(-1))))
    placed = phonemes.withColumn("cum", F.sum("num_samples").over(upto)).withColumn("mark", mark).withColumn("open", opens)
    words = placed.withColumn("word", F.sum(F.col("open").cast("int")).over(upto) - 1).where("NOT mark")
    return words.groupBy(*keys, "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "ord", "phoneme"))), lambda x: x["phoneme"]), "").alias("phonemes"), (F.max("cum") / rate).alias("end"))
