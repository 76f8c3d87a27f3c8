"""Token ids of a public byte-level BPE vocabulary by forced-boundary splitting.

A pair of bytes that stands next to each other in no token of the vocabulary can never lie inside one token, so the
place between them is a certain cut. Cuts are taken where, besides, the right byte is white space and the left one is
not: there the pattern that splits text into words always begins anew, so that a fragment encoded alone gives the ids
it has in the whole text. The bytes of a whole Arrow batch are cut at once, each distinct fragment is encoded once,
and the ids are joined in order.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import as_array, by_bytes

#: Folder of the vocabulary files.
TOKENIZER_DIR = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: The published word pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of fragments kept by a worker, as a count of fragments.
CACHE = 500_000
#: Bytes handled at once.
BLOCK = 16_000_000


@lru_cache(4)
def load(name: str = VOCABULARY, folder: str = TOKENIZER_DIR):
    """The encoder and the table of certain cuts, indexed by left byte * 256 + right byte."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    inside = np.zeros(65536, bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8).astype(np.int32)
            inside[b[:-1] * 256 + b[1:]] = True
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    solid = np.zeros(256, bool)
    solid[33:127] = True
    cut = ~inside & (solid[:, None] & space[None, :]).reshape(-1)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), cut


def encode_array(texts: pa.Array, name: str = VOCABULARY, folder: str = TOKENIZER_DIR, cache: dict[str, list[int]] | None = None) -> pa.Array:
    """Ids of each text; a null or empty text has none."""
    encoder, cut = load(name, folder)
    cache = {} if cache is None else cache
    texts = as_array(texts).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return pa.array([], pa.list_(pa.int32()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    starts = offsets - first
    inner = np.flatnonzero(cut[data[:-1].astype(np.int32) * 256 + data[1:]]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    # Every cut, and every bound of a text; an empty text is an empty fragment that is dropped here.
    edges = np.unique(np.concatenate([inner, starts]))
    pieces = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)) if len(edges) > 1 else pa.array([], pa.large_string())
    coded = pieces.dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(cache) > CACHE:
        cache.clear()
    unknown = [w for w in words if w not in cache]
    for word, ids in zip(unknown, map(encoder.encode_ordinary, unknown)):
        cache[word] = ids
    known = [cache[w] for w in words]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter((i for ids in known for i in ids), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat(begins[which] - (ends - lengths), lengths) + np.arange(total)
    bounds = np.concatenate([[0], ends])[np.searchsorted(edges, starts)]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[take] if total else np.zeros(0, np.int32)))


def _encoder(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in by_bytes(batches, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column("key"), encode_array(batch.column("text"), name, folder, cache)], ["key", "ids"])

    return run


def token_ids(docs: DataFrame, key: str, text: str, name: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) for every row; a null or empty text has an empty list. Special tokens are ordinary text.

    Blank texts have the ids of their white space; rows with a repeated or null key are encoded one by one.
    """
    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(_encoder(name, folder), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
