"""Problem 8: the corpus as token ids of a public byte-level tokenizer.

Texts fall into pre-tokens with positions. Blocks of texts of a bounded number of
characters list their distinct words once; these lists are exploded, the distinct
words of the corpus are gathered by one shuffle and encoded once each, the ids are
joined back to (block, number, word), and every text is put together again by
position. As a word stands once in a block however often it is used, no word is a
hot key, and nothing depends on the size of the vocabulary.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.storage import spool, spread

#: Where the public vocabulary files lie.
TOKENIZERS = os.environ.get("NOTICEWORKS_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokens of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts share a block up to so many characters; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000

_tools: dict = {}


def splitter():
    """The pre-token splitter of this process."""
    if "split" not in _tools:
        import regex

        _tools["split"] = regex.compile(PATTERN).findall
    return _tools["split"]


def encoder(path: str):
    """The tokenizer of this process."""
    if path not in _tools:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tools[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tools[path]


def text_blocks(docs: DataFrame, *, key: str, text: str, chars: int) -> DataFrame:
    """(block, keys, numbers, words): for each text of a block the numbers of its pre-tokens by position, and the block's distinct pre-tokens by number; null texts have null numbers."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = splitter(), TaskContext.get().partitionId() << 33

        def packed(keys: pa.Array, flat: array, ends: list, none: list, words: dict) -> pa.RecordBatch:
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()), mask=pa.array(none, pa.bool_()))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, numbers, pa.array(list(words), pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], ["block", "keys", "numbers", "words"])

        for batch in batches:
            flat, ends, none, words, size, first = array("i"), [0], [], {}, 0, 0
            for at, value in enumerate(batch.column(text).to_pylist()):
                if size and size + len(value or "") > chars:
                    yield packed(batch.column(key).slice(first, at - first), flat, ends, none, words)
                    flat, ends, none, words, size, first, block = array("i"), [0], [], {}, 0, at, block + 1
                none.append(value is None)
                if value:
                    flat.extend([words.setdefault(w, len(words)) for w in split(value)])
                    size += len(value)
                ends.append(len(flat))
            if none:
                yield packed(batch.column(key).slice(first), flat, ends, none, words)
                block += 1

    return spread(docs.select(key, text)).mapInArrow(run, f"block long, keys array<{key_type}>, numbers array<array<int>>, words array<string>")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids): each distinct word encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            # A pre-token passed alone is one pre-token again.
            ids = [tool.encode_ordinary(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.mapInArrow(encode, "word string, ids array<int>")


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens.

    Defined cases: a null text has null ids, an empty text an empty list; repeated
    keys keep their rows; special-token strings are ordinary text; texts of any
    length are encoded whole; an empty table gives no rows.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    key_type = docs.schema[key].dataType.simpleString()
    blocks = spool(text_blocks(docs, key=key, text=text, chars=block_chars), "blocks")
    used = blocks.select("block", F.posexplode("words").alias("number", "word"))
    vocabulary = encode_words(used.select("word").distinct(), path)
    found = used.join(vocabulary.hint("shuffle_hash"), "word").groupBy("block").agg(F.collect_list(F.struct("number", "ids")).alias("found"))

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, numbers, pairs in zip(batch.column("keys"), batch.column("numbers"), batch.column("found"), strict=True):
                start, size, flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
                if pairs.is_valid:
                    number, ids = pairs.values.flatten()
                    flat, number, sizes = ids.flatten().to_numpy(), number.to_numpy(), pc.list_value_length(ids).to_numpy().astype(np.int64)
                    start, size = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
                    start[number], size[number] = np.cumsum(sizes) - sizes, sizes
                at = numbers.values.flatten().to_numpy()
                long = size[at]
                upto = np.concatenate([[0], np.cumsum(long)])
                out = flat[np.repeat(start[at] - upto[:-1], long) + np.arange(upto[-1])]
                lengths = pc.fill_null(pc.list_value_length(numbers.values), 0).to_numpy()
                ends = upto[np.concatenate([[0], np.cumsum(lengths)])]
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()), mask=numbers.values.is_null())
                yield pa.RecordBatch.from_arrays([keys.values, column], [key, "ids"])

    return blocks.select("block", "keys", "numbers").join(found, "block", "left").select("keys", "numbers", "found").mapInArrow(reassemble, f"`{key}` {key_type}, ids array<int>")


def decode_corpus(encoded: DataFrame, *, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text): ids exploded with positions, joined with the token-byte table and put together by position.

    The token table has as many rows as the vocabulary file, 50,256 here. Rows are
    told apart by number, so repeated keys keep their rows; null ids give a null text
    and an empty list ''.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    spark = encoded.sparkSession
    with open(path, "rb") as f:
        table = pd.DataFrame([(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)], columns=["id", "bytes"])
    tokens = F.broadcast(spark.createDataFrame(table, "id int, bytes binary"))
    held = spool(encoded.select(key, "ids"), "ids").withColumn("_row", F.monotonically_increasing_id())
    rows = held.select(F.col(key), "_row", F.posexplode_outer("ids").alias("pos", "id"), F.col("ids").isNull().alias("none"))
    joined = rows.join(tokens, "id", "left").groupBy("_row").agg(F.first(key).alias(key), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "bytes")))).alias("parts"), F.bool_and("none").alias("none"))
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "")
    return joined.select(key, F.when(~F.col("none"), F.decode(F.unhex(hexed), "UTF-8")).alias("text"))


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0 tokens."""
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            sizes = [len(tool.encode_ordinary(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    return spread(docs.select(key, text)).mapInArrow(count, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long")
