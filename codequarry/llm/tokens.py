"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding.

The vocabulary's pattern splits texts into words in Spark. Each distinct word of the corpus is encoded once, into a table of
words and ids. Documents lie in blocks of ``BLOCK_ROWS`` rows; a block's distinct words, a few hundredths of its text, are what
meets the table in a join, so that a frequent word comes once a block and no key is hot. The ids then go back to the words'
places block by block. Decoding joins the ids with the vocabulary's table of pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.tables import cut, read, spread

#: Folder of the vocabulary files; a parameter of every function here.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Rows of a block at most.
BLOCK_ROWS_LOG2 = 12
BLOCK_ROWS = 1 << BLOCK_ROWS_LOG2

# White space as Unicode has it, and the vocabulary's pattern in Java's spelling (its own is PATTERN of the same folder).
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JAVA_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> bytes:
    """The rank file of a vocabulary."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("codequarry", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def split(text: Column) -> Column:
    """The words of a text; joined they are the text again. Null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({JAVA_PATTERN})"), F.lit(1)), F.array().cast("array<string>"))


def _encoded_words(batches: Iterator, ranks) -> Iterator:
    encode = _encoder(ranks.value).encode_ordinary
    for pdf in batches:
        yield pdf.assign(ids=[encode(w) for w in pdf["word"].tolist()])


def distinct_words(blocks: DataFrame) -> DataFrame:
    """(block, word): the distinct words of each block of ``blocks`` (block, text)."""
    return blocks.select("block", F.explode(split(F.col("text"))).alias("word")).distinct()


def word_table(words: DataFrame, ranks) -> DataFrame:
    """(word, ids): each distinct word of ``words`` (block, word), encoded once."""
    return words.select("word").distinct().mapInPandas(lambda batches: _encoded_words(batches, ranks), "word string, ids array<int>")


def _placed(texts, table):
    """Arrow tables of (doc_id, words) and of (word, ids), of one block: ids in the words' places."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    known = table.column("word").combine_chunks()
    lists = table.column("ids").combine_chunks()
    flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy().astype("int64")
    out = []
    for batch in texts.select(["doc_id", "words"]).to_batches():
        column = batch.column("words")
        bounds = column.offsets.to_numpy().astype("int64")
        words = column.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        row = pc.index_in(words.dictionary, value_set=known).to_numpy(zero_copy_only=False)
        if np.isnan(row.astype("float64")).any():
            raise ValueError("a word of the block is missing from its table")
        at = row.astype("int64")[words.indices.to_numpy()] if len(words) else np.zeros(0, "int64")
        n = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])].astype("int32")
        lengths = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids, pa.int32()))
        out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths], names=["doc_id", "ids"]))
    return pa.Table.from_batches(out)


def encode(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, block_rows_log2: int = BLOCK_ROWS_LOG2) -> DataFrame:
    """(doc_id, ids): the ids of each row of ``documents`` (doc_id, text), special tokens' strings being ordinary text.

    A null or empty text has an empty list. Every row stays, repeated ones and those without doc_id too; an empty table gives
    none. Other columns play no part. Each row's block is written down once, so that a task that runs again finds the same.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    own = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    blocks = cut(own.withColumn("block", F.shiftright(F.monotonically_increasing_id(), block_rows_log2)))
    words = cut(distinct_words(blocks))
    met = words.join(word_table(words, ranks), "word").select("block", "word", "ids")
    texts = blocks.repartition("block").select("block", "doc_id", split(F.col("text")).alias("words"))
    return texts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_placed, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(id, piece): the vocabulary as a table, of a fixed size of about 50 000 rows."""
    import pandas as pd

    rows = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, vocabulary(name, folder).splitlines()) if a]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece binary")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): one row for each row, repeated and null doc_ids too. An empty or null list gives ''."""
    table = F.broadcast(pieces(encoded.sparkSession, name, folder))  # as many rows as the vocabulary has
    rows = encoded.select("doc_id", F.xxhash64("ids").alias("h"), F.greatest(F.size("ids"), F.lit(1)).alias("n"), F.posexplode_outer("ids").alias("at", "id")).join(table, "id", "left")
    places = F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", F.hex("piece").alias("h"))))))
    hexed = F.array_join(F.transform(places, lambda x: x["h"]), "")
    texts = rows.groupBy("doc_id", "h", "n").agg(F.decode(F.unhex(hexed), "UTF-8").alias("text"), F.count("*").alias("all"))
    return texts.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("all") / F.col("n")).cast("long")))).drop("col")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k."""
    return encode(read(spark, sf_dir, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as it comes back from its ids."""
    return decode(p8_ids(spark, sf_dir))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
