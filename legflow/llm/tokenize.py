"""Encoding a corpus with a public byte-level BPE through a table of its distinct words, and decoding it again."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.runtime import cut

# Fixed value: how the tokenizer cuts a text into words before merging bytes. (?U) makes the blanks those of Unicode.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENT = 65_536  # a word with more than 1/FREQUENT of all occurrences is frequent, so there are fewer than that


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed vocabulary file; pass another path to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, n -> word, n, ids; each partition loads the vocabulary once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        # the pattern takes a word as it comes: it was cut already
        enc = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})
        one = enc._core_bpe.encode_single_piece if hasattr(enc._core_bpe, "encode_single_piece") else None
        for b in batches:
            ids = [one(w.encode()) if one else enc.encode_ordinary(w) for w in b["word"]]
            yield b.assign(ids=ids)

    return words.mapInPandas(run, "word string, n bigint, ids array<int>")


def encode(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids (array<int>): the text's tokens without special ones, whose strings are ordinary text.

    Null and empty texts give an empty list; every row of `documents` gives one row, with its own key (repeated or null
    keys too). Words are cut in the JVM; each distinct word is encoded once; ids come back by position. Frequent words (fewer
    than FREQUENT by construction, whatever the corpus) join by broadcast and cost no shuffle; of the rest no word has
    more than 1/FREQUENT of the occurrences, so the shuffled join has no hot key.
    """
    spark = documents.sparkSession
    path = path or vocabulary()
    cutting = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))
    docs = documents.select(F.col(key).alias("_key"), cutting.alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    docs = cut(docs)
    counts = docs.select(F.explode("_w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    table = cut(encode_words(counts, path))
    total = table.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total / FREQUENT
    occ = docs.select("_row", F.posexplode("_w").alias("pos", "word"))
    marked = occ.join(F.broadcast(table.filter(often).select("word", "ids")), "word", "left")
    known = marked.filter("ids IS NOT NULL").select("_row", "pos", "ids")
    rare = marked.filter("ids IS NULL").select("_row", "pos", "word").join(table.filter(~often).select("word", "ids"), "word").select("_row", "pos", "ids")
    item = F.struct("pos", "ids")
    lists = known.groupBy("_row").agg(F.collect_list(item).alias("l")).unionByName(rare.groupBy("_row").agg(F.collect_list(item).alias("l")))
    whole = lists.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("l"))), lambda x: x["ids"])).alias("ids"))
    return docs.select("_key", "_row").join(whole, "_row", "left").select(F.col("_key").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, piece (hexadecimal bytes) of a vocabulary: as many rows as it has ids."""
    return spark.createDataFrame([(i, b.hex().upper()) for b, i in _ranks(path or vocabulary()).items()], "id int, piece string")


def decode(encoded: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, text of id lists, by a join of ids with pieces (the vocabulary bounds the broadcast); unknown ids give nothing."""
    e = cut(encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_i")).withColumn("_row", F.monotonically_increasing_id()))
    x = e.select("_row", F.posexplode("_i").alias("pos", "id")).join(F.broadcast(pieces(encoded.sparkSession, path)), "id")
    t = x.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("l"))
    t = t.select("_row", F.decode(F.unhex(F.array_join(F.transform("l", lambda p: p["piece"]), "")), "UTF-8").alias("text"))
    return e.select("_key", "_row").join(t, "_row", "left").select(F.col("_key").alias(key), F.coalesce("text", F.lit("")).alias("text"))
