"""Word counts, vocabularies and document-term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions import text as TX
from inkweave.functions.text import stemmed, terms, tokens


def term_sets(nodes: DataFrame) -> DataFrame:
    """(id, chars, terms): number of characters and the distinct terms of each text."""
    return nodes.select("id", F.length("abstract").alias("chars"), F.array_distinct(terms("abstract")).alias("terms"))


def word_counts(nodes: DataFrame) -> DataFrame:
    """(word, n, docs): occurrences and texts of every word, with partial counts before the shuffle."""
    per = nodes.select("id", F.explode(tokens("abstract")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def vocabulary_band(counts: DataFrame, more_than: int, fewer_than: int) -> DataFrame:
    """(word, n) strictly inside the band."""
    return counts.where((F.col("n") > more_than) & (F.col("n") < fewer_than)).select("word", "n")


def stemmed_counts(counts: DataFrame) -> DataFrame:
    """(stem, n): counts of words (word, n) added up by stem; only distinct words are stemmed."""
    return counts.withColumn("stem", stemmed("word")).groupBy("stem").agg(F.sum("n").alias("n"))


def doc_terms(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, word_idx, tf) of the words of vocab (word, word_idx); a text with none has one row, with the number of words in vocab as its word_idx and tf 1. Counts don't wrap."""
    words = nodes.select("id", F.explode(tokens("abstract")).alias("word"))
    tf = words.join(vocab, "word").groupBy("id", "word_idx").agg(F.count("*").alias("tf"))
    size = vocab.agg(F.count("*").alias("word_idx"))
    none = nodes.select("id").join(tf.select("id").distinct(), "id", "left_anti").crossJoin(F.broadcast(size))  # size is one row
    return tf.unionByName(none.select("id", "word_idx", F.lit(1).cast("bigint").alias("tf")))


def row_normalised(doc_term: DataFrame) -> DataFrame:
    """(id, word_idx, share): counts over the sum of their text."""
    total = doc_term.groupBy("id").agg(F.sum("tf").alias("total"))
    return doc_term.join(total, "id").select("id", "word_idx", (F.col("tf") / F.col("total")).alias("share"))


def stemmed_vocabulary(nodes: DataFrame, more_than: int, fewer_than: int) -> DataFrame:
    """(word_idx, word, n): stems of all texts that are admitted and lie strictly inside the band, numbered from 0 in their order. Only distinct words are stemmed."""
    from inkweave.operators.graph import numbered

    words = nodes.select(F.explode(TX.word_runs("abstract")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    stems = words.withColumn("word", stemmed("word")).groupBy("word").agg(F.sum("n").alias("n"))
    kept = vocabulary_band(stems.where(TX.admitted(F.col("word"), TX.stop_words())), more_than, fewer_than)
    return numbered(kept, "word", "word_idx").select("word_idx", "word", "n")


def stemmed_doc_terms(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, word_idx, tf) of the stems of vocab (word_idx, word) in every text; a text with none has one row, with the number of words in vocab as its word_idx and tf 1."""
    each = nodes.select("id", F.explode(TX.word_runs("abstract")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    forms = each.select("word").distinct().withColumn("stem", stemmed("word")).join(vocab.select(F.col("word").alias("stem"), "word_idx"), "stem").select("word", "word_idx")
    tf = each.join(forms, "word").groupBy("id", "word_idx").agg(F.sum("n").alias("tf"))
    size = vocab.agg(F.count("*").alias("word_idx"))
    none = nodes.select("id").join(tf.select("id").distinct(), "id", "left_anti").crossJoin(F.broadcast(size))  # size is one row
    return tf.unionByName(none.select("id", "word_idx", F.lit(1).cast("bigint").alias("tf")))


def token_ids(nodes: DataFrame, vocab: DataFrame, length: int, end: int | None = None) -> DataFrame:
    """(id, ids, mask): the first `length` tokens of every text by their number in vocab (word, word_idx) plus 2, 1 for others, filled up with 0."""
    t = nodes.select("id", F.posexplode(tokens("abstract")).alias("pos", "word")).where(F.col("pos") <= length)
    number = t.join(vocab.select("word", (F.col("word_idx") + 2).cast("int").alias("n")), "word", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    row = number.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("ids"))  # length + 1 tokens at most
    out = nodes.select("id").join(row, "id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return out.select("id", TX.pad_ids(F.col("ids"), length, end).alias("ids")).withColumn("mask", TX.mask(F.col("ids")))
