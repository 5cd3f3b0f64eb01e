"""The pN_ queries: each runs an operator, with its production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkweave.llm import crosssplit, leakage, lookalike, names, neardup, neighbours, packing, terms, together


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_table(spark, d, "emb"), k=5, least=0.9)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five papers most similar to every paper whose id is divisible by 100, by hidden state."""
    return neighbours.neighbours(_table(spark, d, "emb"), asks="id % 100 = 0")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """The same by term counts."""
    vectors = neighbours.term_vectors(_table(spark, d, "doc_term"), _table(spark, d, "cora_vocab"))
    return neighbours.neighbours(vectors, asks="id % 100 = 0")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = together.names_together(_table(spark, d, "authors"), _table(spark, d, "author_index"), fewest=5)
    return found.where("n * baskets >= 2 * n_a * n_b").select("author_idx_a", "author_idx_b")


def p2_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Every two names on at least two common papers, with the count to be expected, its tail and its false-discovery rate."""
    return together.names_together(_table(spark, d, "authors"), _table(spark, d, "author_index"), fewest=2)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(_table(spark, d, "author_index"), _table(spark, d, "authors"), _table(spark, d, "nicknames"))


def p3_people(spark: SparkSession, d: str) -> DataFrame:
    """The rows of author_index that share a person with another row, with the smallest number among them."""
    return names.people(_table(spark, d, "author_index"), _table(spark, d, "authors"), _table(spark, d, "nicknames"))


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "abstracts").selectExpr("id", "abstract AS text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = crosssplit.overlaps(_table(spark, d, "pairs"), _abstracts(spark, d))
    return found.selectExpr("least(train_id, eval_id) AS pair_id_a", "greatest(train_id, eval_id) AS pair_id_b").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.report(_table(spark, d, "pairs"), _abstracts(spark, d))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the text of every paper of an evaluation row stands in similar texts of training papers."""
    return crosssplit.coverage(_table(spark, d, "pairs"), _abstracts(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked(_table(spark, d, "abstracts")).where("n = 1 AND mark IS NOT NULL").select("term", "mark")


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every run of up to three terms with its counts and mark."""
    return terms.marked(_table(spark, d, "abstracts"), depth=3).select("n", "term", "occurrences", "records", "mark")


def p5_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return terms.vocabulary(_table(spark, d, "abstracts"), _table(spark, d, "cora_vocab"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, d, "abstracts"), n=3, t=0.5)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of papers by five-word shingles and a similarity of 0.8."""
    return neardup.groups(_table(spark, d, "abstracts"), n=5, t=0.8)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_texts(_table(spark, d, "documents"), _table(spark, d, "pack_capacity"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p7_packed(spark, d), _table(spark, d, "pack_capacity"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_passages")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(_table(spark, d, "documents"), _table(spark, d, "eval_passages"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share half of a passage's words in order, edited or in part."""
    return leakage.paraphrases(_table(spark, d, "documents"), _table(spark, d, "eval_passages"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalikes(_table(spark, d, "documents")).selectExpr("id_a AS doc_id_a", "id_b AS doc_id_b")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like others stored otherwise, with their class."""
    return lookalike.classes(_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p9_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from inkweave.llm.sql import SQL

    return dict(SQL)
