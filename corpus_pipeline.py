"""Corpus preparation: language, near duplicates, repeated passages, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's docs. All but the last return the
columns of documents. SQL can express neither the language model nor the merges, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.llm import jaccard_join, language_id, mixing, registry, substring_dedup
from dexspark.llm.common import materialise, table

ORACLE_SQL = None

#: The columns of documents; all others get names of no meaning inside a stage.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def renamed(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in COLUMNS else f"x{n}" for n, c in enumerate(docs.columns)])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that cost more bits a byte in their best language than its texts do.

    Null and empty texts go. Rows with a null lang or doc_id are judged like all others but not
    learned from, and repeated rows are judged each. Extra columns stay, whatever their names.
    """
    model, limits = language_id.train_bounded(docs.filter(~language_id.held_out()))
    own = renamed(docs)
    return language_id.identify(own, model, own.columns, limits).filter("fits").select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every class of near duplicates, and one of rows that are repeated.

    Rows that share a doc_id but not the text stay if their class has no smaller id. Rows with a
    null doc_id stay, one of each text. Null and empty texts are copies of nothing but their own row.
    """
    classes = jaccard_join.near_duplicates(docs)
    copies = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("_copy")).distinct()
    own = renamed(docs).withColumn("_text", F.xxhash64("text"))
    left = own.join(copies, F.col("doc_id") == F.col("_copy"), "left_anti").dropDuplicates(["doc_id", "_text"])
    return left.drop("_text").toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that an earlier document holds; a document with none left goes.

    Texts that lose nothing stay as they are, null and empty ones too, and n_chars follows the
    new text of the others. Rows with a null doc_id lose nothing.
    """
    own = renamed(docs)
    found = substring_dedup.remove_repeats(own, keep=own.columns)
    touched = F.col("n_removed") > 0
    new = {"text": F.when(touched, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(touched, F.length("kept_text")).otherwise(F.col("n_chars"))}
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select(*[new.get(c, F.col(c)).cast(t) for c, t in own.dtypes]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents once at most, whole, up to the budget of their leaf.

    Rows that share a doc_id are drawn or left together, by the tokens and leaf of the one with fewest tokens,
    or of those the first by leaf.
    Null langs and sources are leaves of their own; texts without words have no tokens and go,
    as do rows with a null doc_id, which cannot be drawn.
    """
    own = renamed(docs)
    rows = registry.mixing_rows(own)
    least = rows.groupBy("doc_id").agg(F.min(F.struct("tokens", *[c for c in rows.columns if c not in ("doc_id", "tokens")])).alias("least")).select("doc_id", "least.*")
    drawn = mixing.mix(least, registry.LEVELS, registry.mixing_weights(spark), registry.SHARE, 1, registry.SEED)
    return own.join(drawn.select(F.col("doc_id").alias("_drawn")), F.col("doc_id") == F.col("_drawn"), "left_semi").toDF(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for every row; null texts encode as empty ones."""
    return registry.bpe_digests(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialise(docs)
    return docs
