"""A training-data pipeline over documents: language, quality, near-duplicates, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. Stages but the last return the columns of documents and drop
any other, so a column of any name in docs does no harm. Null ids, texts, languages and sources are values that the operators define; empty
tables give empty tables; texts count as wholes, whatever their length; a repeated row is a row as any other until the
near-duplicates, where it goes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import bpe, chosen_path, langid, mixing, quality
from kmerloom.llm.common import crc_mod
from kmerloom.llm.queries import tokenizer_path
from kmerloom.plans.runtime import cut, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure than this go, with those that have no letter.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages.

    Learned from rows with a language and a text, outside the held-out ids. A text that is null, empty or without a letter is in none
    and goes, as does one whose best language has a posterior under SURE; a tie of two languages has 0.5 each and stays. If nothing
    could be learned, no row stays.
    """
    ship(spark)
    model = langid.learn(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    Learned from the labelled ones among docs, outside the held-out ids; null and empty texts are scored as texts of no words. Without
    a label every score is 0.5 and every row stays, as 0.5 is above the threshold.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    model = quality.learn(docs.where(crc_mod("doc_id", 5) != 0), labels)
    return quality.grade(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id, and of one id the least hash of the text.

    Rows without a word are no duplicates of each other, but rows equal in id and text become one.
    """
    ship(spark)
    return chosen_path.keep_one(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (at most twice) or left out, so that sources have their target weights; null is a source.

    Rows of one id, source and size are drawn together. Documents without a word stay as often as whole copies say.
    """
    ship(spark)
    return mixing.apply_mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of each document, and digests of ids and decoded text; a null or empty text has no ids. One row a row."""
    ship(spark)
    return bpe.encode_texts(docs, tokenizer_path())


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("mixture", mixture), ("tokens", tokens)]
#: Learned models, hashed draws and a tokenizer's merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
