"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, SentencePiece, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import darts, language, lines, mixing, pieces
from faultline.llm.common import small_batches, store, table

#: bits a letter costs in the best language from which on a text counts as no language at all: a uniform code of 2^7 letters,
#: or of all letters of the language where it has more
MOST_BITS = 7.0
#: occurrences from which a line loses all but the first: the operator's own
BOILERPLATE = lines.LEAST
#: share of a document's characters in lines that one earlier document has too, from which on it is left to the near-duplicate stage as it is
COPIED = 0.75
#: a character that is not white space
INK = r"(?U)\S"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, and ``lang`` set to it.

    Texts without letters (``und``) and texts that no language describes in fewer than MOST_BITS bits a letter (more for large alphabets) are rejected.
    The model learns from all labelled documents of this input (a bounded sample of them); without any label nothing can be told
    and all documents stay as they are. Null and empty texts are rejected; an empty table gives an empty table.
    """
    small_batches(spark)
    model = language.learn(docs)
    if not model.langs:
        return docs
    named = language.identify(docs, model, keep=tuple(docs.columns), names=("__lang", "__score", "__bits"))
    wide = {lang: bits for lang, bits in zip(model.langs, map(float, model.uniform_bits)) if bits > MOST_BITS}
    most = F.coalesce(F.create_map(*[F.lit(x) for pair in wide.items() for x in pair])[F.col("__lang")], F.lit(MOST_BITS)) if wide else F.lit(MOST_BITS)
    found = named.filter((F.col("__lang") != language.UNDETERMINED) & (F.col("__bits") < most))
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; one of which only white space is left goes.

    A document most of whose text, COPIED of the characters of its lines, stands in the lines of one earlier document stays whole: it is a copy or
    a near copy, for the near-duplicate stage to judge, and its few own lines must not live on as a document of their own. Null texts and
    rows of null id stay; an empty table gives an empty table; rows that repeat an id lose the same lines.
    """
    small_batches(spark)
    found = lines.origins(docs.select(F.col("doc_id").alias("id"), "text"), least=BOILERPLATE)
    gone = found.groupBy("id").agg(F.collect_list("gone").alias("__gone")).withColumnRenamed("id", "doc_id")
    joined = docs.join(gone, "doc_id", "left").withColumn("__lines", F.split("text", "\n"))
    size = F.aggregate("__lines", F.lit(0), lambda t, x: t + F.char_length(x))
    shared = F.array_max(F.transform("__gone", lambda g: F.aggregate(g, F.lit(0), lambda t, i: t + F.char_length(F.get("__lines", i)))))
    told = joined.withColumn("__all", F.flatten("__gone")).withColumn("__change", F.coalesce(shared < COPIED * size, F.lit(False)))
    kept = F.array_join(F.filter("__lines", lambda x, i: ~F.array_contains("__all", i)), "\n")
    changed = told.withColumn("__left", F.when(F.col("__change"), kept).otherwise(F.col("text")))
    left = changed.filter(~F.col("__change") | F.col("__left").rlike(INK)).withColumn("text", F.col("__left"))
    return left.withColumn("n_chars", F.when(F.col("__change"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id. Null texts and null ids stay; an empty table gives an empty table."""
    small_batches(spark)
    dropped = store(darts.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct())
    few = dropped.limit(200_001).count() <= 200_000
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by the calibrated probabilities of their source, language and topic. Nulls are values of their own; an empty table gives an empty table."""
    return mixing.mix(docs).filter("__kept").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decoded_sha256: each document's ids, begin and end included, and the digest of the text they decode to.

    A null text counts as empty; an empty table gives an empty table.
    """
    small_batches(spark)
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    coded = pieces.encode_and_check(keyed, pieces.model_path(), id_col="key")
    return coded.select("id.doc_id", "id.lang", "id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", deduplicate_lines),
    ("MinHash near-dedup", deduplicate_documents),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: automata, edit joins and hashed signatures are not SQL; the tests hold run() against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
