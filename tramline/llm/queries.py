"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import collocations, exact_dedup, main_text, merkle, neighbours, quality, simhash, substring, token_counts, token_files, toxicity
from tramline.llm.packing import pack_documents
from tramline.llm.pieces import decode_pieces, encode_pieces
from tramline.llm.tokens import tokenizer_path
from tramline.session import materialize, scratch_dir, ship_package, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_files.token_file_digests(spark, path)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, bits=64, reach=3, part_bits=32, part_reach=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts at all prefixes are stored; the rows, with the longest prefix within the limit, are read from them."""
    ship_package(spark)
    store = materialize(token_counts.prefix_store(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), "prefix-counts")
    return token_counts.token_counts(store, limit=1024)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces under dropout; lossless: whether they decode to the text."""
    ship_package(spark)
    model = tokenizer_path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model, rate=0.1, seed=42), model)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", "text_sha256", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, room=2048)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring.repeated_words(table(spark, sf_dir, "documents"), window=35)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.fold("doc_id", 3, 1)
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.fold("doc_id", 4, 2)
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score_quality(docs, model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by crc32 of its id, is verified with its text in lower case."""
    ship_package(spark)
    return merkle.documents_manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, first=2000)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_simhash, op3_token_counts, op4_pieces, op5_packing, op6_neighbours, op7_substring, op8_toxicity, op9_quality, op10_exact_dedup, op11_merkle, op12_collocations, op13_main_text)}
ORACLE_SQL = {"op10_exact_dedup": exact_dedup.OP10_SQL, "op12_collocations": collocations.oracle_sql()}
