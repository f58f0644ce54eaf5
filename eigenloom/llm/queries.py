"""One query per operator over the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .bag_minhash import near_groups
from .block_naming import exact_groups
from .column_bwt import remove_repeats
from .debruijn_spans import remove_repeated_words
from .fill_middle import fill_in_middle, restored
from .language_masks import fit_languages, identify_languages
from .nb_hinge import fit_quality, score_quality
from .packed_ids import read_token_ids, write_token_ids
from .piece_viterbi import decode_pieces, encode_pieces
from .quartile_digest import fingerprint_documents
from .surrogates import replace_personal_data
from .variant_trie import spelling_variants
from .window_packing import pack_documents


# In production the key comes from a secret store; here it is fixed so that results repeat.
SURROGATE_KEY = "example-key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def op1_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("_a", "_b")


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).drop("row")


def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op4_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    lengths = F.transform("removed", lambda x: x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    model = tokenizer_file("piece_bpe_32k.model")
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    coded = encode_pieces(docs, model, keep=("doc_id", "text_sha256"))
    coded = coded.withColumn("_ids", F.col("ids"))
    decoded = decode_pieces(coded, model, ids_col="_ids", keep=("doc_id", "ids", "text_sha256"))
    found = F.sha2(F.col("text").cast("binary"), 256)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        found.alias("decoded_sha256"),
        (found == F.col("text_sha256")).alias("round_trip"),
    )


def op6_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.where(fold("doc_id", 3) != 1))
    docs = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "text")
    return identify_languages(docs, model, keep=("doc_id", "held_out"))


def op7_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(documents(spark, sf_dir), digest=True)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return replace_personal_data(docs, key=SURROGATE_KEY, out_col="clean_text").drop("text")


def op9_nb_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    model = fit_quality(docs, labels)
    docs = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "text")
    scored = score_quality(docs, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), ids=False)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    text = restored(F.col("form"), F.col("output"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files written hold: each document's place, length and checksum."""
    path = scratch_path(spark, "token_ids")
    write_token_ids(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), path)
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_variant_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_block_naming,
        op2_bag_minhash,
        op3_quartile_digest,
        op4_column_bwt,
        op5_piece_viterbi,
        op6_language_masks,
        op7_debruijn_spans,
        op8_surrogates,
        op9_nb_hinge,
        op10_window_packing,
        op11_fill_middle,
        op12_packed_ids,
        op13_variant_trie,
    )
}
