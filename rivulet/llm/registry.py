"""The queries of this subpackage: one module each, all rows of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .text import documents


def op10_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_substring_dedup(spark, sf_dir):
    from .substring import remove_repeated_windows

    done = remove_repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_suffix_array(spark, sf_dir):
    from .suffix_array import REPORT, remove_repeated_bytes

    done = remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"), report=REPORT)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op9_best_fit(spark, sf_dir):
    from .packing import best_fit

    return best_fit(documents(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    from .mixing import plan

    return plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "finish")


def op6_sharding(spark, sf_dir):
    from .sharding import shards

    return shards(documents(spark, sf_dir))


def op8_multiset_hash(spark, sf_dir):
    from .multiset_hash import chained

    return chained(documents(spark, sf_dir))


def op3_quality(spark, sf_dir):
    from .quality import classified

    return classified(documents(spark, sf_dir)).select("doc_id", "votes", "posterior", "score", "keep")


def op1_chat_format(spark, sf_dir):
    from .chat import digests, formatted, with_probe

    return digests(formatted(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op5_audio_fingerprints(spark, sf_dir):
    from .media import fingerprints, media_column, search

    return search(fingerprints(media_column(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "rec_id", "sound"))


def op11_merkle(spark, sf_dir):
    from .merkle import report

    return report(documents(spark, sf_dir))


def op12_packing(spark, sf_dir):
    from .ffd import report

    return report(documents(spark, sf_dir))


def op13_hard_negatives(spark, sf_dir):
    from .vantage import mined

    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {"op13_hard_negatives": op13_hard_negatives, "op12_packing": op12_packing, "op11_merkle": op11_merkle, "op5_audio_fingerprints": op5_audio_fingerprints, "op1_chat_format": op1_chat_format, "op3_quality": op3_quality, "op4_mixing": op4_mixing, "op6_sharding": op6_sharding, "op8_multiset_hash": op8_multiset_hash, "op9_best_fit": op9_best_fit, "op2_substring_dedup": op2_substring_dedup, "op7_suffix_array": op7_suffix_array, "op10_simhash": op10_simhash}


def oracle_sql() -> dict:
    from . import chat, merkle, mixing, substring, suffix_array, vantage

    return {"op1_chat_format": chat.ORACLE, "op2_substring_dedup": substring.ORACLE, "op4_mixing": mixing.ORACLE, "op11_merkle": merkle.ORACLE, "op13_hard_negatives": vantage.ORACLE, "op7_suffix_array": suffix_array.ORACLE}
