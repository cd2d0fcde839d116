"""The queries of the ten operators over their whole tables, with their production parameters."""

from __future__ import annotations

from . import chat, line_dedup, mixing, ngram, packing, quality, secret_scan, simhash, suffixes, vafile
from .common import table


def op1_secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.line_bitmaps(table(spark, sf_dir, "documents"))


def op3_language_model(spark, sf_dir):
    return ngram.perplexities(table(spark, sf_dir, "documents"))


def op4_topk(spark, sf_dir):
    return vafile.neighbours(table(spark, sf_dir, "embeddings"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op7_chat(spark, sf_dir):
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op8_quality(spark, sf_dir):
    return quality.within_limits(table(spark, sf_dir, "documents"))


def op9_suffixes(spark, sf_dir):
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_line_dedup, op3_language_model, op4_topk, op5_packing, op6_mixing, op7_chat, op8_quality, op9_suffixes, op10_simhash)}
ORACLE_SQL = {"op2_line_dedup": line_dedup.SQL, "op3_language_model": ngram.SQL, "op4_topk": vafile.SQL, "op6_mixing": mixing.SQL, "op7_chat": chat.SQL, "op9_suffixes": suffixes.SQL}
