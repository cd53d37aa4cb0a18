"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barograph.llm import (
    decontaminate,
    fim,
    near_dup,
    packing,
    pieces,
    pii,
    repeats_bwt,
    repeats_fm,
    resample,
    secrets,
    sharding,
    toxicity,
    vectors,
)
from barograph.llm.common import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


@query
def op1_minhash_near_dups(spark, sf):
    return near_dup.query(read_table(spark, sf, "documents"))


@query
def op2_differencing_shards(spark, sf):
    return sharding.query(read_table(spark, sf, "documents"))


@query
def op3_byte_repeats(spark, sf):
    return repeats_bwt.query(read_table(spark, sf, "documents"))


@query
def op4_toxicity(spark, sf):
    return toxicity.query(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query
def op5_secrets(spark, sf):
    return secrets.query(read_table(spark, sf, "documents"))


@query
def op6_decontamination(spark, sf):
    return decontaminate.query(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query
def op7_passage_repeats(spark, sf):
    return repeats_fm.query(read_table(spark, sf, "documents"))


@query
def op8_vector_near_dups(spark, sf):
    return vectors.query(read_table(spark, sf, "embeddings"))


@query
def op9_packing(spark, sf):
    return packing.query(read_table(spark, sf, "documents"))


@query
def op10_pii(spark, sf):
    return pii.query(read_table(spark, sf, "documents"))


@query
def op11_importance_resampling(spark, sf):
    return resample.query(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query
def op12_fill_in_middle(spark, sf):
    return fim.query(read_table(spark, sf, "documents"))


@query
def op13_sentencepiece(spark, sf):
    return pieces.query(read_table(spark, sf, "documents"))
