"""Corpus-level keyword operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions import text as txt
from barograph.operators.daily import fill_days
from barograph.operators.series import burst_flags, zscores
from barograph.operators.stats import keyword_counts
from barograph.session import scratch_dir


#: Terms with this share of all postings are frequent; there are at most 10,000 of them.
FREQUENT = 1e-4


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tfidf_top(df: DataFrame, tokens: Column, id_col: str, top_n: int = 3) -> DataFrame:
    """The ``top_n`` terms of each text by tf * (ln((1+N)/(1+df)) + 1).

    Term counts of a text come from the text itself and are written once, as they are
    read twice: for the document frequencies, reduced before their shuffle, and to meet
    them. Frequent terms, which have most rows, meet theirs by broadcast, so that their
    rows are cut to ``top_n`` a text where they are; rows of the others are shuffled.
    """
    listed = df.select(id_col, F.explode(txt.term_counts(tokens)).alias("_t")).select(id_col, "_t.term", "_t.tf")
    postings = _written(listed, "postings")
    frequencies = _written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n_texts = df.agg(F.count(F.lit(1))).scalar()
    n_postings = frequencies.agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()
    frequent = F.col("df") >= FREQUENT * n_postings
    met = postings.join(F.broadcast(frequencies.filter(frequent)), "term", "left")
    rest = met.filter("df is null").drop("df").join(frequencies.filter(~frequent), "term")
    joined = met.filter("df is not null").unionByName(rest)
    idf = F.log((1 + n_texts) / (1 + F.col("df"))) + 1
    scored = joined.withColumn("tfidf", F.col("tf") * idf)
    # A group is one text, so its size is bounded by the text's vocabulary.
    order = Window.partitionBy(id_col).orderBy(F.round("tfidf", 9).desc(), F.col("term"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_n)
        .select(id_col, "rank", "term", "tf", "df", "tfidf")
    )


def keyword_spikes(
    df: DataFrame, tokens: Column, ts: str = "issued_date", by: Sequence[str] = (), window: int = 7, k: float = 2.0
) -> DataFrame:
    """Days on which a token is used unusually often, with the z-score of its count.

    Each token's days are a series of their own, gap-free between its first
    and last use.
    """
    keys = [*by, "token"]
    daily = df.select(*by, F.to_date(ts).alias("issued_date"), tokens.alias("_tokens")).filter("issued_date IS NOT NULL")
    counts = keyword_counts(daily, F.col("_tokens"), [*by, "issued_date"])
    filled = fill_days(counts.select(*keys, "issued_date", F.col("n").alias("total_alerts")), keys)
    scored = zscores(burst_flags(filled, window, k, keys=keys), [window], keys=keys)
    return scored.filter("burst").select(*keys, "issued_date", "total_alerts", f"z_score_{window}")


@dataclass
class TopicModel:
    """A fitted LDA model with its vocabulary."""

    vectorizer: CountVectorizerModel
    lda: LDAModel

    def terms(self, n: int = 5) -> DataFrame:
        """The leading terms ``(topic, rank, term, weight)``."""
        words = SparkSession.active().createDataFrame(list(enumerate(self.vectorizer.vocabulary)), "index int, term string")
        described = self.lda.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "entry"))
        return described.join(words, F.col("entry.termIndices") == F.col("index")).select(
            "topic", (F.col("pos") + 1).alias("rank"), "term", F.col("entry.termWeights").alias("weight")
        )

    def log_perplexity(self, df: DataFrame, tokens: Column) -> float:
        """Upper bound of the mean log loss a token, of texts that may be new to the model."""
        return self.lda.logPerplexity(self.vectorizer.transform(df.select(tokens.alias("tokens")).filter(F.size("tokens") > 0)))


def fit_topics(
    df: DataFrame, tokens: Column, k: int = 5, vocabulary: int = 20_000, max_iter: int = 10, seed: int = 42, partitions: int = 32, share: float = 1.0
) -> TopicModel:
    """An LDA topic model that depends on the texts alone, not on their partitions.

    The vocabulary is made of the terms with the most occurrences, ties in order of the
    alphabet, which bounds the model. The optimizer draws per partition, so texts are
    dealt by their hash to a fixed number of them. ``share`` is that of each iteration.
    Tokens are made once and written; their counts, dealt and sorted once, are kept on
    disk for all iterations, and made again from the written tokens where they are lost.
    """
    tokenized = _written(df.select(tokens.alias("tokens")), "tokens").filter(F.size("tokens") > 0)
    counted = tokenized.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    words = [r["term"] for r in counted.orderBy(F.desc("n"), "term").limit(vocabulary).collect()]
    if not words:
        raise ValueError("no text has a token")
    vectorizer = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="features")
    dealt = tokenized.repartition(partitions, F.xxhash64("tokens")).sortWithinPartitions("tokens")
    counts = vectorizer.transform(dealt).select("features").persist(StorageLevel.DISK_ONLY)
    try:
        lda = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online", subsamplingRate=share).fit(counts)
    finally:
        counts.unpersist()
    return TopicModel(vectorizer, lda)


def topic_terms(df: DataFrame, tokens: Column, k: int = 5, terms: int = 5, vocabulary: int = 20_000, max_iter: int = 10, seed: int = 42) -> DataFrame:
    """The leading terms ``(topic, rank, term, weight)`` of ``fit_topics``."""
    return fit_topics(df, tokens, k, vocabulary, max_iter, seed, share=0.05).terms(terms)
