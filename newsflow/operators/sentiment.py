"""Lexicon sentiment; row-local, so stateless on streams."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.levels import sentiment_label
from newsflow.functions.text import analysis_text, lexicon_hits, term_runs, tokenize
from newsflow.lexicons import NEGATIVE_WORDS, NO_SOURCE, NO_TOPIC, POSITIVE_WORDS
from newsflow.operators.clean import fill_nulls

DEFAULTS = {
    "title": "",
    "content": "",
    "category": NO_TOPIC,
    "source_normalized": NO_SOURCE,
}


def fill_for_sentiment(df: DataFrame) -> DataFrame:
    return fill_nulls(df, {c: v for c, v in DEFAULTS.items() if c in df.columns})


def add_sentiment(
    df: DataFrame, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, min_len: int = 2
) -> DataFrame:
    """``positive_count``, ``negative_count``, ``sentiment_score`` (INT), ``sentiment``."""
    text = analysis_text(F.col("title"), F.col("content"))
    counted = df.withColumn("_tokens", tokenize(text, min_len)).withColumns(
        {
            "positive_count": lexicon_hits(F.col("_tokens"), positive),
            "negative_count": lexicon_hits(F.col("_tokens"), negative),
        }
    )
    score = F.col("positive_count") - F.col("negative_count")
    scored = counted.drop("_tokens").withColumn("sentiment_score", score)
    return scored.withColumn("sentiment", sentiment_label(F.col("sentiment_score")))


#: Bytes of a lexicon that is broadcast; a larger one is dealt out with the terms.
MAX_LEXICON = 8 << 20
#: Places that share the texts' occurrences of one word of a large lexicon.
DEALT = 16


def lexicon_totals(
    df: DataFrame, lexicon: DataFrame, keys, tokens: str = "tokens", sides=()
) -> DataFrame:
    """(keys, ``<side>_count`` for each of ``sides``, ``weight``) by a lexicon of (word, side,
    weight): how often a text's tokens are words of a side, counting repeats, and the sum of
    the weights. A word may be on several sides; texts without hits have zeros. Texts are told
    apart by ``keys``.

    A text's distinct terms meet the lexicon. It is broadcast up to ``MAX_LEXICON`` bytes;
    beyond, a term that very many texts hold meets its word in ``DEALT`` places.
    """
    terms = df.select(*keys, F.explode_outer(term_runs(F.col(tokens))).alias("_run"))
    terms = terms.select(*keys, F.col("_run.term").alias("_term"), (-F.col("_run.rank")).alias("_n"))
    words = lexicon.select(F.col("word").alias("_word"), "side", F.col("weight").alias("_weight"))
    size = words.agg(F.sum(F.octet_length("_word") + F.octet_length("side") + 16)).first()[0] or 0
    if size <= MAX_LEXICON:
        hits = terms.join(F.broadcast(words), F.col("_term") == F.col("_word"), "left")
    else:
        place = F.pmod(F.xxhash64(*keys), F.lit(DEALT)).alias("_place")
        every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<bigint>")).alias("_spot")
        dealt = words.select("*", every).hint("merge")
        same = (F.col("_term") == F.col("_word")) & (F.col("_place") == F.col("_spot"))
        hits = terms.select("*", place).join(dealt, same, "left")

    def total(value):
        return F.sum(F.coalesce(value, F.lit(0)))

    counts = [total(F.when(F.col("side") == s, F.col("_n"))).alias(f"{s}_count") for s in sides]
    return hits.groupBy(*keys).agg(*counts, total(F.col("_weight") * F.col("_n")).alias("weight"))
