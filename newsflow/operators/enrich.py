"""Word counts, keywords, source names and categories.

Everything here is computed inside the row: no shuffle, and no state on streams.
"""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.text import (
    drop_words,
    join_text,
    term_frequency,
    term_runs,
    tokenize,
    top_terms,
    word_count,
)
from newsflow.functions.topics import (
    choose_category,
    normalise_source,
    topic_flag,
    topic_score,
)
from newsflow.lexicons import (
    SOURCE_RULES,
    STOP_WORDS,
    TOPIC_BONUS_KEYWORDS,
    TOPIC_TERMS,
    TOPIC_THRESHOLDS,
)
from newsflow.operators.rows import explode_present


def _text():
    return join_text(F.col("title"), F.col("content"))


def add_word_count(df: DataFrame) -> DataFrame:
    return df.withColumn("word_count", word_count(_text()))


def add_tokens(df: DataFrame, min_len: int = 3, stop_words=STOP_WORDS) -> DataFrame:
    """``tokens`` in text order with repeats, stop words removed."""
    return df.withColumn("tokens", drop_words(tokenize(_text(), min_len), stop_words))


def add_term_frequency(df: DataFrame) -> DataFrame:
    """``term_freq`` map from ``tokens``."""
    return df.withColumn("term_freq", term_frequency(F.col("tokens")))


def explode_terms(df: DataFrame, key: str) -> DataFrame:
    """(key, term, n): the term frequencies of ``tokens`` as rows."""
    runs = explode_present(df, term_runs(F.col("tokens")), "_run")
    return runs.select(key, "_run.term", (-F.col("_run.rank")).alias("n"))


def add_keywords(
    df: DataFrame, k: int = 8, min_len: int = 3, stop_words=STOP_WORDS
) -> DataFrame:
    tokens = drop_words(tokenize(_text(), min_len), stop_words)
    return df.withColumn("keywords", top_terms(tokens, k))


def add_source(df: DataFrame, rules=SOURCE_RULES) -> DataFrame:
    return df.withColumn(
        "source_normalized", normalise_source(F.col("link"), F.col("source"), rules)
    )


def add_topic_flags(
    df: DataFrame, terms=TOPIC_TERMS, word_boundary: bool = False
) -> DataFrame:
    """One boolean ``<topic>_hit`` column per topic."""
    text = df.withColumn("_text", F.lower(_text()))
    return text.withColumns(
        {f"{t}_hit": topic_flag(F.col("_text"), w, word_boundary) for t, w in terms.items()}
    ).drop("_text")


def add_topic_scores(
    df: DataFrame,
    terms=TOPIC_TERMS,
    bonus=TOPIC_BONUS_KEYWORDS,
    word_boundary: bool = False,
) -> DataFrame:
    """One INT ``<topic>_score`` column per topic; needs ``keywords``."""
    flagged = add_topic_flags(df, terms, word_boundary)
    scores = {
        f"{t}_score": topic_score(F.col(f"{t}_hit"), F.col("keywords"), bonus.get(t))
        for t in terms
    }
    return flagged.withColumns(scores).drop(*[f"{t}_hit" for t in terms])


def add_category(
    df: DataFrame,
    terms=TOPIC_TERMS,
    bonus=TOPIC_BONUS_KEYWORDS,
    thresholds=TOPIC_THRESHOLDS,
    word_boundary: bool = False,
) -> DataFrame:
    scored = add_topic_scores(df, terms, bonus, word_boundary)
    scores = {t: F.col(f"{t}_score") for t in terms}
    return scored.withColumn("category", choose_category(scores, thresholds)).drop(
        *[f"{t}_score" for t in terms]
    )


def enrich(df: DataFrame) -> DataFrame:
    """Word count, keywords, source name and category of a clean article."""
    return add_category(add_source(add_keywords(add_word_count(df))))
