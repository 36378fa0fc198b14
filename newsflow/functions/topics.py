"""Source names, topic flags, topic scores and the category they lead to."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from newsflow.lexicons import (
    NO_SOURCE,
    NO_TOPIC,
    SOURCE_RULES,
    TOPIC_BONUS_KEYWORDS,
    TOPIC_HIT_SCORE,
    TOPIC_TERMS,
    TOPIC_THRESHOLDS,
)


def normalise_source(link: Column, source: Column, rules=SOURCE_RULES) -> Column:
    """Name of the first rule found in ``link``; else the part of ``source`` before the
    first hyphen, em dash or bar in title case; ``Unknown`` for an empty source."""
    leading = F.initcap(F.trim(F.regexp_extract(source, r"^[^-—|]+", 0)))
    fallback = F.when(F.length(source) == 0, NO_SOURCE).otherwise(leading)
    if not rules:
        return fallback
    chain = F
    for needle, name in rules:
        chain = chain.when(link.contains(needle), name)
    return chain.otherwise(fallback)


def topic_flag(text: Column, terms, word_boundary: bool = False) -> Column:
    """Whether any term occurs in lower-cased ``text``.

    The default is a plain substring test, which needs no regular expression: a term
    with an optional last letter is found by its shorter form. With ``word_boundary``
    only whole words count.
    """
    if word_boundary:
        body = "|".join(
            re.escape(t[:-2]) + t[-2:] if t.endswith("?") else re.escape(t) for t in terms
        )
        return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])")
    plain = [t[:-2] if t.endswith("?") else t for t in terms]
    # A term that contains another one adds nothing to an OR of substring tests.
    needed = [t for t in plain if not any(o != t and o in t for o in plain)]
    return reduce(lambda a, b: a | b, [text.contains(t) for t in needed])


def topic_score(
    flag: Column,
    keywords: Column,
    bonus: tuple[str, int] | None = None,
    hit_score: int = TOPIC_HIT_SCORE,
) -> Column:
    """Points for a hit plus points for a bonus keyword, INT."""
    score = F.when(flag, hit_score).otherwise(0)
    if bonus is None:
        return score
    word, points = bonus
    return score + F.when(F.array_contains(keywords, word), points).otherwise(0)


def choose_category(
    scores: dict[str, Column], thresholds=TOPIC_THRESHOLDS, default: str = NO_TOPIC
) -> Column:
    """Topic with the highest score that reaches its threshold.

    ``scores`` is in priority order: a topic wins ties against all that follow it.
    """
    topics = list(scores)
    chain = F
    for n, topic in enumerate(topics):
        rest = [scores[t] for t in topics[n + 1 :]]
        wins = scores[topic] >= thresholds[topic]
        if rest:
            wins = wins & (scores[topic] >= (F.greatest(*rest) if len(rest) > 1 else rest[0]))
        chain = chain.when(wins, topic)
    return chain.otherwise(default)
