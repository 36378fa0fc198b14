"""Small tools shared by the tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F


def one(spark, value, expression):
    """Value of ``expression`` (a Column function) for one text."""
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_text(df) -> str:
    """The plan as it ran, after adaptive changes."""
    df.collect()
    return plan_text(df).split("== Initial Plan ==")[0]


# The scripted bursts: (source, count, seconds apart, title, content).
BURSTS = (
    (
        "Injected World News",
        35,
        1.2,
        "Breaking: strong earthquake hits coastal city {}, emergency declared",
        "earthquake disaster emergency rescue teams casualties reported. "
        "earthquake earthquake rescue rescue emergency crisis.",
    ),
    (
        "Injected Business Desk",
        18,
        2.5,
        "Bitcoin market surge continues {} as investors react to inflation data",
        "bitcoin crypto market price surge stocks trading inflation bank earnings. "
        "bitcoin market bullish profit growth.",
    ),
    (
        "Injected Sports",
        4,
        4.0,
        "Local team wins match {} after late goal in league game",
        "match league goal football tournament fans celebrate. match goal.",
    ),
)
BURST_START = datetime(2024, 1, 1, 10, 0, 30)


def burst_articles():
    """(source, title, content, link, published) of all bursts, one after another."""
    now = BURST_START
    for source, count, gap, title, content in BURSTS:
        for n in range(1, count + 1):
            link = f"http://injected.local/{source.split()[-1].lower()}-{n}"
            published = now.strftime("%a %b %d %H:%M:%S UTC %Y")
            yield source, title.format(n), content, link, published
            now += timedelta(seconds=gap)
