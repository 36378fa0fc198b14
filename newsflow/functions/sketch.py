"""Hash buckets of a count-min sketch kept as a relation."""

from pyspark.sql import Column, DataFrame, functions as F

# Sketch size.
DEPTH = 5
WIDTH = 1000

# An MD5 digest has 32 hex digits: eight for each of four sketch rows.
_DIGITS = 8
_ROWS_PER_DIGEST = 4


def _digest(key: Column, n: int) -> Column:
    return F.md5(F.concat(F.lit(f"{n}:"), key))


def sketch_bucket(digest: Column, row: int, width: int = WIDTH) -> Column:
    """Bucket, BIGINT in [0, width), of sketch row ``row`` from its key's digest number
    ``row // 4``."""
    first = row % _ROWS_PER_DIGEST * _DIGITS + 1
    return F.conv(F.substring(digest, first, _DIGITS), 16, 10).cast("bigint") % F.lit(width)


def place_keys(
    df: DataFrame, key: str, columns, depth: int = DEPTH, width: int = WIDTH
) -> DataFrame:
    """(columns, sketch_row, bucket): each row once per sketch row.

    MD5 rather than an engine-specific hash, so that any SQL engine agrees on the
    buckets. The digests are columns of their own: inside the generator each of the
    ``depth`` entries would compute its digest again.
    """
    digests = [f"_digest{n}" for n in range((depth - 1) // _ROWS_PER_DIGEST + 1)]
    hashed = df.select(
        *columns, *[_digest(F.col(key), n).alias(name) for n, name in enumerate(digests)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(row).alias("sketch_row"),
                sketch_bucket(F.col(digests[row // _ROWS_PER_DIGEST]), row, width).alias("bucket"),
            )
            for row in range(depth)
        ]
    )
    return hashed.select(*columns, F.inline(cells))


def add_buckets(df: DataFrame, key: str, names, width: int = WIDTH) -> DataFrame:
    """``df`` with the bucket of ``key`` in each sketch row, as columns ``names``."""
    digests = [f"_digest{n}" for n in range((len(names) - 1) // _ROWS_PER_DIGEST + 1)]
    hashed = df.withColumns({name: _digest(F.col(key), n) for n, name in enumerate(digests)})
    buckets = {
        name: sketch_bucket(F.col(digests[row // _ROWS_PER_DIGEST]), row, width)
        for row, name in enumerate(names)
    }
    return hashed.withColumns(buckets).drop(*digests)
