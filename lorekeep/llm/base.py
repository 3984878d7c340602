"""What the training-data operators share: batches, words, joins back to groups, running sums."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, setting, stored

__all__ = ["SPACES", "WORD", "batches_of", "by_size", "discard", "fresh", "joined_back", "running", "setting", "split_join", "stored", "unit"]

# The six characters that separate words, as a regex class.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of texts that a function over a batch works on at once; a longer text is alone.
CHARS = 2_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A group with more than this share of all rows is hot; there are fewer than 1 / HOT of them.
HOT = 1 / 1000


def _fewer(spark: SparkSession, rows: int) -> bool:
    now = spark.conf.get(_BATCH, None)
    return now is None or int(now) <= 0 or int(now) > rows


def batches_of(spark: SparkSession, rows: int):
    """Bounds the rows of an Arrow batch (texts are long) for the time of a block; a smaller setting is kept."""
    return setting(spark, _BATCH, str(rows) if _fewer(spark, rows) else spark.conf.get(_BATCH))


def by_size(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs (begin, end) of at most ``most`` characters, so that memory goes with them and not with rows."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size + n > most and i > begin:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def joined_back(rows: DataFrame, groups: DataFrame, key: str, group: str, size: str, total: int) -> DataFrame:
    """Rows with the columns of their group (rows.key = groups.group; ``size`` is
    its number of rows, of ``total``).

    Hot groups are fewer than 1 / HOT and are broadcast, so their rows stay
    where they are; all others meet by a shuffle in which no key has more than
    the share HOT of the rows.
    """
    hot = groups.filter(F.col(size) > total * HOT)
    rest = groups.filter(F.col(size) <= total * HOT)
    large = rows.join(F.broadcast(hot), F.col(key) == F.col(group))
    small = rows.join(F.broadcast(hot.select(F.col(group).alias("_hot"))), F.col(key) == F.col("_hot"), "left_anti")
    return large.unionByName(small.join(rest, F.col(key) == F.col(group)))


def split_join(rows: DataFrame, groups: DataFrame, key: str, group: str, by: str, least: int = 200) -> DataFrame:
    """Rows with the columns of their group (rows.key = groups.group), where groups may be wide and keys hot.

    ``rows`` is a stored table; its keys are counted first.  The rows of a key
    with more than the share HOT of them are dealt, by a hash of ``by``, to so
    many pieces that none is larger, and the key's group goes to each piece.
    Hot keys are fewer than 1 / HOT, so their table is small.
    """
    most = max(least, int(rows.count() * HOT))
    n, piece, at = (fresh([*rows.columns, *groups.columns], x) for x in ("_pieces", "_piece", "_at"))
    hot = rows.groupBy(F.col(key).alias(at)).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n)).filter(F.col(n) > 1)
    hot = F.broadcast(stored(hot, "hot"))
    left = rows.join(hot, F.col(key) == F.col(at), "left").withColumn(piece, F.coalesce(F.pmod(F.xxhash64(by), F.col(n)), F.lit(0))).drop(at, n)
    right = groups.join(hot, F.col(group) == F.col(at), "left").withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)).cast("long") - 1))).drop(at, n)
    right = right.withColumnRenamed(piece, at)
    return left.join(right, (F.col(key) == F.col(group)) & (F.col(piece) == F.col(at))).drop(piece, at)


def unit(digest: Column) -> Column:
    """The first 48 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def fresh(taken: list[str], name: str) -> str:
    """A column name that clashes with none of those taken (case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def running(df: DataFrame, keys: list[str], draw: str, order: list, value: Column, out: str, slim: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that
    sort before this one (exclusive prefix sum).  ``draw`` is a column in
    [0, 1) that orders rows before ``order`` does.

    No key is ever sorted in one task.  The rows of a key are cut by ``draw``
    into about sqrt(rows) buckets; bucket totals (partially aggregated before
    they move) give each bucket's offset, and rows are sorted inside buckets
    only.  A key with n rows so needs tasks of about sqrt(n) rows.  ``slim``
    has the same rows with only the columns that totals need.
    """
    cols, slim = df.columns, df if slim is None else slim
    b, v, off, n, base = (fresh(cols, x) for x in ("_bucket", "_value", "_offset", "_rows", "_total"))
    mine = [fresh(cols, f"_key{i}") for i in range(len(keys))]
    sizes = slim.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)])
    # small tables are stored, so that their joins are planned by their true size
    sizes = stored(sizes.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias(n)), "sizes")
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine, strict=True)]

    def cut(d: DataFrame) -> DataFrame:
        d = d.join(sizes, same).drop(*mine)
        return d.withColumn(b, F.floor(F.col(draw) * F.col(n)).cast("long")).withColumn(v, value).drop(n)

    at = fresh(cols, "_at")
    totals = cut(slim).groupBy(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], F.col(b).alias(at)).agg(F.sum(v).alias(base))
    before = Window.partitionBy(*mine).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(totals.select(*mine, at, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(off)), "totals")
    inside = Window.partitionBy(*keys, b).orderBy(draw, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut(df).withColumn(out, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    joined = ranked.join(totals, [*same, F.col(b) == F.col(at)])
    return joined.select(*cols, (F.col(out) + F.col(off)).alias(out))
