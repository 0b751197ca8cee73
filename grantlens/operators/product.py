"""Few columns of many rows: the product of two tables within a key, cut into cells.

Both sides of a key such as the host grow with the data, so the rows of the
product are far more than those of either side. A plain join on the key puts a
key's whole product into one task, and writes its rows in an order in which
every column changes with each row or comes back only after very many rows.

Here the left rows of a key are dealt into groups and the right ones into
chunks, by hash; each pair of group and chunk is a cell, and cells go to as many
tasks as the product's rows need. The right rows of a cell travel in arrays of
``RUN``. Array by array, each left row is written with the whole array: the left
columns stay the same for ``RUN`` rows and the right ones repeat after them. So a
columnar file keeps a few bytes per run instead of each row's texts, however
many rows a key has.

Where one side has a long text of its own in each row, :func:`text_join` instead
deals so few of these rows to a task that a file's dictionary has room for all
their texts. Beyond that room, a file holds the text again in every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.session import ensure_checkpoint_dir

GROUP = 2048  # left rows of a cell; Spark holds the GROUP * RUN rows that one array makes in memory at once
CHUNK = 4096  # right rows of a cell
RUN = 64  # right rows in an array; a multiple of 8, so that the packed bits of a repetition start at a byte
ROWS = 16_000_000  # rows of the product in a task

TEXT = 600_000  # bytes of text in a task; a Parquet column's dictionary holds a megabyte
TASKS = 20_000  # not more tasks than this
FEW_TEXTS = 1024  # left rows of a key in a task
MANY = 32_768  # right rows of a key in a task
FEW = 200_000  # keys cut into cells, small enough to broadcast


def cell_product(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``keys``.

    ``spread`` are columns of ``left`` that tell a key's rows apart. ``left``
    is read three times, so it should be cheap to read. Only the number of
    rows of the product reaches the driver.
    """
    values = [c for c in right.columns if c not in keys]
    # Copies of a right row are numbered, so that they spread over the chunks too.
    right = right.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_n")) \
        .select(*keys, *values, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left")) \
        .join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_right")), keys)
    rows = sizes.agg(F.sum(F.col("_left") * F.col("_right"))).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // ROWS))
    grid = sizes.select(*keys, F.ceil(F.col("_left") / GROUP).alias("_groups"), F.ceil(F.col("_right") / CHUNK).alias("_chunks"))

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    cell = [*keys, "_group", "_chunk"]
    groups = left.join(grid, keys).withColumn("_group", F.pmod(F.xxhash64(*spread), F.col("_groups"))) \
        .withColumn("_chunk", numbers("_chunks")).drop("_groups", "_chunks")
    chunks = right.join(grid, keys).withColumn("_chunk", F.pmod(F.xxhash64(*values, "_copy"), F.col("_chunks"))) \
        .groupBy(*keys, "_groups", "_chunk").agg(F.sort_array(F.collect_list(F.struct(*values))).alias("_all"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(RUN)), lambda at: F.slice("_all", at, RUN))
    runs = chunks.select(*keys, "_groups", "_chunk", F.explode(runs).alias("_rows")).withColumn("_group", numbers("_groups")).drop("_groups")
    # A number of partitions that is asked for is not merged again by AQE, which sees the sides' bytes and not the product's.
    # A merge join streams its left side, the arrays, and keeps the right one's rows of a cell.
    cells = runs.repartition(tasks, *cell).hint("merge").join(groups.repartition(tasks, *cell), cell)
    return cells.withColumn("_row", F.explode("_rows")).select(*left.columns, "_row.*")


def text_join(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``key``; ``left`` has a long ``text`` of its own in each row.

    A left row comes with all its right rows after each other. Both sides are
    read three times; only sizes reach the driver.
    """
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_left"), F.sum(F.octet_length(text) + 4).alias("_text"))
    sizes = sizes.join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_right")), key)
    groups, chunks = F.ceil(F.col("_left") / FEW_TEXTS), F.ceil(F.col("_right") / MANY)
    sizes = sizes.select(key, groups.alias("_groups"), chunks.alias("_chunks"), (F.col("_text") * chunks).alias("_text"))
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    grid = sizes.filter("_groups > 1 OR _chunks > 1").select(key, "_groups", "_chunks").checkpoint()
    total = sizes.agg(F.sum("_text")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, -(-int(total) // TEXT)))
    if grid.count() <= FEW:
        grid = F.broadcast(grid)
    one = F.lit(1).cast("long")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one of its own side's parts, with a copy for every part of the other side."""
        content = [F.col(c) for c in df.columns if c != key]
        mine, theirs = F.coalesce(f"_{own}s", one), F.coalesce(f"_{other}s", one)
        df = df.join(grid, key, "left").withColumn(f"_{own}", F.pmod(F.xxhash64(*content), mine))
        return df.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1))).drop("_groups", "_chunks")

    cell = [key, "_group", "_chunk"]
    left, right = dealt(left, "group", "chunk"), dealt(right, "chunk", "group")
    # A merge join streams its left side, so that a left row's columns stay the same for all its right rows.
    return left.repartition(tasks, *cell).hint("merge").join(right.repartition(tasks, *cell), cell).drop("_group", "_chunk")
