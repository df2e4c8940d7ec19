"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows of each source are shuffled by a seeded digest of id and text checksum and ranked; a row's fractional rank is (2r+1)/(2n)
for rank r of the source's n rows.  Sorting all rows by fractional rank interleaves the sources in proportion, so that
cutting that order into equal runs gives shards which each hold the mixture.  Row counts of shards differ by one at most.
Rows whose fractional ranks agree to one ``GRID``-th are in the order of a part of their digest.

No source or position range is ranked in one piece: a source is ranked in digest ranges, the global order in ``GRID`` ranges of the
fractional rank and each of those in digest ranges again, which splits the rows that very many small sources put at the same
fractional rank; counts of the ranges before are added.  Rows that agree in all that is read are one row with a count until
they have their ranks.  The rows move with an id, a digest, a size and a checksum but never their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that split a source into ranges.
SALT_DIGITS = 3
#: Rows made at once of one with a count.
COPIES = 65_536
#: Ranges of the fractional rank; their prefix sums are the only broadcast, of this many rows.
GRID = 4096


def _key(name: str) -> Column:
    """Text of a column that differs for null and the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def interleave(
    df: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Nulls: a null source is a source of its own, null ids are shuffled by their texts' checksums, a null text has size 16
    and checksum 0.  Repeated rows each get a slot.  Other columns are not read.  An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.col(text_col).cast("string").cast("binary")
    read = df.select(
        F.col(id_col).alias("doc_id"),
        _key(source_col).alias("src"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
    )
    base = read.groupBy("src", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    base = base.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), _key("doc_id"), F.lit(":"), F.col("text_crc32").cast("string")).cast("binary")))
    base = base.withColumn("salt", F.substring("digest", 1, SALT_DIGITS))

    counts = base.groupBy("src", "salt").agg(F.sum("copies").alias("n_salt"))
    ordered = Window.partitionBy("src").orderBy("salt")
    offsets = counts.select(
        "src",
        "salt",
        (F.sum("n_salt").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_salt")).alias("before"),
        F.sum("n_salt").over(Window.partitionBy("src")).alias("n_src"),
    )
    within = Window.partitionBy("src", "salt").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        base.withColumn("in_salt", F.sum("copies").over(within) - F.col("copies"))
        .join(offsets.hint("shuffle_hash"), ["src", "salt"])
        .withColumn("some", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
        .withColumn("copy", F.explode(F.expr(f"sequence(some, least(some + {COPIES - 1}, copies - 1))")))
        .withColumn("r", F.col("before") + F.col("in_salt") + F.col("copy"))
        .withColumn("cell", F.expr(f"((2 * r + 1) * {GRID // 2}) div n_src"))
        .withColumn("fraction", (2 * F.col("r") + 1).cast("double") / (2 * F.col("n_src")).cast("double"))
        .withColumn("part", F.substring("digest", 1 + SALT_DIGITS, SALT_DIGITS))
        .select("doc_id", "src", "size", "text_crc32", "digest", "cell", "part", "fraction")
    )
    # A source of n rows has (b * n + GRID / 2 - 1) div GRID of them before cell b: sources of equal n are counted once.
    by_n = counts.groupBy("src").agg(F.sum("n_salt").alias("n")).groupBy("n").agg(F.count("*").alias("times"))
    starts = (
        by_n.select("n", "times", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("cell"))
        .groupBy("cell")
        .agg(F.sum(F.expr(f"times * ((cell * n + {GRID // 2 - 1}) div {GRID})")).cast("long").alias("start"))
    )
    starts = starts.withColumn("total", F.max("start").over(Window.partitionBy()))  # of GRID + 1 rows

    parts = ranked.groupBy("cell", "part").agg(F.count("*").alias("n_part"))
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("in_cell", F.sum("n_part").over(earlier) - F.col("n_part")).drop("n_part")
    order = Window.partitionBy("cell", "part").orderBy("fraction", "src", "digest", "size")
    placed = (
        ranked.withColumn("in_part", F.row_number().over(order))
        .join(parts.hint("shuffle_hash"), ["cell", "part"])
        .join(F.broadcast(starts), "cell")
        .withColumn("position", F.col("start") + F.col("in_cell") + F.col("in_part") - 1)
        .withColumn("shard", F.expr(f"(position * {shards}) div total").cast("int"))
    )
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("position") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int = 40, seed: int = 7) -> str:
    """The same table in DuckDB's SQL, with one global order in place of the ranges."""
    return f"""
WITH RECURSIVE polynomial AS (
  SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM polynomial WHERE step < 8),
entries AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE step = 8),
raw AS (
  SELECT doc_id, coalesce('=' || source, '-') AS src, coalesce(text, '') AS body FROM documents),
hashed AS (
  SELECT doc_id, src, (length(digits) // 2)::BIGINT + 16 AS size,
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, length(digits) // 2),
             lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM (SELECT *, hex(encode(body)) AS digits FROM raw), entries),
shuffled AS (SELECT *, md5('{seed}:' || coalesce('=' || doc_id::VARCHAR, '-') || ':' || text_crc32::VARCHAR) AS digest FROM hashed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY digest, size) - 1 AS r, count(*) OVER (PARTITION BY src) AS n
  FROM shuffled),
placed AS (
  SELECT *, row_number() OVER (ORDER BY ((2 * r + 1) * {GRID // 2}) // n, substr(digest, {1 + SALT_DIGITS}, {SALT_DIGITS}),
                                        (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, src, digest, size) - 1 AS position,
         count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((position * {shards}) // total)::INT AS shard,
       (position - (((position * {shards}) // total) * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed"""
