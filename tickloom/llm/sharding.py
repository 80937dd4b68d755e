"""Sharding by extendible hashing, with DataFrame operations alone.

A directory is indexed by the leading bits of a row's hash. It starts with one bucket; in each round those that exceed the byte limit, and
no others, split on further bits, until every shard fits. Rounds work on a histogram of hash prefixes that
gets finer only where buckets are still too large, never on the rows, which are assigned once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import quoted, written

#: Bits that a round looks ahead for a bucket that is too large: each such bucket's rows are counted in 2^AHEAD parts at most.
AHEAD = 8


def directory(sized: DataFrame, limit: int, max_rounds: int = 16) -> DataFrame:
    """(prefix, depth, bytes, rows) of each shard of sized (h, bytes): prefix is the leading depth bits of h.

    A bucket splits while it exceeds the limit and holds more than one hash; one that can't be split stays too large.
    """
    spark = sized.sparkSession
    # prefixes are kept as the leading bits of the hash with zeros behind
    open_ = written(sized.agg(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), F.coalesce(F.min("h") == F.max("h"), F.lit(True)).alias("one")).where("rows > 0"), "root")
    done = open_.where(f"bytes <= {limit} or one").drop("one")
    for _ in range(max_rounds):
        large = open_.where(f"bytes > {limit} and not one").select("prefix", "depth")
        if large.isEmpty():
            return done
        # the rows of large buckets, counted by AHEAD more bits
        depth = large.first()["depth"]
        head = lambda bits: F.lit(0).cast("long") if bits == 0 else F.shiftleft(F.shiftright("h", 64 - bits), 64 - bits)
        to = min(64, depth + AHEAD)
        cells = sized.withColumn("prefix", head(depth)).join(large, "prefix", "left_semi").groupBy(F.col("prefix").alias("parent"), head(to).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("least"), F.max("h").alias("most"))
        cells = written(cells, "cells")
        # one bit at a time: a part splits again only if it is too large itself
        level, parts = cells.withColumn("live", F.lit(True)), []
        for bits in range(depth + 1, to + 1):
            key = F.shiftleft(F.shiftright("cell", 64 - bits), 64 - bits)
            sums = level.groupBy(key.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), (F.min("least") == F.max("most")).alias("one")).withColumn("depth", F.lit(bits))
            sums = written(sums, "level")
            last = bits == to
            parts.append(sums if last else sums.where(f"bytes <= {limit} or one"))
            if not last:
                level = level.withColumn("prefix", key).join(sums.where(f"bytes > {limit} and not one").select("prefix"), "prefix", "left_semi").drop("prefix")
                if level.isEmpty():
                    break
        open_ = parts[0]
        for x in parts[1:]:
            open_ = open_.unionByName(x)
        open_ = written(open_, "buckets")
        done = done.unionByName(open_.where(f"bytes <= {limit} or one").drop("one"))
        if to == 64:
            return done
    raise RuntimeError(f"buckets were still too large after {max_rounds} rounds")


def shards(df: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 16 << 20) -> DataFrame:
    """One row per row of df: its id, bytes, shard (prefix bits), depth, shard_bytes and oversized.

    Rows hash by id for the leading 32 bits, by their place for the others: an id that repeats without end still spreads.
    Of a text its UTF-8 bytes count, none for null. oversized marks the shard of one row that exceeds the limit by itself;
    all other shards fit. Null ids hash like any value. An empty table gives an empty result. Other columns play no
    part.
    """
    size = F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long")
    key = F.col(quoted(id_col))
    rows = df.select(key.alias("id"), size.alias("bytes"), F.monotonically_increasing_id().alias("__place"))
    high, low = F.shiftleft(F.shiftright(F.xxhash64("id"), 32), 32), F.xxhash64("__place", F.lit(5)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    rows = written(rows.withColumn("h", high.bitwiseOR(low)).drop("__place"), "sized")
    found = written(directory(rows.select("h", "bytes"), limit), "directory")
    depths = sorted(x["depth"] for x in found.select("depth").distinct().collect())  # at most 65 numbers
    # each row looks itself up once for each depth that occurs
    look = F.array(*(F.struct(F.lit(d).alias("depth"), (F.lit(0).cast("long") if d == 0 else F.shiftleft(F.shiftright("h", 64 - d), 64 - d)).alias("prefix")) for d in depths)) if depths else F.array(F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    named = found.select("prefix", "depth", F.col("bytes").alias("shard_bytes"), (F.col("bytes") > limit).alias("oversized"))
    out = rows.withColumn("look", F.explode(look)).select("id", "bytes", "look.*").join(named, ["prefix", "depth"])
    bits = F.substring(F.lpad(F.bin("prefix"), 64, "0"), F.lit(1), F.col("depth"))
    return out.select(F.col("id").alias(id_col), "bytes", bits.alias("shard"), "depth", "shard_bytes", "oversized")
