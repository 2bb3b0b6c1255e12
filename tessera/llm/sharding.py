"""Sharding along a Hilbert curve over quantised metadata, with native functions only.

Several dimensions, numbers or strings, are quantised to `bits` bits each at quantiles of the data, every row gets the
index of its cell on a Hilbert curve, rows are ordered by that index, and the order is cut into runs of equal row
count. Shards (and the row groups in them) then cover small boxes in every dimension at once, so that min/max
statistics prune files for filters on any of them. Inside a cell rows are ordered by their text's hash, so that equal
texts in a cell are neighbours (a cut between shards may still part them).

A global row number is had without a global sort: rows are counted by (cell, sub-cell), where the sub-cell is part of
the text's hash; the running sum of a bounded number of counts gives each sub-cell its first position, and a window
inside the sub-cell gives the rest. A hot cell is thus spread over SUBCELLS windows. A hot text (more than one row in
HOT_SHARE; there are fewer than HOT_SHARE of them) has a sub-cell of its own, spread over SALTS windows by the id.

Defined cases: null in a dimension counts as its lowest value; null text as empty (size 1, CRC 0); repeated rows
each get a slot; an empty table gives no rows; columns besides id, text and the dimensions' inputs are ignored, or
carried along unread, as a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, own_columns

#: Sub-cells by which a cell of the curve is split. At 100 TB (about 3e10 rows in 4096 cells) a window holds some 30,000 rows.
SUBCELLS = 256
HOT_SHARE = 2048
SALTS = 256


def hilbert_table(dims: int, bits: int) -> list[int]:
    """Index on the Hilbert curve of every cell; a cell is the number made of its coordinates, first one highest."""
    side, table = 1 << bits, []
    for cell in range(side**dims):
        x = [(cell >> (bits * (dims - 1 - d))) & (side - 1) for d in range(dims)]
        q = side >> 1
        while q > 1:  # undo the excess rotations, from the highest bit down
            p = q - 1
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[i]) & p
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, side >> 1
        while q > 1:
            if x[dims - 1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | (v >> b) & 1
        table.append(index)
    return table


def string_cuts(df: DataFrame, col: Column, side: int) -> list[str]:
    """Values that cut the rows, in order of the string, into `side` parts as equal as they go; a frequent value may be several cuts.

    The window has a row for each distinct value: a list of sources or languages.
    """
    by = df.groupBy(F.coalesce(col, F.lit("")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by = by.select("v", "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    crossed = by.filter(F.expr(f"upto * {side} div total > (upto - n) * {side} div total and upto < total"))
    return [r["v"] for r in crossed.select("v").orderBy("v").collect()]  # fewer than side


def curve_cell(df: DataFrame, dims: dict[str, Column], bits: int = 4) -> Column:
    """The Hilbert index of a row's cell, as an expression. Cut points are all that the driver holds: dims * 2**bits values."""
    side = 1 << bits
    kinds = df.select(*[c.alias(n) for n, c in dims.items()]).schema
    numbers = [n for n in dims if kinds[n].dataType.simpleString() != "string"]
    at = [i / side for i in range(1, side)]
    row = df.agg(*[F.percentile_approx(F.coalesce(dims[n], F.lit(-1)), at, 10000).alias(n) for n in numbers]).first() if numbers else {}
    cell = F.lit(0)
    for n, c in dims.items():
        cuts = sorted(set(row[n] or [])) if n in numbers else string_cuts(df, c, side)
        own = F.coalesce(c, F.lit(-1) if n in numbers else F.lit(""))
        # side - 1 cuts at most: a row's coordinate is how many of them lie below its value
        cell = cell * side + sum((F.when(own > F.lit(v), 1).otherwise(0) for v in cuts), F.lit(0))
    table = F.split(F.lit(",".join(map(str, hilbert_table(len(dims), bits)))), ",").cast("array<int>")
    return F.get(table, cell)


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 4, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; shards differ by one row at most. carry: with the whole row as the struct `row`."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    spec = ["doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"), "source", "lang"]
    own = own_columns(docs, "doc_id", "text", "lang", "source")
    facts = materialise(own.select(*spec), "shard-facts")
    curve = curve_cell(facts, {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size")}, bits)
    # fewer than HOT_SHARE rows
    total = facts.count()
    hot = facts.groupBy("text_hash").agg(F.count("*").alias("n")).filter(F.col("n") * HOT_SHARE > total).select("text_hash", F.lit(True).alias("hot"))

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(hot), "text_hash", "left").withColumn("curve", curve).withColumn("sub", F.pmod("text_hash", F.lit(SUBCELLS)).cast("int"))
        return df.withColumn("own", F.when(F.col("hot"), F.col("text_hash"))).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))

    group = ["curve", "sub", "own", "salt"]
    order = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    # one partition, of at most 2**(3 * bits) * SUBCELLS rows and SALTS for each hot text and cell: some millions, whatever the input
    counts = placed(facts).groupBy(*group).agg(F.count("*").alias("n"))
    firsts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    rows = placed(docs.select(*[docs[c] if isinstance(c, str) else c for c in spec], docs_row(docs)) if carry else facts)
    within = Window.partitionBy(*group).orderBy("text_hash", "text_crc32", "doc_id", "size")
    ranked = rows.withColumn("rn", F.row_number().over(within) - 1)
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    ranked = ranked.join(firsts, same[0] & same[1] & same[2] & same[3])
    shard = F.expr(f"cast((first + rn) * {shards} div {max(total, 1)} as int)")
    start = F.expr(f"((shard * {total}L) + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("first") + F.col("rn") - start).alias("slot"), *["row"] * carry)


def docs_row(docs: DataFrame) -> Column:
    return F.struct(*[docs[c] for c in docs.columns]).alias("row")


def sharded_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs itself (all its columns) with shard and slot, one partition a shard, in order: what a writer saves, one file a shard."""
    rows = hilbert_shards(docs, shards, carry=True)
    return rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").select("row.*", F.struct("shard", "slot").alias("place"))
