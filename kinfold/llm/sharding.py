"""Sharding by minimax contiguous partition, with DataFrame functions only.

Equal texts form groups that stay together. Groups lie on a line, ordered by the hash of their text; the top bits
of that hash cut the line into at most ``ATOMS`` atomic stretches of whole groups, so that the list of atomic sizes
is bounded whatever the corpus. The smallest feasible shard capacity over that list is found by binary search, each
trial checked by filling shards greedily, and the line is cut where the greedy filling cuts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import let, materialize

#: Stretches of the line of groups; a bound on every list of sizes.
ATOM_BITS = 16
ATOMS = 1 << ATOM_BITS


def _fill(sizes: Column, capacity: Column) -> Column:
    """Greedy filling: struct(n: shards used, load: of the last one, cuts: positions where a new shard begins)."""
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("load"))
    return F.aggregate(sizes, start, lambda s, x: F.when(s["load"] + x > capacity, F.struct((s["n"] + 1).alias("n"), x.alias("load"))).otherwise(F.struct(s["n"].alias("n"), (s["load"] + x).alias("load"))))


def _capacity(sizes: Column, shards: int) -> Column:
    """Binary search of the smallest capacity for which the greedy filling needs at most ``shards`` shards."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    low = F.greatest(F.array_max(sizes), F.ceil(total / shards).cast("long"))
    start = F.struct(low.alias("lo"), (F.ceil(total / shards).cast("long") + F.array_max(sizes)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("long")
        fits = let(middle, lambda m: _fill(sizes, m)["n"] <= shards)
        stop = s["lo"] >= s["hi"]
        return F.when(stop, s).when(fits, F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, halve)["hi"]


def minimax_cuts(atoms: DataFrame, shards: int) -> list[int]:
    """``atoms`` has int atom and long size, at most ``ATOMS`` rows: the atoms at which shard 1, 2, ... begin."""
    line = atoms.agg(F.array_sort(F.collect_list(F.struct("atom", "size"))).alias("line"))
    line = line.select(F.transform("line", lambda a: a["atom"]).alias("at"), F.transform("line", lambda a: a["size"]).alias("sizes"))
    empty = F.array().cast("array<int>")
    begin = F.struct(F.lit(0).cast("long").alias("load"), empty.alias("cuts"))

    def cuts(capacity: Column) -> Column:
        more = lambda s, a: F.struct((s["load"] + a["sizes"]).alias("load"), s["cuts"].alias("cuts"))
        cut = lambda s, a: F.struct(a["sizes"].alias("load"), F.array_append(s["cuts"], a["at"]).alias("cuts"))
        return F.aggregate(F.arrays_zip("at", "sizes"), begin, lambda s, a: F.when(s["load"] + a["sizes"] > capacity, cut(s, a)).otherwise(more(s, a)))["cuts"]

    # bound by let(): inside a lambda, the search would else run again for every atom
    cut = F.when(F.size("sizes") > 0, let(F.col("sizes"), lambda s: let(_capacity(s, shards), cuts)))
    row = line.select(cut.alias("cuts")).first()
    return list(row["cuts"] or []) if row else []


def shard_documents(docs: DataFrame, shards: int = 40, unit_rows: int = 512) -> DataFrame:
    """Shards 0 .. shards - 1 of near equal bytes (law ``bytes``): one row per document with doc_id, size (UTF-8 bytes
    of the text plus 16), text_crc32, law, shard, slot (gapless from 0 in the shard) and grown_shard (null).

    Equal texts share a shard, so a shard exceeds the mean by no more than the largest atomic stretch. A null text
    has no bytes, size 16, crc32 0, and groups with empty texts. Null ids and repeated rows get slots of their own.
    An empty table gives no rows; fewer groups than shards leave shards empty. Extra columns are ignored."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = materialize(
        docs.select(F.col("doc_id").cast("long"), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("hash")).withColumn(
            "atom", F.shiftrightunsigned("hash", 64 - ATOM_BITS).cast("int")
        )
    )
    atoms = materialize(slim.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    cuts = minimax_cuts(atoms.select("atom", "size"), shards)
    begins = F.array(*[F.lit(c) for c in cuts]).cast("array<int>")
    unit = max(unit_rows, slim.count() >> 20)  # no more units than ATOMS + 2^20
    plan = atoms.select("atom", F.size(F.filter(begins, lambda c: c <= F.col("atom"))).alias("shard"), F.ceil(F.col("n") / unit).cast("int").alias("salts"))
    salted = slim.join(F.broadcast(plan), "atom").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("salts")).cast("int"))
    units = salted.groupBy("shard", "atom", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("atom", "salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = units.select("atom", "salt", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("atom", "salt").orderBy("hash", "doc_id")) - 1
    placed = salted.withColumn("inside", inside).join(starts, ["atom", "salt"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
