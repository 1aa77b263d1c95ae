"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size-of-source times, a whole number plus a fraction. The
fractions are rounded in pairs: word mass moves at random from one document to the other until one of the two
fractions is 0 or 1, which keeps both expectations and the words of the pair; the one left open meets the next
document. Each task rounds its documents in a fixed order and ends with one open document per source; those
residuals meet in the next level of a reduction tree, until each source has one, which is rounded at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import BROADCAST_ROWS, SPACE, materialize

#: Documents a bucket of the first level holds, and residuals that meet in a later one.
BUCKET, FAN_IN = 2048, 64
EPS = 1e-12


def word_count(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, weigh ``weights`` in turn
    and share all sizes; no target exceeds ``most`` times its source's size, the excess goes to the others by weight.
    One row per source is all that these steps handle."""
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = materialize(per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level = float("inf")  # words for each unit of weight; a source is full when level * weight reaches its limit
    full = F.lit(False)
    while True:
        row = weighed.agg(F.sum(F.when(full, F.col("source_size") * most)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(full.cast("int")).alias("n")).first()
        if not row["w"]:
            break
        level = (total - (row["used"] or 0.0)) / row["w"]
        more = full | (F.col("weight") * level > F.col("source_size") * most)
        if weighed.where(more & ~full).isEmpty():
            break
        full = more
    target = F.when(full, F.col("source_size") * most).otherwise(F.col("weight") * (level if level != float("inf") else 0.0))
    return weighed.select("source", F.col("source_size").cast("long"), target.cast("double").alias("target"))


def _coin(seed: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(b"%d|%d" % (a, b), seed) / 2.0**64


def _round(seed: int, last: bool):
    """Rows (grp, part, key, size, whole, frac) sorted by group: yields the same rows with open = false once settled."""

    columns = ["grp", "part", "key", "size", "whole", "frac", "open"]

    def close(held: list) -> tuple:
        """The open document of a finished bucket: on to the next level, or a coin of its own at the root."""
        if not last:
            return (*held, True)
        grp, part, key, size, whole, frac = held
        return (grp, part, key, size, whole + int(_coin(seed, key, -1) < frac), 0.0, False)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the open document: [grp, part, key, size, whole, frac]
        for p in parts:
            out = []
            for grp, part, key, size, whole, frac in p.itertuples(index=False):
                if held is not None and (held[0] != grp or held[1] != part):
                    out.append(close(held))
                    held = None
                if size <= 0 or frac <= EPS or frac >= 1 - EPS:
                    out.append((grp, part, key, size, whole + int(frac >= 1 - EPS), 0.0, False))
                    continue
                if held is None:
                    held = [grp, part, key, size, whole, frac]
                    continue
                up = min((1 - held[5]) * held[3], frac * size)  # words that may move to the held one
                down = min(held[5] * held[3], (1 - frac) * size)
                if _coin(seed, held[2], key) < down / (up + down):
                    first, second = held[5] + up / held[3], frac - up / size
                else:
                    first, second = held[5] - down / held[3], frac + down / size
                free = None
                for k, s, w, f in ((held[2], held[3], held[4], first), (key, size, whole, second)):
                    if EPS < f < 1 - EPS:
                        free = [grp, part, k, s, w, f]
                    else:
                        out.append((grp, part, k, s, w + int(f >= 1 - EPS), 0.0, False))
                held = free
            yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([close(held)], columns=columns)

    return run


def pivotal_counts(items: DataFrame, seed: int = 42) -> DataFrame:
    """Round expected counts: ``items`` has long grp, long key, long size and double rate; returns (grp, key, size, n), one
    row per item. Equal items share their random draws only through their order, which the key fixes; reruns and
    other partitionings agree, as buckets and order follow from the keys alone."""
    schema = "grp long, part long, key long, size long, whole long, frac double, open boolean"
    n = items.groupBy("grp").count().select("grp", F.ceil(F.col("count") / BUCKET).cast("long").alias("parts"))
    n_groups = n.count()
    n = F.broadcast(n) if n_groups <= 10_000 else n
    now = items.join(n, "grp").select("grp", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).alias("part"), "key", "size", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("frac"), "parts")
    most = now.agg(F.max("parts")).first()[0] or 1
    now, settled = now.drop("parts"), []
    while True:
        last = most == 1
        # large documents first: small ones close the open one in the end, so a bucket leaves little open
        dealt = now.repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("size").desc(), F.xxhash64("key", F.lit(seed)), "key", "frac")
        done = materialize(dealt.mapInPandas(_round(seed, last), schema))
        settled.append(done.where("not open"))
        if last:
            break
        most = -(-most // FAN_IN)
        now = done.where("open").select("grp", F.floor(F.col("part") / FAN_IN).cast("long").alias("part"), "key", "size", "whole", "frac")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("grp", "key", "size", F.col("whole").alias("n"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 42) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source): doc_id, size (words), source_size, target (of its
    source) and taken, the words that the mix takes of it, repeats counted.

    Null texts and texts without words have size 0 and are taken 0 words; a null source is a source of its own,
    last in order; rows without doc_id and repeated rows count like others; an empty table gives no rows; extra
    columns are ignored. A source without words has target 0."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")))
    targets = materialize(source_targets(sizes, weights, most).withColumn("grp", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    small = F.broadcast(targets) if targets.count() <= 10_000 else targets
    none = -(2**63)  # stands for a missing doc_id on the way
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = sizes.withColumn("source_null", F.col("source").isNull()).join(small.drop("source"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source_null")) == F.col("grp"))
    items = items.select("grp", F.coalesce("doc_id", F.lit(none)).alias("key"), "size", rate.alias("rate"))
    taken = pivotal_counts(items, seed).join(small, "grp")
    return taken.select(F.when(F.col("key") != none, F.col("key")).alias("doc_id"), "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 42) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with all their columns, each as often as the mix takes it. Rows with equal
    id, source and text share one draw. Documents without words have no mass to mix and are kept once."""
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-(2**63))), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    sizes = materialize(docs.select(F.col("source").cast("string"), key.alias("key"), word_count(F.col("text")).alias("size")))
    grp = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    targets = materialize(source_targets(sizes, weights, most).withColumn("grp", grp)).drop("source")
    small = F.broadcast(targets) if targets.count() <= 10_000 else targets
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    once = sizes.withColumn("grp", grp).groupBy("grp", "key").agg(F.sum("size").alias("size"))
    counts = pivotal_counts(once.join(small, "grp").select("grp", "key", "size", rate.alias("rate")), seed)
    times = materialize(counts.select(F.col("key").alias("kf_key"), F.when(F.col("size") == 0, 1).otherwise(F.col("n")).cast("int").alias("kf_n")).dropDuplicates(["kf_key"]))
    times = F.broadcast(times) if times.count() <= BROADCAST_ROWS else times
    out = docs.withColumn("kf_key", key).join(times, "kf_key")
    return out.withColumn("kf_copy", F.explode(F.array_repeat(F.lit(0), F.col("kf_n")))).select(*docs.columns)
