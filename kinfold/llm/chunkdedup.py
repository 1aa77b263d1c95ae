"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes sets chunk ends, so that ends depend on content alone and fall in step again
soon after an insertion. Chunks are deduplicated by a 128-bit digest: of the copies the one in the document with the
smallest id stays. Chunks are short, some 45 bytes, so that a passage holds several whole ones wherever it begins; a
run of repeated chunks counts from ``min_run`` bytes, longer than what texts share by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import looked_up, materialize, sliced

#: One random word for each byte value, from a rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 2024) for b in range(256)], np.uint64)
#: Five bits that the last 16 bytes decide: an end every 32 bytes on average, after the shortest chunk.
MASK = np.uint64(0x1F << 10)
SHORTEST, LONGEST = 16, 128
#: Bytes of the shortest run that counts. Chance repeats of invented prose reach some 60 bytes in 25 MB.
MIN_RUN = 96
#: One document in SAMPLED is looked at for chunks with more than one row in HOT.
SAMPLED, HOT = 32, 2000


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, ascending; the last is its length. Empty data has none."""
    n = len(data)
    if not n:
        return []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # h[i] becomes the gear hash of the last 2 * step bytes
        h[step:] += h[:-step] << np.uint64(step) if n > step else h[:0]
    out, last = [], 0
    for end in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        if end - last >= SHORTEST:
            out.append(end)
            last = end
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _keys() -> list[Column]:
    """128 bits for a row: rows of equal id and text are one document."""
    parts = (F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.col("text"))
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, doc_id, text) to a row for each chunk."""
    for part in sliced(parts):
        row, start, size, digests, again = [], [], [], [], []
        for i, x in enumerate(part.column(3)):
            data = x.as_py().encode("utf-8", "surrogatepass")
            ends = chunk_ends(data)
            begins = [0, *ends[:-1]][: len(ends)]
            own = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins, ends)]
            seen: set[bytes] = set()
            for d in own:
                again.append(d in seen)
                seen.add(d)
            row += [i] * len(ends)
            start += begins
            size += [b - a for a, b in zip(begins, ends)]
            digests += own
        at = pa.array(row, pa.int64())
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)
        columns = [*(part.column(k).take(at) for k in range(3)), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(again, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "start", "size", "h1", "h2", "again"])


def _repeats(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, doc_id, k1, k2, start, size, again, hot, first) sorted by the first three, null ids last: those of
    digests that occur twice, with gone. Rows of a digest are together but for hot ones, which know the smallest id, first.
    Only the first row of the last digest is held."""
    held: pa.RecordBatch | None = None
    told = False  # whether the held row has been given
    for part in parts:
        if not part.num_rows:
            continue
        rows = pa.Table.from_batches([held, part]).combine_chunks() if held is not None else pa.Table.from_batches([part])
        h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
        doc, none = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_null().to_numpy()
        first = np.flatnonzero(np.insert((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), 0, True))
        size = np.diff(np.append(first, len(h1)))
        lead = np.repeat(first, size)
        hot = rows["hot"].fill_null(False).to_numpy()
        least = np.where(hot, rows["first"].fill_null(0).to_numpy(), doc[lead])
        least_none = np.where(hot, rows["first"].is_null().to_numpy(), none[lead])
        gone = rows["again"].to_numpy() | (none != least_none) | ((doc != least) & ~none)
        stays = (np.repeat(size, size) > 1) | hot
        if held is not None and told:
            stays[0] = False
        out = rows.append_column("gone", pa.array(gone)).filter(pa.array(stays)).select(["k1", "k2", "start", "size", "gone"])
        yield from out.to_batches()
        told = bool(size[-1] > 1 or hot[-1]) or (told and held is not None and len(first) == 1)
        held = rows.slice(int(first[-1]), 1).combine_chunks().to_batches()[0]


def _cut(min_run: int):
    """Rows (doc_id, text, found: repeated chunks) to results."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            out: list[tuple] = []
            for doc_id, text, found in zip(part.column(0), part.column(1), part.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                repeated = removed = spans = 0
                kept, at = [], 0
                chunks = sorted({(c["start"], c["size"], c["gone"]) for c in found.as_py() or ()})
                runs: list[list] = []
                for c in chunks:
                    if runs and runs[-1][-1][0] + runs[-1][-1][1] == c[0]:
                        runs[-1].append(c)
                    else:
                        runs.append([c])
                last_gone = -1
                for r in runs:
                    total = sum(size for _, size, _ in r)
                    if total < min(min_run, len(data)):
                        continue
                    repeated += total
                    for start, size, gone in r:
                        if gone:
                            removed += size
                            spans += start != last_gone
                            kept.append(data[at:start])
                            at = last_gone = start + size
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((doc_id.as_py(), len(data), repeated, removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    return run


def chunk_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_bytes, n_repeated (bytes of chunks that occur
    elsewhere too, in runs of ``min_run`` bytes at least, or a whole text), n_removed (those of them that an earlier copy
    makes redundant), n_spans (maximal removed runs), kept_sha256 of the remaining bytes and kept_text (a character cut
    in two is left out).

    The copy that stays is the first one in the document of smallest doc_id; rows with equal id and text are one
    document and don't remove each other's chunks, but count as repeats; where all copies lack an id, all stay. Null
    and empty texts have no chunks. An empty table gives no rows; extra columns are ignored."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunked = lambda df: df.select(*_keys(), "doc_id", "text").mapInArrow(_chunks, "k1 long, k2 long, doc_id long, start int, size int, h1 long, h2 long, again boolean")
    # Chunks that a share of all rows may hold would meet in one task. A sample of documents finds them, for the balance
    # of tasks alone: their counts combine before the shuffle and their rows stay where they are.
    seen = materialize(chunked(base.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(SAMPLED)) == 0)).groupBy("h1", "h2").agg(F.count("*").alias("n")))
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(materialize(seen.where(F.col("n") > max(20, total // HOT)).select("h1", "h2", F.lit(True).alias("hot"))))  # HOT rows at most
    chunks = chunked(base)
    only = lambda c: F.when(F.col("hot"), F.col(c)).alias(c)  # noqa: E731  all other rows are one group
    firsts = materialize(chunks.join(hot, ["h1", "h2"], "left").groupBy(only("h1"), only("h2")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    firsts = F.broadcast(firsts.where("h1 is not null and n > 1").select("h1", "h2", "first", F.lit(True).alias("hot")))
    marked = chunks.join(firsts, ["h1", "h2"], "left").select("h1", "h2", "doc_id", "k1", "k2", "start", "size", "again", "hot", "first")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k1", "start"), F.lit(4096))).otherwise(-1)
    dealt = marked.withColumn("salt", salt).repartition("h1", "h2", "salt").drop("salt").sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_last())
    repeats = dealt.mapInArrow(_repeats, "k1 long, k2 long, start int, size int, gone boolean")
    found = materialize(repeats.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size", "gone")).alias("found")))  # no more than a document has chunks
    rows = looked_up(base.select("*", *_keys()), found, ["k1", "k2"]).select("doc_id", "text", "found")
    return rows.mapInArrow(_cut(min_run), "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
