"""Exact substring dedup by blockwise suffix sorting with cover samples.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else in the corpus. All suffixes can't be
sorted at once, so they are sorted one bucket at a time. Several lengths can be judged in one pass.

* Cover: of every window of the least length the k-gram of least hash is its anchor (the leftmost; at a run of equal
  k-grams at the window's start, the run's end). As the choice depends on the window's bytes alone, two equal windows
  have their anchors at the same offset, as in a difference cover, with 1 to 2 % of positions in the sample. Suffixes
  whose windows share an anchor k-gram form a bucket; a k-gram that occurs once can't anchor a repeat.
* Ranks: in a bucket, columns are counted from the anchor. Strings at every 16th column, the cover sample, get ranks
  by doubling: 8, 16, 32, ... bytes. A suffix is compared by the rank of its next sample column, which settles
  ties of all but 16 bytes of the length at once, and by the 16 bytes around.
* Memory: a task holds one batch of buckets. A bucket of more than ``bucket_rows`` suffix anchors is dealt by window
  digest instead, counted with partial aggregates, so no single passage ever meets in one task.

Equal texts are one text with a count; if it is two or more, every byte of a text of ``length`` bytes is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import BROADCAST_ROWS, looked_up, materialize, only_keys, sliced

GRAM = 64
#: A passage of 50 words is longer than this in any language of short words.
PASSAGE = 208
SLICE = 1 << 18  # bytes of a text looked at together
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 77) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(SLICE, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position of at most SLICE bytes, mixed."""
    up, down = _powers()
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * down[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * up[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slice_anchors(data: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    h = gram_hashes(data)
    reach = least - GRAM  # windows of an anchor start up to this far before it
    m, w = len(h), reach + 1
    place = np.arange(m, dtype=np.uint64)
    low = np.uint64(SLICE - 1)
    key = (h & ~low) | place  # least hash, then leftmost
    pad = -m % w
    full = np.concatenate([key, np.full(pad, ~np.uint64(0))]) if pad else key
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = m - w + 1
    smallest = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    anchor = (smallest & low).astype(np.int64)
    at = np.arange(windows)
    same = (key[1:] & ~low) == (key[:-1] & ~low)
    flats: list[tuple[int, int]] = []
    first = np.zeros(0, np.int64)
    if same.any():
        stop = np.where(np.append(same, False), m, np.arange(m))
        stop = np.minimum.accumulate(stop[::-1])[::-1]  # last k-gram of the run of equal ones
        lead = anchor == at
        anchor[lead] = stop[anchor[lead]]
        flat = lead & (anchor >= at + reach)  # the whole window is one byte repeated
        if flat.any():
            where = np.flatnonzero(flat)
            begin = where[np.insert(np.diff(where) != 1, 0, True)]
            end = where[np.append(np.diff(where) != 1, True)]
            flats = [(int(a), int(b) + least) for a, b in zip(begin, end)]
            # a longer window that leaves the run: its anchor lies a whole number of steps before the run's end
            gap = anchor[where] - where
            leaves = gap < most - GRAM
            first = np.concatenate([begin, (where + gap % (reach + 1))[leaves]])
            anchor = anchor[~flat]
    found = np.unique(np.concatenate([anchor, first]))
    return found, h[found].view(np.int64), flats


def anchors(data: bytes, least: int, most: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Positions and hashes of the anchors of a text for windows of ``least`` to ``most`` bytes, and the runs of a single
    byte that are ``least`` long."""
    n = len(data)
    if n < least:
        return [], [], []
    whole = np.frombuffer(data, np.uint8)
    found: dict[int, int] = {}
    flats: list[tuple[int, int]] = []
    for lo in range(0, max(n - most, 0) + 1, SLICE - most + 1):
        pos, h, runs = _slice_anchors(whole[lo : lo + SLICE], least, most)
        found.update(zip((pos + lo).tolist(), h.tolist()))
        for a, b in runs:
            if flats and a + lo < flats[-1][1]:  # one run, seen from two slices
                flats[-1] = (flats[-1][0], b + lo)
            else:
                flats.append((a + lo, b + lo))
    order = sorted(found)
    return order, [found[p] for p in order], flats


def _anchor_rows(lengths: tuple[int, ...]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
        for part in sliced(parts):
            got = [anchors(x.as_py().encode("utf-8", "surrogatepass"), lengths[0], lengths[-1]) for x in part.column(2)]
            # in a run of one byte longer than a length, every string of that length occurs twice
            spans = [[{"k": k, "a": a, "b": b} for a, b in g[2] for k, n in enumerate(lengths) if b - a > n] for g in got]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array(spans, kind)],
                ["k1", "k2", "pos", "h", "spans"],
            )

    return run


def _contexts(lengths: tuple[int, ...]):
    """Rows (k1, k2, text, spots) to a row for each anchor with the bytes around."""
    reach, most = lengths[0] - GRAM, lengths[-1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts, 64):
            row, h, pos, off, ctx = [], [], [], [], []
            for i, (text, spots) in enumerate(zip(part.column(2), part.column(3))):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for s in spots.as_py():
                    p = s["pos"]
                    a = max(0, p - reach)
                    row.append(i)
                    h.append(s["h"])
                    pos.append(p)
                    off.append(p - a)
                    ctx.append(data[a : p + most])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(pos, pa.int32()), pa.array(off, pa.int32()), pa.array(ctx, pa.binary())], ["h", "k1", "k2", "pos", "off", "ctx"])

    return run


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal for equal ones, in order."""
    return np.unique(x, return_inverse=True)[1].reshape(x.shape).astype(np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dense((a << np.uint64(32)) | b)


def repeated_starts(group: np.ndarray, times: np.ndarray, off: np.ndarray, ctx: list[bytes], lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Sort the suffixes of a batch of buckets: for every length, each context (row) and start column 0 .. reach, whether
    the window from there occurs at the same column of another context of its group, or the context itself has
    ``times`` > 1."""
    n, reach = len(ctx), lengths[0] - GRAM
    text = np.zeros((n, reach + lengths[-1]), np.uint8)
    left = reach - off
    size = np.array([len(c) for c in ctx])
    for i, c in enumerate(ctx):
        text[i, left[i] : left[i] + len(c)] = np.frombuffer(c, np.uint8)
    words = text.view(">u8").astype(np.uint64)
    r8 = _dense(words)
    ranks = [_pair(r8[:, 0::2], r8[:, 1::2])]  # of 16, 32, 64, ... bytes from every 16th column
    while 16 << len(ranks) <= lengths[-1]:
        step = 1 << (len(ranks) - 1)
        ranks.append(_pair(ranks[-1][:, :-step], ranks[-1][:, step:]))
    columns = reach // 16 + 1
    group = _dense(group)
    head = np.arange(16)
    result: list[np.ndarray] = []
    for length in lengths:
        middle = length // 16 - 1  # all but 16 bytes, in steps of 16: two ranks that may overlap
        r = ranks[middle.bit_length() - 1]
        beyond = middle - (1 << (middle.bit_length() - 1))
        tied = _pair(r[:, :columns], r[:, beyond : beyond + columns])
        out = np.zeros((n, reach + 1), bool)
        for j in range(columns):
            start = 16 * j - head
            start = start[start >= 0]
            tie = _pair(group, tied[:, j])
            again = np.bincount(tie.astype(np.int64), times)[tie.astype(np.int64)] > 1
            if result:  # what doesn't repeat at a shorter length doesn't at a longer one
                again &= result[-1][:, start].any(axis=1)
            live = np.flatnonzero(again)
            if not len(live):
                continue
            row, which = np.nonzero((start[None] >= left[live][:, None]) & (start[None] + length <= (left + size)[live][:, None]))
            if not len(row):
                continue
            s, row = start[which], live[row]
            # the bytes before the sample column and those behind its tie: 16 in all
            at = s[:, None] + np.arange(16)[None]
            edge = text[row[:, None], np.where(at < 16 * j, at, at + 16 * middle)].copy().view(">u8").astype(np.uint64)
            rank = _pair(_pair(_pair(tie[row], which.astype(np.uint64)), _dense(edge[:, 0])), _dense(edge[:, 1])).astype(np.int64)
            out[row, s] = np.bincount(rank, times[row])[rank] > 1
        result.append(out)
    return result


def _solve(lengths: tuple[int, ...], batch_rows: int = 3000):
    """Rows (h, k1, k2, pos, off, ctx) sorted by h to spans (k1, k2, k, a, b) of bytes repeated at the k-th length."""
    reach = lengths[0] - GRAM

    def solve(h, k1, k2, pos, off, ctx):
        order: dict[tuple, int] = {}
        member = np.fromiter((order.setdefault(x, len(order)) for x in zip(h.tolist(), off.tolist(), ctx)), np.int64, len(ctx))
        times = np.bincount(member).astype(float)
        keys = list(order)
        group = np.array([k[0] for k in keys], np.int64).view(np.uint64)
        hits = repeated_starts(group, times, np.array([k[1] for k in keys], np.int64), [k[2] for k in keys], lengths)
        found = []
        for which, (hit, length) in enumerate(zip(hits, lengths)):
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            if not len(row):
                break
            runs = np.searchsorted(row, np.arange(len(keys) + 1))
            n = (runs[1:] - runs[:-1])[member]
            who = np.repeat(np.arange(len(ctx)), n)
            r = runs[:-1][member].repeat(n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            base = pos[who].astype(np.int64) - reach
            found.append((k1[who], k2[who], np.full(len(who), which, np.int32), (base + begin[r]).astype(np.int32), (base + end[r] - 1 + length).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["k1", "k2", "k", "a", "b"]) if found else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for whole in parts:
            for lo in range(0, whole.num_rows, batch_rows):
                part = whole.slice(lo, batch_rows)
                held.append([part.column(k).to_numpy() for k in range(5)] + [part.column(5).to_pylist()])
                h = held[-1][0]
                start = int(np.searchsorted(h, h[-1], "left"))
                if start == 0 and (len(held) == 1 or held[0][0][0] == h[-1]):
                    continue  # one bucket so far; its size is bounded
                join = lambda rows: [np.concatenate([r[k] for r in rows]) for k in range(5)] + [[c for r in rows for c in r[5]]]
                done = held[:-1] + ([[x[:start] for x in held[-1]]] if start else [])
                if done and (out := solve(*join(done))):
                    yield out
                held = [[x[start:] for x in held[-1]]]
        if held:
            out = solve(*[np.concatenate([r[k] for r in held]) for k in range(5)], [c for r in held for c in r[5]])
            if out:
                yield out

    return run


def _window_digests(lengths: tuple[int, ...]):
    """Rows (h, k1, k2, pos, off, ctx) of large buckets to a row for each window, by digest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                row, which, start, digests = [], [], [], []
                for i, (pos, off, ctx) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist())):
                    for k, n in enumerate(lengths):
                        for a in range(min(len(ctx) - n, off) + 1):
                            row.append(i)
                            which.append(k)
                            start.append(pos - off + a)
                            digests.append(xxhash.xxh3_128_digest(ctx[a : a + n]))
                at = pa.array(row, pa.int64())
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), part.column(1).take(at), part.column(2).take(at), pa.array(which, pa.int32()), pa.array(start, pa.int32())], ["d1", "d2", "k1", "k2", "k", "a"]
                )

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal runs; adjacent ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])


def _gone(n: int, length: int, whole, spans, k: int) -> list[tuple[int, int]]:
    """Maximal runs of a text's bytes that repeat at the k-th length."""
    if whole and n >= length:
        return [(0, n)]
    return merge_spans([(s["a"], s["b"]) for s in spans or () if s["k"] == k])


def _cut(lengths: tuple[int, ...]):
    """Rows (doc_id, text, whole, spans) to results."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            out = []
            for doc_id, text, whole, spans in zip(*(part.column(k) for k in range(4))):
                data, whole, spans = text.as_py().encode("utf-8", "surrogatepass"), whole.as_py(), spans.as_py()
                gone = _gone(len(data), lengths[-1], whole, spans, len(lengths) - 1)
                repeated = sum(b - a for a, b in _gone(len(data), lengths[0], whole, spans, 0))
                rest = _without(data, gone)
                out.append((doc_id.as_py(), len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), repeated, rest.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept_text"])

    return run


def repeated_spans(texts: DataFrame, lengths: tuple[int, ...], bucket_rows: int = 20_000) -> DataFrame:
    """``texts`` has k1, k2 (128 bits of digest) and text: rows (k1, k2, whole, spans) for texts with bytes repeated at
    one of ``lengths``, which ascend and are multiples of 16. spans holds (k, a, b): bytes a to b repeat at the k-th
    length; whole tells that the text itself occurs twice or more."""
    if list(lengths) != sorted(set(lengths)) or any(n % 16 for n in lengths) or lengths[0] < GRAM + 16:
        raise ValueError("lengths must ascend, be multiples of 16 and exceed the k-gram")
    long = texts.where(F.octet_length("text") >= lengths[0])
    kind = "k:int,a:int,b:int"
    marked = long.select("k1", "k2", "text").mapInArrow(_anchor_rows(lengths), f"k1 long, k2 long, pos array<int>, h array<long>, spans array<struct<{kind}>>")
    once = materialize(marked.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("pos").alias("pos"), F.first("h").alias("h"), F.first("spans").alias("spans")))
    each = once.select("k1", "k2", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("k1", "k2", "x.pos", "x.h")
    often = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    spots = each.join(often, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "h")).alias("spots"))
    spots = materialize(spots)
    bare = only_keys(long.select("k1", "k2", "text"), spots, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    contexts = bare.join(spots, ["k1", "k2"]).select("k1", "k2", "text", "spots").mapInArrow(_contexts(lengths), "h long, k1 long, k2 long, pos int, off int, ctx binary")
    large = often.where(F.col("n") > bucket_rows).select("h")
    n_large = large.count()
    span = "k1 long, k2 long, k int, a int, b int"
    if not n_large:
        found = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_solve(lengths), span)
    else:
        contexts = materialize(contexts)
        listed = F.broadcast(large) if n_large <= 10_000 else large
        usual = contexts.join(listed, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_solve(lengths), span)
        windows = materialize(contexts.join(listed, "h", "left_semi").mapInArrow(_window_digests(lengths), "d1 long, d2 long, k1 long, k2 long, k int, a int"))
        # windows of two anchors of a text are listed twice: one place of each counts
        places = windows.select("d1", "d2", "k", F.xxhash64("k1", "k2", "a").alias("place"))
        again = materialize(places.groupBy("d1", "d2", "k").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y").select("d1", "d2", "k"))
        again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again  # a common passage has few distinct windows
        sizes = F.array(*[F.lit(n) for n in lengths])
        found = usual.unionByName(windows.join(again, ["d1", "d2", "k"]).select("k1", "k2", "k", "a", (F.col("a") + F.get(sizes, F.col("k"))).alias("b")).distinct())
    nothing = F.lit(None).cast(f"struct<{kind}>")
    whole = once.where("copies > 1").select("k1", "k2", F.lit(True).alias("whole"), nothing.alias("span"))
    local = once.where("copies = 1 and size(spans) > 0").select("k1", "k2", F.lit(False).alias("whole"), F.explode("spans").alias("span"))
    spans = found.select("k1", "k2", F.lit(False).alias("whole"), F.struct("k", "a", "b").alias("span"))
    return whole.unionByName(local).unionByName(spans).groupBy("k1", "k2").agg(F.max("whole").alias("whole"), F.collect_list("span").alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 400, passage: int = PASSAGE, bucket_rows: int = 20_000) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 of the remaining bytes, n_repeated (bytes covered by a string of ``passage`` bytes that starts elsewhere
    too, whether removed or not) and kept_text (a character cut in two is left out).

    A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere in the corpus, the same
    document included; strings don't cross documents and are judged on the input. Null texts are empty; texts under
    ``length`` bytes lose nothing; repeated rows, equal and null ids are documents of their own, so copies of a text
    lose it all. An empty table gives no rows; extra columns are ignored."""
    lengths = tuple(sorted({passage, length}))
    if lengths[-1] != length:
        raise ValueError("a passage that is reported can't be longer than what is removed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    found = materialize(repeated_spans(base, lengths, bucket_rows))
    rows = looked_up(base, found, ["k1", "k2"]).select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    return rows.mapInArrow(_cut(lengths), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept_text string")


def remove_repeats(docs: DataFrame, length: int = PASSAGE, bucket_rows: int = 20_000) -> DataFrame:
    """``docs`` with the bytes that strings of ``length`` bytes repeat cut from its texts, n_chars counted anew if there
    is such a column, and without the documents that lose every word; all other rows and columns stay. Null texts stay
    null; copies of a text lose it all, so run it on deduplicated documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"kf_k1": F.xxhash64(text), "kf_k2": F.xxhash64(F.lit(1), text)})
    found = repeated_spans(keyed.select(F.col("kf_k1").alias("k1"), F.col("kf_k2").alias("k2"), text.alias("text")), (length,), bucket_rows)
    found = materialize(found.select(F.col("k1").alias("kf_k1"), F.col("k2").alias("kf_k2"), F.col("whole").alias("kf_whole"), F.col("spans").alias("kf_spans")))
    rows = looked_up(keyed, found, ["kf_k1", "kf_k2"]).select(*docs.columns, F.coalesce("kf_whole", F.lit(False)).alias("kf_whole"), "kf_spans")
    names = docs.columns
    at, n = names.index("text"), len(names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            texts, stays = [], []
            for text, whole, spans in zip(part.column(at), part.column(n), part.column(n + 1)):
                kept = text.as_py()
                if whole.as_py() or spans.as_py():
                    data = kept.encode("utf-8", "surrogatepass")
                    kept = _without(data, _gone(len(data), length, whole.as_py(), spans.as_py(), 0)).decode("utf-8", "ignore")
                stays.append(kept is None or kept == text.as_py() or bool(kept.strip()))
                texts.append(kept)
            columns = [part.column(k) for k in range(n)]
            columns[at] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out.filter(pa.array(stays, pa.bool_()))

    cut = rows.mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
