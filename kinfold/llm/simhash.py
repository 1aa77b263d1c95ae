"""SimHash near-duplicates by sharded BK-trees.

Fingerprints come from word shingles. Two fingerprints within ``radius`` bits agree on at least m - radius of
m bit blocks, so every choice of m - radius blocks is a shard key and each close pair meets in some shard.
A shard builds its BK-tree (children keyed by the integer Hamming distance to the parent) and searches it by
following only edges within the radius. Trees of a shard with more than ``shard_rows`` fingerprints are cut into
chunk trees, each sent to the tasks that hold one chunk of queries; no tree outgrows that size and nothing is
broadcast that grows with the data. Equal fingerprints are one node, and a task returns a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import BROADCAST_ROWS, materialize, only_keys, sliced
from kinfold.llm.components import connected_components, forest

#: The 192 bits of a text in the near-duplicate stage.
PRINTS = ["fp", "fp2", "fp3"]

#: Pairs of (query, tree node) looked at together; bounds the memory of a search.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text: lower-case A-Z, words split at ASCII white space, shingles joined by one space.
    Fewer words than a shingle give one shingle of all words; no words give zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    else:
        line, digest = b" ".join(found), xxhash.xxh64_intdigest
        at = list(accumulate(map(len, found), lambda x, n: x + n + 1, initial=0))
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(at, at[shingle:])]
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.array(hashes[k : k + 4096], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint's bits as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            got = np.fromiter((fingerprint(x.as_py(), shingle) for x in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees of many groups at once, built and searched level by level with array operations.

    ``group`` tells the tree of each item; the first item of a group is its root. A node's children are kept
    sorted by (node, edge), so that the edges distance - radius .. distance + radius are one slice."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        _, first = np.unique(group, return_index=True)
        self.roots, _, self.tree_of = first, None, np.searchsorted(np.unique(group), group)
        parent = first[self.tree_of]
        edge = np.zeros(n, np.int64)
        todo = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = parent.copy()
        while len(todo):
            d = np.bitwise_count(value[todo] ^ value[at[todo]]).astype(np.int64)
            _, lead, where = np.unique(at[todo] * 65 + d, return_index=True, return_inverse=True)
            head = todo[lead]  # the first comer becomes the child on that edge; the others go down to it
            parent[head], edge[head] = at[head], d[lead]
            at[todo] = head[where]
            todo = np.setdiff1d(todo, head, assume_unique=True)
        child = np.setdiff1d(np.arange(n), first, assume_unique=True)
        key = parent[child] * 65 + edge[child]
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], child[order]

    def search(self, query: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of the query, item) within the radius; ``tree`` is the tree that each query searches."""
        stack = [(np.arange(len(query)), self.roots[tree])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(query[q] ^ self.value[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            total = int(n.sum())
            if total:
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                stack.append((np.repeat(q, n), self.child[np.repeat(low, n) + step]))


def block_masks(radius: int, expected: int, shard_rows: int = 256) -> list[int]:
    """Bit masks whose values are the shard keys: the fewest blocks for which ``expected`` random fingerprints
    leave at most ``shard_rows`` in a shard, at no more than 128 keys a fingerprint."""
    for m in range(radius + 1, min(64, radius + 4) + 1):
        if comb(m + 1, radius) > 128 or expected >> (64 * (m - radius) // m) <= shard_rows:
            break
    cuts = [64 * k // m for k in range(m + 1)]
    block = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(m)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(m), m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int, both: int | None = None, flush: int = 40_000):
    """Tasks get rows (shard, side, fp[, fp2, ..., label, id]) sorted by shard, equal shards together. side 0: in the tree
    and a query; 1: in the tree only; 2: a query only. Links need at most ``radius`` bits of fp to differ and, if ``both``
    is given, at most that many of all prints together; close pairs are linked first, and rows of equal label are linked
    already. Gives (a, b): fps, or ids."""

    def solve(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, *more: np.ndarray) -> pa.RecordBatch | None:
        others = [x.view(np.uint64) for x in more[:-2]]
        value = fp.view(np.uint64)
        inside = np.flatnonzero(side < 2)
        asking = np.flatnonzero(side != 1)
        if not len(inside) or not len(asking):
            return None
        trees = BKForest(shard[inside], value[inside])
        known = shard[inside][trees.roots]
        tree = np.minimum(np.searchsorted(known, shard[asking]), len(known) - 1)
        asking, tree = asking[known[tree] == shard[asking]], tree[known[tree] == shard[asking]]
        root, out = np.arange(len(fp)), []
        if both is not None:
            _, first, place = np.unique(more[-2], return_index=True, return_inverse=True)
            root = first[place]
        for most in (None,) if both is None else (both // 3, 2 * both // 3, both):
            for q, item in trees.search(value[asking], tree, radius if most is None else min(radius, most)):
                left, right = asking[q], inside[item]
                if most is not None:
                    near = sum(np.bitwise_count(x[left] ^ x[right]).astype(np.int64) for x in (value, *others)) <= most
                    left, right = left[near], right[near]
                root, used = forest(len(fp), left, right, root)
                out.append((left[used], right[used]))
        left, right = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))
        name = more[-1] if both is not None else fp
        return pa.RecordBatch.from_arrays([pa.array(name[left]), pa.array(name[right])], ["a", "b"]) if len(left) else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part in parts:
            if not part.num_rows:
                continue
            held.append(tuple(part.column(k).to_numpy() for k in range(part.num_columns)))
            size += part.num_rows
            if size < flush:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            start = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last shard may go on in the next batch
            if start and (out := solve(*(c[:start] for c in columns))):
                yield out
            held, size = [tuple(c[start:] for c in columns)], len(columns[0]) - start
        if held and (out := solve(*(np.concatenate(x) for x in zip(*held)))):
            yield out

    return run


def _deal(keyed: DataFrame, shard_rows: int) -> DataFrame:
    """Rows (shard, fp, ...) with a side, equal shards together and sorted. A shard of more than ``shard_rows`` rows
    is cut into chunks, and each pair of chunks is a shard of its own."""
    rest = [c for c in keyed.columns if c not in ("shard", "fp")]
    large = materialize(keyed.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("chunks")))
    n_large = large.count()
    out = keyed.select("shard", F.lit(0).alias("side"), "fp", *rest)
    if n_large:
        listed = F.broadcast(large) if n_large <= 10_000 else large
        out = out.join(listed, "shard", "left_anti")
        one = "id" if "id" in rest else "fp"
        chunk = keyed.join(listed, "shard").withColumn("chunk", F.pmod(F.xxhash64(one, F.lit(7)), F.col("chunks")).cast("int"))
        other = chunk.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
        cell = F.xxhash64("shard", F.least("chunk", "other"), F.greatest("chunk", "other"))
        out = out.unionByName(other.select(cell.alias("shard"), side.alias("side"), "fp", *rest))
    return out.repartition(F.col("shard")).sortWithinPartitions("shard")


def hamming_links(fps: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``radius`` or fewer differing bits: a spanning forest of
    every shard's links, so that connected components over them are those over all links."""
    masks = [_signed(x) for x in block_masks(radius, fps.count())]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("choice", "bits"))
    keyed = keyed.select("fp", F.xxhash64("choice", "bits").alias("shard"))  # two keys in one shard cost time, not links
    return _deal(keyed, shard_rows).mapInArrow(_links(radius), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): one row per input row with doc_id, fingerprint (16 hex
    digits) and component_id, the smallest doc_id reachable by links.

    Null and blank texts have fingerprint zero and link like any other; repeated rows and equal ids are kept; rows
    without a doc_id take part, but never name a group while another member has an id. Extra columns are ignored.
    An empty table gives no rows."""
    found = materialize(fingerprints(docs, shingle))
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(hamming_links(nodes.select("fp"), radius))
    member = materialize(nodes.join(parts.withColumnRenamed("node", "fp"), "fp"))
    least = member.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = member.join(least, "label").select("fp", "component_id")
    group = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return found.join(group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sampled_masks(expected: int, bits_off: int = 27, recall: float = 0.97, seed: int = 42) -> list[tuple[int, int]]:
    """Masks (of fp, of fp2) of random bit subsets of their 128, large enough to leave some 64 of ``expected`` random
    fingerprints in a shard, and so many that ones ``bits_off`` bits apart share a shard with probability ``recall``."""
    size = int(np.clip(np.ceil(np.log2(max(expected, 1) / 64)), 6, 24))
    met = np.prod([(128 - bits_off - i) / (128 - i) for i in range(size)])
    rng = np.random.default_rng(seed)
    picks = [rng.permutation(128)[:size] for _ in range(int(np.ceil(np.log(1 - recall) / np.log(1 - met))))]
    return [(sum(1 << int(b) for b in p if b < 64), sum(1 << int(b - 64) for b in p if b >= 64)) for p in picks]


def shingle_set(text: str | None, shingle: int) -> list[int]:
    """32-bit hashes of a text's word shingles; two of a text's shingles hardly ever share one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    pieces = {b" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))}
    return sorted({(xxhash.xxh3_64_intdigest(p) >> 32) - (1 << 31) for p in pieces})


def set_prints(text: str | None, shingle: int) -> np.ndarray:
    """192-bit SimHash over a text's distinct word shingles, as its similarity is defined: how often a passage repeats
    doesn't matter."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(found)
    at = list(accumulate(map(len, found), lambda x, n: x + n + 1, initial=0))
    pieces = {line[a : b - 1] for a, b in zip(at, at[shingle:])} or {line}
    bits = np.zeros(192, np.int64)
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.uint64).reshape(-1, 2)
    for k in range(0, len(digests), 4096):
        part = digests[k : k + 4096]
        third = (part[:, 0] ^ (part[:, 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part[:, 1]
        third = (third ^ (third >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        part = np.column_stack([part, third ^ (third >> np.uint64(30))])
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 24), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(digests), bitorder="little").view(np.int64)


def _hashed(shingle: int, what: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(parts):
            text = [x.as_py() for x in part.column(1)]
            if what == "set":
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x, shingle) for x in text], pa.list_(pa.int32()))], ["text_key", "shingles"])
            else:
                three = np.array([set_prints(x, shingle) for x in text], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(three[:, k].copy()) for k in range(3))], ["text_key", *PRINTS])

    return run


def _settled(similarity: float, both: int):
    """Tasks get rows (shard, side, fp, fp2, fp3, id, shingles) sorted by shard, equal shards together, sides as in ``_links``.
    Gives a spanning forest (a, b) of the pairs within ``both`` bits that the exact similarity confirms. Close pairs come
    first, and a pair that confirmed links already join isn't compared: a group of copies costs a comparison a member."""

    def solve(rows: pa.Table, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        side, ident = rows["side"].to_numpy(), rows["id"].to_numpy()
        prints = np.stack([rows[c].to_numpy().view(np.uint64) for c in PRINTS])
        held = rows["shingles"].combine_chunks()
        size = np.diff(held.offsets.to_numpy()).astype(np.int64)
        begin = np.cumsum(size) - size
        codes = np.unique(held.flatten().to_numpy(), return_inverse=True)[1]
        mark = np.zeros(len(codes), np.int64)
        group = np.arange(len(side))
        inside, least = np.flatnonzero(side < 2), -1
        for most in (both // 3, 2 * both // 3, both):
            for i in np.flatnonzero(side != 1):
                near = inside[(group[inside] != group[i]) & ((inside > i) | (side[i] == 2))]
                near = near[np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i])]
                off = np.bitwise_count(prints[:, near] ^ prints[:, i : i + 1]).sum(axis=0, dtype=np.int64)
                near = near[(off > least) & (off <= most)]
                if not len(near):
                    continue
                own, n = codes[begin[i] : begin[i] + size[i]], size[near]
                first = np.cumsum(n) - n
                mark[own] = 1
                shared = np.add.reduceat(mark[codes[np.arange(n.sum()) + np.repeat(begin[near] - first, n)]], first)
                mark[own] = 0
                near = near[shared >= similarity * (n + size[i] - shared)]
                if len(near):
                    near = near[np.unique(group[near], return_index=True)[1]]
                    out.append((np.full(len(near), ident[i]), ident[near]))
                    group[np.isin(group, group[near])] = group[i]
            least = most

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for part in parts:
            out: list[tuple[np.ndarray, np.ndarray]] = []
            shard = part.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and shard[lo] != last:
                        solve(pa.Table.from_batches(held), out)
                        held = []
                    held.append(part.slice(lo, hi - lo))
                    last = shard[lo]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])
        out = []
        if held:
            solve(pa.Table.from_batches(held), out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])

    return run


def _judged(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``links`` (a, b) with holds, whether their shingle sets are similar, and same, whether they are equal."""
    side = lambda i, s: sets.select(F.col("text_key").alias(i), F.col("shingles").alias(s))
    pairs = links.join(side("a", "x"), "a").join(side("b", "y"), "b")
    pairs = pairs.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size("x").alias("x"), F.size("y").alias("y"))
    return materialize(pairs.select("a", "b", (F.col("shared") >= similarity * (F.col("x") + F.col("y") - F.col("shared"))).alias("holds"), ((F.col("shared") == F.col("x")) & (F.col("shared") == F.col("y"))).alias("same")))


def similar_texts(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 20, both: int = 54, shard_rows: int = 4096, rounds: int = 4) -> DataFrame:
    """Groups of texts whose word-shingle sets have a Jaccard similarity of ``similarity`` or more. ``texts`` has
    text_key (equal for equal texts) and text; returns (text_key, part) for texts in groups of more than one key.

    Candidates are close SimHash pairs: within ``radius`` bits in BK-trees of shards by random bit subsets, and within
    ``both`` bits of 192. A spanning forest of them, and each text of equal bits with one of them, is checked on exact
    shingle sets. The bit subsets are tried in ``rounds``; texts that confirmed links join are no candidates of each other
    later, so a large group of copies costs a few comparisons a member. A forest link that the check refutes may have stood
    for true ones, so all pairs within ``both`` bits of such a group of candidates are compared: in one task, or in pairs
    of chunks if the group is large."""
    found = materialize(texts.select("text_key", "text").mapInArrow(_hashed(shingle, "fingerprints"), "text_key long, fp long, fp2 long, fp3 long").distinct())
    nodes = materialize(found.groupBy(*PRINTS).agg(F.min("text_key").alias("id")))
    masks = [(_signed(x), _signed(y)) for x, y in sampled_masks(nodes.count())]
    twins = found.join(nodes, PRINTS).where("text_key <> id").select(F.col("text_key").alias("a"), F.col("id").alias("b"))  # equal in all bits
    labels = sets = links = judged = None
    for r in range(rounds):
        some = list(enumerate(masks))[r::rounds]
        if not some:
            continue
        shards = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(x)), F.col("fp2").bitwiseAND(F.lit(y))) for k, (x, y) in some]
        known = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")) if labels is not None else nodes.withColumn("label", F.col("id"))
        keyed = known.select(*PRINTS, "label", "id", F.explode(F.array(*shards)).alias("shard")).select("shard", *PRINTS, "label", "id")
        new = _deal(keyed, shard_rows).mapInArrow(_links(radius, both), "a long, b long")
        new = new.unionByName(twins) if r == 0 else new
        new = materialize(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ends = new.select(F.col("a").alias("text_key")).union(new.select("b")).distinct()
        ends = ends.join(sets, "text_key", "left_anti") if sets is not None else ends
        more = only_keys(texts.select("text_key", "text"), ends, ["text_key"]).groupBy("text_key").agg(F.first("text").alias("text"))
        more = materialize(more.mapInArrow(_hashed(shingle, "set"), "text_key long, shingles array<int>"))
        sets = more if sets is None else sets.unionByName(more)
        one = _judged(new, sets, similarity)
        judged, links = (one, new) if judged is None else (judged.unionByName(one), links.unionByName(new))
        if r < rounds - 1:
            labels = materialize(connected_components(judged.where("holds").select("a", "b")).withColumnRenamed("node", "id"))
    true = judged.where("holds").select("a", "b")
    if judged.where("not holds").count():
        parts = materialize(connected_components(links))
        unclear = parts.join(judged.where("not holds").select(F.col("a").alias("node")).distinct(), "node").select("label").distinct()
        members = parts.join(unclear, "label").select(F.col("label").alias("shard"), F.col("node").alias("text_key"))
        members = members.join(judged.where("same").select(F.col("b").alias("text_key")), "text_key", "left_anti")  # its equal stands for it
        members = materialize(members.join(found, "text_key").join(sets, "text_key").select("shard", *PRINTS, F.col("text_key").alias("id"), "shingles"))
        true = true.unionByName(_deal(members, shard_rows // 2).mapInArrow(_settled(similarity, both), "a long, b long"))
    return connected_components(true).select(F.col("node").alias("text_key"), F.col("label").alias("part"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one document of each group of equal or similar texts: the
    one of smallest doc_id, rows without an id last; of repeated rows one stays. Null texts equal empty ones."""
    text_key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    row_key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    texts = docs.select(text_key.alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = similar_texts(texts, shingle, similarity)
    slim = docs.select(text_key.alias("text_key"), row_key.alias("kf_row"), F.col("doc_id").cast("long").alias("doc_id"))
    grouped = slim.join(parts, "text_key", "left").select(F.coalesce("part", F.xxhash64(F.lit("one"), F.col("text_key"))).alias("part"), "kf_row", "doc_id")
    stays = grouped.groupBy("part").agg(F.min_by("kf_row", F.struct(F.col("doc_id").isNull(), "doc_id", "kf_row")).alias("kf_row")).select("kf_row")
    many = slim.groupBy("kf_row").agg(F.count("*").alias("n")).where("n > 1").select("kf_row", F.lit(True).alias("kf_many"))
    stays = materialize(stays.join(many, "kf_row", "left").fillna(False, ["kf_many"]))
    listed = F.broadcast(stays) if stays.count() <= BROADCAST_ROWS else stays
    kept = docs.withColumn("kf_row", row_key).join(listed, "kf_row")
    first = F.row_number().over(Window.partitionBy("kf_row").orderBy("kf_row"))
    repeated = kept.where("kf_many").withColumn("kf_first", first).where("kf_first = 1")
    return kept.where("not kf_many").select(*docs.columns).unionByName(repeated.select(*docs.columns))
