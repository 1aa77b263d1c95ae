"""Candidate retrieval: blocked TF-IDF top-k over inverted indexes of bounded size.

A field's postings (entity, term, weight) come from the pool's statistics of its whole country and source, in DataFrame
operations. Records then travel as sparse vectors, one row each, to the cells they search or stand in; a cell with many
records is cut into chunks, and a task indexes one chunk of the pool and scores one chunk of queries against it. A term
that nearly all records share costs a few array operations there, where a join on terms would emit a row for every pair.
Each task returns the k best of every query; a ranking window, which Spark prunes early, merges them. Blocks are equal
keys, never a theta join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.sources.storage import materialize

#: Pool records indexed at once, chunks of them and queries that meet in a task, and scores held at once; they bound its
#: time and memory.
POOL_ROWS, POOL_CHUNKS, QUERY_ROWS, PRODUCTS = 16_384, 4, 32_768, 1 << 20
#: Terms that so many pairs of a query and a pool record share are scored by a matrix product, and as many terms at most.
MATRIX, MATRIX_TERMS = 0.004, 512


@dataclass(frozen=True)
class Field:
    """One text column of a search path. ``query_top`` keeps a query's terms of largest weight only (0: all)."""

    column: str
    analyzer: str = "word"  # or char_wb: 3-grams within padded words
    weight: float = 1.0
    min_df: int = 1
    max_df: float = 1.0
    query_top: int = 0


@dataclass(frozen=True)
class SearchPath:
    name: str
    fields: tuple[Field, ...]
    top_k: int


DEFAULT_PATHS = (
    SearchPath("addr", (Field("addr_norm", max_df=0.2),), 10),
    SearchPath("both", (Field("name_norm", "char_wb", 0.6, min_df=2), Field("addr_norm", weight=0.4, max_df=0.2)), 20),
)


def terms(text: Column, analyzer: str) -> Column:
    """Terms of a text, repeats included. word: maximal runs of letters, digits and underscores, case kept; char_wb:
    3-character windows of each word padded with a space on both sides."""
    if analyzer == "word":
        return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    padded = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))))


def term_weights(records: DataFrame, field: Field, keys: Sequence[str]) -> DataFrame:
    """(keys, entity_id, term, tf): 1 + ln of each term's count in a record."""
    found = records.select(*keys, "entity_id", F.explode(terms(F.coalesce(field.column, F.lit("")), field.analyzer)).alias("term"))
    return found.groupBy(*keys, "entity_id", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))


def fit_idf(pool: DataFrame, tf: DataFrame, field: Field, keys: Sequence[str]) -> DataFrame:
    """(keys, term, idf): ln((1 + n) / (1 + df)) + 1 for terms within the field's limits; n counts all pool records."""
    n = pool.groupBy(*keys).agg(F.count("*").alias("n"))
    df = tf.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    kept = (df.join(n, list(keys)) if keys else df.crossJoin(F.broadcast(n))).where((F.col("df") >= field.min_df) & (F.col("df") <= field.max_df * F.col("n")))
    return kept.select(*keys, "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def postings(tf: DataFrame, idf: DataFrame, field: Field, keys: Sequence[str], top: int = 0) -> DataFrame:
    """(keys, entity_id, term, w) of unit length per record, scaled by the root of the field's weight."""
    raw = tf.join(idf, [*keys, "term"]).select(*keys, "entity_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    whole = Window.partitionBy(*keys, "entity_id")
    if top:
        raw = raw.withColumn("r", F.row_number().over(whole.orderBy(F.desc("w"), "term"))).where(F.col("r") <= top).drop("r")
    scaled = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)) * float(field.weight) ** 0.5
    return raw.select(*keys, "entity_id", "term", scaled.alias("w"))


def block_keys(records: DataFrame, neighbors: DataFrame | None, query: bool) -> DataFrame:
    """(entity_id, block): a query with a state searches its state, neighbours (from, to) and pool records without a
    state; a query without one searches the block of all, where every pool record also stands."""
    state = F.coalesce("addr_state", F.lit(""))
    if not query:
        return records.select("entity_id", F.explode(F.array(state, F.lit("*"))).alias("block"))
    own = records.select("entity_id", F.explode(F.when(state == "", F.array(F.lit("*"))).otherwise(F.array(state, F.lit("")))).alias("block"))
    if neighbors is None:
        return own
    near = records.join(neighbors, F.col("addr_state") == F.col("from")).select("entity_id", F.col("to").alias("block"))
    return own.unionByName(near).distinct()


def _vectors(postings_of: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, entity_id, terms, ws): a sparse vector for each record over the terms of all fields, which are hashed."""
    each = None
    for k, p in enumerate(postings_of):
        one = p.select(*keys, "entity_id", F.struct(F.xxhash64(F.lit(k), "term").alias("t"), "w").alias("x"))
        each = one if each is None else each.unionByName(one)
    held = each.groupBy(*keys, "entity_id").agg(F.collect_list("x").alias("x"))  # no more than a record has terms
    return held.select(*keys, "entity_id", F.col("x.t").alias("terms"), F.col("x.w").alias("ws"))


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every entry of the vectors of ``rows``."""
    held = rows["terms"].combine_chunks()
    size = np.diff(held.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), held.flatten().to_numpy(), rows["ws"].combine_chunks().flatten().to_numpy()


def _spots(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``size`` places from ``begin`` on, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _firsts(q: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their query; ``q`` ascends."""
    return np.arange(len(q)) - np.searchsorted(q, q) < k


def _merged(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``columns`` the group of rows that are multiples of each other (to nine digits), and its factor to the
    first of them. Terms that always come together, like the grams of a word, are such rows: one of them tells all."""
    group, factor = np.zeros(len(columns), np.int64), np.ones(len(columns))
    known: dict[bytes, int] = {}
    for i, x in enumerate(columns):
        factor[i] = x[np.argmax(x != 0)]
        group[i] = known.setdefault(hashlib.blake2b((x / factor[i]).round(9).tobytes(), digest_size=16).digest(), len(known))
    first = np.unique(group, return_index=True)[1]
    return group, factor / factor[first][group]


class _Asked:
    """The queries of a task, and the best records for each among the pool chunks seen so far."""

    def __init__(self, rows: pa.Table, k: int, digits: int):
        self.k, self.digits, self.n = k, digits, rows.num_rows
        self.cell, self.ids = rows["cell"][0], rows["s1_id"].combine_chunks()
        self.row, self.term, self.w = _flat(rows)
        self.names = np.zeros(0, object)  # ids of pool records, in order; best holds (query, place among them, score)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.zeros(self.n)  # what a record must reach: the score of the k-th best, if there are so many

    def meet(self, pool: pa.Table) -> None:
        """Score all queries against a chunk of the pool. Scores in single precision, with a margin for their error, tell
        which pairs may be among the best; these are scored in double precision."""
        n, k = pool.num_rows, self.k
        p_row, p_term, p_w = _flat(pool)
        if not len(p_term) or not len(self.term):
            return
        known, p_at = np.unique(p_term, return_inverse=True)
        at = np.minimum(np.searchsorted(known, self.term), len(known) - 1)
        met = known[at] == self.term
        q_row, at, q_w = self.row[met], at[met], self.w[met]
        df, asked = np.bincount(p_at, minlength=len(known)), np.bincount(at, minlength=len(known))
        # a column of a matrix product costs as much as MATRIX products of weights for each pair
        gain = df / n * asked / self.n
        frequent = np.flatnonzero(gain > MATRIX)
        frequent = frequent[np.argsort(-gain[frequent])][:MATRIX_TERMS]
        column = np.full(len(known), -1)
        column[frequent] = np.arange(len(frequent))
        matrix = np.zeros((len(frequent), n))
        common = column[p_at] >= 0
        matrix[column[p_at[common]], p_row[common]] = p_w[common]
        group, factor = _merged(matrix)
        matrix = matrix[np.unique(group, return_index=True)[1]].astype(np.float32)
        by_term = np.flatnonzero(~common)
        by_term = by_term[np.argsort(p_at[by_term], kind="stable")]
        posting, weight = p_row[by_term], p_w[by_term].astype(np.float32)
        df[frequent] = 0
        begin = np.cumsum(df) - df
        size = np.bincount(p_row, minlength=n)
        start = np.cumsum(size) - size
        norm = lambda row, w: np.sqrt(np.bincount(row, w * w).max())
        margin = (len(frequent) + size.max() + 8) * 2.0**-23 * norm(p_row, p_w) * norm(self.row, self.w) + 10.0**-self.digits
        products = np.cumsum(df[at])
        block = max(1, PRODUCTS // max(n, len(known)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < self.n:
            first = np.searchsorted(q_row, lo)
            # queries whose rows of scores, and whose products, fit
            stop = int(np.searchsorted(products, (products[first - 1] if first else 0) + 4 * PRODUCTS, "right"))
            hi = int(q_row[stop]) if stop < len(q_row) else self.n
            hi = min(max(hi, lo + 1), lo + block, self.n)
            last = np.searchsorted(q_row, hi)
            row, a, w = q_row[first:last] - lo, at[first:last], q_w[first:last]
            dense = column[a] >= 0
            c = column[a[dense]]
            left = np.bincount(row[dense] * len(matrix) + group[c], w[dense] * factor[c], (hi - lo) * len(matrix))
            score = left.astype(np.float32).reshape(hi - lo, len(matrix)) @ matrix
            row_s, a_s, w_s = row[~dense], a[~dense], w[~dense].astype(np.float32)
            spot = _spots(begin[a_s], df[a_s])
            np.add.at(score.reshape(-1), np.repeat(row_s * n, df[a_s]) + posting[spot], np.repeat(w_s, df[a_s]) * weight[spot])
            floor = self.floor[lo:hi] - margin
            if n > k and not self.floor[lo:hi].all():
                # no k-th score of earlier chunks: the k-th of the maxima of parts of the chunk is no more than the k-th score
                wide = max(1, n // (8 * k))
                parts = n // wide
                top = score[:, : wide * parts].reshape(hi - lo, wide, parts).max(axis=1)
                floor = np.maximum(floor, np.partition(top, parts - k, axis=1)[:, parts - k] - 2 * margin)
            near = score >= np.maximum(floor, np.finfo(np.float32).tiny).astype(np.float32)[:, None]
            spot = np.flatnonzero(near)
            q, p = spot // n, spot % n
            if len(q):
                exact = np.zeros((hi - lo, len(known)))
                exact[row, a] = w
                each = size[p]
                spot = _spots(start[p], each)
                s = np.add.reduceat(exact[np.repeat(q, each), p_at[spot]] * p_w[spot], np.cumsum(each) - each).round(self.digits)
                keep = s > 0
                found.append((q[keep] + lo, p[keep], s[keep]))
            lo = hi
        if not found:
            return
        q, p, s = map(np.concatenate, zip(*found))
        names = np.concatenate([self.names, np.array(pool["cand_id"].to_pylist(), object)])
        order = np.argsort(names, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        q = np.concatenate([self.best[0], q])
        p = place[np.concatenate([self.best[1], p + len(self.names)])]
        s = np.concatenate([self.best[2], s])
        rank = np.lexsort((p, -s, q))
        rank = rank[_firsts(q[rank], k)]
        self.names, self.best = names[order], (q[rank], p[rank], s[rank])
        full = np.flatnonzero(np.bincount(self.best[0], minlength=self.n) == k)
        self.floor[full] = self.best[2][np.searchsorted(self.best[0], full, "right") - 1]

    def result(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.best[0]), 1 << 17):
            q, p, s = (x[lo : lo + (1 << 17)] for x in self.best)
            yield pa.RecordBatch.from_arrays([pa.repeat(self.cell, len(q)), self.ids.take(pa.array(q)), pa.array(self.names[p], kind), pa.array(s)], ["cell", "s1_id", "cand_id", "score"])


def _best(k: int, digits: int):
    """Tasks get rows (cell, pg, qc, pc, s1_id, cand_id, terms, ws), sorted by the first four: for each of the first three its
    queries, whose pc is -1, and then the pool chunk by chunk. They give the k best pool records of each query by rounded
    score, ties by id: (cell, s1_id, cand_id, score)."""

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        held: list[pa.RecordBatch] = []
        last = None
        for part in parts:
            task = list(zip(*(part.column(c).to_pylist() for c in range(4))))
            lo = 0
            while lo < len(task):
                hi = lo + 1
                while hi < len(task) and task[hi] == task[lo]:
                    hi += 1
                if held and task[lo] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                held.append(part.slice(lo, hi - lo))
                last, lo = task[lo], hi
        if held:
            yield last, pa.Table.from_batches(held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, kind = None, None, None
        for (*key, pc), rows in chunks(parts):
            if asked and key != task:
                yield from asked.result(kind)
                asked = None
            if pc < 0:
                task, asked, kind = key, _Asked(rows, k, digits), rows.schema.field("cand_id").type
            elif asked:
                asked.meet(rows)
        if asked:
            yield from asked.result(kind)

    return run


def _tasks(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows (cell, pg, qc, pc, s1_id, cand_id, terms, ws) of ``queries`` and ``pool`` (cell, entity_id, terms, ws): every
    chunk of a cell's queries with every chunk of its pool, POOL_CHUNKS at a time; equal tasks together and sorted."""
    chunks = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    cells = chunks(queries, QUERY_ROWS, "qn").join(chunks(pool, POOL_ROWS, "pn"), "cell")  # a cell of one side has no pairs
    draw = lambda n: F.pmod(F.xxhash64("entity_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = F.col("entity_id")
    no = lambda df: F.lit(None).cast(df.schema["entity_id"].dataType)
    groups = F.ceil(F.col("pn") / POOL_CHUNKS).cast("int")
    asks = queries.join(cells, "cell").select("cell", each(groups).alias("pg"), draw("qn").alias("qc"), F.lit(-1).alias("pc"), own.alias("s1_id"), no(pool).alias("cand_id"), "terms", "ws")
    dealt = pool.join(cells, "cell").withColumn("pc", draw("pn"))
    holds = dealt.select("cell", F.floor(F.col("pc") / POOL_CHUNKS).cast("int").alias("pg"), each(F.col("qn")).alias("qc"), "pc", no(queries).alias("s1_id"), own.alias("cand_id"), "terms", "ws")
    return asks.unionByName(holds).repartition("cell", "pg", "qc").sortWithinPartitions("cell", "pg", "qc", "pc")


def search(
    queries: DataFrame, pool: DataFrame, path: SearchPath, keys: Sequence[str] = (), neighbors: DataFrame | None = None, blocked: bool = False, digits: int = 9, fitted: dict | None = None
) -> DataFrame:
    """(keys, s1_id, cand_id, <path>_score, <path>_rank): the top_k pool records of every query by weighted cosine, ties
    by cand_id; only pairs that share a term. Scores are rounded to ``digits`` before ranking. Paths over the same tables
    may share ``fitted``, the term statistics by field."""
    p_all, q_all = [], []
    fitted = {} if fitted is None else fitted
    for f in path.fields:
        what = (f.column, f.analyzer, f.min_df, f.max_df)
        if what not in fitted:
            tf = materialize(term_weights(pool, f, keys))  # read for idf and for postings
            fitted[what] = tf, materialize(fit_idf(pool, tf, f, keys)), term_weights(queries, f, keys)
        tf, idf, asked = fitted[what]
        p_all.append(postings(tf, idf, f, keys))
        q_all.append(postings(asked, idf, f, keys, f.query_top))
    p, q = _vectors(p_all, keys), _vectors(q_all, keys)
    if blocked:
        p = p.join(block_keys(pool, None, False), "entity_id")
        q = q.join(block_keys(queries.dropDuplicates(["entity_id"]), neighbors, True), "entity_id")
    cell = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (*keys, *["block"] * blocked)]).alias("cell")
    slim = lambda df: df.select(cell, "entity_id", "terms", "ws")
    q = materialize(slim(q))
    # only the pool records in a cell that some query searches travel
    p = materialize(slim(p).join(q.select("cell").distinct(), "cell", "left_semi"))
    kinds = ", ".join(f"{c} {df.schema['entity_id'].dataType.simpleString()}" for c, df in (("s1_id", queries), ("cand_id", pool)))
    found = _tasks(q, p).mapInArrow(_best(path.top_k, digits), f"cell string, {kinds}, score double")
    parts = F.split("cell", "\x1f")
    found = found.select(*[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(keys)], "s1_id", "cand_id", "score")
    rank = F.row_number().over(Window.partitionBy(*keys, "s1_id").orderBy(F.desc("score"), "cand_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= path.top_k)
    return best.select(*keys, "s1_id", "cand_id", F.col("score").alias(f"{path.name}_score"), F.col("rank").alias(f"{path.name}_rank"))


def merge_paths(found: Sequence[tuple[str, DataFrame]], on: Sequence[str] = ("s1_id", "cand_id")) -> DataFrame:
    """Full outer join of search paths; a missing rank or score is 0; n_paths counts the paths that found a pair."""
    out = found[0][1]
    for _, df in found[1:]:
        out = out.join(df, list(on), "full_outer")
    filled = {f"{n}_{c}": F.coalesce(f"{n}_{c}", F.lit(0)) for n, _ in found for c in ("score", "rank")}
    out = out.withColumns(filled)
    hits = sum(((F.col(f"{n}_rank") > 0).cast("int") for n, _ in found[1:]), (F.col(f"{found[0][0]}_rank") > 0).cast("int"))
    return out.withColumn("n_paths", hits)


def generate_candidates(queries: DataFrame, pools: dict[str, DataFrame], paths: Sequence[SearchPath] = DEFAULT_PATHS, neighbors: DataFrame | None = None) -> DataFrame:
    """Candidate pairs of S1 records with each pool, inside the country, by all paths; cand_source names the pool. All
    pools are searched together: a pool's name is a key of its statistics and cells, like the country."""
    if not pools:
        raise ValueError("no pool to search")
    columns = list(dict.fromkeys(["country_norm", "entity_id", "addr_state", *[f.column for p in paths for f in p.fields]]))
    pool = None
    for source, df in pools.items():
        one = df.select(*columns, F.lit(source).alias("cand_source"))
        pool = one if pool is None else pool.unionByName(one)
    asks = queries.select(*columns, F.explode(F.array(*[F.lit(s) for s in pools])).alias("cand_source"))
    keys, fitted = ("country_norm", "cand_source"), {}
    found = [(p.name, search(asks, pool, p, keys, neighbors, blocked=True, fitted=fitted)) for p in paths]
    return merge_paths(found, (*keys, "s1_id", "cand_id")).drop("country_norm")


def trim_candidates(pairs: DataFrame, addr_k: int, both_k: int) -> DataFrame:
    """Pairs within either path's limit, n_paths counted anew; 0 leaves a path unlimited, both 0 leave all as it is."""
    if not addr_k and not both_k:
        return pairs
    a = F.col("addr_rank").between(1, addr_k or 10**6)
    b = F.col("both_rank").between(1, both_k or 10**6)
    return pairs.where(a | b).withColumn("n_paths", a.cast("int") + b.cast("int"))


def recall_at(truth: DataFrame, pairs: DataFrame, rank: str, ks: Sequence[int]) -> DataFrame:
    """(k, recall): share of the truth (s1_id, cand_id) that a path finds within its first k, for every k."""
    hit = truth.join(pairs.select("s1_id", "cand_id", F.col(rank).alias("r")), ["s1_id", "cand_id"], "left")
    each = hit.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return each.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("r").between(1, F.col("k")), F.lit(False)).cast("double")), 6).alias("recall"))


def sweep_paths(queries: DataFrame, pool: DataFrame, truth: DataFrame, variants: dict[str, SearchPath], ks: Sequence[int], keys: Sequence[str] = (), blocked: bool = False) -> DataFrame:
    """(variant, k, recall, per_query) for settings of a search path: what a tighter ``max_df`` or ``query_top`` costs in
    recall and saves in candidates."""
    out = None
    for name, path in variants.items():
        found = search(queries, pool, path, keys, blocked=blocked, digits=6)
        kept = found.select("s1_id", "cand_id", F.col(f"{path.name}_rank").alias("r")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("r <= k")
        size = kept.groupBy("k").agg(F.round(F.count("*") / F.count_distinct("s1_id"), 6).alias("per_query"))
        one = recall_at(truth, found, f"{path.name}_rank", ks).join(size, "k", "left").select(F.lit(name).alias("variant"), "k", "recall", "per_query")
        out = one if out is None else out.unionByName(one)
    return out
