"""Quality rules: counts within a text, and lines that recur across the documents of a host.

DataFrame functions only. The second rule hashes normalised lines, counts the documents of each host that hold a
line, removes lines above the limit and rejects documents that lose too much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import SPACE, let, materialize, words

SYMBOLS = "#*$%&|<>"


def repeated_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``found``, first occurrences included.
    Windows are compared by 64-bit hashes."""

    def covered(starts: Column) -> Column:
        # starts ascend: each adds the words that its predecessor doesn't cover
        begin = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
        return F.aggregate(starts, begin, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))["n"]

    def by_sorting(h: Column) -> Column:
        """Starts of repeated windows where many repeat: neighbours of equal hash after sorting."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def hits(o: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(o, i)["h"] == F.get(o, j)["h"], F.lit(False))
            kept = F.filter(o, lambda x, i: ((i > 0) & same(i, i - 1)) | same(i, i + 1))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        return let(pairs, hits)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))

        def count(h: Column) -> Column:
            twice = let(F.sort_array(h), lambda o: F.array_distinct(F.filter(o, lambda x, i: (i > 0) & F.coalesce(x == F.get(o, i - 1), F.lit(False)))))

            def starts(t: Column) -> Column:
                few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
                return F.when(F.size(t) == 0, F.lit(0)).when(F.size(t) <= 32, covered(few)).otherwise(covered(by_sorting(h)))

            return let(twice, starts)

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, count))

    return let(found, of).cast("long")


#: A line with a word in it.
WORDED = f"[^{SPACE}]"


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDED))
    counted = docs.withColumn(
        "kf_counts",
        let(
            words(F.col("text").cast("string")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
                F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    )
    out = counted.select(*docs.columns, "kf_counts.*")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """(hash, n_words) of each line with a word: lower case, white space runs to one space, ends trimmed."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORDED))
    tidy = F.transform(pieces, lambda x: F.trim(F.regexp_replace(F.lower(x), f"[{SPACE}]+", " ")))
    return F.transform(tidy, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.regexp_count(x, F.lit(" ")) + 1).cast("long").alias("n")))


def quality_rules(docs: DataFrame, min_docs: int = 5, growth: float = 1.0, keep_share: float = 0.5) -> DataFrame:
    """Rules over ``docs`` (doc_id, text, source; the source is the host): one row per document with doc_id, the counts
    of :func:`text_counts`, n_removed_words, base_failed and kept.

    A line is removed from a host's documents if more rows of the host hold it than ``min_docs`` and than ``growth``
    times the square root of the host's rows: a share that falls as hosts grow. A document that keeps less than
    ``keep_share`` of its words is rejected. A null text has no words and fails; a null host is a host of its own; every
    row counts as a document, repeated rows and equal or missing ids too; an empty table gives no rows; extra columns are
    ignored."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("\x00none")).alias("host"))
    whole = (F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.col("host"), F.coalesce("text", F.lit("")))
    keys = [F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2")]
    lines = base.select("host", F.explode(F.array_distinct(F.transform(normal_lines(F.col("text")), lambda x: x["line"]))).alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    hosts = base.groupBy("host").agg(F.count("*").alias("host_docs"))
    common = materialize(seen.join(hosts, "host").where(F.col("docs") > growth * F.sqrt("host_docs")).select("host", "line"))
    n_common = common.count()
    listed = F.broadcast(common) if n_common <= 100_000 else common
    spots = base.select("host", *keys, F.posexplode(normal_lines(F.col("text"))).alias("pos", "x")).select("host", "k1", "k2", "pos", "x.line", "x.n")
    # a set, as repeated rows share a key: each line of a text counts once
    lost = spots.join(listed, ["host", "line"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "n")).alias("lost"))
    lost = lost.select("k1", "k2", F.aggregate("lost", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_removed_words"))
    if n_common:
        rows = text_counts(base).select("*", *keys).drop("text", "host")
        out = rows.join(lost, ["k1", "k2"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    else:  # no line is common: nothing to look up
        out = text_counts(base).withColumn("n_removed_words", F.lit(0).cast("long"))
    enough = (F.col("n_words") - F.col("n_removed_words")) >= keep_share * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", (~F.col("base_failed") & enough).alias("kept"))
