"""Quality rules with thresholds that adapt to language and source.

Each document gets counts (words, symbols, repeated lines, words in repeated
three-word windows).  Two base rules are fixed.  The other cutoffs come from
mergeable quantile sketches: for each language and source, each rate of the
documents that pass the base rules is counted in log-linear buckets (relative
error under 1/32, a bounded number of buckets).  Sketches merge by adding
counts: a group with too few documents (``least_docs``) takes the sketch of its
language, and that failing the sketch of all documents.

A document is rejected if one of its rates lies above the cutoff of its group:
the larger of the upper fence Q3 + 3 (Q3 - Q1) and a high quantile of the rate
(``QUANTILE``).  Symbols have the fence alone.  Repeated lines and words also
occur in good texts, and are 0 in most, so that their fence is narrow; their
quantile leaves out 0.5 % of a group at most.  ``SPREAD`` is the least spread
(Q3 - Q1), so that a group where nearly all texts agree has some width.  There
are no other fixed cutoffs.

All of it runs on DataFrame functions and integers, so results are exact and
repeatable.  Null and blank texts have zero counts and fail the base rules.  A
null language or source is a group of its own.  Repeated rows count as often as
they occur.  Values on a cutoff, and all of its bucket, are kept.  Extra
columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, words_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 30
SCALE = 100_000  # rates are parts of so many
SPREAD = 300  # in parts of SCALE
PLACE = 24  # bits of a place in a text
#: Rates and the quantile, in thousandths, that their cutoff reaches at least.
QUANTILE = {"symbols": 750, "dup_lines": 995, "repeat_words": 995}
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def least_docs(rate: str) -> int:
    """The documents a group needs for its own cutoff: enough to tell the quantile from the greatest value."""
    return max(MIN_GROUP, 1000 // (1000 - QUANTILE[rate]))


def _three(at: Column) -> Column:
    """The window of three words at a place."""
    return F.array(*[F.get("_words", at + k) for k in range(3)])


def count_text(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of ``text``."""
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    out = out.select(*keep, "_text", words_of(F.col("_text")).alias("_words"), lines.alias("_lines"))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_text", "_lines")
    return _with_repeats(out).drop("_words")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``_words``) and n_repeat_words: the words in windows of three that occur twice or more.

    Only texts that repeat a hash of a window sort them.  Hashes are sorted
    together with their places as one number, of which the place takes the last
    ``PLACE`` bits; neighbours with the same rest count if their words are
    equal.  If some aren't, or a text is longer than that, whole hashes are
    sorted.
    """
    own = rows.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    windows = F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)))
    out = own.withColumn("_hash", F.slice(windows, F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))).drop("_h")
    out = out.withColumn("_hash", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.col("_hash")))
    kept = lambda x: F.shiftright(x, PLACE)
    place = lambda x: x.bitwiseAND(F.lit(2**PLACE - 1).cast("long")).cast("int")
    short = F.size("_hash") < 2**PLACE
    out = out.withColumn("_sorted", F.when(short, F.sort_array(F.transform("_hash", lambda x, i: F.shiftleft(kept(x), PLACE) + i))))
    after = lambda x, y: F.when(kept(x) == kept(y), _three(place(x)) == _three(place(y)))
    out = out.withColumn("_same", F.transform("_sorted", lambda x, k: after(x, F.get("_sorted", k + 1))))
    met = F.transform("_sorted", lambda x, k: F.when(F.get("_same", k) | F.get("_same", k - 1), place(x)))
    whole = F.col("_hash").isNotNull() & (~short | F.coalesce(F.array_contains("_same", False), F.lit(False)))
    out = out.withColumn("_all", F.when(whole, F.array_sort(F.transform("_hash", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_hash")
    same = lambda x, y: (x["h"] == y["h"]) & (_three(x["i"]) == _three(y["i"]))
    met_whole = F.transform("_all", lambda x, k: F.when(same(x, F.get("_all", k + 1)) | same(x, F.get("_all", k - 1)), x["i"]))
    out = out.withColumn("_at", F.array_compact(F.coalesce(met_whole, met))).drop("_sorted", "_same", "_all")
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2))))
    return out.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")).drop("_at")


def with_rates(counted: DataFrame) -> DataFrame:
    rate = lambda n, of: F.floor(F.lit(SCALE) * F.col(n) / F.greatest(F.col(of), F.lit(1))).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, "symbols": rate("n_symbols", "word_chars"), "dup_lines": rate("n_dup_lines", "n_lines"), "repeat_words": rate("n_repeat_words", "n_words")})


def bucket(value: Column) -> Column:
    """The log-linear bucket of a count: exact under 64, then 32 buckets for each doubling."""
    wide = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (F.lit(32) * wide + F.call_function("shiftright", value, wide)).cast("long")


def bucket_top(at: Column) -> Column:
    """The largest value of a bucket."""
    wide = F.greatest(F.floor((at - 32) / 32), F.lit(0)).cast("int")
    return F.call_function("shiftleft", at - 32 * wide + 1, wide) - 1


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts of each rate by group."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("rate"), bucket(F.col(x)).alias("bucket")) for x in QUANTILE]))
    return rows.select(*by, cells.alias("cell")).groupBy(*by, "cell.rate", "cell.bucket").agg(F.count("*").alias("n"))


def merged(cells: DataFrame, by: list[str]) -> DataFrame:
    """A coarser sketch: the sum of finer ones."""
    return cells.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(cells: DataFrame, by: list[str]) -> DataFrame:
    """For each group its number of documents and the cutoff of each rate."""
    group = Window.partitionBy(*by, "rate")
    ranked = cells.withColumns({"total": F.sum("n").over(group), "below": F.sum("n").over(group.orderBy("bucket"))})
    quantile = lambda q: bucket_top(F.min(F.when(1000 * F.col("below") >= q * F.col("total"), F.col("bucket"))))
    high = F.element_at(F.create_map(*[F.lit(y) for pair in QUANTILE.items() for y in pair]), F.col("rate"))
    found = ranked.groupBy(*by, "rate").agg(F.max("total").alias("docs"), quantile(F.lit(250)).alias("q1"), quantile(F.lit(750)).alias("q3"), quantile(high).alias("high"))
    fence = F.col("q3") + 3 * F.greatest(F.col("q3") - F.col("q1"), F.lit(SPREAD))
    return found.groupBy(*by).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("rate") == x, F.greatest(fence, F.col("high")))).alias(f"most_{x}") for x in QUANTILE])


def thresholds(rated: DataFrame) -> DataFrame:
    """Cutoffs for each (lang_key, source_key) with a document that passes the base rules."""
    cells = written(sketch(rated.filter("not base_failed"), ["lang_key", "source_key"]), "sketch")
    names = [f"most_{x}" for x in QUANTILE]
    level = lambda by: fences(merged(cells, by), by)
    own = level(["lang_key", "source_key"])
    of_lang = level(["lang_key"]).select("lang_key", F.col("docs").alias("lang_docs"), *[F.col(x).alias(f"lang_{x}") for x in names])
    of_all = level([]).select(*[F.col(x).alias(f"all_{x}") for x in names])
    out = own.join(of_lang, "lang_key").crossJoin(F.broadcast(of_all))  # of_all is one row
    least = [F.lit(least_docs(x)) for x in QUANTILE]
    chosen = [F.when(F.col("docs") >= n, F.col(x)).when(F.col("lang_docs") >= n, F.col(f"lang_{x}")).otherwise(F.col(f"all_{x}")).alias(x) for x, n in zip(names, least, strict=True)]
    return written(out.select("lang_key", "source_key", *chosen), "fences")


def _judged(docs: DataFrame, keep: list[str], text: str, lang: Column, source: Column) -> DataFrame:
    key = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit(""))
    rated = written(with_rates(count_text(docs.withColumns({"lang_key": key(lang), "source_key": key(source)}), text, [*keep, "lang_key", "source_key"])), "rated")
    cutoffs = thresholds(rated)
    both = rated.join(small(cutoffs), ["lang_key", "source_key"], "left")
    inside = F.lit(True)
    for x in QUANTILE:
        inside &= F.col(x) <= F.col(f"most_{x}")
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of ``docs`` (doc_id, text, lang, source)."""
    docs = docs.select("doc_id", "text", "lang", "source")
    return _judged(docs, ["doc_id"], "text", F.col("lang"), F.col("source")).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    return _judged(packed, ["row"], "row.text", F.col("row.lang"), F.col("row.source")).filter("kept").select("row.*")
