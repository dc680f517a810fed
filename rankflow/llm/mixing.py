"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Starting from the
cells' tokens, weights are raked in turn to the target shares of the sources,
the languages and the topics, until a round changes no weight by more than
``TOLERANCE`` (of itself), or for ``ROUNDS`` rounds where the targets contradict
each other.  Documents are then sampled: a cell's probability is
min(1, s * weight / tokens), where the common factor s is calibrated, cell after
cell that it uses up, so that the expected tokens meet the budget.

Default targets temper the tokens' shares (a power under 1), so that hot
sources lose weight and rare ones gain.  Named values have the share that is
asked for, and the others divide the rest by their tempered shares; if nothing
is left for them, or all are named, the named shares are scaled to 1.

The topic is a column of the caller's or, by default, a keyword of the text:
the ``TOPICS`` words of a language that most of its documents hold, among those
in a part of ``MOST`` at most, are its topics, and a document has the one that
it repeats most (of equal ones the last by the alphabet), or none.  Document
counts of words come from all documents.  Such topics belong to a language, so
that their targets divide the language's.

Only DataFrame functions are used.  A hot source, language or topic meets only
partial sums; raking works on the table of cells.  Draws come from a digest of
doc_id and text, so repeated rows share one decision and a rerun gives the same
sample.  Null source, language and topic are values of their own.  Null and
blank texts have no token; they share the probability of their cell, and a cell
without any token has weight 0 and probability 1, so that its documents, which
cost nothing, are all kept.  Extra columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, small, words_of, written

MARGINS = ("source", "lang", "topic")
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 20
TOLERANCE = 0.001
TOPICS = 8
MOST = 0.05  # of a language's documents
SLOT_BITS = 16
SLOTS = 2**SLOT_BITS  # of words by hash
FULL = 1024  # slots of a language whose words are counted at first
BUDGET = 0.8  # tokens to keep, as a part of all
SEED = "mix-1"
DRAWS = 2**48


def _among(slot, full: list[int]):
    return lambda w: slot(w).isin(full)


def topic_words(docs: DataFrame) -> DataFrame:
    """(lang, topics) from ``docs`` (lang, words): the keywords of each language; empty words don't count.

    Documents are counted by hashed slots of words first.  A word is in no more
    documents than its slot, so that only the words of a language's fullest
    slots need a count of their own: those in more documents than any slot left
    out are counted for certain.  If they are too few, more slots are taken.
    """
    own = F.pmod(F.xxhash64("lang"), F.lit(2**40))  # one number for language and slot counts faster than two columns
    size = written(docs.groupBy("lang").agg(F.count("*").alias("docs")).withColumn("own", own), "langs")
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS))
    numbered = docs.select("words", (own * SLOTS).alias("base"))
    filled = numbered.select(F.explode(F.array_distinct(F.transform("words", lambda w: slot(w) + F.col("base")))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    slots = filled.select(F.shiftright("key", SLOT_BITS).alias("own"), F.pmod("key", F.lit(SLOTS)).alias("slot"), "n").join(small(size), "own").select("lang", "slot", "n")
    slots = written(slots.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "slot"))), "slots")
    most = FULL
    while True:
        full = [r["slot"] for r in slots.filter(F.col("k") <= most).select("slot").distinct().collect()]  # SLOTS of them at most
        left_out = size.join(slots.filter(F.col("k") > most).groupBy("lang").agg(F.max("n").alias("bar")), "lang", "left").na.fill(0, ["bar"])
        likely = docs.select("lang", F.explode(F.array_distinct(F.filter("words", _among(slot, full)))).alias("word")).filter("word <> ''")
        counts = likely.groupBy("lang", "word").agg(F.count("*").alias("n")).join(small(written(left_out, "bars")), "lang")
        fit = counts.filter((F.col("n") > F.col("bar")) & (F.col("n") <= F.col("docs") * F.lit(MOST)))
        best = fit.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= TOPICS)
        found = written(best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("w")).select("lang", F.col("w.word").alias("topics")), "topics")
        short = left_out.join(found, "lang", "left").filter((F.coalesce(F.size("topics"), F.lit(0)) < TOPICS) & (F.col("bar") > 0))
        if short.isEmpty():
            return found
        most *= 8


def with_keyword(rows: DataFrame, words: str, topics: str, name: str) -> DataFrame:
    """``rows`` with the topic of a text: the keyword that occurs most; null if none does."""
    some = rows.withColumn("_some", F.array_intersect(words, topics))
    # Columns of their own, as expressions would be evaluated anew for each keyword.  Texts with one keyword need no counts.
    found = some.withColumn("_found", F.when(F.size("_some") > 1, F.filter(words, lambda w: F.array_contains("_some", w))))
    counted = F.transform("_some", lambda w: F.struct(F.size(F.filter("_found", lambda x: x == w)).alias("n"), w.alias("word")))
    return found.withColumn(name, F.when(F.size("_some") > 1, F.array_max(counted)["word"]).otherwise(F.get("_some", F.lit(0)))).drop("_some", "_found")


def _digest(doc_id: Column, text: Column) -> Column:
    joined = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("long")


def goal_shares(cells: DataFrame, margin: str, power: float, named: dict[str, float] | None = None) -> DataFrame:
    """(margin, goal): the target share of each value, 1 in all."""
    goal = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("g"))
    given = F.lit(None).cast("double")
    if named:
        shares = F.create_map(*[F.lit(y) for pair in named.items() for y in (f"={pair[0]}", float(pair[1]))])
        given = F.try_element_at(shares, F.col(margin))
    goal = goal.withColumn("given", given)
    sums = goal.agg(F.sum("given").alias("given"), F.sum(F.when(F.col("given").isNull(), F.col("g"))).alias("g")).first()
    asked, others = sums["given"] or 0.0, sums["g"] or 0.0
    rest = max(0.0, 1.0 - asked) if others else 0.0
    scale = 1.0 if asked + rest == 0 else asked + rest
    own = F.coalesce(F.col("given"), F.col("g") * F.lit(rest / others if others else 0.0))
    return written(goal.select(margin, (own / F.lit(scale)).alias("goal")), "goal")


def nested_shares(cells: DataFrame, margin: str, power: float, outer: str, goals: DataFrame) -> DataFrame:
    """(margin, goal) for values that belong to one value of ``outer``: parts of its goal."""
    goal = cells.groupBy(outer, margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("g"))
    total = goal.groupBy(outer).agg(F.sum("g").alias("s")).join(goals, outer)
    share = F.when(F.col("s") > 0, F.col("goal") * F.col("g") / F.col("s")).otherwise(0.0)
    return written(goal.join(total, outer).select(margin, share.alias("goal")), "goal")


def rake(
    cells: DataFrame, rounds: int = ROUNDS, power: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, nested: dict[str, str] | None = None
) -> DataFrame:
    """``cells`` (margins and tokens) with ``weight``: shares of all tokens, raked to the targets.

    ``targets`` gives the shares of some values of a margin; ``nested`` names
    the margin that each value of another belongs to.
    """
    w = cells.withColumn("weight", F.col("tokens").cast("double"))
    goals: dict[str, DataFrame] = {}
    for x in MARGINS:
        of, named = (power or POWER)[x], (targets or {}).get(x)
        outer = None if named else (nested or {}).get(x)
        goals[x] = nested_shares(cells, x, of, outer, goals[outer]) if outer else goal_shares(cells, x, of, named)
    for _ in range(rounds):
        w = w.withColumn("before", F.col("weight"))
        for x in MARGINS:
            now = w.groupBy(x).agg(F.sum("weight").alias("now")).join(goals[x], x)
            factor = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
            # Written at each step: the table is used twice, so an unwritten plan would double with each margin.
            w = written(w.join(now.select(x, factor.alias("factor")), x).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "raked")
        moved = w.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest(F.col("before"), F.lit(1e-300))).alias("m")).first()["m"]
        w = w.drop("before")
        if moved is None or moved <= TOLERANCE:
            break
    return w


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``prob``, such that the expected tokens are ``budget`` of all."""
    totals = raked.agg(F.sum("tokens").alias("t")).first()
    aim = float(totals["t"] or 0) * budget
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    s, before = aim, None
    while s != before:  # cells are used up one after the other, never fewer than before
        full = F.col("ratio") * F.lit(s) >= 1
        sums = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if not sums["rest"]:
            break
        s, before = max(s, max(0.0, aim - (sums["full"] or 0)) / sums["rest"]), s
    return raked.withColumn("prob", F.least(F.lit(1.0), F.coalesce(F.col("ratio") * F.lit(s), F.lit(1.0))))


def _mixed(docs: DataFrame, keep: list[str], text: str, of: dict[str, Column], doc_id: Column, topic: Column | None, **options) -> DataFrame:
    key = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.withColumns({"source": key(of["source"]), "lang": key(of["lang"]), "_words": words_of(F.col(text)), "draw": _digest(doc_id, body)})
    if topic is None:
        worded = docs.select(key(of["lang"]).alias("lang"), pieces_of(F.col(text)).alias("words"))
        sized = with_keyword(sized.join(small(topic_words(worded)), "lang", "left"), "_words", "topics", "_keyword")
        topic = F.concat("lang", F.lit(" "), F.coalesce("_keyword", F.lit("")))
        options["nested"] = {"topic": "lang"}
    named = written(sized.select(*keep, "source", "lang", F.size("_words").cast("long").alias("n_tokens"), "draw", key(topic).alias("topic")), "sized")
    budget = options.pop("budget", BUDGET)
    cells = written(named.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    cells = written(calibrate(rake(cells, **options), budget), "cells")
    total = named.join(small(cells.select(*MARGINS, "ratio", "prob")), list(MARGINS))
    return total.withColumn("kept", F.col("draw") < F.col("prob") * F.lit(float(DRAWS)))


def mix(docs: DataFrame, topic: Column | None = None, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (of a token, 1 on average), prob and kept for each row."""
    docs = docs.select(F.col("doc_id"), "text", F.col("source").alias("_source"), F.col("lang").alias("_lang"))
    out = _mixed(docs, ["doc_id"], "text", {"source": F.col("_source"), "lang": F.col("_lang")}, F.col("doc_id"), topic, **options)
    tokens = out.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
    plain = lambda x: F.when(F.col(x) != "", F.substring(F.col(x), 2, 2**31 - 1)).alias(x)
    return out.select("doc_id", plain("source"), plain("lang"), plain("topic"), "n_tokens", F.round(F.coalesce("ratio", F.lit(0.0)) * F.lit(float(tokens)), 6).alias("weight"), F.round("prob", 6).alias("prob"), "kept")


def sample_mix(docs: DataFrame, topic: Column | None = None, **options) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    of = {"source": F.col("row.source"), "lang": F.col("row.lang")}
    return _mixed(packed, ["row"], "row.text", of, F.col("row.doc_id"), topic, **options).filter("kept").select("row.*")
