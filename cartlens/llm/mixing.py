"""Mix sources to target weights: capped water-filling of word budgets, then seeded repetitions of documents.

1. Every source has a size (words of its documents) and a weight. A budget of words is shared by weight; a source takes
   at most max_epochs times its size, and what it cannot take is shared again by weight among the others. Each round
   clamps the sources that the present rate per unit of weight would overfill and raises the rate for the rest, until no
   source is above its limit. A round is one sum over the table of sources; two numbers reach the driver.
2. A source's target becomes repetitions: as many whole ones as fit go to all its documents. For the rest, a seeded hash
   orders the documents; those before the cut get one more repetition and the one at the cut gives its first words, so
   the words taken are the target to the word. The cut is found by sums over digits of the hash, two at a time inside
   the cell that holds it: no task sees more of a source than 256 sums, or the last cell's documents.

DataFrame functions only. A null text has size 0 and gives nothing; a null source is a source of its own, and a source
without a weight gets 0 words. Documents that share hash, size and source (repeated rows) share what is left at the cut
in equal parts, rounded down, so reruns agree whatever the order of rows. An empty table gives no rows. Other columns
pass through; a column that has an output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.joins import join_small
from cartlens.functions.ranking import dense_index
from cartlens.llm.frames import set_aside
from cartlens.session import stage

#: Hexadecimal digits of the hash by which the cut is narrowed, then the whole hash.
DIGITS = (2, 4, 6, 32)

_OUTPUTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(docs: DataFrame, weights: list[int], source_col: str = "source") -> DataFrame:
    """(source, weight): sources in code-point order, null last, weigh as the list says, over and over."""
    sources = docs.select(F.col(source_col).alias("source")).distinct()
    placed = dense_index(sources, "source", "_place")
    after = sources.filter("source IS NULL").select("source", F.lit(placed.count()).cast("long").alias("_place"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return placed.unionByName(after).select("source", cycle[(F.col("_place") % len(weights)).cast("int")].alias("weight"))


def _key(source: Column) -> Column:
    """A source as a text that is never null, so that null sources meet."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def fill(sources: DataFrame, budget: int, max_epochs: float) -> DataFrame:
    """Add target to (source_size, weight): weight times a common rate, at most max_epochs times the size."""
    limit = F.col("source_size") * F.lit(float(max_epochs))
    rate, clamped = 0.0, -1
    while True:
        full = (F.col("weight") <= 0) | (F.lit(rate) * F.col("weight") >= limit)
        left = sources.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full & (F.col("weight") > 0), limit)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if left["n"] == clamped or left["weights"] == 0:
            break
        clamped, rate = left["n"], (budget - left["used"]) / left["weights"]
    if left["weights"] == 0:  # the limits together are below the budget
        return sources.withColumn("target", F.when(F.col("weight") > 0, limit).otherwise(0.0))
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(limit, F.lit(rate) * F.col("weight"))).otherwise(0.0))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    max_epochs: float = 3.0,
    seed: int = 0,
    budget: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Docs without their text, with size, source_size, target (the source's) and taken (words, repeats counted).

    weights: (source, weight), one row per source. budget: words of the mix, by default those of all documents.
    """
    bare = docs.drop(*(c for c in _OUTPUTS if c != text_col))
    own, back = set_aside(bare, "_src", "_hash", "_whole", "_cut", "_left", "_n", "_salt")
    names = dict(zip(bare.columns, own.columns, strict=True))
    text, source = F.col(names[text_col]), F.col(names[source_col])
    parts = F.lit(str(seed)), F.coalesce(F.col(names[id_col]).cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))
    added = word_count(text).alias("size"), _key(source).alias("_src"), F.md5(F.concat_ws("|", *parts)).alias("_hash")
    sized = stage(own.select(*(n for c, n in names.items() if c != text_col), *added), "mix-sizes")
    sizes = sized.groupBy("_src").agg(F.sum("size").alias("source_size"))
    weighed = weights.select(_key(F.col("source")).alias("_src"), F.col("weight").cast("double").alias("weight"))
    sources = stage(sizes.join(weighed, "_src", "left").fillna({"weight": 0.0}), "mix-sources")
    if budget is None:
        budget = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    words = F.floor(F.col("target") + F.lit(0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    plan = stage(
        fill(sources, budget, max_epochs)
        .withColumn("_whole", whole)
        .select("_src", "source_size", "target", "_whole", (words - F.col("_whole") * F.col("source_size")).alias("_gap")),
        "mix-plan",
    )
    known = stage(plan.drop("_gap").join(cuts(sized, plan), "_src", "left"), "mix-cuts")
    more = F.when(F.col("_hash") < F.col("_cut"), F.col("size")).when(F.col("_hash") == F.col("_cut"), F.floor(F.col("_left") / F.col("_n")))
    taken = F.col("_whole") * F.col("size") + F.coalesce(more, F.lit(0).cast("long"))
    rows = join_small(sized, known, ["_src"], ["_hash"]).withColumn("taken", taken)
    return back(rows.select(*(n for c, n in names.items() if c != text_col), *_OUTPUTS))


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(_src, _cut, _left, _n) for every source with a gap: the hash at its cut, the words left for the documents that
    have this hash, and how many they are. Cells before the cut are taken whole; the cell at it is looked into again.
    """
    at = stage(plan.filter("_gap > 0").select("_src", "_gap", F.lit("").alias("_cell")), "mix-cells")
    for known, width in zip((0, *DIGITS), DIGITS, strict=False):
        inside = join_small(sized.select("_src", "_hash", "size"), at, ["_src"], ["_hash"])
        sums = (
            inside.filter(F.substring("_hash", 1, known) == F.col("_cell"))
            .groupBy("_src", "_gap", F.substring("_hash", 1, width).alias("_next"))
            .agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        )
        # At most 256 rows of a source, in the last round the different hashes of one cell in 16 million.
        place = Window.partitionBy("_src").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        left = sums.withColumn("_left", F.col("_gap") - F.coalesce(F.sum("_sum").over(place), F.lit(0)))
        found = left.filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_sum")))
        at = stage(found.select("_src", F.col("_left").alias("_gap"), F.col("_next").alias("_cell"), "_n"), "mix-cells")
        if width != DIGITS[-1]:
            at = at.drop("_n")
    return at.select("_src", F.col("_cell").alias("_cut"), F.col("_gap").alias("_left"), "_n")
