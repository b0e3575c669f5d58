"""Mixing sources to target weights by Pareto order sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytree.llm.rawtext import SPACE_CLASS, SPACES
from tallytree.operators.ordering import numbered
from tallytree.session import pin

#: Sources in code-point order weigh these, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together as a multiple of all words, and the limit for a source and a document.
SHARE, LIMIT = 1.5, 2
#: A cut is searched among this many classes of the ranking, as often as it takes.
_CLASS_BITS, _KEY_BITS = 10, 40


def word_count(text: str) -> Column:
    """Words of a text, 0 for a null one."""
    trimmed = F.trim(F.col(text), F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def filled(sources: DataFrame, total: float, amount: str = "source_size", limit: int = LIMIT) -> DataFrame:
    """``sources`` (weight, ``amount``) with ``target``: ``total`` shared by weight, no more than ``limit`` times the amount.

    What a full source cannot take is shared again by weight among the others. Each step is one
    aggregate over the sources; the number of steps is at most the number of fill levels.
    """
    sums = lambda rows: rows.agg(F.sum(F.when(F.col("full"), F.col(amount) * limit)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col(amount) * F.lit(limit)
        spent, open_ = sums(sources.withColumn("full", full))
        if not open_:
            return sources.withColumn("target", F.col(amount).cast("double") * limit)
        found = (total - float(spent or 0)) / float(open_)
        if level is not None and found <= level:
            break
        level = found
    return sources.withColumn("target", F.when(full, F.col(amount).cast("double") * limit).otherwise(F.col("weight") * F.lit(level)))


def uniform(*parts: Column, seed: str) -> Column:
    """In (0, 1), the same for the same parts everywhere: 48 bits of a digest."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _preference(size: Column) -> Column:
    """Binary digits of the size: longer documents are repeated and taken a little more readily."""
    return F.length(F.bin(size))


def _factors(rows: DataFrame) -> DataFrame:
    """(rank, factor): expected copies are factor * preference, LIMIT at most, and meet the target of the source in words.

    Preferences are whole numbers below 64, so a source has few classes; those with the largest
    preference reach the limit first.
    """
    classes = rows.groupBy("rank", "target", "preference").agg(F.sum("size").alias("words"))
    fullest = Window.partitionBy("rank").orderBy(F.desc("preference"))
    before = F.coalesce(F.sum("words").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("preference")).over(fullest.rowsBetween(0, Window.unboundedFollowing))
    steps = classes.withColumn("factor", F.try_divide(F.col("target") - before * LIMIT, open_.cast("double")))
    fits = steps.filter(F.col("factor") * F.col("preference") < LIMIT)
    return fits.groupBy("rank").agg(F.max_by("factor", "preference").alias("factor"))


def _draws(rows: DataFrame, seed: str) -> DataFrame:
    """Add ``whole`` (certain copies) and ``key``, the place in the Pareto order; no key where no further copy can come.

    The order is that of the random odds u / (1 - u) divided by the inclusion odds p / (1 - p).
    """
    expected = F.least(F.lit(float(LIMIT)), F.coalesce(F.col("factor") * F.col("preference"), F.lit(float(LIMIT))))
    out = rows.withColumn("_expected", F.greatest(expected, F.lit(0.0))).withColumn("whole", F.floor("_expected").cast("long"))
    p, u = F.col("_expected") - F.col("whole"), uniform(F.col("row_id"), seed=seed)
    ratio = (u / (1 - u)) / (p / (1 - p))
    key = F.when((p > 0) & (F.col("size") > 0), F.floor(ratio / (1 + ratio) * float(1 << _KEY_BITS)).cast("long"))
    return out.withColumn("key", key).drop("_expected")


def _cuts(ranked: DataFrame) -> DataFrame:
    """(rank, cut): a source takes its documents with key < cut, which brings its words next to the target.

    Words are counted in ever finer classes of the key around the cut; documents do not move, and no
    step sorts them. Documents with one key stand or fall together.
    """
    edge = ranked.groupBy("rank", "target").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"))
    edge = pin(edge.select("rank", (F.col("target") - F.col("sure")).alias("need"), F.lit(0).cast("long").alias("low")), "mix-needs")
    bits = _KEY_BITS
    while bits > 0:
        bits -= _CLASS_BITS
        width = 1 << bits
        here = ranked.filter("key IS NOT NULL").join(edge, "rank")
        here = here.withColumn("step", F.floor((F.col("key") - F.col("low")) / width).cast("long"))
        classes = here.filter((F.col("step") >= 0) & (F.col("step") < 1 << _CLASS_BITS))
        classes = classes.groupBy("rank", "need", "low", "step").agg(F.sum("size").alias("words"))
        order = Window.partitionBy("rank").orderBy("step")
        upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
        classes = classes.select("*", upto.alias("upto"), F.lead("step").over(order).isNull().alias("last"))
        # The class where the need is met, or the last one if there is less than that.
        met = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need"))
        less = F.col("last") & (F.col("upto") < F.col("need"))
        rest = F.col("need") - (F.col("upto") - F.col("words"))
        chosen = classes.filter(met | less).select(
            "rank", rest.alias("need"), (F.col("low") + F.col("step") * width).alias("low"), "words")
        edge = pin(chosen, "mix-edge")
    # The documents at the edge come in if that is nearer to the target than leaving them out.
    enters = F.abs(F.col("words") - F.col("need")) <= F.abs(F.col("need"))
    return edge.select("rank", F.when(enters, F.col("low") + 1).otherwise(F.col("low")).alias("cut"))


def copies(docs: DataFrame, source_column: str, row_id: Column, size: Column, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and n_copies (0 to 2) of each row.

    Sources in code-point order, null last, weigh ``WEIGHTS``, repeating; together they get ``SHARE``
    times all words, none more than ``LIMIT`` times its own. Every document has an expected number
    of copies; its whole part is certain, and the fractions are inclusion probabilities of a Pareto order
    sample that stops where the words of the source come nearest to its target. Empty documents take
    nothing; of two rows with one id and size both are taken or none. Reruns agree. Source tables have
    one row per source; documents meet them in joins that Spark splits where one source is hot.
    """
    own = docs.columns
    sized = docs.withColumns({"_source": F.col(source_column), "row_id": row_id, "size": size})
    narrow = pin(sized.select("_source", "row_id", "size"), "mix-sizes")
    sources = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sources, [], [F.col("_source").isNull(), F.col("_source")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = pin(ranked.withColumn("weight", weight), "mix-sources")
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    targets = pin(filled(ranked, SHARE * everything), "mix-targets")

    def placed(rows: DataFrame) -> DataFrame:
        out = rows.join(targets.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name")))
        return out.withColumn("preference", _preference(F.col("size")))

    factors = pin(_factors(placed(narrow).filter("size > 0")), "mix-factors")
    drawn = lambda rows: _draws(placed(rows).join(factors, "rank", "left"), seed)
    ranks = pin(drawn(narrow).select("rank", "target", "size", "whole", "key"), "mix-keys")
    cuts = _cuts(ranks)
    out = drawn(sized).join(cuts, "rank", "left")
    taken = F.when(F.col("size") == 0, 0).otherwise(
        F.col("whole") + F.when(F.coalesce(F.col("key") < F.col("cut"), F.lit(False)), 1).otherwise(0))
    return out.select(*own, "size", "source_size", "target", taken.cast("long").alias("n_copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    ``size`` and the other columns of the computation may clash with columns of ``docs``: theirs win.
    """
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    out = copies(safe, at["source"], F.col(at["doc_id"]), word_count(at["text"]))
    out = out.filter("n_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return out.select(*[F.col(c).alias(n) for n, c in at.items()])
