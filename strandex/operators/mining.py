"""Mining frequent substrings: k-grams, running counts, series of similar k-grams, candidates and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines whose k-grams are counted in one window; a frequent k-gram is counted in as many windows as there are such runs.
RUN = 1 << 16
#: More k-grams than this are joined by a shuffle instead of a broadcast.
BROADCAST_KGRAMS = 200_000


def histogram(lines: DataFrame) -> DataFrame:
    """(symbol, ch, freq) for the characters 1 to 127; freq is one more than the count."""
    chars = lines.select(F.explode(F.filter(F.split("line", ""), lambda c: c != "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    every = lines.sparkSession.range(1, 128).select(F.col("id").cast("int").alias("symbol"), F.char(F.col("id")).alias("ch"))
    return every.join(F.broadcast(chars.where(F.ascii("ch").between(1, 127))), "ch", "left").select("symbol", "ch", (F.coalesce("n", F.lit(0)) + 1).alias("freq"))


def kgrams(lines: DataFrame, k: int) -> DataFrame:
    """(line_no, pos, kgram, n_pos): all windows of k characters; shorter lines have none."""
    long_enough = lines.where(F.length("line") >= k)
    at = long_enough.select("line_no", "line", (F.length("line") - k + 1).cast("long").alias("n_pos"), F.explode(F.sequence(F.lit(0), F.length("line") - k)).alias("pos"))
    return at.select("line_no", F.col("pos").cast("long").alias("pos"), F.substring(F.col("line"), F.col("pos") + 1, F.lit(k)).alias("kgram"), "n_pos")


def running_counts(grams: DataFrame, run: int = RUN) -> DataFrame:
    """Adds hh: how often the k-gram was seen up to here in the order (line_no, pos), 0 at its first sight.

    Ranks are taken inside runs of `run` lines and moved on by the counts of the runs before, so no window holds all
    occurrences of a frequent k-gram. The counts of runs grow with the corpus and are merged with the ranks: sizes that
    are estimated from the corpus' files don't see the k-grams, and would have them broadcast.
    """
    marked = grams.withColumn("run", F.floor(F.col("line_no") / run))
    inside = marked.withColumn("rank", F.row_number().over(Window.partitionBy("kgram", "run").orderBy("line_no", "pos")))
    sums = marked.groupBy("kgram", "run").agg(F.count("*").alias("n"))
    before = sums.select("kgram", "run", (F.sum("n").over(Window.partitionBy("kgram").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    total = F.col("rank") + F.col("before")
    return inside.join(before.hint("merge"), ["kgram", "run"]).select("line_no", "pos", "kgram", "n_pos", F.when(total > 1, total).otherwise(0).cast("long").alias("hh"))


def final_counts(grams: DataFrame, top: int) -> DataFrame:
    """The order-free form: hh is the k-gram's count in all, for the `top` most frequent k-grams (ties by k-gram), else 0."""
    heavy = grams.groupBy("kgram").agg(F.count("*").alias("hh")).orderBy(F.desc("hh"), "kgram").limit(top)
    side = F.broadcast(heavy) if top <= BROADCAST_KGRAMS else heavy
    return grams.join(side, "kgram", "left").select("line_no", "pos", "kgram", "n_pos", F.coalesce("hh", F.lit(0)).cast("long").alias("hh"))


def similar(current: Column, previous: Column, ratio: float) -> Column:
    """Whether counts are within the ratio of each other, both bounds strict. Multiplied out: division by zero can't arise."""
    return (current * F.lit(ratio) < previous) & (current > previous * F.lit(ratio))


def series(counted: DataFrame, lines: DataFrame, k: int, ratio: float, trim_tail: bool = True) -> DataFrame:
    """(line_no, s, e, text): maximal stretches of heavy k-grams whose neighbours' counts are similar.

    With trim_tail, as a one-pass scan that never sees the line's end does it: a stretch of several k-grams that is still
    open there loses its last character, and a stretch that the last k-gram alone begins by a break of ratio is dropped.
    The lines are the whole corpus and are never broadcast.
    """
    by_line = Window.partitionBy("line_no").orderBy("pos")
    previous = F.coalesce(F.lag("hh").over(by_line), F.lit(0))
    marked = counted.withColumn("prev", previous)
    broken = (F.col("hh") > 0) & (F.col("prev") > 0) & ~similar(F.col("hh"), F.col("prev"), ratio)
    begins = (F.col("hh") > 0) & ((F.col("prev") == 0) | broken)
    numbered = marked.withColumn("broken", broken).withColumn("sid", F.sum(begins.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))).where("hh > 0")
    spans = numbered.groupBy("line_no", "sid").agg(F.min("pos").alias("s"), F.max("pos").alias("e"), F.max(F.col("n_pos") - 1).alias("last"), F.min_by("broken", "pos").alias("broken"))
    width = F.col("e") - F.col("s") + k
    if trim_tail:
        spans = spans.where(~((F.col("s") == F.col("last")) & F.col("broken")))
        width = F.when((F.col("e") == F.col("last")) & (F.col("e") > F.col("s")), width - 1).otherwise(width)
    return spans.withColumn("width", width).join(lines.hint("merge"), "line_no").select("line_no", "s", "e", F.substring(F.col("line"), (F.col("s") + 1).cast("int"), F.col("width").cast("int")).alias("text"))


def series_counts(found: DataFrame) -> DataFrame:
    """(pat, real_count): lines that hold the series, each line once."""
    return found.select("line_no", F.col("text").alias("pat")).distinct().groupBy("pat").agg(F.count("*").alias("real_count"))


def heavy(counts: DataFrame, capacity: int) -> DataFrame:
    """The `capacity` most frequent, ties by text."""
    return counts.orderBy(F.desc("real_count"), "pat").limit(capacity)


def containment_scores(candidates: DataFrame, at_least: int = 1) -> DataFrame:
    """(pat, real_count, score): 1 + the counts of all candidates that contain this one, itself included.

    As an equi-join: every candidate is exploded to its distinct substrings, of lengths that candidates have. These grow
    with the square of a candidate's length and are never broadcast.
    """
    lengths = candidates.agg(F.collect_set(F.length("pat"))).scalar()  # in the same job, which reads the candidates' exchange again
    windows = candidates.select("pat", "real_count", F.explode(lengths).alias("n")).where(f"n <= length(pat) and n >= {at_least}")
    parts = windows.select("pat", "real_count", "n", F.explode(F.sequence(F.lit(1), F.length("pat") - F.col("n") + 1)).alias("i")).select("pat", "real_count", F.substring(F.col("pat"), F.col("i"), F.col("n")).alias("part")).distinct()
    sums = parts.groupBy("part").agg(F.sum("real_count").alias("total"))
    return candidates.join(sums.hint("merge"), candidates["pat"] == sums["part"]).select("pat", "real_count", (F.col("total") + 1).alias("score"))


def pool_size(n: int) -> int:
    """Candidates that are kept for a dictionary of n patterns."""
    return int(n * 1.2) + (1000 if n < 1000 else 0)


def top_candidates(scored: DataFrame, n: int) -> DataFrame:
    """The best candidates by score, ties by text; none for n = 0."""
    return scored.orderBy(F.desc("score"), "pat").limit(pool_size(n) if n else 0)


def without_listed(found: DataFrame, white_list: DataFrame, k: int) -> DataFrame:
    """Series that are no part, of k characters or more, of a listed string."""
    listed = white_list.select(F.col("pat").alias("w")).where(F.length("w") >= k)
    starts = listed.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - k + 1)).alias("i"))
    parts = starts.select("w", "i", F.explode(F.sequence(F.lit(k), F.length("w") - F.col("i") + 1)).alias("n")).select(F.substring(F.col("w"), F.col("i"), F.col("n")).alias("text")).distinct()
    return found.join(parts, "text", "left_anti")


def signature_sets(found: DataFrame, ratio: float, separator: str = "¡Ã", run: int = RUN) -> DataFrame:
    """(signature, n): the sets of series that go together, and how many lines have each.

    A line's series are looked at in their order, each text once. One joins the line's set if its running count, over all
    lines up to this one (0 at its first sight), is over `ratio` times the count of the last that joined (0 before). A
    signature is the set in the order of texts, with the separator before each and at the end; lines without a set have none.
    """
    once = found.groupBy("line_no", F.col("text").alias("kgram")).agg(F.min("s").alias("pos")).withColumn("n_pos", F.lit(0).cast("long"))
    series_of = running_counts(once, run).groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("pos", "hh", "kgram"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<string>").alias("kept"))

    def admit(state: Column, x: Column) -> Column:
        joined = F.struct(x["hh"].alias("last"), F.concat(state["kept"], F.array(x["kgram"])).alias("kept"))
        return F.when(x["hh"] > state["last"] * F.lit(ratio), joined).otherwise(state)

    kept = series_of.select(F.sort_array(F.aggregate("all", start, admit)["kept"]).alias("kept")).where(F.size("kept") > 0)
    return kept.select(F.concat(F.lit(separator), F.array_join("kept", separator), F.lit(separator)).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


def at_least(counts: DataFrame, threshold: int) -> DataFrame:
    """Items seen `threshold` times or more."""
    return counts.where(F.col("real_count") >= threshold)


def approximate_top(grams: DataFrame, column: str, k: int, counters: int = 10_000) -> DataFrame:
    """(item, count) of about the k most frequent, from a mergeable sketch of bounded size: counts are estimates."""
    found = grams.agg(F.expr(f"approx_top_k({column}, {k}, {counters})").alias("t"))
    return found.select(F.explode("t").alias("t")).select("t.item", "t.count")


def space_saving(items: DataFrame, column: str, order: list[str], capacity: int) -> DataFrame:
    """(item, count, delta) of the one-pass summary that evicts a least counter and inherits its count.

    Its result depends on the order of all items, so it is one task by its nature; for comparison with exact counts, not
    for large inputs.
    """

    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, list[int]] = {}
        groups: dict[int, dict[str, None]] = {}  # by count, in order of arrival

        def leave(item: str, n: int) -> None:
            groups[n].pop(item)
            if not groups[n]:
                groups.pop(n)

        for item in pdf.sort_values(order)[column]:
            if item in counts:
                leave(item, counts[item][0])
                counts[item][0] += 1
            elif len(counts) < capacity:
                counts[item] = [1, 0]
            else:
                n = min(groups)
                evicted = next(iter(groups[n]))
                leave(evicted, n)
                counts.pop(evicted)
                counts[item] = [n + 1, n]
            groups.setdefault(counts[item][0], {})[item] = None
        return pd.DataFrame([(i, c, d) for i, (c, d) in counts.items()], columns=["item", "count", "delta"])

    return items.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(one, "item string, count long, delta long")
