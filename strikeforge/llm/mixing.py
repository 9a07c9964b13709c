"""A training mixture of sources whose weights change over the course of training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeforge.llm.shared import WORD, fresh

#: ``(time, weight)`` knots from time 0 to 1; the weight is linear between them.
Schedule = Sequence[tuple[float, float]]
#: Documents per ordering bucket of a source, on average.
BUCKET_DOCS = 4096


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """``size``: words of the text, none for NULL."""
    words = F.regexp_count(F.col(text), F.lit(WORD))
    return docs.withColumn("size", F.coalesce(words, F.lit(0)).cast("long"))


def integral(schedule: Schedule) -> float:
    """The weight a source has over all of training."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _segments(schedule: Schedule) -> Column:
    """Linear pieces: start, length, weight at the start, slope, demand before the start."""
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        values = (t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), before)
        pieces.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("tlwmd", values))))
        before += (t1 - t0) * (w0 + w1) / 2
    return F.array(*pieces)


def _time_of(demand: Column, segments: Column) -> Column:
    """The time by which a schedule has asked for ``demand``: its integral, inverted."""
    piece = F.try_element_at(F.filter(segments, lambda s: s.d <= demand), F.lit(-1))
    rest = demand - piece.d
    root = F.sqrt(F.greatest(piece.w * piece.w + 2 * piece.m * rest, F.lit(0.0)))
    into = F.coalesce(F.try_divide(2 * rest, piece.w + root), F.lit(0.0))
    return piece.t + F.least(into, piece.l)


def source_targets(
    sized: DataFrame, schedules: Sequence[Schedule], *, source: str = "source",
    by_source: Mapping[str | None, int] | None = None, max_repeats: int = 3,
) -> DataFrame:
    """One row per source: ``source, kind`` (its schedule), ``n_docs, source_size, target``.

    Targets share the words of all sources by weight. A target stops at ``max_repeats`` times
    its source's size and the excess goes to the others by weight, until none is above: the
    sources are capped in the order of size over weight. Runs over one row per source.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % len(schedules)
    if by_source is not None:
        given = [F.when(F.col("source").eqNullSafe(s), F.lit(k)) for s, k in by_source.items()]
        kind = F.coalesce(*given, kind)
    weight = F.element_at(F.array(*(F.lit(float(integral(s))) for s in schedules)), kind + 1)
    cap = F.col("source_size") * max_repeats
    ranked = totals.withColumn("kind", kind.cast("int")).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", cap)
    by_room = Window.orderBy(
        F.try_divide(F.col("cap").cast("double"), F.col("weight")).asc_nulls_last(),
        F.col("source").asc_nulls_last(),
    )
    whole = Window.partitionBy()
    upto = by_room.rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({
        "total": F.sum("source_size").over(whole),
        "caps_before": F.sum("cap").over(upto) - F.col("cap"),
        "weight_from": F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"),
    })
    above = (F.col("total") - F.col("caps_before")) * F.col("weight")
    capped = above > F.col("cap") * F.col("weight_from")
    # Sources after the first one that fits have even more room.
    capped = F.min(capped.cast("int")).over(upto) == 1
    ranked = ranked.withColumn("capped", capped)
    ranked = ranked.withColumns({
        "left": F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole),
        "weights": F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole),
    })
    shared = F.try_divide(F.col("left").cast("double") * F.col("weight"), F.col("weights"))
    target = F.when(F.col("capped"), F.col("cap").cast("double"))
    return ranked.select(
        "source", "kind", "n_docs", "source_size",
        target.otherwise(F.coalesce(shared, F.lit(0.0))).alias("target"),
    )


def mix_sources(
    sized: DataFrame, schedules: Sequence[Schedule], *, doc_id: str = "doc_id",
    source: str = "source", by_source: Mapping[str | None, int] | None = None,
    max_repeats: int = 3, seed: int = 42,
) -> DataFrame:
    """Every input row in training order, with what the mix takes of it and when.

    ``sized`` has a ``size`` in words (``with_size``). Sources in code point order, NULL last, take
    ``schedules`` in turn, or those ``by_source`` numbers. A source's documents stand in a
    seeded hash order and are read up to ``max_repeats`` times, until its target is met;
    the last document is taken up to the word that meets it. The word with number ``c`` of a source
    is due when the source's schedule has asked for ``c`` of its target, which gives each take its
    position between 0 and 1.

    Adds ``source_size``, ``target``, ``taken`` (words, repeats counted), ``takes`` (position and
    words of each) and ``position`` (of the first), and sorts all rows by it; documents that
    are not taken come last without a position. ``n_docs``, ``kind`` and other inner columns are
    not returned; input columns named like the added ones are replaced.

    The order inside a source is a running total in two steps, over hash buckets and inside
    them, so a source with a third of all rows is spread over as many tasks as it has buckets.
    Rows without size are taken with no words. Repeated rows are neighbours in the order and all
    are kept. An empty table gives an empty result.
    """
    added = ("source_size", "target", "taken", "takes", "position")
    kept = [c for c in sized.columns if c not in added]
    inner = fresh("_", sized)
    s, of, number, order, at, before, first, pieces = (
        f"{inner}{n}" for n in ("s", "of", "n", "order", "bucket", "before", "first", "segments")
    )
    col = F.col
    targets = source_targets(
        sized, schedules, source=source, by_source=by_source, max_repeats=max_repeats
    )
    targets = targets.select(col("source").alias(of), F.struct("*").alias(s))
    rows = sized.select(*kept).withColumn(number, F.coalesce(col("size").cast("long"), F.lit(0)))
    rows = rows.join(targets, col(source).eqNullSafe(col(of))).drop(of)
    buckets = F.ceil(col(f"{s}.n_docs") / BUCKET_DOCS).cast("long")
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), col(doc_id), col(number)).cast("binary"))
    high = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    rows = rows.withColumn(order, shuffled).withColumn(
        at, F.shiftright(high * buckets, 32)  # buckets are ranges of the order
    )
    sums = rows.groupBy(col(f"{s}.source").alias(of), col(at).alias("bucket")).agg(
        F.sum(number).alias("held")
    )
    along = Window.partitionBy(of).orderBy("bucket")
    along = along.rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = fresh(f"{inner}b", sized)
    sums = sums.select(
        of, col("bucket").alias(in_bucket),
        F.coalesce(F.sum("held").over(along), F.lit(0)).alias(before),
    )
    rows = rows.join(
        sums, col(f"{s}.source").eqNullSafe(col(of)) & (col(at) == col(in_bucket))
    )
    inside = Window.partitionBy(of, in_bucket).orderBy(order, doc_id, number)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        first: col(before) + F.coalesce(F.sum(number).over(inside), F.lit(0)),
        "source_size": col(f"{s}.source_size"), "target": col(f"{s}.target"),
    })
    wanted = F.floor(col("target") + 0.5)
    segments = F.element_at(F.array(*map(_segments, schedules)), col(f"{s}.kind") + 1)
    whole = F.element_at(F.array(*(F.lit(float(integral(x))) for x in schedules)), col(f"{s}.kind") + 1)

    def take(repeat: Column) -> Column:
        start = col(first) + repeat * col("source_size")
        words = F.greatest(F.least(wanted - start, col(number)), F.lit(0))
        due = F.try_divide(start * whole, col("target"))
        return F.struct(
            _time_of(due, col(pieces)).alias("position"), words.cast("long").alias("words")
        )

    repeats = F.array(*(F.lit(k).cast("long") for k in range(max_repeats)))
    rows = rows.withColumn(pieces, segments)
    rows = rows.withColumn("takes", F.filter(F.transform(repeats, take), lambda t: t.words > 0))
    rows = rows.withColumns({
        "taken": F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: n + t.words),
        "position": F.get("takes", F.lit(0)).position,
    })
    ordered = rows.select(*kept, *added, order)
    return ordered.orderBy(col("position").asc_nulls_last(), order, doc_id).drop(order)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per take, a repeated document once per repeat, sorted by training position.

    A column ``words`` of the input is replaced by the words of the take.
    """
    kept = [c for c in mixed.columns if c not in ("takes", "position", "words")]
    takes = mixed.select(*kept, F.inline("takes"))
    return takes.orderBy("position", *(["doc_id"] if "doc_id" in kept else []))
