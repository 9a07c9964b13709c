"""Credentials in texts, told from examples by how many owners and texts hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeforge.llm.shared import fresh
from strikeforge.sources.tables import Stage

#: What three of four values do not exceed is usual. So many times the usual texts is wide use where
#: owners are more than usual too, and inside any number of owners.
USUAL, WIDE_TEXTS, HEAVY_TEXTS = 0.75, 3, 30


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value_group`` is the secret itself, at least ``min_chars`` long.

    A base kind's matches always stay; matches of the others are candidates.
    """

    name: str
    pattern: str
    min_chars: int
    value_group: int = 0
    base: bool = True


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
         r"""([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Kind("access", r"AKIA[A-Z0-9]+", 20),
    # Runs are maximal, so asking for the length in the pattern finds the same ones sooner.
    Kind("hex", r"[0-9a-f]{24,}", 24),
    Kind("provider", r"(?:gh[pousr]_|glpat-|sk_live_|xox[abps]-|AIza)[A-Za-z0-9_-]{16,}", 20,
         base=False),
    Kind("bearer", r"(?i)\bbearer\x20+[A-Za-z0-9._~+/-]{16,}=*", 23, base=False),
    Kind("opaque", r"\b(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])"
         r"[A-Za-z0-9+/_-]{28,}", 28, base=False),
)


def _matches(text: Column, kind: Kind, number: int) -> Column:
    """All matches of a kind in their order: how far each lies behind the one before, its length,
    and its value's length and hashes.

    The texts between matches come from splitting at the pattern. Each regular expression runs
    once over a text; what follows looks at one match at a time.
    """
    pattern = F.lit(kind.pattern)
    rows = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, 0).alias("whole"),
        F.regexp_extract_all(text, pattern, kind.value_group).alias("value"),
    )
    made = F.transform(rows, lambda r, nth: F.struct(
        F.lit(number).alias("kind"), nth.alias("nth"),
        (F.length(r.gap) + F.length(r.whole)).alias("step"), F.length(r.whole).alias("span"),
        F.length(r.value).alias("chars"),
        F.xxhash64(r.value).alias("high"), F.xxhash64(F.lit("value"), r.value).alias("low"),
    ))
    empty = F.array().cast(
        "array<struct<kind:int,nth:int,step:int,span:int,chars:int,high:bigint,low:bigint>>"
    )
    return F.when(text.rlike(kind.pattern), made).otherwise(empty)


def _constant(values, kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), kind + 1)


def _spans(matches: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Start and stop (code points, end exclusive) of every match, and which of them are base;
    others only where no base span lies.

    Positions are running totals over the matches of a text and kind. A base span that overlaps
    starts before, and then the furthest stop so far is beyond the start, or after, and then the
    next start is before the stop: two ordered passes over the spans of a text, however many.
    """
    along = Window.partitionBy("no", "kind").orderBy("nth")
    along = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum("step").over(along).cast("int")
    spans = matches.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("span"))
    spans = spans.filter(F.col("chars") >= _constant([k.min_chars for k in kinds], F.col("kind")))
    spans = spans.withColumn("base", _constant([k.base for k in kinds], F.col("kind")))
    if all(k.base for k in kinds):
        return spans
    rising = Window.partitionBy("no").orderBy("start", "kind")
    falling = Window.partitionBy("no").orderBy(F.desc("start"), F.desc("kind"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_base = lambda c: F.when(F.col("base"), F.col(c))
    spans = spans.withColumns({
        "reach": F.max(of_base("stop")).over(upto(rising)),
        "next": F.min(of_base("start")).over(upto(falling)),
    })
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) \
        & F.coalesce(F.col("next") >= F.col("stop"), F.lit(True))
    return spans.filter(F.col("base") | free)


def scan_secrets(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
    repository: str = "doc_id", kinds: tuple[Kind, ...] = KINDS, max_owners: int = 1,
) -> DataFrame:
    """Every input row (without its text) with ``spans``, by start and then kind.

    A span has ``kind, start, stop, base, owners, repositories, texts, live``. Values are compared
    across the corpus by 128-bit hashes and counted by distinct owner, repository and text (by its
    hash, so copies of one text count once). The lesser of repositories and texts is a value's
    uses. It is an example if more owners hold it than usual (``max_owners`` at least) in more
    than ``WIDE_TEXTS`` times the usual uses; if its uses are more than ``HEAVY_TEXTS`` times the usual ones,
    all inside one owner or not; or if every owner of the corpus holds it, and these are more than
    ``max_owners``. Otherwise it is live. Usual is what ``USUAL`` of all distinct values do not
    exceed. Base spans always stay; candidates of other kinds stay if they are live and no base
    span overlaps them.

    Counts are combined before each shuffle, so an example in a third of all documents is one row
    per task and owner. Spans without texts, and the counts, are written to the shared folder and
    joined from there. The work is proportional to texts and matches, also where one text has very many.

    A NULL or empty text has no spans. A NULL owner or repository counts as one of its own. Repeated
    rows are all returned; they are the same repository. All other columns are passed on, but
    a column ``spans`` is replaced. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in (text, "spans")]
    body = F.coalesce(docs[text], F.lit(""))
    nobody = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit(""))
    row = F.struct(*(docs[c] for c in own), F.lit(0).alias(fresh("_", docs)))
    found = docs.select(
        row.alias("row"), F.monotonically_increasing_id().alias("no"),
        nobody(owner).alias("owner"), nobody(repository).alias("repository"),
        F.xxhash64(body).alias("text_hash"),
        F.concat(*(_matches(body, k, i) for i, k in enumerate(kinds))).alias("found"),
    )
    stage = Stage(docs.sparkSession)
    stage.write("found", found)  # the numbers are fixed from here on
    found = stage.read("found")
    matches = found.filter("size(found) > 0").select(
        "no", "owner", "repository", "text_hash", F.inline("found")
    )
    # What lies behind the last match of a text has no match of its own.
    stage.write("spans", _spans(matches.filter("span IS NOT NULL"), kinds).select(
        "no", "owner", "repository", "text_hash", "kind", "start", "stop", "base", "high", "low"
    ))
    each = stage.read("spans")
    stage.write("values", each.groupBy("high", "low").agg(
        F.count_distinct("owner").alias("owners"),
        F.count_distinct("repository").alias("repositories"),
        F.count_distinct("text_hash").alias("texts"),
    ))
    values, uses = stage.read("values"), F.least("repositories", "texts")
    usual = lambda c: F.coalesce(F.percentile(c, USUAL), F.lit(1.0))
    usual_owners, usual_uses = values.agg(usual(F.col("owners")), usual(uses)).first()
    all_owners = found.agg(F.count_distinct("owner")).first()[0]
    owners = F.col("owners")
    example = (
        (owners > max(max_owners, usual_owners)) & (uses > WIDE_TEXTS * usual_uses)
        | (uses > HEAVY_TEXTS * usual_uses)
        | (owners > max_owners) & (owners == all_owners)
    )
    names = F.array(*(F.lit(k.name) for k in kinds))
    judged = each.drop("owner", "repository", "text_hash").join(values, ["high", "low"]).withColumns({
        "live": ~example, "owners": owners.cast("int"),
    })
    stays = judged.filter("base OR live").groupBy("no").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.col("kind").alias("number"), "stop", "base", "owners", "repositories", "texts",
        "live",
    ))).alias("spans"))
    spans = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(
        F.element_at(names, s.number + 1).alias("kind"), s.start.alias("start"),
        s.stop.alias("stop"), s.base.alias("base"), s.owners.alias("owners"),
        s.repositories.alias("repositories"), s.texts.alias("texts"), s.live.alias("live"),
    ))
    joined = found.join(stays, "no", "left")
    return joined.select(*(F.col(f"row.`{c}`") for c in own), spans.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def digest_secrets(docs: DataFrame) -> DataFrame:
    """Counts and lists of the spans of every document, and how many of them look live."""
    scanned = scan_secrets(docs.select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s.base)
    count = lambda name: F.size(F.filter(base, lambda s: s.kind == name)).cast("long")
    return scanned.select(
        "doc_id", *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"),
    )
