"""URL rules, found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikeforge.llm.shared import fresh, lower_ascii

#: Literal tokens of urls and rules are maximal runs of these.
TOKEN = "[a-z0-9]+"
#: What a rule's ``^`` stands for: a character that separates, or the end.
SEPARATOR = "(?:[^A-Za-z0-9_.%-]|$)"


@dataclass(frozen=True)
class SiteRule:
    """Judges a host, all its subdomains, and paths that begin with the rule's."""

    site: str
    verdict: str

    @property
    def name(self) -> str:
        return self.site

    @property
    def specificity(self) -> int:
        return len(self.site)

    def regex(self) -> str:
        return rf"(?s)^(?:.*\.)?{_quoted(self.site.partition('/')[0].lower())}\z"

    def prefix(self) -> str:
        return "".join(self.site.partition("/")[1:])

    def tokens(self) -> list[str]:
        """Whole tokens of whatever the rule fits: its path may end inside one."""
        return re.findall(TOKEN, re.sub("[A-Za-z0-9]+$", "", self.site).lower())


@dataclass(frozen=True)
class PatternRule:
    """Judges urls that hold a pattern: literal text, ``*`` for anything, ``^`` for a separator."""

    pattern: str
    verdict: str

    @property
    def name(self) -> None:
        return None

    @property
    def specificity(self) -> int:
        return -1

    def regex(self) -> str:
        special = {"*": ".*", "^": SEPARATOR}
        return "(?s)" + "".join(special.get(c) or _quoted(c) for c in self.pattern)

    def prefix(self) -> str:
        return ""

    def tokens(self) -> list[str]:
        """Only those that literal text bounds on both sides are whole tokens of the url."""
        bounded = re.finditer("(?<=[^*A-Za-z0-9])[A-Za-z0-9]+(?=[^*A-Za-z0-9])", self.pattern)
        return [m[0].lower() for m in bounded]


Rule = SiteRule | PatternRule


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for NULL."""
    after = F.when(
        F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))
    ).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    return lower_ascii(host), path


def url_tokens(url: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit(TOKEN), 0)
    return F.array_distinct(found)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (i, r.name, r.verdict, r.specificity, isinstance(r, SiteRule), r.regex(), r.prefix(),
         r.tokens())
        for i, r in enumerate(rules)
    ]
    schema = """rule_no int, rule string, verdict string, specificity int, on_site boolean,
        regex string, prefix string, tokens array<string>"""
    return spark.createDataFrame(rows, schema)


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under the one of its tokens that fewest urls hold; ties by token.

    ``tokens``: one row per url and token. A rule without a whole token stands under the
    empty one, which every url has. Counts are taken of the rules' tokens only.
    """
    literal = rules.select("rule_no", F.explode("tokens").alias("token")).distinct()
    counted = tokens.join(literal.select("token").distinct(), "token", "left_semi")
    counted = counted.groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    weighed = literal.join(counted, "token", "left").withColumn(
        "n_urls", F.coalesce("n_urls", F.lit(0))
    )
    first = Window.partitionBy("rule_no").orderBy("n_urls", "token")
    rarest = weighed.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    rarest = rarest.select("rule_no", "token")
    return rules.drop("tokens").join(rarest, "rule_no", "left").withColumn(
        "token", F.coalesce("token", F.lit(""))
    )


def judge_urls(
    urls: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per distinct url: ``url, host, path, rule, verdict``.

    A site rule that fits decides, the longest first (ties: the lesser text); ``rule`` names it.
    Without one, a pattern rule that blocks does, then ``default``. Tokens of a url fetch the
    rules that stand under them, and only those run their regular expressions, against
    the host for site rules (the path is compared as text) and the whole url for pattern rules.

    Repeated urls are judged once, combined before the shuffle. NULL is a url with empty host and
    path; empty tables give empty results.
    """
    host, path = split_url(F.col("url"))
    distinct = urls.select(F.col(url).alias("url")).distinct()
    parts = distinct.select("url", host.alias("host"), path.alias("path"))
    tokens = parts.select("url", "host", "path", F.explode(
        F.array_append(url_tokens(F.col("url")), F.lit(""))
    ).alias("token"))
    index = rule_index(rule_table(urls.sparkSession, rules), tokens.select("token"))
    subject = F.when(F.col("on_site"), F.col("host")).otherwise(F.coalesce("url", F.lit("")))
    fetched = tokens.join(index, "token").withColumn("subject", subject)
    fits = fetched.filter("subject RLIKE regex AND startswith(path, prefix)")
    # The best of a url: site rules before patterns, the longest, then the lesser text.
    best_first = Window.partitionBy("url").orderBy(
        F.desc("on_site"), F.desc("specificity"), F.asc("rule"),
        F.desc(F.col("verdict") == "block"), F.asc("rule_no"),
    )
    best = fits.withColumn("_n", F.row_number().over(best_first)).filter("_n = 1")
    best = best.select(F.col("url").alias("_url"), "rule", "verdict")
    judged = parts.join(best, F.col("url").eqNullSafe(F.col("_url")), "left")
    return judged.select(
        "url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` and ``verdict`` of its url.

    Columns of ``pages`` with these names are replaced; repeated rows are all returned.
    """
    made = ("host", "path", "rule", "verdict")
    key = fresh("_url", pages)
    judged = judge_urls(pages, rules, url=url, default=default).withColumnRenamed("url", key)
    own = pages.drop(*made)
    joined = own.join(judged, F.col(url).eqNullSafe(F.col(key)), "left")
    return joined.select(*own.columns, *made)
