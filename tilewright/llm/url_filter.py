"""URL filtering by rules and a character language-model ratio, in DataFrame operations only.

Rules decide first. The urls that a rule accepts or rejects train two character models of
variable order (contexts of 0 to ORDER characters, each order interpolated with the next
shorter one by Witten and Bell's weights). All other urls are judged by the difference of
the two log-likelihoods per character, against a threshold that is calibrated on a
quarter of the decided urls, which trains nothing.

Counts cover every decided url. They are kept by window (the character and its context):
a pre-aggregated table far smaller than the text. Each window's difference is worked out
once there. Urls look theirs up with a broadcast join while that table has at most
BROADCAST_WINDOWS rows, else with a shuffled join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ORDER = 4
BROADCAST_WINDOWS = 400_000
#: Calibration looks at differences per character in steps of this size, up to BINS steps from 0.
STEP, BINS = 0.01, 1000
#: The rules to apply, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_PAD, _END = "\u0001", "\u0002"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A to Z in lower case. Empty if null or without ://."""
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def _windows(urls: DataFrame, keep: list[str], order: int) -> DataFrame:
    """A row for each character of host and path and for their end, with its context."""
    # a url's own marks would be taken for its start or end
    plain = F.translate(F.concat("host", "path"), _PAD + _END, "\ufffd\ufffd")
    padded = F.concat(F.lit(_PAD * order), plain, F.lit(_END))
    rows = urls.select(*keep, padded.alias("s"))
    at = F.explode(F.sequence(F.lit(1), F.length("s") - order)).alias("at")
    return rows.select(*keep, "s", at).select(*keep, F.expr(f"substring(s, at, {order + 1})").alias("w"))


def window_ratios(windows: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, llr) of windows (w, a, r): how often each ends an accepted or a rejected url's context."""
    size = 65536  # characters that the shortest model takes for possible
    known: DataFrame | None = None
    for k in range(order + 1):
        grams = windows.groupBy(F.expr(f"right(w, {k + 1})").alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.expr(f"left(g, {k})"))
        for c in "ar":
            grams = grams.withColumn(f"n{c}", F.sum(c).over(context)).withColumn(f"t{c}", F.sum(F.sign(c)).over(context))
        if known is None:
            shorter = grams.withColumns({"pa": F.lit(1.0 / size), "pr": F.lit(1.0 / size)})
        else:
            shorter = grams.join(known, F.expr("substring(g, 2)") == F.col("short"))
        new = {f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}")) for c in "ar"}
        known = shorter.select(F.col("g").alias("short"), *[v.alias(n) for n, v in new.items()])
    return known.select(F.col("short").alias("w"), (F.log("pa") - F.log("pr")).alias("llr"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    rule is the longest rule that fits (null if none), verdict its verdict; without a rule
    the verdict is "allow" when score, the log-likelihood difference per character, reaches
    the calibrated threshold, else "block". Without accepted or without rejected urls the
    threshold is 0. Null urls and urls without :// have an empty host and path and are
    judged by their end alone. The characters U+0001 and U+0002 are scored as U+FFFD, and
    shown as they are. Repeated rows count and are answered once each; null ids are
    kept. Further columns are not read. An empty table gives an empty result.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("uid", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("test", F.pmod(F.xxhash64("host", "path"), F.lit(4)) == 0)
    verdict = F.col("decided.verdict")
    train = lambda v: F.when((verdict == v) & ~F.col("test"), 1).otherwise(0)
    marked = rows.withColumns({"a": train("allow"), "r": train("block")})
    counts = _windows(marked, ["a", "r"], order).groupBy("w").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    ratios = cut(window_ratios(cut(counts), order))
    lookup = F.broadcast(ratios) if ratios.count() <= BROADCAST_WINDOWS else ratios
    scores = _windows(rows, ["uid", "page_id", "host", "path", "decided", "test"], order).join(lookup, "w")
    scores = scores.groupBy("uid", "page_id", "host", "path", "decided", "test").agg(F.avg("llr").alias("score"))
    scores = cut(scores)
    limit = _threshold(scores.filter(F.col("test") & F.col("decided").isNotNull()))
    own = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return scores.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", own).alias("verdict"), "score")


def _threshold(scored: DataFrame) -> float:
    """The step that best parts accepted from rejected urls (mean of both rates); nearest 0 of equals."""
    step = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / STEP))).cast("int").alias("step")
    found = scored.groupBy(step, F.col("decided.verdict").alias("verdict")).count().collect()
    good = {r["step"]: r["count"] for r in found if r["verdict"] == "allow"}
    bad = {r["step"]: r["count"] for r in found if r["verdict"] == "block"}
    if not good or not bad:
        return 0.0
    best, above, below = [], sum(good.values()), 0
    for s in range(-BINS, BINS + 1):  # accepted at or above step s, rejected below it
        best.append((above / sum(good.values()) + below / sum(bad.values()), -abs(s), s))
        above -= good.get(s, 0)
        below += bad.get(s, 0)
    return max(best)[2] * STEP
