"""URL filter: host and path rules first, then a ratio of two character language models.

The models are variable-order Markov chains over lower-cased URLs (without scheme), one of accepted and one of rejected URLs,
smoothed by Witten-Bell interpolation from order 0 up to `order`.  They are fitted on at most `fit_rows` labelled URLs (the
first by hash), four fifths of them for counts and one fifth for calibration: the threshold on the difference of log10
likelihoods per character is the one of best balanced accuracy there.

Nulls: a null URL, or one without `://`, has an empty host and path, and the models judge the empty text.  Equal rows get equal
answers.
Other columns of the input are kept unless their name is one of the result's.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule(rules: list[tuple[str, str, str]], at: Column, way: Column) -> Column:
    """The longest fitting rule as (rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((at == h) | at.endswith(f".{h}")) & way.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class Markov:
    """Witten-Bell: P(c | s) = (n(s, c) + t(s) P(c | shorter s)) / (n(s) + t(s)), t: distinct successors; below order 0 uniform over `symbols`."""

    def __init__(self, texts, order: int = 4, symbols: int = 256):
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for n in range(order + 1):
                    counts[padded[i - n : i]][padded[i]] += 1
        self.order, self.symbols = order, symbols
        self.counts = {s: (sum(own.values()), dict(own)) for s, own in counts.items()}
        self.known: dict[str, float] = {}

    def log10_of(self, gram: str) -> float:
        """Of its last character after those before; kept, up to a fixed number."""
        found = self.known.get(gram)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[gram] = math.log10(self.p(gram[:-1], gram[-1]))
        return found

    def p(self, s: str, c: str) -> float:
        low = self.p(s[1:], c) if s else 1 / self.symbols
        n, own = self.counts.get(s, (0, {}))
        return (own.get(c, 0) + len(own) * low) / (n + len(own)) if n else low

    def log10(self, text: str) -> float:
        padded, k = "\x02" * self.order + text + "\x03", self.order
        return sum(self.log10_of(padded[i - k : i + 1]) for i in range(k, len(padded)))


def shown(url: str | None) -> str:
    return (url or "").partition("://")[2].lower()


class Ratio:
    """difference(url) < threshold: rejected."""

    def __init__(self, rows: list[tuple[str, bool]], order: int = 4):
        fold = [zlib.crc32(u.encode()) % 5 for u, _ in rows]
        self.good = Markov((shown(u) for (u, ok), f in zip(rows, fold, strict=True) if ok and f), order)
        self.bad = Markov((shown(u) for (u, ok), f in zip(rows, fold, strict=True) if not ok and f), order)
        self.threshold = calibrated([(self.difference(u), ok) for (u, ok), f in zip(rows, fold, strict=True) if not f])

        for x in (self.good, self.bad):
            x.known.clear()  # what is broadcast holds the counts alone

    def difference(self, url: str | None) -> float:
        text = shown(url)
        return (self.good.log10(text) - self.bad.log10(text)) / (len(text) + 1)


def calibrated(scored: list[tuple[float, bool]]) -> float:
    """The threshold of best balanced accuracy; minus infinity unless both classes are there."""
    good, bad = sum(ok for _, ok in scored), sum(not ok for _, ok in scored)
    if not good or not bad:
        return -math.inf
    best, at, lost, caught = 0.5, -math.inf, 0, 0
    scored = sorted(scored)
    for (x, ok), (y, _) in zip(scored, scored[1:], strict=False):
        lost, caught = lost + ok, caught + (not ok)
        if y > x and (now := (caught / bad + 1 - lost / good) / 2) > best:
            best, at = now, (x + y) / 2
    return at


def judge(pages: DataFrame, rules=RULES, fit_rows: int = 20_000, order: int = 4) -> DataFrame:
    """pages(url, ...) with host, path, rule, verdict and difference (null where a rule decides)."""
    ruled_by = "_" * (1 + max(map(len, pages.columns)))  # a name that no column has
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "difference")]
    url = F.col("url").cast("string")
    ruled = pages.select(*kept).withColumns({"host": host(url), "path": path(url)})
    ruled = ruled.withColumn(ruled_by, rule(rules, F.col("host"), F.col("path")))
    labelled = ruled.where(F.col(ruled_by).isNotNull()).select(url.alias("url"), (F.col(f"{ruled_by}.verdict") == "allow").alias("ok"))
    rows = [tuple(r) for r in labelled.orderBy(F.xxhash64("url"), "url").limit(fit_rows).collect()]
    model = ruled.sparkSession.sparkContext.broadcast(Ratio(rows, order))
    threshold = model.value.threshold

    @F.pandas_udf("double")
    def difference(urls):
        return urls.map(model.value.difference)

    # Only URLs without a rule go to the models.
    by_rule = ruled.where(F.col(ruled_by).isNotNull()).withColumn("difference", F.lit(None).cast("double"))
    scored = ruled.where(F.col(ruled_by).isNull()).withColumn("difference", difference(F.coalesce(url, F.lit(""))))
    told = by_rule.unionByName(scored)
    verdict = F.coalesce(F.col(f"{ruled_by}.verdict"), F.when(F.col("difference") < F.lit(threshold), "block").otherwise("allow"))
    return told.select(*kept, "host", "path", F.col(f"{ruled_by}.rule").alias("rule"), verdict.alias("verdict"), "difference")
