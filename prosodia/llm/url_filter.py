"""URL filtering: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import LOWER, UPPER, materialise

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Parts that rows of rare and unknown suffixes are dealt to.
SALTS = 16
#: Bin edges of the lexical features; a value's bin is the number of edges that it exceeds.
EDGES = {
    "length": (25, 30, 35, 40, 45, 50, 60, 80, 120),
    "host_length": (8, 12, 16, 20, 24, 32),
    "depth": (1, 2, 3, 4, 6),
    "labels": (1, 2, 3, 4),
    "digit_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "entropy": (3.0, 3.4, 3.7, 3.9, 4.1, 4.3, 4.6),
    "params": (0, 1, 2, 4),
    "hyphens": (0, 1, 2, 4),
    "suffix": (-2.0, -1.0, -0.5, -0.2, 0.2, 0.5, 1.0, 2.0),
}


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule_host: str, rule_path: str) -> Column:
    in_host = (F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)
    return in_host & F.col("path").startswith(rule_path)


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``: the longest rule that fits, else nulls.

    Of rules of one length the first in the list wins. The list is a literal of the plan, as long as curated lists are;
    longer ones belong in a table that is joined on the host's suffixes.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = _fits(rule_host, rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Bits for each character, by its own character frequencies; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.coalesce(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c))), F.lit(0.0))


def features(urls: DataFrame) -> DataFrame:
    """Adds the raw features to rows with ``url``, ``host`` and ``path``. Entropy is the host's and path's: query strings
    and whole very long texts do not make it slower than linear in their length times their alphabet."""
    url = F.coalesce("url", F.lit(""))
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(F.concat("host", "path")),
            "params": F.when(F.instr(url, "?") > 0, F.regexp_count(F.substring_index(url, "?", -1), F.lit("[^&#]+"))).otherwise(0).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        }
    )


def _binned(name: str) -> Column:
    return sum((F.col(name) > F.lit(float(e))).cast("int") for e in EDGES[name])


#: Suffixes that may be sent to every task, the most frequent ones, and how long such a suffix is at most.
HEAD_SUFFIXES, HEAD_CHARS = 10_000, 253


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, bin, left, right) with leaf weights, and a table (tld, suffix, rank) of all
    suffixes' log-odds; the rank is 1 for those sent to every task and 0 for the others."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None

    def margin(self) -> Column:
        def say(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, bin_, left, right = node
            return F.when(F.col(f"b_{name}") <= bin_, say(left)).otherwise(say(right))

        return sum((say(t) for t in self.trees), F.lit(self.base))

    def apply(self, urls: DataFrame) -> DataFrame:
        """Adds ``block_score`` between 0 and 1 to rows with ``url``, ``host`` and ``path``, by functions and joins only."""
        scored = features(with_suffix(urls, self.suffixes))
        scored = scored.withColumns({f"b_{n}": _binned(n) for n in EDGES})
        scored = scored.withColumn("block_score", 1 / (1 + F.exp(-self.margin())))
        return scored.select(*urls.columns, "block_score")


def _tld() -> Column:
    return F.substring_index("host", ".", -2)


def with_suffix(rows: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Adds ``suffix``, the log-odds of the last two labels of each row's ``host``; 0 where no labelled url has them.

    Frequent suffixes meet their rows where these are. What is left has no key that many rows share, but rows of suffixes
    that are in no label: these are told apart by a hash of the url, so that one unknown suffix is not one task's.
    """
    if suffixes is None:
        return rows.withColumn("suffix", F.lit(0.0))
    head = F.broadcast(suffixes.where("rank = 1").select("tld", F.col("suffix").alias("sent")))
    rows = rows.withColumn("tld", _tld()).join(head, "tld", "left")
    known = rows.where("sent is not null").withColumn("suffix", F.col("sent")).drop("sent", "tld")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    tail = suffixes.where("rank = 0").select("tld", F.col("suffix").alias("rare"), F.explode(salts).alias("salt"))
    others = rows.where("sent is null").withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(tail, ["tld", "salt"], "left")
    return known.unionByName(others.withColumn("suffix", F.coalesce("rare", F.lit(0.0))).drop("sent", "rare", "salt", "tld"))


def fit(labelled: DataFrame, trees: int = 30, depth: int = 3, rate: float = 0.3, max_rows: int = 50_000) -> Trees:
    """Learns from ``labelled`` (url, host, path, block 0 or 1; null labels are left out).

    Log-odds of suffixes come from all rows and cover all suffixes; their table stays distributed. Trees are grown from
    about ``max_rows`` rows, chosen by a hash of the url, counted by the bins of all features: that many cells at most
    reach the driver. What the trees see of suffixes comes from the half of the rows that they are not grown from, since
    a suffix of one url would give its label away. No labels or one class only: no trees, and the score is the smoothed
    share of blocked rows (0 without labels).
    """
    rows = labelled.where("block is not null").withColumn("half", F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2)))
    total = rows.agg(F.count("*"), F.sum("block"), F.sum("half")).first()
    n, blocked, grown = total[0], total[1] or 0, total[2] or 0
    if not n:
        return Trees(base=-30.0)
    prior = math.log((blocked + 1) / (n - blocked + 1))
    if blocked in (0, n):
        return Trees(base=prior)
    odds = lambda n, b: F.log((F.col(b) + 1) / (F.col(n) - F.col(b) + 1)) - prior
    other = F.when(F.col("half") == 0, F.col("block"))
    by = rows.groupBy(_tld().alias("tld")).agg(
        F.count("*").alias("n"), F.sum("block").alias("b"), F.count(other).alias("n0"), F.coalesce(F.sum(other), F.lit(0)).alias("b0")
    )
    top = by.where(F.length("tld") <= HEAD_CHARS).orderBy(F.desc("n"), "tld").limit(HEAD_SUFFIXES).select("tld", F.lit(1).alias("top"))
    by = by.join(F.broadcast(top), "tld", "left")
    suffixes = materialise(by.select("tld", odds("n", "b").alias("suffix"), odds("n0", "b0").alias("other_half"), F.coalesce("top", F.lit(0)).alias("rank")))
    names = list(EDGES)
    share = min(1_000_000, max(1, round(1_000_000 * max_rows / max(grown, 1))))
    some = rows.where((F.col("half") == 1) & (F.pmod(F.xxhash64("url", F.lit("trees")), F.lit(1_000_000)) < share))
    seen = with_suffix(some, suffixes.select("tld", F.col("other_half").alias("suffix"), "rank"))
    binned = features(seen).select(*(_binned(x).alias(x) for x in names), "block")
    cells = binned.groupBy(*names).agg(F.count("*").alias("n"), F.sum("block").alias("b"))
    return Trees(prior, _boost(sorted(map(tuple, cells.collect())), names, prior, trees, depth, rate), suffixes.drop("other_half"))


def _boost(cells: list[tuple], names: list[str], base: float, trees: int, depth: int, rate: float) -> list:
    """Histogram boosting on the logistic loss over weighted cells."""
    k = len(names)
    margin = [base] * len(cells)
    out = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [c[k] * q - c[k + 1] for c, q in zip(cells, p, strict=True)]
        hess = [c[k] * q * (1 - q) for c, q in zip(cells, p, strict=True)]

        def grow(rows: list[int], left: int, grad=grad, hess=hess):
            g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
            leaf = -rate * g / (h + 1.0)
            best = (1e-3, None)
            for f in range(k if left else 0):
                sums: dict[int, list[float]] = {}
                for i in rows:
                    s = sums.setdefault(cells[i][f], [0.0, 0.0])
                    s[0] += grad[i]
                    s[1] += hess[i]
                gl = hl = 0.0
                for bin_ in sorted(sums)[:-1]:
                    gl, hl = gl + sums[bin_][0], hl + sums[bin_][1]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, bin_))
            if best[1] is None:
                for i in rows:
                    margin[i] += leaf
                return leaf
            f, bin_ = best[1]
            return (names[f], bin_, grow([i for i in rows if cells[i][f] <= bin_], left - 1), grow([i for i in rows if cells[i][f] > bin_], left - 1))

        out.append(grow(list(range(len(cells))), depth))
    return out


def judge(
    pages: DataFrame,
    model: Trees | None = None,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): one row per input row.

    The verdict is that of the longest rule that fits, else ``block`` where the trees' score reaches the threshold.
    Without a model, the trees are trained on the pages that rules decide: those are the labelled URLs. Null urls and
    urls without ``://`` have an empty host and path, fit no rule and are judged by the trees. Repeated rows come out as
    often as they came in. Very long urls are read whole. An empty table gives no rows; further columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = with_rule(rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}), rules)
    if model is None:
        model = fit(rows.select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("block")))
    scored = model.apply(rows)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
