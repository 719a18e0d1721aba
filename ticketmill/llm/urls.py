"""URL filter: rules first, boosted trees on lexical features for the rest.

The trees are trained from URLs that carry a verdict already; here those are the ones a rule fits.
Training needs no row on the driver: every level of a tree is one aggregation of gradients by leaf,
feature and bin, whose result is bounded by leaves times features times bins. The finished trees are
compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, prepare, staged

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts like its own.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Labelled URLs that the trees are trained on at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 10, 3, 24
#: Parts of the labelled URLs; a URL's own part has no say in the shares it is trained with.
FOLDS = 5
SHRINKAGE, RIDGE = 0.4, 1.0

FEATURES = [
    "length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "longest_number",
    "entropy", "parameters", "query_length", "suffix_share", "domain_share", "ending_share",
]
#: Which features count labels of an ending, and the ending.
SHARES = {"suffix_share": "suffix", "domain_share": "domain", "ending_share": "ending"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[0] + rule[1]


def matched_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls; of equally long ones the first."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules or RULES, key=lambda r: len(rule_name(r))):
        own, start, says = rule
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        name = F.when(fits, F.lit(rule_name(rule))).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def described(pages: DataFrame, url: str = "url", rules=None) -> DataFrame:
    """``pages`` with host, path, rule, rule_verdict, lexical features and the three endings."""
    host, path = host_and_path(F.col(url))
    df = pages.withColumns(
        {"_url": F.coalesce(F.col(url), F.lit("")), "host": host, "path": path}
    )
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    size = F.length("_url")
    digits = F.length(F.regexp_replace("_url", "[^0-9]", ""))
    # Natural logarithms of the shares of all distinct characters.
    entropy = F.aggregate(
        F.array_distinct(F.split("_url", "")),
        F.lit(0.0),
        lambda total, c: total + F.when(c == "", 0.0).otherwise(_information(c)),
    )
    numbers = F.transform(F.regexp_extract_all("_url", F.lit("([0-9]+)"), 1), lambda x: F.length(x))
    return df.withColumns(
        {
            "rule": name,
            "rule_verdict": verdict,
            "length": size.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
            "host_labels": F.length(F.regexp_replace("host", "[^.]", "")).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(digits.cast("double"), size.cast("double")), F.lit(0.0)),
            "longest_number": F.coalesce(F.array_max(numbers), F.lit(0)).cast("double"),
            "entropy": entropy,
            "parameters": F.when(query == "", 0.0).otherwise(
                F.length(F.regexp_replace(query, "[^&]", "")) + 1.0
            ),
            "query_length": F.length(query).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1),
        }
    ).drop("_url")


def _information(c: Column) -> Column:
    n = F.length("_url").cast("double")
    share = (n - F.length(F.replace(F.col("_url"), c, F.lit("")))) / n
    return -share * F.log(share)


@dataclass
class Split:
    """value <= cut goes left. Ends of the tree are numbers."""

    feature: str
    cut: float
    left: Split | float
    right: Split | float

    def value(self) -> Column:
        sides = [s.value() if isinstance(s, Split) else F.lit(float(s)) for s in (self.left, self.right)]
        return F.when(F.col(self.feature) <= self.cut, sides[0]).otherwise(sides[1])


@dataclass
class UrlModel:
    """log-odds of ``block`` = base + the sum of all trees; shares of labels by ending."""

    base: float
    trees: list[Split | float] = field(default_factory=list)
    shares: dict[str, DataFrame] = field(default_factory=dict)

    def log_odds(self) -> Column:
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + (tree.value() if isinstance(tree, Split) else F.lit(float(tree)))
        return total

    def with_shares(self, df: DataFrame) -> DataFrame:
        """Each ending's share of blocked URLs; endings not seen in training get the usual share."""
        usual = 1 / (1 + 2.718281828459045 ** -self.base)
        for name, ending in SHARES.items():
            if ending in self.shares:
                df = df.join(self.shares[ending], ending, "left")
                df = df.withColumn(name, F.coalesce(name, F.lit(usual)))
            else:
                df = df.withColumn(name, F.lit(usual))
        return df


def _out_of_fold(chosen: DataFrame, rate: float) -> DataFrame:
    """``chosen`` with the shares of its endings among the rows of all other folds."""
    chosen = chosen.withColumn("_fold", F.pmod(F.xxhash64("path", "host"), F.lit(FOLDS)))
    for name, ending in SHARES.items():
        own = chosen.groupBy(ending, "_fold").agg(F.sum("block").alias("_s"), F.count("*").alias("_n"))
        every = own.groupBy(ending).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
        shares = own.join(every, ending).select(
            ending,
            "_fold",
            ((F.col("_all_s") - F.col("_s") + rate) / (F.col("_all_n") - F.col("_n") + 1.0)).alias(name),
        )
        chosen = chosen.join(shares, [ending, "_fold"])
    return chosen.drop("_fold")


def _middles(binned: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[float]]:
    """Cuts halfway between the values on either side, so that a split leans to neither."""
    at = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b"), F.col(f).alias("v"))
                for f in FEATURES
            ]
        )
    ).alias("at")
    ends = binned.select(at).groupBy("at.f", "at.b").agg(F.min("at.v").alias("least"), F.max("at.v").alias("most"))
    rows = sorted((r.f, r.b, r.least, r.most) for r in ends.collect())
    out = {f: list(c) for f, c in cuts.items()}
    for (f, b, _, most), (g, _, least, _) in zip(rows, rows[1:]):
        middle = (most + least) / 2
        if f == g and most <= middle < least:
            out[f][b] = middle
    return out


def _best_splits(sample: DataFrame, leaf: Column, model: UrlModel, cuts: dict[str, list[float]]):
    """{leaf: (gain, feature, cut, left value, right value, own value)} from one aggregation."""
    p = 1 / (1 + F.exp(-model.log_odds()))
    rows = sample.withColumn("_leaf", leaf).select(
        "_leaf",
        (F.col("block") - p).alias("g"),
        (p * (1 - p)).alias("h"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])
        ).alias("at"),
    )
    sums: dict[tuple[int, str], list[tuple[int, float, float]]] = {}
    for r in rows.groupBy("_leaf", "at.f", "at.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        sums.setdefault((r["_leaf"], r.f), []).append((r.b, round(r.g, 9), round(r.h, 9)))
    best: dict[int, tuple] = {}
    for (at, f), bins in sorted(sums.items()):
        g, h = sum(x[1] for x in bins), sum(x[2] for x in bins)
        own = g / (h + RIDGE)
        best.setdefault(at, (1e-6, None, 0.0, own, own, own))
        gl = hl = 0.0
        for b, bg, bh in sorted(bins)[:-1]:
            gl, hl = gl + bg, hl + bh
            gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
            if b < len(cuts[f]) and gain > best[at][0] + 1e-9:
                best[at] = (gain, f, cuts[f][b], gl / (hl + RIDGE), (g - gl) / (h - hl + RIDGE), own)
    return best


def _grow(sample: DataFrame, model: UrlModel, cuts: dict[str, list[float]]) -> Split | float:
    """One tree, a level at a time. Leaves are numbered 1; 2, 3; 4 to 7 as in a heap."""
    splits: dict[int, tuple] = {}
    values: dict[int, float] = {}
    leaf, open_ = F.lit(1), {1}
    for depth in range(DEPTH):
        best = _best_splits(sample.filter(leaf.isin(sorted(open_))), leaf, model, cuts)
        grown = set()
        for at, (_, f, cut, left, right, own) in best.items():
            if f is None:
                values[at] = own
                continue
            splits[at] = (f, cut)
            values[2 * at], values[2 * at + 1] = left, right
            grown |= {2 * at, 2 * at + 1}
        if not grown or depth == DEPTH - 1:
            break
        step = leaf
        for at in sorted({n // 2 for n in grown}):
            f, cut = splits[at]
            step = F.when(leaf == at, F.when(F.col(f) <= cut, 2 * at).otherwise(2 * at + 1)).otherwise(step)
        leaf, open_ = step, grown

    def build(at: int) -> Split | float:
        if at in splits:
            return Split(*splits[at], build(2 * at), build(2 * at + 1))
        return SHRINKAGE * values.get(at, 0.0)

    return build(1)


def train(labelled: DataFrame, sample: int = SAMPLE_ROWS) -> UrlModel:
    """A model from described rows with ``block`` (0 or 1), at most ``sample`` of them.

    The sample are the distinct rows with the lowest hashes, the same in every run; copies of a url count
    once, however many there are. Without rows the model allows everything; with one label only it says
    that label.
    """
    chosen = staged(lowest_hashes(labelled, sample), "urls")
    n, blocked = chosen.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0))).first()
    if not n:
        return UrlModel(-1.0)
    rate = (blocked + 0.5) / (n + 1)
    model = UrlModel(log(rate / (1 - rate)))
    if blocked in (0, n):
        return model
    for name, ending in SHARES.items():  # endings of the sample: SAMPLE_ROWS rows at most
        model.shares[ending] = staged(
            chosen.groupBy(ending).agg(((F.sum("block") + rate) / (F.count("*") + 1.0)).alias(name)),
            "shares",
        )
    chosen = staged(_out_of_fold(chosen, rate), "urls")
    points = [i / BINS for i in range(1, BINS)]
    edges = chosen.agg(*[F.percentile(f, F.lit(points)).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f])) for f in FEATURES}
    # Bin b has the values above cut b - 1 and up to cut b.
    binned = {
        f"bin_{f}": reduce(
            lambda total, c, f=f: total + (F.col(f) > c).cast("int"), cuts[f], F.lit(0)
        )
        for f in FEATURES
    }
    chosen = staged(chosen.withColumns(binned), "bins")
    cuts = _middles(chosen, cuts)
    for _ in range(TREES):
        model.trees.append(_grow(chosen, model, cuts))
    return model


def judge(pages: DataFrame, url: str = "url", rules=None, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``block_chance`` (columns of these names go).

    The verdict is the longest fitting rule's, else the trees': ``block`` from a chance of 0.5 on.
    Null, empty and malformed urls have empty host and path, fit no rule and are left to the trees.
    Repeated rows get equal results.
    """
    prepare(pages.sparkSession)
    made = ["host", "path", "rule", "block_chance", "verdict"]
    keep = [c for c in pages.columns if c not in made]
    # The page travels as one value, so none of its columns can clash with a feature.
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page")
    rows = described(pages.select(page, F.col(url).alias("_source")), "_source", rules)
    labelled = rows.filter("rule IS NOT NULL").select(
        "host", "path", *FEATURES[: -len(SHARES)], *SHARES.values(),
        (F.col("rule_verdict") == "block").cast("int").alias("block"),
    )
    model = train(labelled, sample)
    chance = 1 / (1 + F.exp(-model.log_odds()))
    judged = model.with_shares(rows).withColumn("block_chance", chance)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).select(
        *[F.col("_page").getField(c).alias(c) for c in keep], *made
    )
