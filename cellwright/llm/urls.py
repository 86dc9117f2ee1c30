"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams.

A rule ``(action, host, path)`` fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's; the longest fitting rule decides (of equally long ones the first by
text, and of contradictory ones that which allows).  A few rules are one expression; more are joined by the suffixes that a host can have.  Where no rule fits, the model
decides: each n-gram of ``^host$`` and of the path adds the weight of its bucket, and a URL is blocked if the sum is positive.
Weights are fixed-point integers, so sums don't depend on their order.

The model is trained on the driver by gradient descent, from ``LABELLED`` or from a table of (url, label) of which at most ``SAMPLE``
rows are taken, those with the least hashes.
Null URLs and those without ``://`` have empty host and path; they get the model's verdict on
empty strings.  Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BUCKETS = 2048
SIZES = (3, 4)
SCALE = 1_000_000
#: Up to so many rules are one expression, and up to so many are broadcast; more are joined by shuffle.
MOST_RULES, MOST_BROADCAST = 100, 100_000
#: Labelled URLs that are taken from a table.
SAMPLE = 5000

#: Invented URLs with label 1 for block.
LABELLED = [
    ("news.example.com", "/en/world/2021/article-17", 0),
    ("www.example.org", "/docs/intro", 0),
    ("blog.example.net", "/posts/how-to-bake-bread", 0),
    ("library.example.org", "/catalogue/item/812", 0),
    ("university.example.edu", "/courses/algebra", 0),
    ("example.com", "/about", 0),
    ("docs.example.io", "/reference/functions", 0),
    ("museum.example.org", "/fr/collections", 0),
    ("forum.example.net", "/thread/4432", 0),
    ("wiki.example.org", "/de/artikel/wald", 0),
    ("science.example.com", "/papers/graph-theory", 0),
    ("weather.example.net", "/es/tiempo/madrid", 0),
    ("m.example.com", "/fr/314", 0),
    ("blog.example.com", "/es/27.html", 0),
    ("en.example.org", "/en/55", 0),
    ("shop.example.com", "/books/history", 0),
    ("recipes.example.net", "/soup/tomato", 0),
    ("history.example.org", "/de/1900", 0),
    ("", "", 0),
    ("city.example.gov", "/services/parking", 0),
    ("casino-bonus.example.com", "/free-spins/win-cash", 1),
    ("xxx-video.example.net", "/adult/clip/99", 1),
    ("cheap-pills.example.org", "/viagra/buy-now", 1),
    ("bet365win.example.com", "/casino/poker", 1),
    ("free-porn.example.net", "/xxx/gallery", 1),
    ("replica-watches.example.com", "/cheap/buy-now", 1),
    ("crypto-double.example.org", "/win-cash/bonus", 1),
    ("escort-girls.example.net", "/adult/city", 1),
    ("warez.example.org", "/crack/keygen-download", 1),
    ("torrent-crack.example.com", "/serial/keygen", 1),
    ("payday-loan.example.net", "/apply/cash-now", 1),
    ("lottery-winner.example.com", "/claim/prize", 1),
    ("hot-singles.example.org", "/adult/chat", 1),
    ("click-bonus.example.net", "/popup/redirect?ad", 1),
    ("pills-online.example.com", "/pharmacy/viagra", 1),
    ("slots.example.org", "/casino/jackpot", 1),
    ("spam-seo.example.net", "/tag/cheap-cheap-cheap", 1),
    ("phish-login.example.com", "/verify/account/password", 1),
    ("poker.example.net", "/bonus/free-spins", 1),
    ("adult-cam.example.org", "/live/xxx", 1),
]


def grams(host: str, path: str) -> list[str]:
    """n-grams marked by their part: h for host, p for path."""
    out = []
    for mark, s in (("h", f"^{host}$"), ("p", path)):
        for n in SIZES:
            out += [mark + s[i : i + n] for i in range(len(s) - n + 1)]
    return out


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % BUCKETS


@lru_cache
def train(labelled: tuple[tuple[str, str, int], ...] = tuple(LABELLED), steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Bias and bucket weights in units of 1 / SCALE, from (host, path, label).  The work is bounded by their number."""
    found = [[_bucket(g) for g in grams(host, path)] for host, path, _ in labelled]
    y = np.array([label for *_, label in labelled], float)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    bucket = np.array([b for f in found for b in f], np.int64)
    w, bias, n = np.zeros(BUCKETS), 0.0, max(1, len(y))
    for _ in range(steps):
        z = np.bincount(row, w[bucket], minlength=len(y)) + bias if len(row) else np.full(len(y), bias)
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        bias -= rate * e.sum() / n
        w = w - rate * (np.bincount(bucket, e[row], minlength=BUCKETS) / n + decay * w)
    return round(float(bias) * SCALE), tuple(round(float(x) * SCALE) for x in w)


def labelled_urls(table: DataFrame, sample: int = SAMPLE) -> tuple[tuple[str, str, int], ...]:
    """(host, path, label) of at most ``sample`` distinct rows of a table (url, label) with labels 0 and 1."""
    host, path = host_path(F.col("url"))
    rows = table.where(F.col("label").isin(0, 1)).select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label")).distinct()
    return tuple((r.host, r.path, r.label) for r in rows.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(sample).collect())


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 2**31 - 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, 2**31 - 1), r"\A[^?#]*", 0)
    return lower_ascii(host), path


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def _chained(base: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    # a later branch is tested first: shortest rules go in first
    for a, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]], r[0] == "allow")):
        fits = _fits(F.col("host"), F.col("path"), h, p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return base.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))


def _joined(base: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join of rules with the ends of hosts, as many labels long as a rule's host is at most."""
    size = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.count(F.lit(1)).alias("n")).first()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(size["labels"] or 1))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    wide = base.withColumn("row", F.monotonically_increasing_id()).withColumn("end", F.explode(ends))
    table = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    if size["n"] <= MOST_BROADCAST:
        table = F.broadcast(table)
    hit = wide.join(table, (F.col("end") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")), "left")
    rule = F.concat("rule_host", "rule_path")
    best = F.min(F.when(rule.isNotNull(), F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), "action")))
    return hit.groupBy("row", "page_id", "host", "path").agg(best.alias("b")).select("page_id", "host", "path", "b.rule", "b.action")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (units of 1 / SCALE) of each row of ``pages``.

    ``rules``: a list or a table (action, host, path), of any number.  ``labelled``: a table (url, label) to train on.
    """
    rules = RULES if rules is None else rules
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and any(r[0] not in ("allow", "block") for r in rules):
        raise ValueError("rules are (allow or block, host, path)")
    if isinstance(rules, list) and len(rules) <= MOST_RULES:
        ruled = _chained(base, rules)
    else:
        ruled = _joined(base, pages.sparkSession.createDataFrame(rules, "action string, host string, path string") if isinstance(rules, list) else rules)
    bias, weights = train() if labelled is None else train(labelled_urls(labelled))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")

    def part(mark: str, s: Column, n: int) -> Column:
        starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.element_at(F.col("weights"), (F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(s, i, F.lit(n))).cast("binary")), 1, 7), 16, 10).cast("int") % BUCKETS + 1)))

    total = F.aggregate(
        F.concat(*[part(m, s, n) for m, s in (("h", F.concat(F.lit("^"), F.col("host"), F.lit("$"))), ("p", F.col("path"))) for n in SIZES]),
        F.lit(bias).cast("bigint"),
        lambda acc, x: acc + x,
    )
    scored = ruled.withColumn("weights", table).withColumn("score", total)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    bias, weights = train()
    rules = ", ".join(f"({quote(a)}, {quote(h)}, {quote(p)})" for a, h, p in RULES)
    parts = " UNION ALL ".join(f"SELECT r, unnest(list_transform(range(1, length({s}) - {n} + 2), lambda i: '{m}' || substr({s}, i, {n}))) AS g FROM hp" for m, s in (("h", "('^' || host || '$')"), ("p", "path")) for n in SIZES)
    return f"""
    WITH u AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, r, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
    hp AS (SELECT page_id, r, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
    w AS (SELECT string_split('{",".join(map(str, weights))}', ',')::BIGINT[] AS w),
    g AS ({parts}),
    z AS (SELECT r, sum(w[('0x' || substr(md5(g), 1, 7))::BIGINT % {BUCKETS} + 1])::BIGINT AS z FROM g, w GROUP BY r),
    rl AS (SELECT * FROM (VALUES {rules}) v(action, rh, rp)),
    best AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM hp JOIN rl ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {bias} + coalesce(z, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict, CAST({bias} + coalesce(z, 0) AS BIGINT) AS score
    FROM hp LEFT JOIN best USING (r) LEFT JOIN z USING (r)"""
