"""URL filters: allow and block rules, then empirical-Bayes host reputation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a rule is a host, then the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Public suffixes of two labels (fixed values, the commonest; a parameter); any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.uk", "gov.in", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.uk")
#: Bytes of hosts and bounds that are broadcast at most; parts that a host's pages are dealt into beyond.
FEW_BYTES, SALT = 16 << 20, 32


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null. ``rules`` is a short list, kept in the plan."""
    longest = sorted(rules, key=lambda r: -len(r[1]))
    fits = [(h := r.partition("/")[0], "/" + r.partition("/")[2], v, r) for v, r in longest]
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for h, p, v, r in reversed(fits):
        ok = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(ok, F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"))).otherwise(out)
    return out


def suffix_of(host: Column, known: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: the last two labels if they are in ``known``, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*known), two).otherwise(F.substring_index(host, ".", -1)) if known else F.substring_index(host, ".", -1)


def domain_of(host: Column, known: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; a host that is a suffix is its own."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*known), F.substring_index(host, ".", -3)).otherwise(two) if known else two


def _shrunk(counts: DataFrame, parent_mean: str) -> DataFrame:
    """Posterior ``mean`` and ``strength`` of each group under a beta prior at its parent's mean.

    The prior's strength is one number a level: the beta-binomial overdispersion of all its
    groups around their parents' means, by moments, held within [1, 1000]; 1 where no group has
    two pages, as then nothing tells it.
    """
    m = F.col(parent_mean)
    v = F.col("n") * m * (1 - m)
    spread = F.pow(F.col("bad") - F.col("n") * m, F.lit(2)) - v
    rho = F.try_divide(F.sum(spread), F.sum((F.col("n") - 1) * v))
    level = counts.agg(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(1e-6)) - 1)).alias("k"))
    return counts.crossJoin(F.broadcast(level)).withColumn("mean", (F.col("k") * m + F.col("bad")) / (F.col("k") + F.col("n"))).withColumn("strength", F.col("k") + F.col("n"))


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``outcomes``: host, bad (0/1), one row a labelled page. Returns host, mean, strength, bound.

    Counts go from hosts (cut once: a row a host) to registered domains to suffixes; means come
    back down, each level shrunk towards the one above. ``bound`` is the posterior mean less 1.645 standard deviations.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    hosts = common.cut(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    domains = common.cut(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    tops = common.cut(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    root = tops.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("root"))
    top = common.cut(_shrunk(tops.crossJoin(F.broadcast(root)), "root").select("suffix", F.col("mean").alias("suffix_mean")))
    mid = common.cut(_shrunk(domains.join(top, "suffix"), "suffix_mean").select("domain", F.col("mean").alias("domain_mean")))
    low = _shrunk(hosts.join(mid, "domain"), "domain_mean")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return low.select("host", "mean", "strength", (F.col("mean") - 1.645 * sd).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, id: str = "page_id", url: str = "url", rules=RULES, limit: float = 0.25, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per page: ``id``, ``host``, ``path``, ``rule``, ``verdict``.

    The longest rule that fits decides. Without one, a page is blocked if its host's posterior
    bound exceeds ``limit``; hosts without a labelled page, and empty hosts, are allowed. Null
    urls and urls without ``://`` have an empty host and path. Repeated rows each return a row.
    """
    here = pages.select(F.col(id).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    here = here.withColumn("_r", first_rule(F.col("host"), F.col("path"), rules))
    known = common.cut(reputations(outcomes.filter("host <> ''"), suffixes).select("host", "bound"))
    size = known.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    if size <= FEW_BYTES:
        out = here.join(F.broadcast(known), "host", "left")
    else:  # a host may hold a third of all pages: each host's row meets ``SALT`` parts of its pages
        known = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = here.withColumn("_s", F.pmod(F.xxhash64("_id", "path"), F.lit(SALT)).cast("int")).join(known, ["host", "_s"], "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("_id").alias(id), "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages: the document a page shows is the number its path ends in; bad: quality 0 or toxic 1."""
    doc = F.regexp_extract(path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(\.html)?/?$", 1)
    shown = pages.select(host_of(F.col("url")).alias("host"), F.when(doc != "", doc).cast("long").alias("doc_id")).filter("doc_id is not null")
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return shown.join(bad, "doc_id").select("host", "bad")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP10_SQL = f"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(verdict, rule, rhost, rpath) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')
), shown AS (
  SELECT host, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(\\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM h WHERE host <> ''
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), CASE WHEN two THEN -3 ELSE -2 END, -1), '.') AS domain,
    array_to_string(list_slice(string_split(host, '.'), CASE WHEN two THEN -2 ELSE -1 END, -1), '.') AS suffix, bad, n
  FROM (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN {SUFFIXES} AS two, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM shown JOIN lab USING (doc_id) GROUP BY host)
), domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL),
root AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM suffixes),
s1 AS (SELECT suffix, bad, n, m FROM suffixes, root),
sk AS (SELECT greatest(1.0, least(1000.0, 1 / greatest(coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0.5), 1e-6) - 1)) AS k FROM s1),
d1 AS (SELECT d.domain, d.bad, d.n, (k * s1.m + s1.bad) / (k + s1.n) AS m FROM domains d JOIN s1 USING (suffix), sk),
dk AS (SELECT greatest(1.0, least(1000.0, 1 / greatest(coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0.5), 1e-6) - 1)) AS k FROM d1),
h1 AS (SELECT g.host, g.bad, g.n, (k * d1.m + d1.bad) / (k + d1.n) AS m FROM hosts g JOIN d1 USING (domain), dk),
hk AS (SELECT greatest(1.0, least(1000.0, 1 / greatest(coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0.5), 1e-6) - 1)) AS k FROM h1),
rep AS (SELECT host, (k * m + bad) / (k + n) AS mean, k + n AS strength FROM h1, hk),
fit AS (
  SELECT page_id, host, path, max_by(struct_pack(verdict, rule), length(rule)) FILTER (WHERE rule IS NOT NULL) AS best
  FROM (SELECT DISTINCT page_id, host, path FROM h) LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
)
SELECT h.page_id, h.host, h.path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (strength + 1)) > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN fit ON h.page_id IS NOT DISTINCT FROM fit.page_id AND h.host = fit.host AND h.path = fit.path LEFT JOIN rep ON rep.host = h.host
"""
