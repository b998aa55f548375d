"""URL filtering by rules, then by empirical-Bayes host reputation.

A page's labelled outcome is bad (1) or good (0). Rates are shrunk along a chain
of beta-binomial priors: all pages -> public suffix -> registered domain ->
host. At each level the prior's weight kappa is the moment estimate over that
level's groups, and the posterior mean of one level is the prior mean of the
next. Every host of the pages has a posterior: without outcomes of its own it is
the prior that the nearest level with outcomes gives. A host is blocked if the
lower posterior bound of its bad rate (mean - z sd) exceeds a limit: few
outcomes shrink to the parent.

Counts per host are partially aggregated, so a host with a third of all pages
is one row per task; levels above are aggregated from those counts. Pages are
joined only with blocked hosts: broadcast up to ``BROADCAST_HOSTS`` of them, so
that a host with a third of all pages moves none; beyond, a left join that
adaptive execution can split.

Ties: of rules of equal length that fit a url, the last in the order given
wins; the contract's rules have no such pair. A posterior bound of exactly the
limit allows.

Defined cases: no pages give no rows, no labels block nothing but by rule; a null url, or one without ``://``, has empty host and path,
fits no rule and has the verdict allow; null page_ids and repeated rows are
kept row by row; repeated or null labels: a page's outcome is its worst label,
null counts as good; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp",
    "ac.nz", "co.nz", "geek.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.mx", "edu.mx", "gob.mx", "net.mx", "org.mx",
    "ac.in", "co.in", "edu.in", "gov.in", "net.in", "nic.in", "org.in", "res.in",
    "ac.kr", "co.kr", "go.kr", "ne.kr", "or.kr", "re.kr",
    "ac.za", "co.za", "gov.za", "net.za", "org.za", "web.za",
    "com.ar", "edu.ar", "gob.ar", "gov.ar", "net.ar", "org.ar",
    "com.tr", "edu.tr", "gov.tr", "net.tr", "org.tr",
    "com.tw", "edu.tw", "gov.tw", "net.tw", "org.tw",
    "com.hk", "edu.hk", "gov.hk", "net.hk", "org.hk",
    "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg",
    "com.my", "edu.my", "gov.my", "net.my", "org.my",
    "ac.il", "co.il", "gov.il", "net.il", "org.il",
    "ac.th", "co.th", "go.th", "in.th", "or.th",
    "ac.id", "co.id", "go.id", "or.id", "web.id",
    "com.ua", "edu.ua", "gov.ua", "net.ua", "org.ua",
    "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl",
    "ac.at", "co.at", "gv.at", "or.at",
    "co.hu", "co.it", "com.es", "com.fr", "com.pt", "com.gr", "com.ru", "msk.ru",
    "com.co", "com.pe", "com.ve", "com.ec", "com.uy", "com.py", "com.bo",
    "com.eg", "com.sa", "com.pk", "com.bd", "com.vn", "com.ph", "com.ng", "co.ke", "co.tz", "co.ug",
)
Z, LIMIT = 1.645, 0.5
#: Blocked hosts that may be broadcast (names of at most 253 characters on the net; beyond that size they are joined).
BROADCAST_HOSTS, BROADCAST_BYTES = 1_000_000, 64_000_000
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        _, h, p = rule
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def with_levels(df: DataFrame) -> DataFrame:
    """Adds domain and suffix to rows with host; ports and user names are left out of both."""
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)
    number = bare.rlike("^[0-9.]+$")
    return df.withColumns({"suffix": F.when(number, "ip").otherwise(suffix), "domain": F.when(number, bare).otherwise(domain)})


def _kappa(groups: DataFrame) -> float:
    """The weight of the prior over those of ``groups`` (n, bad) with outcomes, by moments; one row comes to the driver."""
    k, n, x, sq, between = groups.where("n > 0").agg(
        F.count("*"), F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad") * F.col("bad") / F.col("n"))
    ).first()
    if not n or not 0 < x < n or k < 2:
        return 1.0
    p = x / n
    spread = (between - n * p * p) / (p * (1 - p))
    rho = (spread - (k - 1)) / max(n - sq / n - (k - 1), 1e-9)
    return 1 / min(max(rho, 1e-4), 0.5) - 1


def reputation(outcomes: DataFrame, pages: DataFrame) -> DataFrame:
    """host, n, bad, mean, low from outcomes(host, bad 0/1): one row for each host of pages(host)."""
    counts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = with_levels(pages.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "bad"]))
    hosts = written(hosts, "host-counts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    parent, mean = None, F.lit((bad or 0) / n if n else 0.0)
    for level in LEVELS:
        groups = hosts.groupBy(*LEVELS[: LEVELS.index(level) + 1]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        kappa = _kappa(groups)
        if parent is not None:
            groups, mean = groups.join(parent, list(LEVELS[: LEVELS.index(level)])), F.col("up")
        a, b = kappa * mean + F.col("bad"), kappa * (1 - mean) + F.col("n") - F.col("bad")
        groups = groups.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        parent = groups.select(*LEVELS[: LEVELS.index(level) + 1], F.col("mean").alias("up"))
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b") + 1) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b"))))
    return groups.select("host", "n", "bad", "mean", (F.col("mean") - Z * sd).alias("low"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. labels: page_id, bad."""
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).fillna("", ["host", "path"])
    worst = labels.groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(0))).alias("bad"))
    blocked = reputation(split.join(worst, "page_id").select("host", "bad"), split).where((F.col("low") > limit) & (F.col("host") != "")).select("host", F.lit(True).alias("ill"))
    blocked = written(blocked, "blocked-hosts")
    n, size = blocked.agg(F.count("*"), F.sum(F.octet_length("host"))).first()
    if n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES:
        blocked = F.broadcast(blocked)
    host, path = F.col("host"), F.col("path")
    return split.join(blocked, "host", "left").select(
        "page_id",
        "host",
        "path",
        rule_for(host, path, rules, lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(rule_for(host, path, rules, lambda r: r[0]), F.when(F.col("ill"), "block").otherwise("allow")).alias("verdict"),
    )


def op6(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Judges every page; a label's doc_id names the page, bad is quality 0 or toxic 1."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return judged(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _sql() -> str:
    def level(name: str, up: str | None) -> str:
        keys = LEVELS[: LEVELS.index(name) + 1]
        on = " AND ".join(f"g.{k} = u.{k}" for k in keys[:-1])
        join, mean = (f"JOIN m_{up} u ON {on}", "u.mean") if up else ("", "(SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM hosts)")
        return f"""
g_{name} AS (SELECT {', '.join(keys)}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY ALL),
s_{name} AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(bad) AS x, sum(n * n) AS sq, sum(bad * bad / n) AS b FROM g_{name} WHERE n > 0),
k_{name} AS (SELECT CASE WHEN n IS NULL OR NOT (0 < x AND x < n) OR k < 2 THEN 1.0 ELSE 1 / least(greatest(
  ((b - n * (x / n) * (x / n)) / ((x / n) * (1 - x / n)) - (k - 1)) / greatest(n - sq / n - (k - 1), 1e-9), 1e-4), 0.5) - 1 END AS kappa FROM s_{name}),
a_{name} AS (SELECT g.*, kappa * {mean} + g.bad AS a, kappa * (1 - {mean}) + g.n - g.bad AS b FROM g_{name} g {join}, k_{name}),
m_{name} AS (SELECT *, a / (a + b) AS mean FROM a_{name})"""

    case = lambda f: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{f((v, h, p))}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " END"
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, coalesce({lower.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
worst AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, count(worst.page_id) AS n, coalesce(sum(bad), 0) AS bad, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS p,
  regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM split LEFT JOIN worst ON split.page_id = worst.page_id GROUP BY host),
hosts AS (SELECT host, n, bad,
  CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN 'ip' WHEN array_to_string(p[-2:], '.') IN ({two}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
  CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare WHEN array_to_string(p[-2:], '.') IN ({two}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM counted),
{level("suffix", None)},{level("domain", "suffix")},{level("host", "domain")},
ill AS (SELECT host, true AS ill FROM m_host WHERE mean - {Z} * sqrt(a * b / ((a + b + 1) * (a + b) * (a + b))) > {LIMIT} AND host <> '')
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule,
  coalesce({case(lambda r: r[0])}, CASE WHEN ill THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN ill USING (host)
"""


OP6_SQL = _sql()
