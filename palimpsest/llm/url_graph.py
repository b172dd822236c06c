"""URL filter: path rules, and trust spread over the link graph for pages no rule fits.

Hosts with allowed pages are seeds of trust, which follows links (personalised PageRank); hosts with blocked
pages are seeds of distrust, which follows links backwards. A host's seed is the share of its pages that rules
allow or block. ``score = seed + damping * (sum over neighbours of score / degree)``, that is PageRank divided
by ``1 - damping``, so that scores don't shrink as the graph grows. A host whose distrust exceeds its trust by
the threshold is blocked; a host nothing is known of is allowed. Everything is built-in DataFrame functions;
what is joined in the rounds is one narrow row per host or per pair of hosts.

Defined cases: null url or none with ``://``: host and path are empty, and the verdict is allow; null html has
no links; repeated rows count as often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

#: (host, path, verdict); a short list that is written into the plan as one CASE.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DAMPING = 0.5
ROUNDS = 8
THRESHOLD = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
_PARENT = r"^[^.]+\.([^.]+\.[^.]+\..+)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _ranked(rules):
    return sorted(rules, key=lambda r: -len(r[0] + r[1]))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a parent domain of it) and a path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(_ranked(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts: absolute links in the pages, and a link each way between a
    host and its parent domain if that has three labels or more (``m.shop.example.org`` and
    ``shop.example.org``), as sites link their subdomains."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_HREF), 1)).alias("href"))
    to = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    pairs = links.select("src", host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    hosts = pages.select(host_of(F.col(url_col)).alias("dst")).where("dst <> ''").distinct()
    subs = hosts.select(F.col("dst").alias("src"), F.regexp_extract("dst", _PARENT, 1).alias("dst")).where("dst <> ''")
    pairs = pairs.unionByName(subs).unionByName(subs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds from the seeds (host, trust, distrust)."""
    edges = materialize(edges)
    if edges.isEmpty():
        return seeds
    out_links = edges.groupBy(F.col("src")).agg(F.sum("links").alias("n_out"))
    in_links = edges.groupBy(F.col("dst")).agg(F.sum("links").alias("n_in"))
    weighted = materialize(
        edges.join(out_links, "src").join(in_links, "dst").select("src", "dst", (damping * F.col("links") / F.col("n_out")).alias("w_out"), (damping * F.col("links") / F.col("n_in")).alias("w_in"))
    )
    seeds = materialize(seeds)
    scores = seeds
    for _ in range(rounds):
        forth = weighted.join(scores.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("w_out") * F.col("trust")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = weighted.join(scores.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("w_in") * F.col("distrust")).alias("distrust"))
        scores = materialize(forth.unionByName(back).unionByName(seeds).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    return scores


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = materialize(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": name, "ruled": verdict}))
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(pages, url_col, html_col))
    bad = F.coalesce(F.col("distrust") - F.col("trust") >= threshold - 1e-9, F.lit(False))
    return ruled.join(scores, "host", "left").select(
        F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict")
    )


def oracle_sql(rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, round by round."""
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in _ranked(rules)]
    names = " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, _ranked(rules), strict=True))
    verdicts = " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, _ranked(rules), strict=True))
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    url = _URL.replace("'", "''")
    href = _HREF.replace("'", "''")
    parts = [
        f"p AS (SELECT page_id, html, coalesce({lower(f'''regexp_extract(url, '{url}', 1)''')}, '') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages)",
        f"r AS (SELECT *, CASE {names} END AS rule, CASE {verdicts} END AS ruled FROM p)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS href FROM p)",
        f"e0 AS (SELECT src, {lower(f'''regexp_extract(CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END, '{url}', 1)''')} AS dst FROM l)",
        f"u AS (SELECT DISTINCT host AS src, regexp_extract(host, '{_PARENT}', 1) AS dst FROM p)",
        "e AS (SELECT src, dst, count(*) AS links FROM (SELECT * FROM e0 UNION ALL SELECT * FROM u UNION ALL SELECT dst, src FROM u) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        f"w AS (SELECT src, dst, {damping} * links / sum(links) OVER (PARTITION BY src) AS w_out, {damping} * links / sum(links) OVER (PARTITION BY dst) AS w_in FROM e)",
        "s0 AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM r WHERE host <> '' GROUP BY host)",
    ]
    for k in range(rounds):
        parts.append(
            f"s{k + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT dst AS host, w_out * trust AS trust, 0.0 AS distrust FROM w JOIN s{k} ON src = host"
            f" UNION ALL SELECT src, 0.0, w_in * distrust FROM w JOIN s{k} ON dst = host UNION ALL SELECT * FROM s0) GROUP BY host)"
        )
    return (
        "WITH " + ",\n".join(parts)
        + f"\nSELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN s.distrust - s.trust >= {threshold - 1e-9} THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN s{rounds} s ON r.host = s.host"
    )
