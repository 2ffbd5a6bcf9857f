"""URL verdicts by host and path rules, spread over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.operators.components import connected_components
from twinweave.runtime import materialise

#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones, allow before block."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


#: What holds no markup of the page's own: comments and the insides of some elements, to the end if they are not closed.
ASIDE = "(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "template", "textarea"))])


def link_targets(html: Column) -> Column:
    """Canonical link and refresh target named by a page's own markup, each once; empty strings are left out."""
    html = F.regexp_replace(html, ASIDE, " ")
    canonical = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?\s*refresh\b[^>]*>""", 0)
    target = F.regexp_extract(_attribute(refresh, "content"), r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)""", 1)
    return F.array_distinct(F.filter(F.array(F.trim(_attribute(canonical, "href")), F.trim(target)), lambda x: x != ""))


def _absolute(target: Column, url: Column) -> Column:
    """A target as a full URL, relative ones against the page's."""
    own = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(own, target))
        .when(target.rlike("^[?#]"), url)
        .otherwise(F.concat(own, F.regexp_replace(path_of(url), "[^/]*$", ""), target))
    )


def url_filter(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    The longest rule that fits decides. A page without a rule takes the decision
    of its equivalence class: URLs tied by canonical links and refreshes in the
    html (outside comments, scripts, styles, templates and text areas), or by ``redirects(from_url, to_url)``. In a class an explicit allow comes
    before a block; without either, and for pages with no ties, the verdict is
    allow. A URL stands for its host and path, so scheme, query and fragment don't
    part it. A null URL, or one without ``://``, has an empty host and path, ties
    with nothing and is allowed. Repeated rows are judged alike; an empty table
    gives no rows; other columns are not read.

    Rules are a short setting and become one expression. Only URLs on an edge go
    through the distributed components; pages meet their class by a left join.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    named = F.col(html_col).cast("string").rlike("(?i)canonical|http-equiv")
    edges = pages.where(named).select(url.alias("from_url"), F.explode(link_targets(F.col(html_col).cast("string"))).alias("to_url")).select("from_url", _absolute(F.col("to_url"), F.col("from_url")).alias("to_url"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    node = lambda c: F.concat(host_of(F.col(c)), path_of(F.col(c)))
    ties = materialise(edges.select(node("from_url").alias("a"), node("to_url").alias("b")).where("a <> '' and b <> ''").distinct(), "url-edges")
    classes = connected_components(ties)
    host, path = F.regexp_extract("node", "^[^/]*", 0), F.regexp_extract("node", "^[^/]*(.*)$", 1)
    decided = classes.withColumn("v", matched(host, path, rules)[1]).groupBy("component").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"), F.max((F.col("v") == "block").cast("int")).alias("blocked"))
    spread = classes.join(decided, "component").where("blocked = 1 or allowed = 1").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("class_verdict"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("own", verdict).withColumn("node", F.concat("host", "path"))
    return judged.join(spread, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "class_verdict", F.lit("allow")).alias("verdict"))


