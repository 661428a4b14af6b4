"""URL filters with redirect equivalence.

A rule names a host and the start of a path; it fits the host and its subdomains,
and the longest fitting rule decides. Urls that lead to each other are aliases:
by canonical links and refresh redirects in their pages, by a redirect table
if there is one, and by tracking parameters (``TRACKING``), which lead to the url
without them. Aliases are the connected components of these edges, found by
alternating large-star and small-star rounds, each of which sends every node's
least neighbour to its neighbours; a node with very many neighbours is reduced on
the map side and joined in parts. The rounds' edges are written to the shared folder.

A url that no rule fits takes the decision of its component: allow if an explicit
allow rule fits any alias (explicit allow precedes), else block if a block rule
does, else allow. Urls count as the same node if they differ only in the
fragment or in the case of scheme and host.

Null urls and those without ``://`` have no host, match no rule and are allowed.
Null and empty html gives no edges. Pages that share a url are judged alike; each
keeps its row. Empty tables give no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.html import unescape
from fieldtally.functions.urls import join_url
from fieldtally.llm.common import stored
from fieldtally.llm.graph import components

#: Parameters that say where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid)"

_URL = r"^[^:/?#]*://([^/?#]*)([^?#]*)"
_TAG_END = r"[^<>]*+>"  # up to the next tag at most, so that unclosed ones take no time


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path start) that fits, as struct (verdict, rule); null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    listed = F.array(
        *[
            F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
            for v, h, p in ordered
        ]
    )
    fits = F.filter(
        listed,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    first = F.get(fits, F.lit(0))
    return F.when(
        first.isNotNull(), F.struct(first["verdict"].alias("verdict"), F.concat(first["host"], first["path"]).alias("rule"))
    )


def node_of(url: Column) -> Column:
    """The url without fragment, its scheme and host in lower case, an empty path as ``/``."""
    plain = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    origin = F.regexp_extract(plain, r"(?s)^(?:(?!://).)*://[^/?#]*", 0)
    rest = F.substring(plain, F.length(origin) + 1, F.length(plain))
    return F.concat(F.lower(origin), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))


def untracked(node: Column) -> Column:
    """The node without tracking parameters."""
    cut = F.regexp_replace(node, rf"(?i)(?<=[?&]){TRACKING}=[^&]*&?", "")
    return F.regexp_replace(cut, r"[?&]$", "")


def _attribute(tag: Column, pattern: str) -> Column:
    quoted = F.regexp_extract(tag, pattern + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    value = F.regexp_replace(quoted, r"(?is)^[a-z-]+\s*=\s*", "")
    return F.trim(unescape(F.regexp_replace(value, r"""^["']|["']$""", "")))


def targets(url: Column, html: Column) -> Column:
    """Absolute urls of the canonical links and refresh redirects of a page."""
    links = F.filter(
        F.regexp_extract_all(html, F.lit(rf"(?is)<link\b{_TAG_END}"), F.lit(0)),
        lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""),
    )
    canonical = F.transform(links, lambda t: _attribute(t, r"(?is)\bhref"))
    metas = F.filter(
        F.regexp_extract_all(html, F.lit(rf"(?is)<meta\b{_TAG_END}"), F.lit(0)),
        lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""),
    )
    refresh = F.transform(
        metas,
        lambda t: F.regexp_extract(_attribute(t, r"(?is)\bcontent"), r"""(?is)^[\s\d.]*[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1),
    )
    found = F.filter(F.concat(canonical, refresh), lambda h: h != "")
    return F.transform(found, lambda h: join_url(url, h))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and ``decided_by``: rule, alias or default.

    ``rules``: (allow or block, host, path start). ``redirects``: rows (source, target) of absolute urls.
    """
    url = F.col("url")
    # a page without either word in it has no such tags; most pages end here
    html = F.when(F.col("html").rlike(r"(?i)canonical|http-equiv"), F.col("html"))
    found = F.coalesce(F.when(html.isNotNull(), targets(url, html)), F.array().cast("array<string>"))
    seen = stored(
        pages.select(
            "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"),
            F.when(url.contains("://"), node_of(url)).alias("node"),
            found.alias("targets"),
        ),
        "urls",
    )
    node, clean = F.col("node"), untracked(F.col("node"))
    edges = seen.select(node.alias("a"), F.explode("targets").alias("t")).select("a", node_of(F.col("t")).alias("b"))
    edges = edges.union(seen.filter(node != clean).select(node.alias("a"), clean.alias("b")))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    aliases = components(edges)
    own = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    decided = (
        aliases.withColumn("own", own)
        .groupBy("root")
        .agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
        .filter("blocked and not coalesce(allowed, false)")
        .select("root")
    )
    # written, so that the join's sides are plain exchanges, which Spark splits where a root has very many aliases
    blocked = aliases.join(stored(decided, "blocked"), "root").select("node", F.lit(True).alias("by_alias"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = seen.withColumn("fit", rule).join(blocked, "node", "left")
    return judged.select(
        "page_id", "url", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("by_alias"), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("fit").isNotNull(), "rule").when(F.col("by_alias"), "alias").otherwise("default").alias("decided_by"),
    )
