"""URL filtering with redirect equivalence, in DataFrame operations only.

Pages that redirect to one another or name one another as canonical are one
resource. Rules decide single urls; a block spreads over the connected
component, an explicit allow in it takes precedence, and a url's own rule
always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import lower_ascii
from quirespark.llm.graph import connected_components

_LINK = r"(?is)<link\b[^>]*>"
_CANONICAL = r"""(?is)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?:[\s/>]|$))"""
_META = r"(?is)<meta\b[^>]*>"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"""(?is)\bhref\s*=\s*(?:"\s*([^"]*?)\s*"|'\s*([^']*?)\s*'|([^\s>"']+))"""
_GOTO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """A path with ``.`` and ``..`` taken out; most paths have neither and stay."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, tail).otherwise(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), clean).otherwise(path)


def resource(url: Column) -> Column:
    """What a url names: scheme and host in lower case, no dot segments, at least ``/`` as path, no fragment."""
    path = F.when(path_of(url) == "", "/").otherwise(_without_dots(path_of(url)))
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.concat(lower_ascii(F.substring_index(url, "://", 1)), F.lit("://"), host_of(url), path, query)


def resolved(base: Column, to: Column) -> Column:
    """The url that a reference on the page ``base`` means, by RFC 3986; null for other schemes and the page itself."""
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    root = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)
    return (
        F.when(to.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), F.when(to.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), to))
        .when(to.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path, to))
        .when((to == "") | to.startswith("#"), None)
        .otherwise(F.concat(root, folder, to))
    )


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) redirect and canonical-link edges that the pages' html states, between resources.

    Every ``link`` whose rel has the word canonical and every ``meta refresh`` of a
    page count. References may be of any form of RFC 3986.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    tags = lambda tag, test: F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(test))
    href = lambda t: F.concat(*(F.regexp_extract(t, _HREF, g) for g in (1, 2, 3)))
    to = F.concat(
        F.transform(tags(_LINK, _CANONICAL), href),
        F.transform(tags(_META, _REFRESH), lambda t: F.regexp_extract(t, _GOTO, 1)),
    )
    # most pages state neither; the cheap test keeps the patterns off them
    lowered = F.lower(html)
    return (
        pages.where(F.col(url_col).contains("://") & (lowered.contains("canonical") | lowered.contains("http-equiv")))
        .select(F.col(url_col).alias("base"), F.explode(to).alias("to"))
        .select("base", resolved(F.col("base"), F.replace("to", F.lit("&amp;"), F.lit("&"))).alias("dst"))
        .where("dst is not null")
        .select(resource(F.col("base")).alias("src"), resource(F.col("dst")).alias("dst"))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (action, host, path) rule that fits, as a struct (rule, action); null if none does."""

    def fits(rule_host: str, rule_path: str) -> Column:
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    found = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,action:string>")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row.

    ``rules`` are (allow or block, host, path), a short list that becomes part of
    the plan; ``edges`` (src, dst) are redirect and canonical links between urls
    (default: those stated in the pages' html). The verdict is the rule's; else
    allow if the url's component has an explicitly allowed url; else block if it
    has a blocked one; else allow. Urls of one resource (host in another case, dot
    segments, a fragment) are one node. Null urls and urls without ``://`` have empty
    host and path and belong to no component. Repeated urls and rows are judged
    alike; other columns are not read.
    """
    if any(action not in ("allow", "block") for action, _, _ in rules):
        raise ValueError("a rule allows or blocks")
    edges = links_of(pages, url_col) if edges is None else edges.where(F.col("src").contains("://") & F.col("dst").contains("://")).select(*(resource(F.col(c)).alias(c) for c in ("src", "dst")))
    members = connected_components(edges, "src", "dst")
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    verdicts = members.groupBy("component").agg(
        F.when(F.bool_or(F.coalesce(own == "allow", F.lit(False))), "allow")
        .when(F.bool_or(F.coalesce(own == "block", F.lit(False))), "block")
        .alias("spread")
    )
    spread = members.join(verdicts.where("spread is not null"), "component").select("node", "spread")
    judged = (
        pages.select(F.col(id_col), F.col(url_col).alias("_url"))
        .select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.when(F.col("_url").contains("://"), resource(F.col("_url"))).alias("node"))
        .withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    )
    return judged.join(spread, "node", "left").select(
        id_col, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", "spread", F.lit("allow")).alias("verdict")
    )


def blocked_hosts(judged: DataFrame) -> DataFrame:
    """(host, n_blocked, n_pages): the report by host."""
    return judged.groupBy("host").agg(F.count_if(F.col("verdict") == "block").alias("n_blocked"), F.count(F.lit(1)).alias("n_pages"))
