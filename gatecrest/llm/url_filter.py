"""URL filter by redirect equivalence: block decisions spread over all aliases of a page, explicit allows come first.

Edges join a page's URL to its normal form, to the canonical link and to the redirect targets that its HTML declares;
the connected components of these edges are the aliases of one page.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecrest.llm.common import cut
from gatecrest.llm.components import connected_components

#: Host labels and URL parts that block; hosts, or URLs in normal form, that are allowed whatever blocks them.
BLOCK_WORDS = ("casino", "free-bets", "cheap-pills", "ads-track")
ALLOW = ("tionble.example.org",)

#: Tags that may declare where a page is, what marks them, and the target in them; then scripts that move on.
TAGS = (
    (r"(?i)<link\b[^>]*>", r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""", r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""),
    (r"(?i)<meta\b[^>]*>", r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b""", r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""),
)
MOVED = r"""(?i)\blocation(?:[.]href\s*=|[.](?:replace|assign)\s*[(]|\s*=)\s*["']\s*([^"'\s]+)"""
HOST = r"^[a-z]+://([^/?#]*)"


def normal(url: Column) -> Column:
    """Scheme and fragment dropped, host in lower case without www. or m., no tracking parameter, no trailing slash, .html or index page."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^(www|m)[.]", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path, query = F.regexp_extract(rest, r"^[^?]*", 0), F.regexp_extract(rest, r"[?](.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ""), "^&", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?[.]html?$", ""), "/+$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def absolute(target: Column, url: Column) -> Column:
    """A target in full: relative ones begin at the page's scheme, host, path or folder; ``.`` and ``..`` are resolved. Null for one that isn't a page's (mailto, javascript, a fragment alone)."""
    root = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*", 0)
    page = F.regexp_extract(url, r"^[A-Za-z]+://[^?#]*", 0)
    folder = F.regexp_replace(F.substr(page, F.length(root) + 1), "[^/]*$", "")
    full = F.when(target.rlike("(?i)^https?://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("#") | target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
    full = full.when(target.startswith("/"), F.concat(root, target)).when(target.startswith("?"), F.concat(page, target)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    host, rest = F.regexp_extract(full, r"^[A-Za-z]+:/*[^/?#]*", 0), F.regexp_replace(full, r"^[A-Za-z]+:/*[^/?#]*", "")
    path, tail = F.regexp_extract(rest, r"^[^?#]*", 0), F.regexp_extract(rest, r"[?#].*$", 0)
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    return F.when(path.contains("/."), F.concat(host, F.array_join(steps, "/"), tail)).otherwise(full)


def _marked(pattern: str, tag: Column) -> Column:
    return tag.rlike(pattern)


def _target(pattern: str, tag: Column) -> Column:
    return F.regexp_extract(tag, pattern, 1)


def declared(html: Column) -> Column:
    """The targets of all canonical links, refreshes and moves of a page."""
    found = []
    for tag, mark, target in TAGS:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), partial(_marked, mark))
        found.append(F.transform(tags, partial(_target, target)))
    return F.array_distinct(F.concat(*found, F.regexp_extract_all(html, F.lit(MOVED), F.lit(1))))


def decide(pages: DataFrame, block_words: Sequence[str] = BLOCK_WORDS, allow: Sequence[str] = ALLOW) -> DataFrame:
    """(page_id, url, canonical, decision, reason) of every row of pages.

    canonical is the least normal form among the page's aliases. A page is allowed, with reason 'allowed', if its own
    normal form, or its host, is in ``allow``. Else it is blocked if its own URL has a blocked word in the host
    ('listed'), or if an alias has ('alias'); an allowed alias neither blocks nor clears. Others are kept ('clean').

    Every canonical link, refresh and move that the HTML declares counts, with attributes in any order, quoted or not.

    A null or blank URL has no aliases: canonical is null, and it is kept as 'no url'. Null html declares no edges.
    Repeated rows give a row each. Only page_id, url and html are read. No rows give no rows.
    """
    pages = pages.select("page_id", "url", "html")
    own = F.when(F.trim("url") != "", normal(F.col("url")))
    links = pages.where("html is not null and trim(url) <> ''").select("url", own.alias("u"), F.explode(declared(F.col("html"))).alias("t")).where("t <> ''")
    links = links.select("u", absolute(F.col("t"), F.trim("url")).alias("t")).where("t is not null")
    edges = links.select("u", normal(F.col("t")).alias("v"))
    groups = cut(connected_components(edges))
    named = pages.select("page_id", "url", own.alias("own")).join(groups.withColumnRenamed("node", "own"), "own", "left").withColumn("component", F.coalesce("component", "own"))
    host = F.regexp_extract("own", r"^[^/?]*", 0)
    listed = F.coalesce(host.rlike("|".join(w.replace(".", "[.]") for w in block_words)), F.lit(False)) if block_words else F.lit(False)
    allowed = F.coalesce(F.col("own").isin(*allow) | host.isin(*allow), F.lit(False)) if allow else F.lit(False)
    named = cut(named.withColumn("listed", listed).withColumn("allowed", allowed))
    member = groups.withColumnRenamed("node", "own")
    bad = member.withColumn("listed", listed).withColumn("allowed", allowed).where("listed and not allowed").select("component", F.lit(True).alias("bad")).distinct()
    ruled = named.join(bad, "component", "left")
    reason = F.when(F.col("own").isNull(), "no url").when(F.col("allowed"), "allowed").when(F.col("listed"), "listed").when(F.col("bad"), "alias").otherwise("clean")
    return ruled.select("page_id", "url", F.col("component").alias("canonical"), F.when(reason.isin("listed", "alias"), "block").otherwise("keep").alias("decision"), reason.alias("reason"))


def oracle(block_words: Sequence[str] = BLOCK_WORDS, allow: Sequence[str] = ALLOW) -> str:
    """The same in SQL with patterns of its own; the components by a recursive closure over the edges. Targets relative to a folder, which the given tables don't have, count for nothing here."""

    def norm(u: str) -> str:
        bare = f"regexp_replace(regexp_replace(trim({u}), '#.*$', ''), '^[A-Za-z]+://', '')"
        host = f"regexp_replace(lower(regexp_extract({bare}, '^[^/?]*', 0)), '^(www|m)[.]', '')"
        rest = f"regexp_replace({bare}, '^[^/?]*', '')"
        path = f"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^?]*', 0), '(/index)?[.]html?$', ''), '/+$', '')"
        query = f"regexp_replace(regexp_replace(regexp_extract({rest}, '[?](.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '')"
        return f"({host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"

    quote = "[\"'']?"
    tag = lambda name, mark, at: f"SELECT own AS u, url, regexp_extract(x, '(?i)[[:space:]]{at}[[:space:]]*=[[:space:]]*{quote}([^\"''[:space:]>]+)', 1) AS t FROM (SELECT own, url, unnest(regexp_extract_all(html, '(?i)<{name}[[:space:]][^>]*>')) AS x FROM p) WHERE regexp_matches(x, '(?i){mark}')"
    arms = " UNION ALL ".join((
        tag("link", f"rel[[:space:]]*=[[:space:]]*{quote}[^>\"'']*canonical", "href"),
        f"SELECT own, url, regexp_extract(x, '(?i)url[[:space:]]*=[[:space:]]*{quote}([^\"''[:space:]>;]+)', 1) FROM (SELECT own, url, unnest(regexp_extract_all(html, '(?i)<meta[[:space:]][^>]*>')) AS x FROM p) WHERE regexp_matches(x, '(?i)http-equiv[[:space:]]*=[[:space:]]*{quote}refresh')",
        "SELECT own, url, unnest(regexp_extract_all(html, '(?i)location(?:[.]href[[:space:]]*=|[.](?:replace|assign)[[:space:]]*[(]|[[:space:]]*=)[[:space:]]*[\"'']([^\"''[:space:]]+)', 1)) FROM p",
    ))
    target = "CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || t END"
    words = "|".join(w.replace(".", "[.]") for w in block_words)
    names = ", ".join(f"'{a}'" for a in allow)
    flags = lambda own: f"regexp_matches(regexp_extract({own}, '^[^/?]*', 0), '{words}') AS listed, ({own} IN ({names}) OR regexp_extract({own}, '^[^/?]*', 0) IN ({names})) AS allowed"
    return f"""WITH RECURSIVE p AS (SELECT page_id, url, html, {norm("url")} AS own FROM pages),
    l AS (SELECT u, {target} AS t FROM ({arms}) WHERE t <> ''),
    h AS (SELECT u, {norm("t")} AS v FROM l WHERE t IS NOT NULL),
    e AS (SELECT u, v FROM h WHERE u <> v UNION SELECT v, u FROM h WHERE u <> v),
    r AS (SELECT u AS node, v AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
    g AS (SELECT node, least(node, min(seen)) AS component FROM r GROUP BY node),
    bad AS (SELECT DISTINCT component FROM (SELECT component, {flags("node")} FROM g) WHERE listed AND NOT allowed),
    f AS (SELECT page_id, url, coalesce(g.component, own) AS canonical, {flags("own")} FROM p LEFT JOIN g ON own = node),
    d AS (SELECT page_id, url, canonical, CASE WHEN allowed THEN 'allowed' WHEN listed THEN 'listed' WHEN canonical IN (SELECT component FROM bad) THEN 'alias' ELSE 'clean' END AS reason FROM f)
    SELECT page_id, url, canonical, CASE WHEN reason IN ('listed', 'alias') THEN 'block' ELSE 'keep' END AS decision, reason FROM d"""
