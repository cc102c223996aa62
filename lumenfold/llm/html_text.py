"""Main text of web pages by consensus host paths.

Each page's containers are scored and the page votes for its best one, named by its path of generalised
tag-class steps. Votes are summed for each host, and pages are extracted again at the paths that their host
settled on; a page that has none of them uses its own best container.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_if_null, materialize, small

#: A path wins with this share of its host's votes or the most of them; any other is tried on the pages that vote for it.
SHARE = 0.02
#: Containers below so many others are part of the last one's path.
DEPTH = 256

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math"}
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Never part of an article, whatever their class.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "fieldset", "menu", "dialog", "head", "object", "embed", "applet", "canvas", "audio", "video", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "note"}
#: Words of a class or id that mark what is no article.
MARKS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets header masthead topbar footer foot bottombar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion form search pagination pager toolbar tags copyright disclaimer legal skip hidden".split())
#: Words that say nothing about the kind of a container. A class or id of these and of marks only is no article's; one
#: with any other word ("legal-analysis", "with-sidebar") is.
NEUTRAL = set("area article bar block body bottom box btn button buttons col column container content entry group header icon inner item items left link links list main message module outer page panel post posts right row section site text title top wrap wrapper".split())
CONTAINERS = {"body", "article", "main", "section", "div", "td", "center", "blockquote", "html", "dd", "li"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
P_ENDERS = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}
#: What an end tag does not reach through.
SCOPES = {"td", "th", "table", "html", "body", "article", "section", "main", "div", "nav", "footer", "header", "aside", "form"}
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised step of a tag (digits of its class become one #), and whether it is boilerplate."""
    if not attributes.strip():
        return tag, tag in BOILERPLATE
    klass, name, bad = "", "", tag in BOILERPLATE
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html_lib.unescape(value.strip("\"'")).lower()
        if key == "class":
            klass = value
        elif key == "id":
            name = value
        elif key == "role":
            bad = bad or value in ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            bad = True
    if tag not in ("body", "html", "article", "main"):
        for said in map(set, map(WORDS.findall, f"{klass} {name}".split())):
            bad = bad or bool(said & MARKS) and said <= MARKS | NEUTRAL
    label = ".".join(sorted({DIGITS.sub("#", c) for c in (klass or name).split()}))
    return (f"{tag}.{label}" if label else tag), bad


def blocks(page: str) -> list[tuple[str, str, int]]:
    """The page's text blocks outside boilerplate, in order: (path of the open containers, text, characters in links)."""
    out: list[tuple[str, str, int]] = []
    opened: dict[str, int] = defaultdict(int)
    last, depth = page.rfind(">"), 0
    stack: list[tuple[str, str, str, bool, int]] = []  # tag, step, container path, boilerplate, depth
    text: list[str] = []
    linked = at = 0
    links = 0
    path, bad = "", False

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((path, joined, linked))
            text.clear()
        linked = 0

    def leave(k: int) -> None:
        """Closes what is open from place k on."""
        nonlocal path, bad, links, depth
        for x in stack[k:]:
            opened[x[0]] -= 1
        if any(x[0] not in INLINE for x in stack[k:]):
            flush()
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]
        path, bad, depth = stack[-1][2:] if stack else ("", False, 0)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 else None  # no tag ends any more
        upto = m.start() if m else end
        if upto > at and not bad:
            piece = page[at:upto]
            if "&" in piece:
                piece = html_lib.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if stack[k][0] in SCOPES and (tag in INLINE or tag in ("p", "li")):
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = RAW_END[tag].search(page, at)
                at = close.end() if close else end
            if tag not in ("svg", "math"):
                flush()
            else:
                text.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input", "embed"):
                if tag != "wbr" and not bad:
                    text.append(" ")
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag)
            if any(opened[t] for t in closes or ()) or tag in P_ENDERS and opened["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    t = stack[k][0]
                    if t in (closes or ()) or tag in P_ENDERS and t == "p":
                        leave(k)
                        break
                    if t in SCOPES or t in ("ul", "ol", "dl") and t != "p":
                        break
        if m[3].endswith("/") and tag not in INLINE and tag in ("hr",):
            continue
        step, own = _step(tag, m[3])
        if not bad and own:
            flush()
        if tag in CONTAINERS and not (bad or own) and depth < DEPTH:
            path, depth = f"{path}>{step}" if path else step, depth + 1
        bad = bad or own
        links += tag == "a"
        opened[tag] += 1
        stack.append((tag, step, path, bad, depth))
    flush()
    return out


def scores(found: list[tuple[str, str, int]]) -> dict[str, float]:
    """Of each container: the characters of its blocks outside links, those of nested containers counting
    less the deeper they are, with a little more for sentences and for article and main."""
    out: dict[str, float] = {}
    for path, text, linked in found:
        worth = max(0, len(text) - 2 * linked) * (1.0 if len(text) >= 25 else 0.4) + 10 * min(3, text.count(",") + text.count("."))
        place = path
        while place:
            last = place.rpartition(">")[2].partition(".")[0]
            weight = 1.15 if last in ("article", "main") else 0.9 if last in ("body", "html") else 1.0
            out[place] = out.get(place, 0.0) + worth * weight
            worth *= 0.92
            place = place.rpartition(">")[0]
    return out


def best_path(found: list[tuple[str, str, int]]) -> tuple[str, float]:
    ranked = scores(found)
    if not ranked:
        return "", 0.0
    path = max(ranked, key=lambda p: (ranked[p], len(p), p))
    return path, ranked[path]


def main_text(page: str, paths: list[str]) -> tuple[str, str]:
    """The text at the first of the paths that the page has, or at its own best path; and that path."""
    found = blocks(page)
    for path in [*paths, best_path(found)[0]]:
        kept = [text for own, text, _ in found if own == path or own.startswith(path + ">")] if path else []
        if kept:
            return "\n".join(kept), path
    return "\n".join(text for _, text, _ in found), ""


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths array<string>): the container paths that win the pages' votes. Votes are summed in each
    task before they are shuffled, so a host of any size is a few rows."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), empty_if_null(html_col).alias("page"))

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held: dict[tuple[str, str], list[float]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path, score = best_path(blocks(page))
                if path:
                    x = held.setdefault((host, path), [0, 0.0])
                    x[0] += 1
                    x[1] += score
            rows = sorted(held.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([int(v[0]) for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.float64())], names=["host", "path", "votes", "score"])

    votes = source.mapInArrow(vote, "host string, path string, votes bigint, score double").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"), F.max_by("path", F.struct("votes", "path")).alias("first"))
    # at most 1 / SHARE paths of a host pass
    ranked = votes.join(totals, "host").where((F.col("votes") >= SHARE * F.col("all_votes")) | (F.col("path") == F.col("first")))
    order = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return ranked.withColumn("place", order).groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x.path).alias("paths"))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars, path) of every page, from the whole html.

    A null html is an empty page: its text is '' and its n_chars 0, as for a page without text outside
    boilerplate. Null urls, and urls without a host, share the host ''. Repeated rows are extracted each for
    itself; other columns are not read; an empty table gives no rows. Character references are decoded,
    white space inside a block becomes one space, blocks are joined by a line end.
    """
    hosts = materialize(host_paths(pages, url_col=url_col, html_col=html_col), "hosts")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), empty_if_null(html_col).alias("page"), host_of(F.col(url_col)).alias("host"))
    source = source.join(small(hosts), "host", "left").select("id", "url", "page", "paths")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [main_text(page, paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([len(x[0]) for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string())], names=["id", "url", "text", "n_chars", "path"])

    kinds = f"id {source.schema['id'].dataType.simpleString()}, url {source.schema['url'].dataType.simpleString()}"
    return source.mapInArrow(run, f"{kinds}, text string, n_chars bigint, path string").withColumnsRenamed({"id": id_col, "url": url_col})


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
