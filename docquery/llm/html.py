"""Main text of pages: a host's suffix array finds what its pages repeat, markup tells what is article and what is none.

Every block that is shown has a kind: plain, article, or marked as a menu, advert and the like. The streams of a host's
pages without their article text are sorted as one suffix array; long runs that distinct pages share are boilerplate. What
is left of plain text is a page's main text if no article is named. Article text itself is exempt: see the README for what
its repeated runs would cost.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import annotate, quoted, written

#: Tokens of a repeated run at least, distinct pages that must share it, and their share of the host's pages; the square
#: root of these pages is enough where it is less.
RUN_TOKENS, RUN_PAGES, RUN_SHARE = 8, 3, 0.3
#: Characters of pages of one host that one suffix array covers. The pages of a larger host are dealt by a hash of their
#: text, and the runs that its parts' arrays find are counted over all parts: the limit changes no result.
ARRAY_CHARS = 1 << 18
#: Large hosts whose list is broadcast; a longer list is joined.
LISTED_HOSTS = 50_000
#: Characters of pages that a task of the last shuffle is given, about.
TASK_CHARS = 1 << 25
#: Kinds of blocks.
PLAIN, ARTICLE, MARKED = 0, 1, 2

# Elements whose text is never shown, those that hold no article text, and those that end a line.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_CHROME = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map"}
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_FOREIGN = {"svg", "math"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_STACKED = (_BLOCKS | _CHROME) - {"p", "li", "dt", "dd", "hr", "tr", "td", "th", "option", "optgroup", "h1", "h2", "h3", "h4", "h5", "h6", "html"}
_WORDS = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup popover promo promotion related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)(?:>|\Z)|</(?=\Z)|<(?=\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SITE_NAMES = (["site", "header"], ["global", "header"], ["siteheader"])
# Elements whose start tag ends open ones of the given names, looked for up to an element that holds them apart.
_ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ITEMS |= {"tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
_ITEMS |= {t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
# What a name may have beside such words and still be one of them.
_BESIDE = set("area bar block body bottom box btn button container content copy fixed float group header holder icon id inner item items large left link links list main middle mobile module outer overlay page panel post right row section site slot small sticky text title top unit wrap wrapper zone".split())


def _names_chrome(name: str) -> bool:
    """Whether a class or id says so as a whole: one of its words does, and all others may stand beside it."""
    words = [w.lower() for w in _PARTS.split(name) if w]
    if words in _SITE_NAMES:
        return True
    return any(w in _WORDS for w in words) and all(w in _WORDS or w in _BESIDE for w in words)


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _CHROME or tag == "header" and not inside:
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and any(map(_names_chrome, value.split())):
            return True
    return False


def shown(html: str) -> list[tuple[str, int]]:
    """(text, kind) of every block that is shown, in page order: PLAIN, ARTICLE or MARKED as a menu or the like."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether they hold no article text
    text: list[str] = []
    chrome = article = 0
    at, n = 0, len(html)

    def end():
        if text:
            found = " ".join(unescape("".join(text)).split())
            if found:
                out.append((found, MARKED if chrome else ARTICLE if article else PLAIN))
            text.clear()

    def close_from(i):
        nonlocal chrome, article
        end()
        for name, hides in stack[i:]:
            chrome -= hides
            article -= name in ("article", "main")
        del stack[i:]

    def imply(tag):
        """Ends what a start tag ends unsaid: an open paragraph, before a block, and the item or cell before this one."""
        ends, apart = _ITEMS.get(tag, (set(), set()))
        for i in range(len(stack) - 1, -1, -1):
            name = stack[i][0]
            if name in ends or name == "p":
                close_from(i)
            elif name in apart or not ends and name in _STACKED or name in ("article", "main", "table") and name not in ends:
                return

    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)|\\Z", re.IGNORECASE).search(html, at)
            at = close.end()
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCKS or tag in _ITEMS:
            end()
            if not closing:
                imply(tag)
        if m[3].endswith("/") and (tag in _FOREIGN or any(name in _FOREIGN for name, _ in stack)):
            continue  # only there does a slash end an element
        if tag in _VOID or tag not in _STACKED and not _is_chrome(tag, m[3], article > 0) and not closing:
            continue
        if closing:
            at_stack = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at_stack is not None:
                close_from(at_stack)
        else:
            hides = _is_chrome(tag, m[3], article > 0)
            if hides:
                end()
            stack.append((tag, hides))
            chrome += hides
            article += tag in ("article", "main")
    end()
    return out


def blocks(html: str) -> list[tuple[str, bool]]:
    """(text, whether in an article) of every block that is not in a menu or the like, in page order."""
    return [(text, kind == ARTICLE) for text, kind in shown(html) if kind != MARKED]


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in their order, and of each the length of the prefix it shares with the one before.

    Ranks by doubling the compared length until all differ, which they do if the stream ends in a token of its own; the
    ranks of each length are kept, from which shared lengths are put together.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    levels, size = [rank.astype(np.int64)], 1
    while n and levels[-1].max() < n - 1:
        following = np.full(n, -1, np.int64)
        following[: max(n - size, 0)] = levels[-1][size:]
        _, rank = np.unique(levels[-1] * (n + 1) + following + 1, return_inverse=True)
        levels.append(rank.astype(np.int64))
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    shared, here, before = np.zeros(n, np.int64), order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, np.append(levels[k], [-1, -2])
        same = level[np.minimum(here, n)] == level[np.where(before < n, before, n + 1)]
        shared[1:] += same * step
        here, before = here + same * step, before + same * step
    return order, shared


def intervals(ids: np.ndarray, page: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffix array the suffixes of at least so many tokens before their page ends: starts, the interval of each
    whose members share as many tokens, and of each interval the number of distinct pages."""
    order, shared = suffix_array(ids)
    group = np.cumsum(shared < tokens) - 1
    long = (order + tokens <= len(ids)) & (page[np.minimum(order + tokens - 1, len(page) - 1)] == page[order]) if len(ids) else np.zeros(0, bool)
    order, group = order[long], group[long]
    _, group = np.unique(group, return_inverse=True)
    pairs = np.unique(group * (int(page.max(initial=0)) + 1) + page[order])
    return order, group, np.bincount(pairs // (int(page.max(initial=0)) + 1), minlength=int(group.max(initial=-1)) + 1)


def covered(n: int, starts: np.ndarray, tokens: int) -> np.ndarray:
    """Which of n places lie in a run of so many tokens from one of the starts."""
    edge = np.zeros(n + tokens + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + tokens, -1)
    return np.cumsum(edge)[:n] > 0


def repeated(ids: np.ndarray, page: np.ndarray, tokens: int, pages: int) -> np.ndarray:
    """Which tokens lie in a run of at least so many tokens that at least so many pages share."""
    starts, group, shared = intervals(ids, page, tokens)
    return covered(len(ids), starts[shared[group] >= pages], tokens)


def _whole(gone: np.ndarray, tokens: int) -> np.ndarray:
    """Of a block's covered stretches those of a run's length, or of the whole block: less is the edge of a run beside it."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out = np.zeros(len(gone), bool)
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out[a:b] = b - a >= min(tokens, len(gone))
    return out


def enough(n, share: float = RUN_SHARE, least: int = RUN_PAGES) -> int:
    """Distinct pages of n that make a run they share boilerplate."""
    return max(least, math.ceil(min(share * n, math.sqrt(n))))


class Streams:
    """The token streams of some pages of one host, distinct pages once, each closed by a token of its own."""

    def __init__(self, pages: list[list[tuple[str, int]]], bodies: list | None = None):
        self.start: dict = {}
        self.bodies = [body_of(p) for p in pages] if bodies is None else bodies
        known: dict[str, int] = {"\n": 0}
        ids, page = [], []
        for body, p in zip(self.bodies, pages, strict=True):
            if body not in self.start:
                self.start[body] = at = len(ids)
                for text, kind in p:
                    if kind != ARTICLE:
                        ids.append(0)
                        ids += [known.setdefault(t, len(known)) for t in text.split(" ")]
                ids.append(-len(self.start))
                page += [len(self.start) - 1] * (len(ids) - at)
        self.ids, self.page = np.array(ids, np.int64), np.array(page, np.int64)
        self.words = list(known)

    def runs(self, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all runs of so many tokens, the interval of each, and of the intervals pages and hashes of the text."""
        start, group, shared = intervals(self.ids, self.page, tokens)
        first = np.zeros(len(shared), np.int64)
        first[group] = start
        text = (" ".join(self.words[i] for i in self.ids[a : a + tokens].tolist()).encode("utf-8", "replace") for a in first.tolist())
        return start, group, shared, np.array([int.from_bytes(blake2b(t, digest_size=8).digest(), "little", signed=True) for t in text], np.int64)


def body_of(page: list[tuple[str, int]]) -> bytes:
    """What tells distinct pages apart: a digest of all their blocks."""
    return blake2b("\n".join(t for t, _ in page).encode("utf-8", "replace"), digest_size=16).digest()


def unique_runs(pages: list[list[tuple[str, int]]], common: np.ndarray | None = None, tokens: int = RUN_TOKENS, least: int = RUN_PAGES, share: float = RUN_SHARE) -> list[tuple[str, int]]:
    """Text and number of removed tokens of each page of one host, from its blocks.

    Runs outside articles that enough distinct pages share go; where the pages are only a part of a host's, those of the
    given hashes. Then an article's page keeps its article, and plain text too if it has more of that than of article:
    there the article is a teaser. Another page keeps its plain text. Marked text goes, whether repeated or not.
    """
    streams = Streams(pages)
    if common is None:
        gone = repeated(streams.ids, streams.page, tokens, enough(len(streams.start), share, least))
    else:
        start, group, _, hashes = streams.runs(tokens)
        gone = covered(len(streams.ids), start[np.isin(hashes, common)[group]] if len(start) else start, tokens)
    out = []
    for body, p in zip(streams.bodies, pages, strict=True):
        at, removed = streams.start[body], 0
        left: list[tuple[str, int]] = []
        for text, kind in p:
            if kind != ARTICLE:
                words = text.split(" ")
                here = gone[at + 1 : at + 1 + len(words)]
                at += 1 + len(here)
                if here.any():
                    here = _whole(here, tokens)
                    removed += int(here.sum())
                    text = " ".join(w for w, g in zip(words, here, strict=True) if not g)
            if text and kind != MARKED:
                left.append((text, kind))
        size = [sum(len(t) for t, k in left if k == kind) for kind in (PLAIN, ARTICLE)]
        out.append(("\n".join(t for t, k in left if k == ARTICLE or size[0] > size[1]), removed))
    return out


def host_of(url):
    """From the first :// up to /, ?, # or the end, A-Z as a-z; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", array_chars: int = ARRAY_CHARS) -> DataFrame:
    """key, url, text and n_removed of every page.

    text has the main text's blocks, one a line, white space within a block as one space, character references decoded;
    n_removed is how many tokens outside articles the host's suffix array took as repeated. Pages of a host that name an
    article in their markup and those that do not are told apart and judged among themselves. A null or empty page has the
    empty text. Whole pages count, however long. Pages of equal text count once as evidence and get equal texts; rows come
    back as often as they were given; a null url is the host of all such pages; other columns are not read.
    """
    spark = pages.sparkSession

    def parsed(texts):
        return [shown((t or b"").decode("utf-8", "replace")) for t in texts]

    def factory():
        def work(texts):
            found = parsed(texts)
            return [[t for t, _ in p] for p in found], [[k for _, k in p] for p in found], [int.from_bytes(body_of(p)[:8], "little", signed=True) for p in found]

        return work

    # A site is a host's pages with an article, or those without; its size is known before anything is parsed.
    names_article = F.coalesce(quoted(html).rlike(r"(?i)<(article|main)[\s/>]"), F.lit(False))
    narrow = pages.select(quoted(key).alias("k"), quoted(url).alias("u"), quoted(html).alias("h"), F.xxhash64(host_of(quoted(url)), names_article).alias("site"))
    parts = narrow.groupBy("site").agg(F.sum(F.length("h")).alias("chars")).select("site", "chars", F.ceil(F.col("chars") / array_chars).alias("parts"))
    sizes = parts.agg(F.sum("chars").alias("chars"), F.count_if(F.col("parts") > 1).alias("large")).first()
    large = parts.where("parts > 1").select("site", "parts")
    if sizes["large"] <= LISTED_HOSTS:
        large = F.broadcast(spark.createDataFrame([(r["site"], r["parts"]) for r in large.collect()], "site long, parts long"))
    part = F.pmod("body", F.coalesce("parts", F.lit(1)))
    found = annotate(narrow, "h", ["k", "u", "site"], factory, "blocks array<string>, kinds array<int>, body long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes["chars"] or 0) // TASK_CHARS))
    dealt = found.join(large, "site", "left").withColumns({"part": part, "dealt": F.col("parts").isNotNull()}).drop("parts", "body").repartition(tasks, "site", "part")

    def together(frame):
        return [list(zip(b, k, strict=True)) for b, k in zip(frame["blocks"], frame["kinds"], strict=True)]

    def of_host(frame, common):
        if not len(frame):
            return pd.DataFrame({"k": [], "u": [], "text": [], "n_removed": []})
        given = common["run"].to_numpy(np.int64) if frame["dealt"].iloc[0] else None
        runs = unique_runs(together(frame), given)
        frame["text"], frame["n_removed"] = [t for t, _ in runs], [n for _, n in runs]
        return frame[["k", "u", "text", "n_removed"]]

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = f"k {kinds['k']}, u string, text string, n_removed long"
    if not sizes["large"]:
        common = spark.createDataFrame([], "site long, part long, run long")
    else:
        common = _common_runs(narrow.join(large, "site"), factory, part, tasks)
    done = dealt.groupBy("site", "part").cogroup(common.groupBy("site", "part")).applyInPandas(of_host, schema)
    return done.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_removed")


def _common_runs(large: DataFrame, factory, part, tasks: int) -> DataFrame:
    """(site, part, run): the hashes of runs that enough pages of a site share, for each part that has them.

    Each part's suffix array gives its distinct runs and the pages that have them. As equal pages are in one part, the
    parts' counts add up. A run of one page of one part is no row until another part has it too: it is counted by Spark.
    """

    def runs_of(frame):
        streams = Streams([[(t, k) for t, k in zip(b, ks, strict=True) if k != ARTICLE] for b, ks in zip(frame["blocks"], frame["kinds"], strict=True)], frame["body"].tolist())
        _, _, shared, hashes = streams.runs(RUN_TOKENS)
        whole = frame["body"].nunique()
        made = pd.DataFrame({"run": np.append(hashes, 0), "n": np.append(shared, whole), "whole": np.append(np.zeros(len(hashes), bool), True)})
        made["site"], made["part"] = frame["site"].iloc[0], frame["part"].iloc[0]
        return made[["site", "part", "run", "n", "whole"]]

    found = annotate(large, "h", ["site", "parts"], factory, "blocks array<string>, kinds array<int>, body long").withColumn("part", part)
    outside = F.filter(F.arrays_zip("blocks", "kinds"), lambda x: x["kinds"] != ARTICLE)
    found = found.select("site", "part", "body", F.transform(outside, lambda x: x["blocks"]).alias("blocks"), F.transform(outside, lambda x: x["kinds"]).alias("kinds"))
    runs = written(found.repartition(tasks, "site", "part").groupBy("site", "part").applyInPandas(runs_of, "site long, part long, run long, n long, whole boolean"), "runs")
    size = runs.where("whole").groupBy("site").agg(F.sum("n").alias("size"))
    least = F.greatest(F.lit(RUN_PAGES), F.ceil(F.least(RUN_SHARE * F.col("size"), F.sqrt("size"))))
    shared = runs.where("not whole").groupBy("site", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= RUN_PAGES)
    shared = shared.join(size, "site").where(F.col("n") >= least).select("site", "run")
    return runs.where("not whole").join(shared, ["site", "run"], "left_semi").select("site", "part", "run")
