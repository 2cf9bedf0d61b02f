"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: block tags with their path and attributes, and text blocks with their
path. The occurrence vector of a token says how often each page of the host has it; pages that share
their article (all text outside marked regions) are one page here, so that copies of an article can't
look like a template. Tokens of one vector form an equivalence class; the vector is summed up as a
fingerprint, so that no host's pages ever meet in one task. A class is kept if it is large (`MIN_SIZE`
tokens), has a tag, and is frequent (`MIN_PAGES` pages, all of a host of two, and a share of
`SUPPORT` of the host's pages). In a page a class is valid if its tokens occur in the class's order, as
often as each other, and nested: within one slot of the classes accepted before, from the most frequent
down. The accepted classes are the page's template: their text is boilerplate, inside articles too, and
what stands between their tokens are slots. From the slots the article is taken: those in article or
main elements, else all outside menus, headers, footers, sidebars, notices, adverts, forms and
comments that are not mostly links.

Defined results: null and empty pages have the empty text; a page without a host is of host '';
a host of one page, or of copies of one article, has no template; unclosed, stray and cut-off tags are
tolerated; repeated page_ids are pages of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Tokens, pages and share of the host's pages that make a class large and frequent.
MIN_SIZE, MIN_PAGES, SUPPORT = 3, 3, 0.3
#: Share of a block's letters in links from which it counts as a menu.
LINKS = 0.6
#: Template tokens up to which the templates are broadcast.
BROADCAST_TOKENS = 300_000

RAW = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|button|title|video|audio"
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^<]*$|[^<]+|<", re.S | re.I)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open one of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUT_TAGS = frozenset("nav footer aside form dialog menu head fieldset".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar side footer masthead banner cookie cookies consent gdpr notice notices alert ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion "
    "comment comments commentlist disqus reply replies respond discussion social share sharing breadcrumb breadcrumbs pagination pager related recommended newsletter subscribe signup login search searchbox widget popup modal "
    "overlay toolbar copyright skip hidden teaser trackback".split()
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")


def _outside(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the element holds no main text."""
    if name in OUT_TAGS or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main") or not attrs:
        return False
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if key in ("class", "id", "role"):
            words = set(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if words & OUT_WORDS or (not in_article and "header" in words) or (key == "role" and words & {"complementary", "contentinfo", "navigation", "banner"}):
                return True
    return False


def parse(page: str) -> list[tuple[str, str | None, bool, int, float]]:
    """Tags and text blocks in page order: path, text (None: the tag of that path), whether outside main text, 1 in main and 2 in an article, share of letters in links."""
    out: list[tuple[str, str | None, bool, int, float]] = []
    stack: list[tuple[str, bool, int, str]] = []  # name, outside (itself or around), article level, path
    text: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, outside, level, path = stack[-1] if stack else ("", False, 0, "")
                out.append((path, joined, outside, level, linked / len(joined)))
            text.clear()
        linked = 0

    def push(name: str, attrs: str, out_of: bool, level: int) -> None:
        _, outside, _, path = stack[-1] if stack else ("", False, 0, "")
        stack.append((name, outside or out_of, level, f"{path}/{name}"))
        out.append((f"{path}/{name}{attrs}", None, outside or out_of, level, 0.0))

    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            piece = m[0]
            if m["raw"]:
                if m["raw"].lower() == "title" or not text:
                    continue
                text.append(" ")
            elif piece[0] != "<" or piece == "<":
                piece = entities.unescape(piece)
                text.append(piece)
                if in_link:
                    linked += len(piece.strip())
            continue
        name, attrs = name.lower(), m["attrs"]
        if name == "br":
            text.append(" ")
        if name == "a":
            in_link = 0 if m["end"] else 1
        if m["end"]:
            if name in BLOCKS:
                flush()
                in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        block = name in BLOCKS
        if block:
            flush()
            in_link = 0
            if name in SELF_CLOSING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SELF_CLOSING[name]:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "td", "th", "blockquote", "select"):
                        break
        if name in VOID or attrs.endswith("/"):
            continue
        level = stack[-1][2] if stack else 0
        out_of = _outside(name, attrs, level > 0 or name == "article")
        if name == "article":
            level = 2
        elif name == "main" or re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I):
            level = max(level, 1)
        if block:
            push(name, attrs, out_of, level)
        elif out_of:
            flush()
            push(name, attrs, out_of, level)
    flush()
    return out


def tokens(page: str) -> tuple[list[tuple], np.ndarray]:
    """The page's tags and blocks, and their tokens (hashes of path and text)."""
    got = parse(page)
    return got, np.array([xxhash.xxh64_intdigest(p if t is None else f"{p}\0{t}") for p, t, *_ in got], np.uint64).view(np.int64)


def content(got: list[tuple]) -> int:
    """A fingerprint of the text outside marked regions and menus: what copies of an article share."""
    inside = max([b[3] for b in got if b[1] is not None and not b[2]], default=0)
    return xxhash.xxh64_intdigest("\0".join(t for _, t, outside, level, links in got if t is not None and not outside and level >= inside and links <= LINKS)) - (1 << 63)


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page's host, content, and its distinct tokens with their counts, first places (in thousandths of the page) and whether they are tags."""
    for frame in frames:
        rows = []
        for u, h in zip(frame["url"], frame["html"]):
            got, ids = tokens(h or "")
            names, at, n = np.unique(ids, return_index=True, return_counts=True)
            tags = np.array([got[a][1] is None for a in at], bool)
            rows.append((host(u), content(got), names, n.astype(np.int32), (at * 1000 // max(1, len(ids))).astype(np.int32), tags))
        yield pd.DataFrame(rows, columns=["host", "content", "tokens", "counts", "places", "tags"])


def templates(pages: DataFrame, min_size: int = MIN_SIZE, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """host, token, class, nth, pages, size: the tokens of each host's large and frequent equivalence classes, numbered in their order."""
    seen = pages.mapInPandas(_pages, "host string, content long, tokens array<long>, counts array<int>, places array<int>, tags array<boolean>")
    one = seen.dropDuplicates(["host", "content"])  # copies of an article are one page
    flat = one.select("host", "content", F.explode(F.arrays_zip("tokens", "counts", "places", "tags")).alias("t"))
    per = flat.groupBy("host", "t.tokens").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("content", "t.counts")).alias("mark"), F.sum(F.col("t.counts").cast("long")).alias("times"), F.avg("t.places").alias("place"), F.bool_or("t.tags").alias("tag")
    )
    per = cut(per.where("pages >= 2").withColumnRenamed("tokens", "token"))
    # The most frequent token of a host is in each of its pages (the page's first tag), or nearly so.
    sizes = per.groupBy("host").agg(F.max("pages").alias("all"))
    frequent = per.join(sizes, "host").where((F.col("pages") >= F.least(F.lit(min_pages), "all")) & (F.col("pages") >= support * F.col("all")))
    classes = frequent.groupBy("host", "pages", "mark", "times").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("members"), F.bool_or("tag").alias("tag"))
    classes = classes.where(F.col("tag") & (F.size("members") >= min_size))
    return classes.select("host", F.xxhash64("pages", "mark", "times").alias("class"), "pages", F.size("members").alias("size"), F.posexplode("members").alias("nth", "m")).select("host", "m.token", "class", "nth", "pages", "size")


def of_template(ids: np.ndarray, template: dict[int, tuple[int, int, int, int]]) -> dict[int, int]:
    """The places of the page's template tokens and the pages that share them; template: class, nth, pages, size of a token.

    Classes are taken from the most frequent and largest down. One is valid if its places, in page order, count through the
    class again and again, and if no accepted token stands inside one of these rounds.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    rank: dict[int, tuple[int, int, int]] = {}
    for at, t in enumerate(ids.tolist()):
        if (m := template.get(t)) is not None:
            places.setdefault(m[0], []).append((at, m[1]))
            rank[m[0]] = (-m[2], -m[3], m[0])
    taken = np.zeros(len(ids) + 1, np.int64)  # accepted tokens before each place
    out: dict[int, int] = {}
    for name in sorted(places, key=rank.__getitem__):
        size = -rank[name][1]
        found = places[name]
        if len(found) % size or any(nth != i % size for i, (_, nth) in enumerate(found)):
            continue
        rounds = [(found[i][0], found[i + size - 1][0]) for i in range(0, len(found), size)]
        if out:
            before = np.cumsum(taken)
            if any(before[b] - before[a] for a, b in rounds):
                continue
        for at, _ in found:
            out[at] = -rank[name][0]
            taken[at] = 1
    return out


def main_text(got: list[tuple], ids: np.ndarray, template: dict[int, tuple[int, int, int, int]]) -> list[str]:
    """The article's blocks: what stands in the slots of the template that lie in the main part."""
    known = of_template(ids, template) if template else {}
    # Two pages alone don't tell an article's own words from a template's.
    slots = [b for at, b in enumerate(got) if b[1] is not None and not (at in known and (b[3] == 0 or known[at] >= MIN_PAGES))]
    level = max([b[3] for b in slots if not b[2]], default=0)
    return [text for _, text, outside, at, links in slots if not outside and at >= level and (level > 0 or links <= LINKS)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = cut(templates(picked))
    per_host = found.groupBy("host").agg(F.collect_list(F.struct("token", "class", "nth", "pages", "size")).alias("template"))
    with_host = picked.withColumn("host", F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))
    if found.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS:
        joined = with_host.join(F.broadcast(per_host), "host", "left")
    else:  # a host's pages are dealt over 32 parts, so that a large host is no single task's
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = with_host.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(32)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict] = {}  # the templates of the hosts seen last
        for frame in frames:
            out = []
            for h, name, t in zip(frame["html"], frame["host"], frame["template"]):
                if name not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[name] = {m["token"]: (m["class"], m["nth"], m["pages"], m["size"]) for m in t} if t is not None else {}
                got, ids = tokens(h or "")
                out.append("\n\n".join(main_text(got, ids, held[name])))
            yield pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"], "text": out})

    # Ids travel as text: a long column with nulls would reach pandas as floating point.
    done = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "host", "template").mapInPandas(run, "page_id string, url string, text string")
    return done.withColumn("page_id", F.col("page_id").cast("long"))


def extract_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
