"""Main text of web pages: a host's suffix array and the page's markup vote on every block.

Markup says of a block that it is in the article, outside it in an element that
can't be main text, in something whose name only hints at page furniture, or
open. Reader comments are unique by nature, and so are many adverts: whatever is
named as comments is out, and so is what is named as an advert, a sidebar or the
like, unless it is the larger part of what may be main text, as a wrapper is. The token streams of a host's pages, with a mark at each block's edge, are
concatenated and their suffixes sorted by their first DEPTH tokens; an interval
of the array with so long a common prefix on PAGES or more distinct pages is a
repeated substring. The array is built over all blocks of all pages. Repeats
decide what markup leaves in doubt: covered runs of open blocks go and unique
runs stay, and a block that its name hints at goes if it repeats. An article's
plain blocks stay, whatever repeats. Where a host has fewer than PAGES pages
nothing can repeat, and what a name hints at goes if it is the smaller part.

A host of many pages is cut into shards of bounded size, each with an array of
its own; substrings that no shard has often enough are then counted over all of
them by key.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import WordHashes, mix, runs, signed, table

#: Tokens (marks count) of a substring that counts as long, and distinct pages that make it boilerplate.
DEPTH, PAGES = 8, 3
#: Characters of html in a shard of a host, about.
SHARD = 6_000_000

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
# HTML's element names and the words that name page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
OUTSIDE = set("head nav footer aside form button select datalist noscript template svg canvas object audio video dialog menu".split())
MAIN_ROLES = {"main", "article"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
COMMENTS = set("comment comments comment-list commentlist comment-section disqus disqus_thread replies respond".split())
FURNITURE = COMMENTS | set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies cookie-banner cookie-notice consent gdpr popup modal newsletter subscribe paywall sidebar side-bar menu main-menu nav navbar navigation breadcrumb breadcrumbs footer site-footer social share sharing share-buttons related related-posts recommended login signup pagination pager skip-link".split()
)
TOP = set("header site-header masthead topbar".split())
#: A name with such a part hints at furniture.
HINT = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|popups?|modal|newsletter|subscri\w*|paywall|sidebars?|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|footer|comments?|social|share|sharing|related|recommended|login|signup|search|pagination|pager|skip|masthead|topbar)(?:[_-]|$)", re.I)
#: A name with such a part is of reader comments, but not if another part says that it only tells of their state.
COMMENT = re.compile(r"(?:^|[_-])(?:comments?|commentlist|commentary|repl(?:y|ies)|disqus|respond)(?:[_-]|$)", re.I)
STATE = re.compile(r"(?:^|[_-])(?:no|not|has|have|with|without|open|opened|closed|enabled|disabled|free|on|off)(?:[_-]|$)", re.I)
#: A name with such a part is of furniture that tends to be unique.
SURE_HINT = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|popups?|newsletter|subscri\w*|paywall|sidebars?|breadcrumbs?|social|share|sharing|login|signup|pagination|pager)(?:[_-]|$)", re.I)
#: Elements whose start ends an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = BLOCK - {"body", "head", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "optgroup"}
#: Kinds of blocks: the article's, none of it, open, hinted at inside an article and outside; and so named that they are out if they are the smaller part.
ARTICLE, OUT, OPEN, DOUBT, HINTED, NAMED, NAMED_OUTSIDE = range(7)
INSIDE = (ARTICLE, DOUBT, NAMED)


def kind_of(name: str, given: dict, kind: int, parent: str, top: bool) -> int:
    """The kind of what is in an element, from its name, attributes, and the kind and name of its parent; ``top``: nothing but wrappers above."""
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().split() if given else ()
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    if kind == OUT or hidden or not FURNITURE.isdisjoint(names) or role in OUTSIDE_ROLES:
        return OUT
    if name not in ("body", "html") and any(COMMENT.search(n) and not STATE.search(n) for n in names):
        return OUT
    if name in OUTSIDE:
        # a form around the whole page says nothing about what is in it
        return HINTED if name == "form" and top else OUT
    if name in ("article", "main") or role in MAIN_ROLES or "articlebody" in given.get("itemprop", "").lower():
        return kind if kind in (DOUBT, NAMED) else ARTICLE
    if kind not in INSIDE and (name == "header" or not TOP.isdisjoint(names)):
        return OUT
    if name in ("body", "html") or kind in (NAMED, NAMED_OUTSIDE):
        return kind
    if any(SURE_HINT.search(n) and not STATE.search(n) for n in names):
        return NAMED if kind in INSIDE else NAMED_OUTSIDE
    if any(map(HINT.search, names)):
        return DOUBT if kind in INSIDE else HINTED
    return kind


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    loose = False  # whether the block under way has words outside links
    stack: list[tuple[str, int, bool]] = [("", OPEN, True)]
    places: dict[str, list[int]] = {}

    def flush():
        nonlocal loose
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                kind = stack[-1][1]
                # an item of a list that is a link as a whole is an entry of a menu
                out.append((NAMED_OUTSIDE if kind == OPEN and not loose and places.get("li") else kind, joined))
            text.clear()
        loose = False

    def add(part: str):
        nonlocal loose
        text.append(part)
        loose = loose or not (places.get("a") or part.isspace())

    def last(names) -> int:
        """Where the innermost open element of one of the names is; 0 if none is open."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names, until=()):
        k = last(names)
        if not k or k < last(until):
            return
        if stack[k][1] != stack[k - 1][1] or any(name in BLOCK for name, _, _ in stack[k:]):
            flush()
        for name, _, _ in stack[k:]:
            places[name].pop()
        del stack[k:]

    page = page or ""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in BLOCK:
                flush()
            if name not in VOID:
                close((name,), ("td", "th", "table") if name not in BLOCK else ())
            elif name == "br":
                text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if name in ENDS_P:
            close(("p",), ("button", "table", "td", "th", "article", "section", "div") if name != "p" else ("button", "table"))
        if name in CLOSES:
            close(CLOSES[name], ("ul", "ol", "dl", "table", "select", "tbody"))
        attributes = m["attrs"] or m["attrs2"]
        given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        parent, kind, top = stack[-1]
        new = kind_of(name, given, kind, parent, top)
        if new != kind:
            flush()
        if page[m.end() - 2 : m.end()] != "/>" or name in BLOCK:
            places.setdefault(name, []).append(len(stack))
            stack.append((name, new, top and name in ("html", "body", "div")))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def sizes(kinds: list[int], texts: list[str]) -> list[int]:
    size = [0] * 7
    for k, t in zip(kinds, texts):
        size[k] += len(t)
    return size


def settled(kinds: list[int], texts: list[str], named: tuple[int, int]) -> list[int]:
    """The kinds with the ``named`` ones out where they are the smaller part, of the article or of what is open; else in doubt."""
    size = sizes(kinds, texts)
    inside, outside = named
    new = {inside: OUT if size[inside] < size[ARTICLE] else DOUBT, outside: OUT if size[outside] < size[OPEN] else HINTED}
    return [new.get(k, k) for k in kinds]


def parse(batches):
    for b in batches:
        kinds, texts = [], []
        for v in b.column("html"):
            found = blocks(v.as_py())
            texts.append([t for _, t in found])
            kinds.append(settled([k for k, _ in found], texts[-1], (NAMED, NAMED_OUTSIDE)))
        yield pa.RecordBatch.from_arrays([b.column("src"), b.column("host"), pa.array(kinds, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], names=["src", "host", "kinds", "blocks"])


def stream(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of a page with a mark before and after each block, and the block of each."""
    tokens, of = [b"\n"], [-1]
    for i, t in enumerate(texts):
        w = t.encode().split()
        tokens += [*w, b"\n"]
        of += [i] * len(w) + [-1]
    return tokens, np.array(of)


def suffix_intervals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` with DEPTH tokens or more, in the order of their first DEPTH; and where each interval of equal ones begins.

    Ranks by the first 1, 2, 4, 8 tokens, doubled by sorting pairs of ranks.
    """
    rank, size = ids.astype(np.int64), 1
    while size < DEPTH:
        step = min(size, DEPTH - size)
        n = len(rank) - step
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[step : step + n], return_inverse=True)
        size += step
    order = np.argsort(rank, kind="stable")
    return order, np.flatnonzero(np.diff(rank[order], prepend=-1))


def repeated_starts(ids: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Where a substring of DEPTH tokens begins that PAGES or more distinct pages have; none crosses a page's end."""
    order, begin = suffix_intervals(ids)
    if not len(order):
        return order
    inside = page[order] == page[order + DEPTH - 1]
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    seen = np.unique(of[inside] * (int(page.max()) + 1) + page[order[inside]])
    many = np.bincount(seen // (int(page.max()) + 1), minlength=len(begin)) >= PAGES
    return order[inside & many[of]]


def in_doubt(kinds: list[int], texts: list[str]) -> bool:
    """Whether markup alone doesn't decide on the page."""
    size = sizes(kinds, texts)
    return size[DOUBT] > 0 or size[OPEN] + size[HINTED] > size[ARTICLE]


def solve_shard(shard: pa.Table) -> pa.Table:
    """``src, text`` of the pages of a shard, from its suffix array, the pages' kinds, and the starts that ``more`` adds."""
    known: dict[bytes, int] = {}
    ids, pages, edges, same = [], [], [0], {}
    texts, kinds = shard["blocks"].to_pylist(), shard["kinds"].to_pylist()
    for row in texts:
        tokens = stream(row or [])[0]
        ids.append(np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens)))
        # pages with the same stream are one page
        pages.append(np.full(len(tokens), same.setdefault(ids[-1].tobytes(), len(same))))
        edges.append(edges[-1] + len(tokens))
    starts = np.sort(repeated_starts(np.concatenate(ids), np.concatenate(pages)))
    cut = np.searchsorted(starts, edges)
    out = []
    for i, (kind, row, more) in enumerate(zip(kinds, texts, shard["more"].to_pylist())):
        if len(same) < PAGES and not more:
            kind = settled(kind, row, (DOUBT, HINTED))
        if in_doubt(kind, row):
            out.append(chosen(kind, row, np.union1d(starts[cut[i] : cut[i + 1]] - edges[i], np.array(more or (), np.int64))))
        else:
            out.append("\n".join(t for k, t in zip(kind, row) if k == ARTICLE))
    return pa.table([shard["src"], pa.array(out, pa.string())], names=["src", "text"])


def doubtful(batches):
    """``host, page, gram, at`` of the suffixes of pages in doubt."""
    word = WordHashes()
    for b in batches:
        hosts, grams, marks, at = [], [], [], []
        for host, kinds, texts in zip(b.column("host").to_pylist(), b.column("kinds").to_pylist(), b.column("blocks").to_pylist()):
            if in_doubt(kinds, texts):
                tokens = stream(texts)[0]
                g = keyed(host, tokens, word)
                hosts += [host] * len(g)
                grams.append(signed(g))
                marks.append(np.full(len(g), page_mark(tokens, word)))
                at.append(np.arange(len(g), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(np.concatenate(c) if c else [], t) for c, t in ((marks, pa.int64()), (grams, pa.int64()), (at, pa.int32()))]], names=["host", "page", "gram", "at"])


def keyed(host: str, tokens: list[bytes], word: WordHashes) -> np.ndarray:
    """The hash of each suffix's first DEPTH tokens and the host."""
    return mix(runs(word(tokens), DEPTH) ^ word([host.encode()]))


def page_mark(tokens: list[bytes], word: WordHashes) -> int:
    return int(signed(word([b" ".join(tokens)]))[0])


def suffixes(batches):
    """Each page's distinct suffixes."""
    word = WordHashes()
    for b in batches:
        grams, pages = [], []
        for host, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tokens = stream(texts or [])[0]
            g = np.unique(keyed(host, tokens, word))
            grams.append(signed(g))
            # pages with the same stream are one page
            pages.append(np.full(len(g), page_mark(tokens, word)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (grams, pages)], names=["gram", "page"])


def repeated(evidence: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of the suffixes ``asked (gram)`` that PAGES or more distinct pages of ``evidence (host, blocks)`` have.

    A page sets one of 64 bits, so that a suffix is one short row from each
    task; the few whose pages may have met in a bit are counted again in full.
    """
    found = evidence.mapInArrow(suffixes, "gram long, page long").join(asked, "gram", "left_semi")
    bit = F.expr("shiftleft(1L, CAST(page & 63 AS INT))")
    sums = table(found.groupBy("gram").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")).where(F.col("n") >= PAGES).select("gram", (F.bit_count("bits") >= PAGES).alias("sure")))
    sure, open_ = sums.where("sure").select("gram"), sums.where("NOT sure").select("gram")
    if open_.isEmpty():
        return sure
    again = found.join(open_, "gram", "left_semi").groupBy("gram").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= PAGES).select("gram")
    return table(sure.unionByName(again))


def chosen(kinds: list[int], texts: list[str], starts) -> str:
    """The page's main text: blocks of the article, what doubtful ones don't repeat, and of open ones the unique runs if they are more than the article."""
    tokens, of = stream(texts)
    gone = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts + DEPTH, len(tokens)), -1)
    covered = np.cumsum(gone[:-1]) > 0
    out, size = [], [0, 0]
    for i, (kind, text) in enumerate(zip(kinds, texts)):
        at = np.flatnonzero(of == i) if kind in (DOUBT, OPEN, HINTED) else None
        if kind == DOUBT and covered[at].mean() >= 0.5:
            continue
        if kind in (OPEN, HINTED):
            text = b" ".join(tokens[j] for j in unique_runs(at, covered)).decode()
        if kind != OUT and text:
            is_open = kind in (OPEN, HINTED)
            size[is_open] += len(text)
            out.append((is_open, text))
    return "\n".join(t for is_open, t in out if not is_open or size[1] > size[0])


def unique_runs(block: np.ndarray, covered: np.ndarray) -> list[int]:
    """The block's tokens but for covered runs that are all of it or long by themselves: a repeat may reach a few tokens into a unique block."""
    out: list[int] = []
    edges = np.flatnonzero(np.diff(covered[block].astype(np.int8))) + 1
    for run in np.split(block, edges):
        if len(run) and not (covered[run[0]] and (len(run) >= DEPTH or len(run) == len(block))):
            out += run.tolist()
    return out


def marked(batches):
    """``page``, the hash of each row's stream, goes before its other columns."""
    word = WordHashes()
    for b in batches:
        marks = [page_mark(stream(t or [])[0], word) for t in b.column("blocks").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), *b.columns], names=["page", *b.schema.names])


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", shard: int = SHARD) -> DataFrame:
    """``src, text`` per row of ``pages``; ``src`` holds its columns but the html.

    Blocks of main text in page order, joined by one newline, white space in a
    block being one space; the empty string where there is none, as for null and
    empty pages. Copies of a page don't make each other boilerplate, and each
    has its own row. A null url is a host of its own. A page of any length is
    parsed whole, in time that grows with it. An empty table gives an empty one.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    kept = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*kept or [F.lit(None).alias("none")]).alias("src"), host.alias("host"), F.col(html_col).alias("html"))
    found = T.StructType.fromDDL("host string, kinds array<int>, blocks array<string>").fields
    parsed = rows.mapInArrow(parse, T.StructType([rows.schema["src"], *found]))

    large = rows.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).where(F.col("chars") > shard)
    large = table(large.select(F.col("host").alias("large"), F.ceil(F.col("chars") / shard).cast("int").alias("shards")))
    of_large = rows.select(F.struct(F.lit(None).alias("none")).alias("src"), "host", "html").join(large, F.col("host") == F.col("large"), "left_semi")
    of_large = of_large.mapInArrow(parse, T.StructType([of_large.schema["src"], *found]))
    # what pages in doubt have, and any shards of their host have too
    asked = table(of_large.select("host", "kinds", "blocks").mapInArrow(doubtful, "host string, page long, gram long, at int"))
    more = None
    if not asked.isEmpty():
        common = repeated(of_large.select("host", "blocks"), asked.select("gram").distinct())
        more = table(asked.join(common, "gram").groupBy("host", "page").agg(F.collect_set("at").alias("more")))
    if more is None:
        parsed = parsed.withColumn("more", F.lit(None).cast("array<int>"))
    else:
        parsed = parsed.mapInArrow(marked, T.StructType([T.StructField("page", T.LongType()), *parsed.schema.fields])).join(more, ["host", "page"], "left").drop("page")
    dealt = parsed.join(large, F.col("host") == F.col("large"), "left").withColumn("shard", F.pmod(F.xxhash64(F.col("src").cast("string")), F.coalesce("shards", F.lit(1))))
    return dealt.select("host", "shard", "src", "kinds", "blocks", "more").groupBy("host", "shard").applyInArrow(solve_shard, T.StructType([rows.schema["src"], T.StructField("text", T.StringType())]))


def op9_html_text(spark, sf_dir):
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select(F.col("src.page_id").alias("page_id"), F.col("src.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
