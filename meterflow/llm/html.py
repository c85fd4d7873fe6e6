"""Main text of web pages, by differencing pages with the nearest URL.

1. A page becomes text lines, one per block, each with the region it stands in: content (an
   article or main element), furniture (menus, headers, footers, sidebars, notices, adverts,
   forms, comments, by element or by a whole class, id or role) or plain.  An article or main
   element inside furniture is content again, unless an article is one of many there (teasers,
   comments, adverts); a header inside content belongs to it.
2. Each page is paired with pages of its host whose URL path is nearest: of the ``REACH`` pages before and
   after it in the order of (path, page), those with most leading path segments in common.  Pages of
   equal lines are copies, not neighbours: the next nearest stands in for them.
3. The lines of a page outside content regions and those of its nearest neighbours are aligned by
   their longest common subsequence, and lines shared with one of ``PAIRS`` neighbours go.  What is left
   of the plain lines stays beside the content regions, which stay whole (articles may quote each
   other).  Furniture that differs from page to page is dropped by its region.

Cases: null or empty html gives an empty text; a page alone on its host, or with copies only, loses
no shared lines; of equally near pages those with the nearest place, then with the smaller page_id, are
taken; rows that repeat a page_id are extracted each on its own and share neighbours, null
page_ids have none; a malformed URL counts as a host of its own; very long pages are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.base import packed, per_batch, plain, prepare, settle

#: Elements by what they hold.
SILENT = frozenset("script style noscript template svg math head title iframe object embed canvas audio video map textarea select option button datalist".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT = frozenset(("article", "main"))
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of a block ends, if they are open and nothing encloses them.
CLOSED_BY_BLOCK = frozenset(("p",))
#: Whole names in class, id or role that mark furniture.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe signup share sharing social comment comments disqus respond related recommended widget toolbar pagination pager login search form contentinfo complementary".split())
#: Compound names of the same sort, as content systems and frameworks give them.
COMPOUND = frozenset("ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper ads-container advert-box cookie-banner cookie-bar cookie-consent cookie-notice comment-form comment-list comment-section comments-area comments-list comments-section footer-nav header-nav main-menu main-nav nav-bar nav-menu navbar-nav newsletter-form newsletter-signup page-footer page-header related-articles related-links related-posts share-bar share-buttons share-links site-footer site-header site-nav skip-link social-links social-share".split())
#: Elements and names of furniture whose articles are not the page's own.
OTHERS = frozenset("nav footer aside menu dialog ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond related recommended widget popup modal".split())
#: Elements that no class, id or role marks.
WHOLE = frozenset("html body article main".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title"}


def _furniture(name: str, attributes: str) -> int | None:
    """-1 for furniture that holds articles of others, 0 for other furniture, else None."""
    if name in FURNITURE:
        found = {name}
    elif "=" in attributes and name not in WHOLE:
        names = {n for m in _MARK.findall(attributes) for n in "".join(m).lower().split()}
        found = (names & MARKS) | {part for n in names & COMPOUND for part in n.split("-")}
    else:
        return None
    return None if not found else 0 if OTHERS.isdisjoint(found) else -1


def lines(html: str) -> list[tuple[str, int]]:
    """(text, region) of each block that has text: region 2 content, 1 plain, 0 furniture."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # name, region, silent
    text: list[str] = []
    region, silent, at, size = 1, False, 0, len(html)

    def end_block() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                out.append((line, max(region, 0)))
            text.clear()

    while at < size:
        token = _TOKEN.match(html, at)
        at = token.end()
        name = token.group(1)
        if name is None:
            whole = token.group()
            if not silent and not (whole.startswith("<!") or whole.startswith("<?")):
                text.append(whole)
            continue
        name = name.lower()
        if html[token.start() + 1] == "/":
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                if name in BLOCKS:
                    end_block()
                continue
            if name not in BLOCKS and any(s[0] in BLOCKS for s in stack[depth + 1 :]):
                continue  # a stray end of an inline element does not close blocks
            if name in BLOCKS:
                end_block()
            del stack[depth:]
            region, silent = (stack[-1][1], stack[-1][2]) if stack else (1, False)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            end_block()
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[i][0] in CLOSED_BY_BLOCK:
                    del stack[i:]
                    region, silent = (stack[-1][1], stack[-1][2]) if stack else (1, False)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in VOID or (token.group(2) or "").endswith("/"):
            continue
        attributes = token.group(2) or ""
        inner = region
        kind = _furniture(name, attributes)
        if name == "main" or name in CONTENT and region >= 0:
            inner = 2
        elif kind is not None and not (name == "header" and region == 2):
            inner = min(kind, region)
        hidden = silent or name in SILENT
        if name in _RAW:  # its inside is not markup
            end = re.compile(f"</{name}", re.I).search(html, at)
            at = end.start() if end else size
        stack.append((name, inner, hidden))
        region, silent = inner, hidden
    end_block()
    return out


def shared(a: list, b: list) -> set[int]:
    """Positions of a in a longest common subsequence of a and b."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = {*range(start), *range(len(a) - end, len(a))}
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    places: dict = {}
    for j, item in enumerate(y):
        places[item] = places.get(item, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for item in x:  # one bit for each column: clear where the length grows
        match = places.get(item, 0)
        both = row & match
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    j = len(y) - 1
    for i in range(len(x) - 1, -1, -1):
        before = rows[i - 1] if i else full
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if before >> j & 1:
            found.add(start + i)
            j -= 1
    return found


#: Pages looked at on either side, and neighbours whose shared lines go.
REACH, PAIRS = 2, 2


def main_text(html: str, others: list[list[str]]) -> str:
    """The page's main text, given the lines of its neighbours outside their content."""
    return differenced(lines(html), others)


def differenced(mine: list[tuple[str, int]], others: list[list[str]]) -> str:
    outside = [i for i, (_, r) in enumerate(mine) if r < 2]
    common = {outside[k] for other in others if other for k in shared([mine[i][0] for i in outside], other)}
    return "\n\n".join(t for i, (t, r) in enumerate(mine) if r == 2 or r == 1 and i not in common)


def _sign(found: list[tuple[str, int]]) -> bytes:
    return blake2b("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _outside(rows: dict[str, list]) -> dict[str, list]:
    """Lines outside content regions, the only ones that a neighbour can take away, and a digest of all lines."""
    found = [lines(h or "") for h in rows["html"]]
    return {"page_id": rows["page_id"], "shell": [[t for t, r in f if r < 2] for f in found], "sign": [_sign(f) for f in found]}


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, place): pages of known page_id in the order of host and path.

    Ranges are sorted by themselves; what the driver sees is one count for each.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/]*", ""), r"(\.html?|/)$", "")
    keyed = pages.select("page_id", F.when(host == "", url).otherwise(host).alias("host"), path.alias("path")).where("page_id is not null")
    one = keyed.groupBy("page_id").agg(F.min(F.struct("host", "path")).alias("u")).select("page_id", "u.*")
    ordered = one.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    ranged = settle(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("inside")))
    before, total = [], 0
    for row in ranged.groupBy("part").count().orderBy("part").collect():
        before += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    start = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    return ranged.select("page_id", "host", "path", (start + F.col("inside")).alias("place"))


def nearest(pages: DataFrame) -> DataFrame:
    """(page_id, near_id, rank): pages of the same host by nearness, 2 * REACH at most."""
    at = settle(numbered(pages))
    steps = F.explode(F.array(*[F.lit(k) for k in range(-REACH, REACH + 1) if k])).alias("step")
    asked = at.select("page_id", "host", "path", "place", steps).select("page_id", "host", "path", "step", (F.col("place") + F.col("step")).alias("place"))
    other = at.select("place", "host", F.col("page_id").alias("near_id"), F.col("path").alias("near_path"))
    same = F.aggregate(
        F.zip_with(F.split("path", "/"), F.split("near_path", "/"), lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")),
    )["n"]
    found = asked.join(other, ["place", "host"]).select("page_id", "near_id", (-same).alias("far"), F.abs("step").alias("step"))
    ranked = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("far", "step", "near_id"))).alias("near"))
    return ranked.select("page_id", F.posexplode("near").alias("rank", "n")).select("page_id", F.col("n.near_id").alias("near_id"), "rank")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    shells = per_batch(pages.select("page_id", "html").where("page_id is not null"), "page_id long, shell array<string>, sign binary", _outside)
    one = shells.groupBy("page_id").agg(F.min(F.struct("shell", "sign")).alias("s")).select(F.col("page_id").alias("near_id"), "s.*")
    near = nearest(pages).join(one, "near_id").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sign", "shell"))).alias("near"))

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = []
        for data, others in zip(rows["packed"], rows["near"], strict=True):
            mine = lines(plain(data))
            sign = _sign(mine)
            texts.append(differenced(mine, [o["shell"] for o in others or [] if o["sign"] != sign][:PAIRS]))
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    whole = lambda some: packed(pages.where(some).withColumnRenamed("html", "text"), "page_id", "url")
    known = whole("page_id is not null").join(near, "page_id", "left")
    # Pages without an id have no neighbours and stay where they are.
    lone = whole("page_id is null").withColumn("near", F.lit(None).cast(known.schema["near"].dataType))
    return per_batch(known.unionByName(lone), "page_id long, url string, text string, n_chars long", work)
