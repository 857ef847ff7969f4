"""Main text of web pages with removal of site templates (operator 3).

A page is parsed into blocks. Every element is hashed with all it holds, and Spark counts on how many
pages of a host each such subtree occurs. Subtrees that recur on many pages of a host are its
template: their blocks are deleted. Elements that are boilerplate by their kind (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) go by name, class or
role. If a page marks its main content (article or main), only blocks in it stay.

Articles may have copies and near copies, so inside main content a subtree must be on at least half of
the host's pages, and goes only from pages most of whose main text stands in no such subtree.

A block is the text between two block-level tags, with character references decoded and white
space runs made one space; blocks are joined in page order by an empty line.

Defined results: null html counts as empty and gives an empty text; a null url has an empty host,
which is a host like any other. Tags without an end are closed by the next block, their parent's
end or the end of the page. Repeated rows come back as often as they came in; a page id may repeat.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prioscope.llm.common import kept, text_of
from prioscope.llm.filters import bit_filter, passes, slot_of
from prioscope.llm.urls import url_parts

LEAST_PAGES, LEAST_SHARE = 5, 0.01
#: Inside main content: what articles quote or copy of each other is on few of a host's pages.
INSIDE_SHARE = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key ends an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = {"article", "main"}
_BASE, _PRIME = 0x5851F42D4C957F2D, 2**127 - 1
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form"}
BOILERPLATE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget".split()
)
#: Names that inside main content mean the article's own heading.
HEADINGS = {"header", "masthead"}
_SKIPPED = BOILERPLATE_TAGS | RAW


def _boilerplate(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _SKIPPED or (tag == "header" and not in_main):
        return True
    if "=" in attributes and tag not in ("body", "html"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                if value in BOILERPLATE_ROLES:
                    return True
            elif any(part in BOILERPLATE_NAMES and not (in_main and part in HEADINGS) for part in _NAME_PART.findall(value)):
                return True
    return False


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parse(page: str) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """Blocks that may be main text with the number of the element around them, and of each element its parent and hash."""
    return _parse(page)[:3]


def _parse(page: str) -> tuple[list[tuple[str, int]], list[int], list[int], list[bool]]:
    """``parse``, and of each element whether it stands inside main content; such an element has no parent outside.

    The hash of an element without text is 0; inside and outside of main content hashes differ. The hash of
    a subtree is cut out of running sums over the hashes of the page's blocks, so the time is linear
    however deep elements are nested.
    """
    stack: list[tuple] = []  # (tag, is boilerplate, is main, element number, how many blocks came before, element around it, in main)
    open_tags: Counter[str] = Counter()
    parents: list[int] = []
    hashes: list[int] = []
    sums, powers = ([0], [0]), [1]  # sums outside, and inside of main content
    insides: list[bool] = []
    blocks: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    skip = main = 0
    inner = -1

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if not text:
            return
        if not main or not skip:
            own = sums[main > 0]
            own.append((own[-1] * _BASE + _hash(text)) % _PRIME)
            if len(powers) < len(own):
                powers.append(powers[-1] * _BASE % _PRIME)
        if not skip:
            blocks.append((text, inner, main > 0))

    def close() -> None:
        nonlocal skip, main, inner
        tag, boiler, is_main, number, before, around, inside = stack.pop()
        open_tags[tag] -= 1
        skip -= boiler
        main -= is_main
        inner = around
        if number >= 0:
            own = sums[inside]
            n = len(own) - 1 - before
            if n:
                hashes[number] = _hash(f"{'main ' * inside}{tag} {n} {(own[-1] - own[before] * powers[n]) % _PRIME}")

    def enter(tag: str, boiler: bool, is_main: bool, hashed: bool) -> None:
        nonlocal skip, main, inner
        stack.append((tag, boiler, is_main, len(hashes) if hashed else -1, len(sums[main > 0]) - 1, inner, main > 0))
        open_tags[tag] += 1
        if is_main and not main:
            inner = -1
        if hashed:
            parents.append(inner)
            inner = len(hashes)
            hashes.append(0)
            insides.append(main > 0)
        skip += boiler
        main += is_main

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        stop = match.start() if match else end
        if stop > at:
            buffer.append(unescape(page[at:stop]))
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        tag, block = match[2].lower(), match[2].lower() in BLOCK
        if tag == "br":
            buffer.append(" ")
        if block:
            flush()
        if match[1]:
            if open_tags[tag]:
                if not block:
                    if stack[-1][0] == tag:
                        close()
                    continue
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag in VOID or match[3].endswith("/"):
            continue
        if block:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ()) or (stack[-1][0] not in BLOCK and open_tags["p"])):
                close()
            boiler = _boilerplate(tag, match[3], main > 0)
            is_main = not boiler and not skip and (tag in MAIN or re.search(r"\brole\s*=\s*[\"']?main\b", match[3]) is not None)
            enter(tag, boiler, is_main, not is_main and tag not in ("html", "body"))
        else:
            boiler = _boilerplate(tag, match[3], main > 0)
            if boiler:
                flush()
            enter(tag, boiler, False, False)
    flush()
    while stack:
        close()
    marked = any(b[2] for b in blocks)
    return [(t, number) for t, number, in_main in blocks if in_main or not marked], parents, hashes, insides


def _around(blocks: list[tuple[str, int]], parents: list[int]) -> list[bool]:
    """Of each element whether a block that may be main text stands in it."""
    found = [False] * len(parents)
    for _, number in blocks:
        while number >= 0 and not found[number]:
            found[number] = True
            number = parents[number]
    return found


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [_parse(h) for h in frame["html"]]
        yield frame.drop(columns="html").assign(
            texts=[[t for t, _ in blocks] for blocks, *_ in found],
            inner=[[i for _, i in blocks] for blocks, *_ in found],
            parents=[p for _, p, _, _ in found],
            hashes=[h for _, _, h, _ in found],
            insides=[i for *_, i in found],
            holds=[_around(blocks, p) for blocks, p, _, _ in found],
        )


def _without_template(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks that stand in no element of the template, however far up it is. Parents come before their children.

    Main content of which the template holds half or more is a copy of other pages' and stays whole.
    """
    for frame in frames:
        texts = []
        for page in frame.itertuples():
            template, gone, insides = set(page.struck.tolist()), [], page.insides.tolist()
            for parent, h in zip(page.parents.tolist(), page.hashes.tolist()):
                gone.append(h in template or (parent >= 0 and gone[parent]))
            stay = [i < 0 or not gone[i] for i in page.inner.tolist()]
            main = any(g and inside for g, inside in zip(gone, insides))
            if main and 2 * sum(len(t) for t, s in zip(page.texts, stay) if s) <= sum(map(len, page.texts)):
                stay = [True] * len(stay)
            texts.append([t for t, s in zip(page.texts, stay) if s])
        yield frame[["page_id", "url"]].assign(texts=texts)


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Counts per host and subtree are summed before they are shuffled. A subtree found on a third of
    all pages is a large key only in the join that marks pages, which Spark can split, as neither
    side is fixed to a partitioning. Only texts of pages that may lose a block are shuffled.
    """
    host, _ = url_parts(F.col("url").cast("string"))
    given = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"),
        host.alias("host"), text_of("html").alias("html"),
    )
    parsed = kept(
        given.mapInPandas(
            _parsed,
            "row long, page_id string, url string, host string, texts array<string>, inner array<int>, parents array<int>, hashes array<long>, insides array<boolean>, holds array<boolean>",
        ),
        "parsed",
    )
    each = parsed.select("row", "host", F.explode(F.array_distinct(F.arrays_zip("hashes", "insides"))).alias("e")).where("e.hashes <> 0")
    counts = each.groupBy("host", F.col("e.hashes").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.first("e.insides").alias("inside")).where(F.col("n") >= least_pages)
    hosts = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = F.col("n") >= F.col("pages") * F.when(F.col("inside"), inside_share).otherwise(least_share)
    template = kept(counts.join(hosts, "host").where(often).select("host", "hash"), "template")
    # Only a page with a block inside a subtree of the template loses one.
    holding = F.filter("hashes", lambda h, i: F.get("holds", i) & (h != 0))
    held = parsed.select("row", "host", F.explode(F.array_distinct(holding)).alias("hash"))
    struck = kept(held.join(template, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("struck")), "struck")
    mark = F.xxhash64("row")
    shared = pages.sparkSession.sparkContext.broadcast(bit_filter(struck.select(mark.alias("mark")), "mark"))

    @F.pandas_udf("boolean")
    def maybe(slot: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, slot.to_numpy(np.int64)))

    rows = parsed.withColumn("maybe", maybe(slot_of(mark)))
    joined = rows.where("maybe").join(struck, "row", "left").withColumn("struck", F.coalesce("struck", F.array().cast("array<bigint>")))
    left = joined.select("page_id", "url", "texts", "inner", "parents", "hashes", "insides", "struck").mapInPandas(
        _without_template, "page_id string, url string, texts array<string>"
    )
    whole = left.unionByName(rows.where("NOT maybe").select("page_id", "url", "texts"))
    return whole.select(F.col("page_id").cast("long").alias("page_id"), "url", F.array_join("texts", "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


#: For pages whose main content is an article of headings and paragraphs, with the named references only.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(body, '</?(p|h1)>')) AS part, generate_subscripts(string_split_regex(body, '</?(p|h1)>'), 1) AS nr FROM a),
c AS (SELECT page_id, url, nr, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        part, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;', chr(39)),
        '&amp;?', '&', 'g') AS part FROM b),
d AS (SELECT page_id, url, nr, trim(regexp_replace(part, '\s+', ' ', 'g')) AS part FROM c)
SELECT page_id, url, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY nr) FILTER (part <> ''), '') AS text,
       length(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY nr) FILTER (part <> ''), '')) AS n_chars
FROM d GROUP BY page_id, url
"""
