"""HTML extraction by template deduction over equivalence classes.

Pages are read as sequences of tokens: the tag path of every text block, and the block itself. Within a host, tokens
whose occurrence vectors over its pages are equal form an equivalence class (Arasu and Garcia-Molina 2003). A vector
is held as the sum over distinct page contents of hash(page) * count, so classes come from one aggregate and a host
may hold any share of the pages; copies of one page count once. A class is valid if it occurs in at least ``share`` of
the host's distinct contents and in at least ``least`` of them, and has at least ``members`` tokens. The root of the
template is made of the widest valid class that stands once on a page: the most of its tokens that keep one order on all
pages. A text token of a valid class nests in the template if it stands in one gap of the root, the same on all pages.
Nested text tokens are the template's fixed parts, all other blocks fill its slots.

Where a page's own markup names its slot, that slot is taken as it is and the template has no say in it: a passage that
articles share is content. Other pages get the slots of the template. What is extracted: blocks under ``article``
(else ``main``, else any slot of the template), never those under
navigation, header, footer, aside, form, script or style elements, or under elements whose class or id names
as a whole a menu, sidebar, notice, advert or reader comment. An ``article`` or ``main`` in such an element, outside any other
article, is taken if the page has none elsewhere, unless it is hidden. Text inside an ``article`` or ``main`` element is content
even if pages share it. Character references are decoded, white space inside a block becomes one space, blocks are
joined by one space. Null html: empty text. Null or malformed urls form a host of their own. Repeated rows are extracted
each; extra columns are ignored. Unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "math"}
_VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
_DROP_WORDS = set("ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr nav navbar navigation menu sidebar side footer header masthead breadcrumb breadcrumbs comment comments commentlist commentform commenter reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip".split())
#: Words that say where a dropped part stands or what holds it: 'site-header' and 'cookie-bar' are dropped, 'has-sidebar' and 'related-work' are not.
_PLACE_WORDS = set("site page global top bottom left right inner outer upper lower primary secondary main wrap wrapper box bar container area section block list item items link links button buttons menus content text title body form panel slot unit zone icon icons to x y z a b c".split())
#: A class name that ends in one of these is dropped whatever stands before it, but for a word of layout.
_DROP_ENDS = set("ads advert adverts advertisement cookies gdpr navbar navigation sidebar breadcrumb breadcrumbs comments replies disqus newsletter popup pagination pager".split())
_LAYOUT_WORDS = set("has with without no is layout body page column columns col".split())
#: Areas by which a page names its own content.
_NAMED_SLOTS = ("article", "main", "inner")
#: Elements that end without an end tag where one of these begins: the tags that it closes, and the element that bounds the search.
_CELLS, _ROWS = {"td", "th"}, {"tr", "td", "th"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), (_CELLS, {"tr", "table"})),
    "tr": (_ROWS, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"} | _ROWS, {"table"})),
    "option": ({"option"}, {"select"}),
}


def _furniture(name: str) -> bool:
    """Whether a whole class name, id or role names furniture: all its parts do, or say only where it stands."""
    words = _WORDS.findall(_CAMEL.sub("-", name).lower())
    if not words or _DROP_WORDS.isdisjoint(words):
        return False
    return all(w in _DROP_WORDS or w in _PLACE_WORDS for w in words) or words[-1] in _DROP_ENDS and _LAYOUT_WORDS.isdisjoint(words)


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in _DROP:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    if _HIDDEN.search(attrs):
        return True
    return any(_furniture(name) for m in _NAMED.findall(attrs) for name in "".join(m).split())


def blocks(page: str | None) -> list[tuple[str, str, str]]:
    """(path, area, text) of each non-empty block in page order; area: article, main, inner (article or main in a dropped element), drop or "" (elsewhere)."""
    page = page or ""
    out: list[tuple[str, str, str]] = []
    #: (tag, area, inline) of open elements; inline ones only if they are left out: 1, or 2 if no end tag follows.
    stack: list[tuple[str, str, int]] = []
    lower = page.lower()
    last_end: dict[str, int] = {}
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                area = stack[-1][1] if stack else ""
                out.append((">".join(t for t, _, inline in stack if not inline), "drop" if area == "hidden" else area, text))

    def close(tags: set[str], bounds: set[str]) -> None:
        """Ends the outermost of ``tags`` that is open within the nearest of ``bounds``."""
        cut = len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in bounds:
                break
            if stack[i][0] in tags:
                cut = i
        del stack[cut:]

    def end_paragraph() -> None:
        i = len(stack) - 1
        while i >= 0 and stack[i][2]:
            i -= 1
        if i >= 0 and stack[i][0] == "p":
            del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        until = m.start() if m else n
        if until > at and not (stack and stack[-1][2]):
            parts.append(page[at:until])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, end, attrs = m[2].lower(), bool(m[1]), m[3] or ""
        alone = attrs.endswith("/") and not re.search(r"=\s*[^\s\"']*/$", attrs)
        if tag in _RAW:
            if not end and not alone:
                shut = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = shut.end() if shut else n
            continue
        if tag in _VOID:
            continue
        if tag in _INLINE:
            # An inline element that is left out ends at its own end tag, others of its name inside it counted.
            if end:
                if stack and stack[-1][2] and stack[-1][0] == tag:
                    stack.pop()
            elif not alone and (_unwanted(tag, attrs) or stack and stack[-1][2] and stack[-1][0] == tag):
                if tag not in last_end:
                    last_end[tag] = lower.rfind(f"</{tag}")
                stack.append((tag, "hidden" if _HIDDEN.search(attrs) or stack and stack[-1][1] == "hidden" else "drop", 1 if last_end[tag] >= at else 2))
            continue
        if tag in ("br", "hr"):
            if not (stack and stack[-1][2]):
                parts.append(" ")
            continue
        flush()
        if end:
            bounds = _CLOSES[tag][1] if tag in _CLOSES else set()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag and not stack[i][2]:
                    del stack[i:]
                    break
                if stack[i][0] in bounds:
                    break
        elif not alone:
            while stack and stack[-1][2] == 2:
                stack.pop()
            end_paragraph()
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            outer = stack[-1][1] if stack else ""
            if tag in ("article", "main"):
                swallowed = outer == "drop" and not any(a == "article" for _, a, _ in stack)
                inner = "inner" if swallowed else outer if outer in ("article", "drop", "hidden", "inner") else tag
            elif outer in ("drop", "hidden") or tag in ("html", "body") or not _unwanted(tag, attrs):
                inner = outer
            else:
                inner = "hidden" if _HIDDEN.search(attrs) else "drop"
            if outer == "drop" and tag not in ("html", "body", "article", "main") and _HIDDEN.search(attrs):
                inner = "hidden"
            stack.append((tag, inner, 0))
    flush()
    return out


def _mark(*x) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(map(str, x)).encode("utf-8", "surrogatepass")) - 2**63


def _content(page: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The blocks of the innermost kind of content area that the page has."""
    for kind in ("article", "main", "inner", ""):
        some = [b for b in page if b[1] == kind]
        if some:
            return some
    return []


def _before(orders):
    """One row: the tokens, sorted, and for each two of them whether the one stands before the other in all ``orders``."""
    import pandas as pd

    tokens = np.sort(orders["tokens"].iloc[0])
    before = np.ones((len(tokens), len(tokens)), bool)
    for order in orders["tokens"]:
        place = np.empty(len(tokens), np.int64)
        place[np.searchsorted(tokens, order)] = np.arange(len(tokens))
        before &= place[:, None] < place[None, :]
    return pd.DataFrame({"host": [orders["host"].iloc[0]], "tokens": [tokens], "before": [np.packbits(before).tobytes()]})


def _chain(parts):
    """The longest chain of tokens that stand in one order everywhere."""
    import pandas as pd

    tokens = parts["tokens"].iloc[0]
    n = len(tokens)
    before = np.ones(n * n, bool)
    for b in parts["before"]:
        before &= np.unpackbits(np.frombuffer(b, np.uint8), count=n * n).astype(bool)
    before = before.reshape(n, n)
    length, last = np.ones(n, np.int64), np.full(n, -1)
    for i in np.argsort(before.sum(0), kind="stable"):  # who stands before others has fewer before it
        if (earlier := np.flatnonzero(before[:, i])).size:
            last[i] = earlier[length[earlier].argmax()]
            length[i] = length[last[i]] + 1
    some, i = [], int(length.argmax())
    while i >= 0:
        some.append(tokens[i])
        i = int(last[i])
    return pd.DataFrame({"host": parts["host"].iloc[0], "token": some})


def deduce(pages: DataFrame, share: float = 0.5, least: int = 4, members: int = 2) -> DataFrame:
    """(host, token): the text tokens of each host's template; at most blocks-a-page / share of them for a host."""

    def work(batches):
        import pyarrow as pa

        common.claim("html")

        for batch in batches:
            out = {k: [] for k in ("host", "page", "token", "is_text", "n", "first", "last")}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(page)
                if any(b[1] in _NAMED_SLOTS for b in found):
                    # The page's own markup names its slot: its fixed parts lie outside and count by path alone.
                    found = [b for b in found if b[1] not in _NAMED_SLOTS]
                whole = _mark(*(x for b in found for x in (b[0], b[2])), page if len(found) < 2 else "")
                seen: dict[tuple[bool, int], list[int]] = {}
                for i, (path, _, text) in enumerate(found):
                    for at, k in ((2 * i, (False, _mark(path))), (2 * i + 1, (True, _mark(path, text)))):
                        seen.setdefault(k, []).append(at)
                for (is_text, token), at in seen.items():
                    for k, x in zip(out, (host, whole, token, is_text, len(at), at[0], at[-1])):
                        out[k].append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    rows = pages.select(F.coalesce("host", F.lit("")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(work, "host string, page long, token long, is_text boolean, n int, first int, last int")
    rows = common.written(rows.groupBy("host", "page", "token", "is_text").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")), "html-tokens")
    total = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    small = lambda df, name: common.broadcast_if_small(df := common.written(df, name), df.count(), 20_000)
    vector = F.sum(F.xxhash64("page").cast("decimal(38,0)") * F.col("n"))
    tokens = rows.groupBy("host", "token", "is_text").agg(vector.alias("vector"), F.count("*").alias("pages_with"), F.max("n").alias("most")).where(F.col("pages_with") >= least)
    tokens = common.written(tokens.join(small(total, "html-totals"), "host").where(F.col("pages_with") >= share * F.col("pages")), "html-frequent")
    # Equal vectors: one class. One token alone is no class: a frequent text may be a slot's value.
    key = ["host", "vector", "pages_with"]
    classes = tokens.groupBy(*key).agg(F.count("*").alias("members"), F.max("most").alias("most")).where(F.col("members") >= members)
    classes = common.written(classes, "html-classes")
    placed = rows.join(small(tokens.join(classes.select(*key), key).select("host", "token", "is_text", "vector", "pages_with"), "html-candidates"), ["host", "token", "is_text"])
    # The root: of the widest class that stands once on a page, the most tokens that keep one order on all pages. All
    # tokens nest in it: each in one gap between the root's tokens, the same on all pages.
    root = classes.where("most = 1").groupBy("host").agg(F.max(F.struct("pages_with", "members", "vector")).alias("r")).select("host", "r.vector", "r.pages_with")
    anchors = common.written(placed.join(small(root, "html-roots"), key).select("host", "page", "token", "first"), "html-anchors")
    orders = anchors.groupBy("host", "page").agg(F.array_sort(F.collect_list(F.struct("first", "token"))).alias("o")).select("host", F.transform("o", lambda x: x.token).alias("tokens")).distinct()
    part = orders.withColumn("part", F.pmod(F.xxhash64("tokens"), F.lit(64))).groupBy("host", "part").applyInPandas(_before, "host string, tokens array<long>, before binary")
    chain = small(part.groupBy("host").applyInPandas(_chain, "host string, token long"), "html-chains")
    at = anchors.join(chain, ["host", "token"]).groupBy("host", "page").agg(F.collect_list("first").alias("at"))
    gap = lambda c: F.when(F.col("at").isNotNull(), F.size(F.filter("at", lambda p: p < F.col(c))))
    texts = placed.where("is_text").join(at, ["host", "page"], "left")
    nested = texts.groupBy("host", "token").agg(F.min(gap("first")).alias("low"), F.max(gap("last")).alias("high"))
    return nested.where("low is null or low = high").select("host", "token")


def extract(pages: DataFrame, share: float = 0.5, least: int = 4) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html)."""
    from .urlrules import parts

    host = parts(F.col("url").cast("string"))[0]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    # Pages that mark their article need no template; only the others' hosts get a list of fixed texts.
    template = common.written(deduce(rows, share, least).groupBy("host").agg(F.collect_set("token").alias("fixed")), "html-templates")
    template = common.broadcast_if_small(template, template.count(), 20_000)
    joined = rows.join(template, "host", "left").select("page_id", "url", "html", "fixed")

    def work(batches):
        import pyarrow as pa

        common.claim("html")

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for page, fixed in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    some = _content(blocks(page))
                    if fixed and some and some[0][1] == "":
                        known = set(fixed)
                        some = [b for b in some if _mark(b[0], b[2]) not in known] or some
                    texts.append(" ".join(b[2] for b in some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(work, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")


def op2_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
