"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: an element's place is the path of its tags and classes,
its presentation the sequence of its children. A presentation node's importance is the entropy of its
presentations over the host's pages, a content node's is one minus the entropy with which its texts
spread over the pages: what all pages share is of no importance. A branch's composite importance is the
mean over its texts, with a share of its own presentation. What markup itself says of an element, that it
is a menu, an advert or a form, is a prior that its importance is multiplied by; branches whose product is
low are removed from each page, inside articles as well as outside.

Entropies are sums over (host, place, text), so the trees of all hosts are built by grouped sums that
no large host overloads; trees as such are never put together in one task. Copies of one page count as
one. With few pages a host tells little, so an importance is drawn towards 1 the more, the fewer there are.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Importance times prior below which a branch goes.
LEAST_IMPORTANCE = 0.3
#: What markup says: named as no main text; perhaps so (gone if the host's pages agree); nothing.
NAMED, DOUBTED, PLAIN = 0.25, 0.5, 1.0
#: Share of a branch's composite importance that its own presentations make up.
OWN_SHARE = 0.1
#: An importance of 1 counts as much as so many pages.
PRIOR_PAGES = 1.5
#: Elements deeper than this have the place of the element of this depth above them.
MOST_DEPTH = 64
#: Places of low importance that are broadcast at most; beyond, they are joined by host.
BROADCAST_PLACES = 50_000

# Fixed values of HTML: void elements, elements with raw content, block elements, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes xmp title textarea canvas".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option dd dt li".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table select html body".split())

# Elements, roles and words of class or id that name what isn't main text.
BOILER_TAGS = frozenset("head nav footer aside form button select dialog menu".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr notice"
    " popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer"
    " comment comments disqus reply replies respond login signin signup search pagination pager toolbar skip".split()
)
DOUBTED_WORDS = frozenset("promotion widget widgets share sharing social related recommended".split())
OUTSIDE_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: Words before what an element has or lacks, which doesn't say what it is: has-sidebar, no-comments.
ABOUT = frozenset("has no with without".split())
#: Around an article, these stay what they are; other elements are wrappers.
NO_WRAPPERS = frozenset("nav footer aside head dialog menu".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[>\"']")
#: One attribute after another, each with its whole value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
READ = frozenset("class id role hidden aria-hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("tag", "parent", "place", "depth", "prior", "comments", "inside", "children", "gone")

    def __init__(self, tag: str, key: str, parent: Element | None, prior: float, comments: bool, inside: bool):
        self.tag, self.parent, self.prior, self.comments, self.inside = tag, parent, prior, comments, inside
        self.children: list[str] = []
        self.gone: bool | None = None
        self.depth = parent.depth + 1 if parent else 0
        if self.depth > MOST_DEPTH:
            self.place = parent.place
        else:
            self.place = hashed(key, parent.place if parent else 0)
            if parent:
                parent.children.append(key)


_PLACES: dict[tuple[str, int], int] = {}


def hashed(value: str, seed: int = 0) -> int:
    """A signed 64-bit hash that is the same in every process."""
    known = _PLACES.get((value, seed)) if len(value) < 80 else None
    if known is None:
        known = int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
        if len(value) < 80:
            if len(_PLACES) > 100_000:
                _PLACES.clear()
            _PLACES[value, seed] = known
    return known


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def named_words(value: str, most: int = 99) -> set[str]:
    """Words of a class or id, without what an element is said to have or to lack, and without those of names of more than
    `most` words, which say what a text is about."""
    out: set[str] = set()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if len(words) > most:
            continue
        out.update(w for before, w in zip(["", *words], words) if before not in ABOUT)
    return out


def described(tag: str, attributes: str, inside: bool) -> tuple[str, float, bool]:
    """(key, prior, whether it holds reader comments) by what markup says; inside: within an article or main, where an id
    counts if it is one word, a class if it is two at most, and the id of a heading, which is a link's target, not at all."""
    prior = NAMED if tag in BOILER_TAGS or tag == "header" and not inside else DOUBTED if tag == "noscript" else PLAIN
    if not attributes or attributes.isspace():
        return tag, prior, False
    key, comments = tag, False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in READ:
            continue
        value = value.strip("\"'").lower()
        if name == "class" or name == "id":
            value = re.sub(r"\d+", "0", value)
            key += f".{value}" if name == "class" else f"#{value}"
            words = named_words(value, 99 if not inside else 2 if name == "class" else 0 if tag in HEADINGS else 1)
            if tag not in ("html", "body", "article", "main"):
                comments = comments or bool(words & COMMENT_WORDS)
                if words & BOILER_WORDS or not inside and words & OUTSIDE_WORDS:
                    prior = NAMED
                elif words & DOUBTED_WORDS:
                    prior = min(prior, DOUBTED)
        elif name == "role":
            prior = NAMED if value in BOILER_ROLES else prior
        elif (name == "hidden" or value == "true") and tag not in ("html", "body"):
            prior = NAMED
    return key, prior, comments


def tag_end(page: str, at: int, dead: set[str]) -> int:
    """The end of a tag whose name ends at `at`, beyond quoted values; dead: quotes that the page holds no more of."""
    first = at
    while True:
        m = QUOTE_OR_END.search(page, at)
        if m is None:
            return page.find(">", first)
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while before > first and page[before].isspace():
            before -= 1
        at = m.end()
        if page[before] == "=" and m[0] not in dead:
            end = page.find(m[0], at)
            if end < 0:
                dead.add(m[0])
            else:
                at = end + 1


def parsed(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """(elements, (the block's element, its text) in page order); text of raw elements is left out.

    The time is linear in the page's length, however deep its elements and whatever is left open.
    """
    root = Element("html", "html", None, PLAIN, False, False)
    stack, elements, out, pieces = [root], [root], [], []
    where: dict[str, list[int]] = {"html": [0]}  # places of open elements on the stack, by tag
    scopes = [0]
    owner, main_seen, dead = root, set(), set()

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((owner, text))
            pieces.clear()

    def pop_to(depth: int) -> None:
        if any(e.tag in BLOCK or e.prior < PLAIN for e in stack[depth:]):
            close()
        for e in reversed(stack[depth:]):
            where[e.tag].pop()
            if e.tag in SCOPES:
                scopes.pop()
        del stack[depth:]

    def push(element: Element) -> None:
        where.setdefault(element.tag, []).append(len(stack))
        if element.tag in SCOPES:
            scopes.append(len(stack))
        stack.append(element)

    def write(text: str) -> None:
        nonlocal owner
        if text:
            if not pieces:
                owner = stack[-1]
            pieces.append(text)

    at, end, last_end = 0, len(page), page.rfind(">")
    while at < end:
        i = page.find("<", at)
        if i < 0:
            write(page[at:])
            break
        write(page[at:i])
        if page.startswith(("<!", "<?"), i):
            opening, ending = ("<!--", "-->") if page.startswith("<!--", i) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", i) else ("<!", ">")
            stop = page.find(ending, i + len(opening))
            at = end if stop < 0 else stop + len(ending)
            continue
        if i > last_end:  # no tag ends any more
            write(page[i:])
            break
        m = NAME.match(page, i)
        if m is None:
            write("<")
            at = i + 1
            continue
        stop = tag_end(page, m.end(), dead)
        tag, attributes, at = m[1].lower(), page[m.end():stop], stop + 1
        if page[i + 1] == "/":
            open_ = where.get(tag)
            if not open_ or open_[-1] == 0:
                if tag in BLOCK:
                    close()
            elif tag not in SAME_ENDS or scopes[-1] < open_[-1]:
                pop_to(open_[-1])
            continue
        if tag == "br":
            write("\n")
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                stop = page.find(">", found.end()) if found else -1
                at = end if stop < 0 else stop + 1
            continue
        if tag in ("html", "body"):
            close()
            if tag == "body" and stack[-1].tag == "head":
                pop_to(len(stack) - 1)
            if tag == "body" and not where.get("body"):
                push(Element(tag, tag, stack[-1], PLAIN, False, False))
                elements.append(stack[-1])
            continue
        if tag in BLOCK or tag == "head":
            close()
        if tag in ENDS_P and where.get("p"):
            pop_to(where["p"][-1])
        if tag in SAME_ENDS:
            same = max((where[t][-1] for t in SAME_ENDS[tag] if where.get(t)), default=-1)
            if same > scopes[-1]:
                pop_to(same)
        if tag in VOID:
            continue
        above = stack[-1]
        key, prior, comments = described(tag, attributes, above.inside)
        if prior < PLAIN:
            close()
        element = Element(tag, key, above, prior, comments or above.comments, above.inside or tag in ("article", "main"))
        elements.append(element)
        if tag in ("article", "main") and tag not in main_seen and not above.comments:
            main_seen.add(tag)  # the first one: what it stands in is a wrapper
            while above is not None and above.tag not in NO_WRAPPERS:
                above.prior, above = PLAIN, above.parent
        if not attributes.endswith("/") or tag in BLOCK:
            push(element)
    close()
    return elements, out


def blocks(page: str) -> list[tuple[Element, str]]:
    return parsed(page)[1]


def is_gone(element: Element, low: dict[int, float]) -> bool:
    """Whether the element or one around it is of too low importance."""
    open_, e = [], element
    while e is not None and e.gone is None:
        open_.append(e)
        e = e.parent
    gone = e.gone if e is not None else False
    for e in reversed(open_):
        gone = e.gone = gone or e.prior * low.get(e.place, 1.0) < LEAST_IMPORTANCE
    return gone


def main_text(page: str, low: dict[int, float]) -> str:
    """Blocks in page order, without those in branches whose importance times prior is low.

    low: importances by place, where they aren't high. If nothing would be left, markup alone decides:
    near copies of one page make up some hosts.
    """
    elements, found = parsed(page)
    main = [t for e, t in found if not is_gone(e, low)]
    if not main and low:
        for e in elements:
            e.gone = None
        main = [t for e, t in found if not is_gone(e, {})]
    return "\n".join(main)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html, copies) -> rows (host, place, kind, value, n, s, chain): sums over the pages of a batch, in
    which a page with copies counts for its part.

    kind 0: pages that hold the place. kind 1: value is a hashed text of the place; n its occurrences, s
    the sum of c ln c over pages with c occurrences. kind 2: value is a hashed presentation; n pages.
    chain: the places from a text's up to the root.
    """
    for batch in batches:
        sums: dict[tuple, list] = defaultdict(lambda: [0.0, 0.0])
        chains: dict[int, list[int]] = {}
        for url, page, copies in zip(*(c.to_pylist() for c in batch.columns)):
            host, weight, texts, shapes = host_of(url), 1 / (copies or 1), Counter(), {}
            elements, found = parsed(page or "")
            for e in elements:
                if e.depth <= MOST_DEPTH:
                    shapes.setdefault(e.place, e)
            for e, text in found:
                texts[e.place, hashed(text)] += 1
                if e.place not in chains:
                    up, chain = shapes[e.place], []
                    while up is not None:
                        chain.append(up.place)
                        up = up.parent
                    chains[e.place] = chain
            for place, e in shapes.items():
                sums[host, place, 0, 0][0] += weight
                sums[host, place, 2, hashed(" ".join(dict.fromkeys(e.children)))][0] += weight
            for (place, text), c in texts.items():
                s = sums[host, place, 1, text]
                s[0] += weight * c
                s[1] += weight * c * math.log(c)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()),
            pa.array([k[3] for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.float64()), pa.array([sums[k][1] for k in keys], pa.float64()),
            pa.array([chains.get(k[1]) if k[2] == 0 else None for k in keys], pa.list_(pa.int64())),
        ], ["host", "place", "kind", "value", "n", "s", "chain"])


def host_column(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), HOST.pattern, 1)), F.lit(""))


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, place, importance): composite importances in the style tree of each host."""
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_column(url_col).alias("h"), F.xxhash64(html_col).alias("x"))
    copies = rows.groupBy("h", "x").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    weighed = rows.join(copies, ["h", "x"], "left").select("url", "html", "copies")
    counted = weighed.mapInArrow(_counts, "host string, place long, kind int, value long, n double, s double, chain array<long>")
    values = cut(counted.groupBy("host", "place", "kind", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.first("chain", ignorenulls=True).alias("chain")))

    def of(kind: int, x: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, x))

    places = values.groupBy("host", "place").agg(
        of(0, F.col("n")).alias("pages"), F.coalesce(of(1, F.col("n")), F.lit(0.0)).alias("texts"),
        of(1, F.col("n") * (F.log("n") - F.col("s") / F.col("n"))).alias("spread"),
        of(2, F.col("n") * F.log("n")).alias("shapes"), F.first("chain", ignorenulls=True).alias("chain"),
    )
    log_m = F.log("pages")
    many = F.col("pages") > 1
    content = F.when(many & (F.col("texts") > 0), F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("texts") / log_m)).otherwise(1.0)
    shape = F.when(many, F.greatest(F.lit(0.0), (log_m - F.col("shapes") / F.col("pages")) / log_m)).otherwise(1.0)
    scored = places.select("host", "place", "pages", "texts", content.alias("content"), shape.alias("shape"), "chain")
    own = F.struct(F.col("place"), F.col("shape"), F.col("pages"), F.lit(0.0).alias("texts"), F.lit(0.0).alias("content"))
    none = F.lit(None).cast("double")
    up = F.transform(F.coalesce("chain", F.array().cast("array<long>")), lambda p: F.struct(
        p.alias("place"), none.alias("shape"), none.alias("pages"), F.col("texts").alias("texts"), (F.col("content") * F.col("texts")).alias("content")))
    branches = scored.select("host", F.explode(F.concat(F.array(own), up)).alias("b")).groupBy("host", F.col("b.place").alias("place")).agg(
        F.max("b.shape").alias("shape"), F.max("b.pages").alias("pages"), F.sum("b.texts").alias("texts"), F.sum("b.content").alias("content"))
    found = OWN_SHARE * F.col("shape") + (1 - OWN_SHARE) * F.col("content") / F.col("texts")
    others = F.greatest(F.col("pages") - 1, F.lit(0.0))
    drawn = (found * others + PRIOR_PAGES) / (others + PRIOR_PAGES)
    return branches.where("texts > 0").select("host", "place", drawn.alias("importance"))


def low_places(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, place, importance): branches that go if markup says the least against them."""
    return importances(pages, url_col, html_col).where(F.col("importance") * DOUBTED < LEAST_IMPORTANCE)


def _texts(low: dict[str, dict[int, float]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages = (c.to_pylist() for c in batch.columns[1:3])
            lows = [low.get(host_of(u), {}) for u in urls] if low is not None else [dict(x or ()) for x in batch.column(3).to_pylist()]
            texts = [main_text(p or "", x) for p, x in zip(pages, lows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages, from the whole html.

    Defined results: null and empty html give an empty text; pages without a host, or with a null url, form
    one site of their own; pages of any length and depth are read whole; copies of a page on one host count
    as one page in its tree, and each has its row; an empty table gives an empty one; other columns are ignored.
    """
    low = cut(low_places(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"
    if low.count() <= broadcast_places:
        found: dict[str, dict] = defaultdict(dict)
        for r in low.collect():
            found[r.host][r.place] = r.importance
        return rows.mapInArrow(_texts(dict(found)), kind)
    by_host = low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("place", "importance"))).alias("low"))
    joined = rows.withColumn("host", host_column("url")).join(by_host, "host", "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(_texts(None), kind)
