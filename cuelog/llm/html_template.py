"""Main text of web pages: templates deduced from tokens that share occurrence vectors across a host's pages."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import append_columns, cut_lineage, schema_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>|<(script|style|noscript|template|textarea|title|iframe|svg|math)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
#: Tags that do not end a block of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open paragraph ends before these, and before another block.
_CLOSED_BY_ITSELF = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of a page that are not its article.
_OTHER_TAGS = frozenset("head nav footer aside form button select option menu dialog object embed audio video canvas map fieldset".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_OTHER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adbox adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
                         "footer sidebar widget related recommended share sharing social cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login "
                         "comment comments commentlist reply replies respond disqus discussion pagination pager toolbar search skip masthead".split())
#: Names of articles beside or inside the page's own.
_OTHER_ARTICLES = _OTHER_NAMES | frozenset("teaser teasers card cards".split())
_NOT_OTHER = frozenset("has with no without content main article layout wrapper container".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a layout is made of.
_CONTAINER = re.compile(r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>|<(script|style|noscript|template|textarea|title|iframe|svg|math)\b.*?(?:</\1\s*>|\Z)"
                        r"|<(/?)(body|div|section|main|article|nav|aside|header|footer|form|dialog)(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
_LAYOUT_DEPTH = 3


@dataclass
class Block:
    """A run of text without a block tag inside."""
    path: int                 # hash of the open elements
    above: tuple[int, ...]    # hashes of all paths above, outermost first
    text: str
    linked: int               # characters inside links
    article: bool
    main: bool
    heading: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tags: dict[int, int] = field(default_factory=lambda: defaultdict(int))  # path -> times opened
    depth: dict[int, int] = field(default_factory=dict)
    rank: dict[int, int] = field(default_factory=dict)  # path -> 2: an outermost article, 1: main, 0: others
    headings: set[int] = field(default_factory=set)

    def contents(self) -> dict[int, tuple[int, int]]:
        """path -> (hash of all text inside its elements, characters), for paths with text that are no headings."""
        chains: dict[int, list] = {}
        for block in self.blocks:
            said = xxhash.xxh64_intdigest(block.text)
            for path in set(block.above):
                chain = chains.setdefault(path, [path, 0])
                chain.append(said)
                chain[1] += len(block.text)
        return {path: (_hash(path, *chain[2:]), chain[1]) for path, chain in chains.items() if path not in self.headings}


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) >> 1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _names(attributes: dict[str, str]) -> set[str]:
    joined = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return set(re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", joined).lower()))


def _path(above: int, tag: str, attributes: dict[str, str]) -> int:
    """An element with all it stands in; long numbers in a class are a page's own."""
    return _hash(above, tag, re.sub("[0-9]{3,}", "#", attributes.get("class", "")), re.sub("[0-9]+", "#", attributes.get("id", "")))


def _is_other(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds something else than the article."""
    if tag in _OTHER_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or attributes.get("role", "").lower() in _OTHER_ROLES:
        return True
    if tag == "article":  # tag-... and category-... name what it is about
        names = _names(attributes | {"class": re.sub(r"(?<!\S)(?:tag|category)-\S+", "", attributes.get("class", ""))})
        return bool(names & _OTHER_ARTICLES) and not names & (_NOT_OTHER - {"article"})
    names = _names(attributes)
    return bool(names & _OTHER_NAMES) and not names & _NOT_OTHER or ("header" in names and not in_article and not names & _NOT_OTHER)


def layout_of(source: str | None) -> int:
    """Hash of a page's outer containers, without those of menus, notices and the like, which come and go, and without what articles hold."""
    stack: list[tuple[str, int, bool]] = []  # tag, path, closed to the layout
    seen: set[int] = set()
    for m in _CONTAINER.finditer(source or ""):
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if (m[4] or "").endswith("/"):
            continue
        _, above, closed = stack[-1] if stack else ("", 0, False)
        attributes = _attributes(m[4])
        path = _path(above, tag, attributes)
        closed = closed or len(stack) > _LAYOUT_DEPTH or _is_other(tag, attributes, False)
        if not closed:
            seen.add(path)
        stack.append((tag, path, closed or tag == "article"))
    return _hash("layout", *sorted(seen))


def read_page(source: str | None, trusted: bool = False) -> Page:
    """The blocks of a page's text outside menus, notices and the like, and its tags by path.

    An ``article`` named as a comment, a teaser and so on is not the page's own, unless the
    page has no other (or they are ``trusted``).
    """
    page = Page()
    doubted = False
    stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, path, other, article, main
    text: list[str] = []
    linked = links = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole and not (stack and stack[-1][2]):
                above = tuple(e[1] for e in stack)
                page.blocks.append(Block(above[-1] if above else 0, above, whole, linked, bool(stack) and stack[-1][3], bool(stack) and stack[-1][4], bool(stack) and stack[-1][0] in _HEADINGS))
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(source or ""):
        token, tag = m[0], m[3]
        if tag is None:
            if token[0] != "<":
                text.append(token)
                if links:
                    linked += len(token)
            elif token == "<":
                text.append(token)
            continue
        tag = tag.lower()
        if not m[5]:
            continue  # the page ends inside a tag
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if m[2] else 1))
            continue
        end_block()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] in _CLOSED_BY_ITSELF.get(tag, ())):
            stack.pop()
        links = 0
        attributes = _attributes(m[4])
        _, above, other, article, main = stack[-1] if stack else ("", 0, False, False, False)
        path = _path(above, tag, attributes)
        page.tags[path] += 1
        page.depth[path] = len(stack)
        if tag in _HEADINGS:
            page.headings.add(path)
        if tag not in _VOID and not (m[4] or "").endswith("/"):
            outermost = tag == "article" and not article
            inmain = tag == "main" or attributes.get("role", "").lower() == "main"
            page.rank[path] = 2 if outermost else int(inmain)
            article = article or tag == "article" or "articlebody" in attributes.get("class", "").lower()
            aside = _is_other(tag, attributes, article)
            doubted = doubted or (outermost and aside and not other)
            stack.append((tag, path, other or (aside and not (trusted and outermost)), article, main or inmain))
    end_block()
    if doubted and not trusted and not any(b.article for b in page.blocks):
        return read_page(source, True)
    return page


STATS = "host string, layout long, kind string, token long, path long, depth int, rank int, pages long, times long, vector_a long, vector_b long, chars long"
#: The layout that stands for all pages of a host.
_WHOLE_HOST = 0


def _count(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Partial sums of the tokens of every host, and of every layout of it, over a batch of pages."""
    for batch in batches:
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
        for ident, host, layout, source in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page", "host", "layout", "html")), strict=True):
            page = read_page(source)
            contents = page.contents()
            rows = [("tag", path, path, page.depth[path], page.rank.get(path, 0), times, contents.get(path, (0, 0))[1]) for path, times in page.tags.items()]
            rows += [("text", token, path, 0, 0, page.tags[path], size) for path, (token, size) in contents.items()]
            rows.append(("page", 0, 0, 0, 0, 1, sum(len(b.text) for b in page.blocks)))
            for *key, times, size in rows:
                part = _hash(ident, times)
                for of in (layout, _WHOLE_HOST):
                    total = sums[host, of, *key]
                    for k, value in enumerate((1, times, part & 0x7FFFFFFF, (part >> 31) & 0x7FFFFFFF, size)):
                        total[k] += value
        if sums:
            columns = list(zip(*((*key, *values) for key, values in sums.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)


def deduce_templates(pages: DataFrame, least_pages: int = 4, share: float = 0.6) -> DataFrame:
    """(host, layout, root, said): a template for every layout, and every host (layout 0), with ``least_pages`` pages.

    ``pages``: ``page``, ``host``, ``layout``, ``html``.  Tokens are tags with the path of
    elements that they stand in, and the whole text of the elements of one path.  A token's
    occurrence vector, times on every page, is kept as sums of hashes of (page, times), so
    tokens with equal sums form an equivalence class, and no host's pages need to meet.  A class
    is valid if it is on a ``share`` of the pages and has a tag among its tokens.  Valid
    classes nest into the template, and tags that are once on each of their pages and hold nearly
    all text are its candidate slots: the ``root`` is the outermost ``article`` among them, else
    ``main``, else the inmost.  Elements whose text shares the class of their own tag say
    the same wherever they stand (``said``); that is the template's text.  If one of them holds more
    than half of all text, the pages are copies rather than a template's, and nothing is taken for said.
    """
    schema = schema_of(STATS)
    arrow = to_arrow_schema(schema)
    place = ["host", "layout"]
    counted = pages.mapInArrow(lambda batches: _count(batches, arrow), schema).groupBy(*place, "kind", "token", "path", "depth").agg(
        *[F.sum(c).alias(c) for c in ("pages", "times", "vector_a", "vector_b", "chars")], F.max("rank").alias("rank"))
    counted = cut_lineage(counted.filter(F.col("pages") >= least_pages))
    sizes = counted.filter("kind = 'page'").select(*place, F.col("pages").alias("_pages"), F.col("chars").alias("_chars"))
    frequent = counted.filter("kind <> 'page'").join(sizes, place).filter(F.col("pages") >= share * F.col("_pages"))
    tag = F.col("kind") == "tag"
    classes = frequent.groupBy(*place, "vector_a", "vector_b", "pages", "times").agg(
        F.first("_chars").alias("_chars"), F.collect_set(F.when(tag, F.col("token"))).alias("tags"),
        F.max(F.when(tag & (F.col("times") == F.col("pages")) & (F.col("chars") >= 0.8 * F.col("_chars")), F.struct("rank", "depth", "token"))).alias("root"),
        F.collect_list(F.when(~tag, F.struct("path", "token", "chars"))).alias("texts"))
    valid = classes.filter(F.size("tags") > 0).withColumn("own", F.filter("texts", lambda t: F.array_contains("tags", t["path"])))
    none = F.array().cast("array<long>")
    return cut_lineage(valid.groupBy(*place).agg(
        F.max("root").getField("token").alias("root"),
        F.when(F.coalesce(F.max(F.array_max(F.col("own.chars"))), F.lit(0)) <= 0.5 * F.first("_chars"), F.flatten(F.collect_list("own.token"))).otherwise(none).alias("said")))


def article(page: Page, root: int | None, said: frozenset[int]) -> list[str]:
    """The article's blocks, in page order.

    The slot is what stands in ``root``, with the headings right before it; if the root is wider than
    the page's ``article`` elements, these are taken of it.  Pages without the root, or without
    a template, go by their tags alone.
    """
    own = {path for path, (token, _) in page.contents().items() if token in said} if said else set()
    free = [b for b in page.blocks if own.isdisjoint(b.above)]
    slot = [k for k, b in enumerate(free) if root in b.above]
    if slot:
        inside = [free[k].text for k in slot if free[k].article]
        if inside:
            return inside
        first = slot[0]
        while first and free[first - 1].heading:
            first -= 1
        return [b.text for b in free[first:slot[0]]] + [free[k].text for k in slot]
    for inside in (lambda b: b.article, lambda b: b.main):
        texts = [b.text for b in free if inside(b)]
        if texts:
            return texts
    return [b.text for b in free if b.linked <= 0.6 * len(b.text)]


def extract_text(pages: DataFrame, **deduction) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    The text of the article alone: what stands in the slot that the template of the page's
    layout has for it, without the text of the template's own elements inside, and without menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments.  A page whose
    layout is on too few pages goes by the template of its whole host; where that has too few pages
    too, or the page lacks the slot, the slot is the ``article`` element, else ``main``, else the page
    without link lists.  A sentence that stands among an article's other paragraphs stays however often
    it is repeated; an element of its own that says the same on all pages that have it goes, unless it is a heading.
    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by two line feeds.  Null html, a cut-off page or broken tags are read as far as
    they go; a null url is a host of its own.  Repeated pages count once for each row.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    base = pages.select("page_id", "url", "html", host.alias("host"))

    def layouts():
        return lambda batch: [[layout_of(source) for source in batch.column(batch.schema.get_field_index("html")).to_pylist()]]

    base = append_columns(base, layouts, "layout long")
    templates = deduce_templates(base.select(F.xxhash64("page_id", "url").alias("page"), "host", "layout", "html"), **deduction)
    whole = templates.filter(F.col("layout") == _WHOLE_HOST).select("host", F.col("root").alias("host_root"), F.col("said").alias("host_said"), F.lit(True).alias("host_known"))
    joined = base.join(templates.withColumn("known", F.lit(True)), ["host", "layout"], "left").join(whole, "host", "left")
    chosen = [F.when(F.col("known"), F.col(c)).otherwise(F.col(f"host_{c}")).alias(c) for c in ("root", "said")]

    def make():
        def work(batch):
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            known: dict[tuple, frozenset[int]] = {}
            out = []
            for place, layout, source, root, said in zip(*map(column, ("host", "layout", "html", "root", "said")), strict=True):
                if (place, layout) not in known:
                    known[place, layout] = frozenset(said or ())
                out.append("\n\n".join(article(read_page(source), root, known[place, layout])))
            return [out, [len(t) for t in out]]
        return work

    return append_columns(joined.select("page_id", "url", "html", "host", "layout", *chosen), make, "text string, n_chars long").select("page_id", "url", "text", "n_chars")
