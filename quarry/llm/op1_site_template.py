"""Main text of web pages by site template removal.

Pass 1 parses every page into an element tree, hashes the subtree of every
element that could be template (tag, attributes, text), and counts per host, in
Spark, under how many different parents each subtree occurs. A subtree recurs
if that number reaches a share of the host's different pages that have text. The copies of one article
under many addresses have equal parents, so the article's own paragraphs do not
recur through them; a menu sits in a different page each time and does. Of
subtrees that are mostly link text the shape alone (without text) is counted
too, as menus may change their words from page to page.

Pass 2 parses again, deletes the recurring subtrees and those whose element,
role or class says that they are no article (menus, footers, sidebars,
notices, adverts, forms, comments), and joins the text that stays. Of a form
around an article or most of the page only the inputs and labels go.
Elements and roles decide alone. Names (the whole, first or last word of a
class or id) are no more than a hint: they never mark an article, a heading or
a paragraph, and inside an article, or for an element with most of the page's
text, a named element goes only if it recurs or is mostly links as well, or is
plainly a comment list, a cookie notice or an advert.
Where a page marks its article (``main``,
``article``), only that part is text. Inside it a recurring subtree goes if it is
mostly link text or so named, and a box (a ``div``, a list, a section) also if
it stands in many different articles of the host, whatever its name: a letter
form or an advert. Articles count once however often they are copied; a box with a
quarter of an article's text is no box; paragraphs, headings and quotations that many
articles share are theirs.

Counts are combined per (host, subtree) before the shuffle, so a hot host is
spread over all its subtrees; the recurring subtrees of a host are bounded by
its subtrees per page over the share. The html itself is not shuffled unless
that table is larger than the session's broadcast threshold.

Cases: null or empty html gives an empty text; a null or hostless url is
cleaned by marks alone; tags cut off at the end of the page, unclosed and
stray tags are tolerated; very long pages are read whole; repeated rows each
give a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import query, read, stage

MIN_PAGES = 3            # production parameters: a subtree recurs under so many parents at least,
SHARE = 0.01             # and on that share of the host's pages
BOX_ARTICLES = 5         # a box in an article recurs in so many different ones at least,
BOX_SHARE = 0.05         # and in as many as that share of the host's pages
LINKS = 0.5              # mostly links: that share of its text is link text

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style noscript template head title iframe object embed svg math canvas audio video "
                    "select textarea button input datalist map".split())
NO_ARTICLE = frozenset("nav footer aside dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
            "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
SCOPE = frozenset("html body article main section table td th div aside nav header footer form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search alertdialog alert menu menubar toolbar".split())
BOXES = frozenset("center details div dl ol section table ul".split())
FORMS = frozenset("form dialog".split())        # roles of what may stand around the whole page
# Words of class and id names that mark what is no article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs "
                  "comment comments commentlist cookie cookies consent dialog discussion disqus footer gdpr masthead "
                  "menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager "
                  "paywall popup promo promoted promotion recommended related replies respond share sharing sidebar "
                  "signup skip social sponsor sponsored subscribe teaser toolbar topbar widget".split())
REPLIES = frozenset("comment comments commentlist discussion disqus replies respond related recommended teaser".split())
# Names that can be nothing else, inside an article too.
PLAIN = re.compile(r"comments|commentlist|comments?-(area|block|box|container|form|list|respond|section|thread|wrapper)|disqus(-thread)?|"
                   r"(article|page|post|reader|user|visitor)-comments?|(box|slot|unit|wrapper)-(ads?|adverts?|advertisement)|"
                   r"(cookies?|consent|gdpr)-(banner|bar|modal|notice|overlay|popup)|adsense|adsbygoogle|"
                   r"(ads?|adverts?|advertisement)(-(banner|box|container|slot|unit|wrapper))?")
NEVER_NAMED = frozenset("html body main h1 h2 h3 h4 h5 h6 p".split())
# Names that begin so tell of the article's subject: "category-social".
SUBJECT = frozenset("cat category keyword subject tag tax taxonomy term topic".split())
# After these words a name tells of the page's layout: "has-sidebar".
LAYOUT = re.compile(r"\b(has|with|without|no)[^a-z0-9]+[a-z0-9]+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(maxsize=1 << 14)                     # a host's pages repeat their names
def _name_words(names: str) -> list[list[str]]:
    out = []
    for name in names.split():
        name = _CAMEL.sub(" ", name.partition("--")[0] or name).lower()
        words = [w for w in _SPLIT.split(LAYOUT.sub(" ", name)) if w and not w.isdigit()]
        if words and words[0] not in SUBJECT:
            out.append(words)
    return out


class Element:
    __slots__ = ("tag", "attrs", "children", "text_len", "link_len", "content", "shape", "fixed", "form", "named",
                 "is_main", "has_main")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.is_main = tag in ("main", "article") or attrs.get("role") in ("main", "article") \
            or attrs.get("itemprop") == "articleBody"
        self.fixed, self.named = self._no_article(), self._named()
        self.form = tag == "form" or attrs.get("role") in FORMS
        self.has_main = 0                       # it holds an article (1) or the page's main part (2)

    @property
    def marked(self) -> bool:
        """Its element, role, state or name says that it is no article."""
        return self.fixed or self.form or self.named

    def _no_article(self) -> bool:
        """Its element, role or state says so."""
        a = self.attrs
        return self.tag in NO_TEXT or self.tag in NO_ARTICLE or "hidden" in a or a.get("aria-hidden") == "true" \
            or a.get("role") in ROLES or "display:none" in (a.get("style") or "").replace(" ", "").lower()

    def is_page_main(self) -> bool:
        return self.tag == "main" or self.attrs.get("role") == "main"

    def names(self) -> list[list[str]]:
        """The words of each of its classes and its id, without modifiers and numbers."""
        return _name_words(f"{self.attrs.get('class') or ''} {self.attrs.get('id') or ''}")

    def named_in(self, marks: frozenset[str]) -> bool:
        """A name's whole, first or last word is one of ``marks``."""
        return any(w[0] in marks or w[-1] in marks or "".join(w) in marks for w in self.names())

    def plain(self) -> bool:
        """Its name can mean nothing of the article."""
        return any(PLAIN.fullmatch("-".join(w)) for w in self.names())

    def _named(self) -> bool:
        """Its class or id says so."""
        return ("class" in self.attrs or "id" in self.attrs) and self.tag not in NEVER_NAMED and not self.is_main \
            and self.named_in(MARKS)


class TreeBuilder(HTMLParser):
    """A tolerant element tree: implied and missing end tags, stray end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]

    def _pop_to(self, tags, limits) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._pop_to(("p",), ("table", "td", "th", "button", "object"))
        if tag in SIBLINGS:
            for _ in range(len(SIBLINGS[tag])):
                self._pop_to(SIBLINGS[tag], HOLDS[tag])
        node = Element(tag, {k: v for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)        # "/>" closes nothing but void elements

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", ())
        elif tag not in VOID:
            self._pop_to((tag,), SCOPE - {tag} if tag in INLINE or tag == "p" else ())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    b = TreeBuilder()
    if html:
        cut = html.rfind("<")                   # a tag cut off at the end of the page
        if cut > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[cut:]):
            html = html[:cut]
        b.feed(html)
        b.close()
    measure(b.root)
    return b.root


def _walk(root: Element):
    """Elements children first, without recursion."""
    todo, out = [root], []
    while todo:
        e = todo.pop()
        out.append(e)
        todo.extend(c for c in e.children if type(c) is Element)
    return reversed(out)


def _hash(*parts: bytes) -> bytes:
    return blake2b(b"\0".join(parts), digest_size=8).digest()


def measure(root: Element) -> None:
    """Set text and link lengths, content hash and shape hash of all elements,
    and take the marks from wrappers of the article."""
    for e in _walk(root):
        head = f"{e.tag} {e.attrs.get('class') or ''} {e.attrs.get('id') or ''} {e.attrs.get('role') or ''}".encode()
        text = link = 0
        content, shape = [head], [head]
        for c in e.children:
            if type(c) is Element:
                text += c.text_len
                link += c.link_len
                content.append(c.content)
                if shape[-1] != c.shape:        # a run of equal shapes counts once
                    shape.append(c.shape)
            else:
                words = " ".join(c.split())
                text += len(words)
                if words:
                    content.append(words.encode("utf-8", "surrogatepass"))
        e.text_len, e.link_len = (0, 0) if e.tag in NO_TEXT else (text, text if e.tag == "a" else link)
        e.content, e.shape = _hash(b"c", *content), _hash(b"s", *shape)
    opened = _unmark(root, False)
    if not _outermost(root):
        opened |= _unmark(root, True)
    todo = [(root, False)] if opened else []
    while todo:                                 # the labels of a form go, its text stays
        e, inside = todo.pop()
        inside = inside or (e.tag == "form" or e.attrs.get("role") in FORMS) and not e.form
        for c in e.children:
            if type(c) is Element:
                c.fixed = c.fixed or inside and c.tag == "label"
                todo.append((c, inside))


def _unmark(root: Element, no_article: bool) -> bool:
    """A wrapper that is named for something beside the article, but holds a
    marked article and most of the page, is not marked itself. Where no article
    is found, neither is a smaller such wrapper, nor an element with most of
    the page's text that is not mostly links. A plain name, or one that tells
    of other articles, then stays marked if the page has text without it. A
    form is not marked if it holds a marked article or most of the page's
    text; whether one was is returned."""
    opened = False
    only = no_article and not _has_text(root)
    for e in _walk(root):
        e.has_main = max((max(c.has_main, c.is_main + c.is_page_main()) for c in e.children
                          if type(c) is Element and c.text_len and not c.marked), default=0)
        most = 2 * e.text_len >= root.text_len
        if e.form and e.text_len and (e.has_main or e.is_main or most):
            e.form, opened = False, True
        if e.named and e.text_len:
            others = e.has_main == 1 and e.named_in(REPLIES)
            if e.has_main and not others:
                e.named = not (most or no_article)
            elif no_article and most and not mostly_links(e) and (only or not (others or e.plain())):
                e.named = False
    return opened


def _has_text(root: Element) -> bool:
    """Text other than links stands outside all marked elements."""
    todo = [root]
    while todo:
        for c in todo.pop().children:
            if type(c) is not Element:
                if c.strip():
                    return True
            elif not c.marked and c.tag not in ("a", "header"):
                todo.append(c)
    return False


def mostly_links(e: Element) -> bool:
    return e.link_len >= LINKS * max(e.text_len, 1)


def _outermost(top: Element) -> list[Element]:
    """The outermost marked articles below an element, in page order."""
    found, todo = [], [c for c in reversed(top.children) if type(c) is Element]
    while todo:
        e = todo.pop()
        if e.marked:
            continue
        if e.is_main and e.text_len:
            found.append(e)
        else:
            todo.extend(c for c in reversed(e.children) if type(c) is Element)
    return found


def article_roots(root: Element) -> list[Element]:
    """The elements that hold the article: the page's main part or its one
    article, its articles, or else the whole page."""
    found = _outermost(root)
    mains = [e for e in found if e.is_page_main()]
    roots = mains[:1] or found or [root]
    while len(roots) == 1 and len(inner := _outermost(roots[0])) == 1 and roots[0] is not root:
        roots = inner
    return roots


def box_hash(e: Element, article: Element) -> bytes | None:
    """The hash by which an element is counted as a box of articles, if it may be one."""
    if e.tag in BOXES and e.text_len and 4 * e.text_len < article.text_len and not e.has_main and not e.is_main:
        return e.content[::-1]                  # apart from the hashes of subtrees
    return None


def hashes_of(root: Element) -> set[tuple[bytes, bytes, bool]]:
    """(subtree, parent, is a box) hashes of all elements that may be
    template; the parent of a box is its article."""
    roots = {id(e) for e in article_roots(root) if e is not root}
    out, todo = set(), [(root, None)]
    while todo:
        e, inside = todo.pop()
        if inside is None and id(e) in roots:
            inside = e
        for c in e.children:
            if inside is not None and type(c) is Element and (box := box_hash(c, inside)):
                out.add((box, inside.content, True))
            if type(c) is Element and c.text_len and id(c) not in roots:
                links = mostly_links(c)
                if inside is None or links or c.named:
                    out.add((c.content, e.content, False))
                if links and c.tag not in INLINE:
                    out.add((c.shape, e.content, False))
            if type(c) is Element and c.tag not in NO_TEXT:
                todo.append((c, inside))
    return out


def main_text(root: Element, recurring: frozenset[bytes] | set[bytes]) -> tuple[str, int]:
    """The text that stays, and the number of recurring subtrees deleted."""
    roots = article_roots(root)
    explicit = roots[0] is not root
    ids = {id(r) for r in roots}
    deleted, out = 0, []
    todo: list = [(root, None)]               # with the article that an element is in
    while todo:
        e, inside = todo.pop()
        if e is None:
            out.append(inside)                  # what ends a block
            continue
        if type(e) is str:
            if inside:
                out.append(e)
            continue
        if id(e) in ids:
            inside = inside or e
        elif e is not root:
            links = mostly_links(e)
            article = explicit and inside
            box = box_hash(e, inside) if article else None
            recurs = box in recurring or e.text_len and e.tag not in INLINE and not e.has_main and not e.is_main and (
                e.content in recurring and (links or e.named or not article) or links and e.shape in recurring)
            deleted += bool(recurs)
            if recurs or e.fixed or e.form or e.tag == "header" and not article and not e.has_main:
                continue
            if e.named and (not article or links or e.plain() or e.has_main == 1 and e.named_in(REPLIES)):
                continue
        end = "" if e.tag in INLINE else " "
        if inside:
            out.append(end)
        todo.append((None, end))
        todo.extend((c, inside) for c in reversed(e.children))
    return " ".join("".join(out).split()), deleted


def host_of(url):
    """The host of an address, lower-cased; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def recurring_subtrees(pages: DataFrame, html: str = "html", min_pages: int = MIN_PAGES,
                       share: float = SHARE) -> DataFrame:
    """(host, subtrees): the hashes that recur, for a table with ``host``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, subtrees, parents, boxes = [], [], [], []
            for host, page in zip(batch.column(0), batch.column(1)):
                if not host.as_py():
                    continue
                root = parse(page.as_py())
                if root.text_len:                               # the page itself: a row without a subtree
                    hosts.append(host.as_py())
                    subtrees.append(None)
                    parents.append(int.from_bytes(root.content, "little", signed=True))
                    boxes.append(False)
                for subtree, parent, box in hashes_of(root):
                    hosts.append(host.as_py())
                    boxes.append(box)
                    subtrees.append(int.from_bytes(subtree, "little", signed=True))
                    parents.append(int.from_bytes(parent, "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(parents, pa.int64()), pa.array(boxes, pa.bool_())],
                names=["host", "subtree", "parent", "box"])

    least = F.when(F.col("box"), F.lit(max(BOX_ARTICLES, min_pages))).otherwise(F.lit(min_pages))
    counts = (pages.select("host", html).mapInArrow(run, "host string, subtree bigint, parent bigint, box boolean").distinct()
              .groupBy("host", "subtree", "box").agg(F.count(F.lit(1)).alias("n")))
    counts = stage(counts.filter(F.col("subtree").isNull() | (F.col("n") >= least)), "page-subtrees")
    sizes = counts.filter("subtree IS NULL").select("host", F.col("n").alias("pages"))
    return counts.filter(F.col("subtree").isNotNull()).join(sizes, "host") \
                 .filter(F.col("n") >= F.when(F.col("box"), F.lit(max(BOX_SHARE, share))).otherwise(F.lit(share)) * F.col("pages")) \
                 .groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("subtrees"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
            share: float = SHARE) -> DataFrame:
    """``pages`` with text, n_chars and n_recurring (subtrees deleted because
    they recur on the host); columns of those names are replaced."""
    keep = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "n_recurring")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"),
                        host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    templates = stage(recurring_subtrees(rows, "html", min_pages, share), "page-templates")

    @F.arrow_udf("text string, n_recurring int")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[bytes, frozenset] = {}
        for html_batch, template_batch in batches:
            texts, deleted = [], []
            for page, template in zip(html_batch, template_batch):
                hashes = frozenset()
                if template.is_valid:
                    packed = template.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                    hashes = known.get(packed)
                    if hashes is None:
                        if len(known) >= 256:
                            known.clear()
                        hashes = known[packed] = frozenset(
                            packed[i:i + 8] for i in range(0, len(packed), 8))
                text, n = main_text(parse(page.as_py()), hashes)
                texts.append(text)
                deleted.append(n)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(deleted, pa.int32())],
                                             ["text", "n_recurring"])

    done = rows.join(templates, "host", "left").withColumn("got", run(F.col("html"), F.col("subtrees")))
    return done.select("page.*", F.col("got.text").alias("text"),
                       F.char_length("got.text").cast("bigint").alias("n_chars"),
                       F.col("got.n_recurring").alias("n_recurring"))


@query("op1_site_template_text")
def op1_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
