"""Main text of web pages by site style trees: pages of a host are merged, and branches of low importance are removed.

The tree of a host has a node for each path of tags and classes. A node's presentation importance is the entropy of the tag
sequences below it; the importance of a text block falls with the entropy of that text over the pages that show it,
weighed by the share of the host's pages that do. Composite importance of an element mixes its own with the mean of what
lies below, and a quarter of it is a prior from names: 0 inside elements called navigation, footer, notice or the like, 1 elsewhere. Such
an element goes if it and all elements below it stay under one half, so its name alone doesn't remove it: content that is
laid out differently from page to page stays. Elements without any such name go where the tree shows the site's template: outside main content, the same
sequence of children on all pages down to the last level, and a list or words that nearly all pages share. Where a host has few pages, the importance of elements of the same tag on all hosts stands in.

Entropy can't tell content from what changes with the page and yet isn't content: reader comments, adverts, forms, lists of related pages.
Elements whose tag, role or class names declare them such are left out before the trees are built, unless the page's content lies in them.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Element names of HTML by their part in a page.
RAW = frozenset("script style noscript template iframe textarea select svg math object canvas noembed noframes xmp title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
OTHER = frozenset("html head body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre address figure figcaption details summary center form fieldset menu".split())
_TAGS = OTHER | INLINE | VOID
REPEATED = frozenset("nav footer menu".split())
CHANGING = frozenset("aside form button dialog head fieldset".split())
CLOSES = {t: frozenset(x.split()) for t, x in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}.items()}
_PARAGRAPH = frozenset(("p",))
HOLDS = {"li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "tbody": frozenset(("table",)), "thead": frozenset(("table",)), "tfoot": frozenset(("table",))}
# Class names of boilerplate that repeats over a site's pages, and of what changes with the page but isn't content.
REPEATED_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead banner footer cookie cookies consent gdpr notice notification alert "
    "pagination pager toolbar skip copyright legal disclaimer".split()
)
CHANGING_WORDS = frozenset(
    "sidebar ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion popup modal overlay newsletter subscribe subscription "
    "signup login signin register search comment comments disqus reply replies respond discussion share sharing social follow related recommended recommendations widget hidden paywall "
    "teaser outbrain taboola".split()
)
REPEATED_STARTS = tuple("cookie breadcrumb navbar navigation".split())
CHANGING_STARTS = tuple("comment advert sidebar newsletter sponsor disqus subscri recommend".split())
REPEATED_ENDS = tuple("nav menu footer banner navbar".split())
CHANGING_ENDS = tuple("sidebar comments advert".split())
CONTENT_WORDS = frozenset("article post entry content story main body text".split())
#: Words that say what part of a page an element is, not what it is about: ``share-box`` is a box, ``social-policy`` a subject.
PART_WORDS = frozenset("box area section wrapper wrap block list container inner outer top bottom left right item items link links button buttons bar panel slot zone unit count icon icons title primary secondary site page global".split())
#: Of an element inside a line only these names make it go.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored".split())
REPEATED_ROLES = frozenset("navigation banner contentinfo menu menubar toolbar alert alertdialog".split())
CHANGING_ROLES = frozenset("complementary search form dialog".split())


@dataclass
class Node:
    """An element or, with ``text`` set, a block of text.

    ``level`` is what its own names say, ``subject`` that they may well be about its subject, ``content`` that they call it content. ``settle`` derives the
    rest: ``said``: names call it boilerplate; ``named``: it or an element around it is; ``noise``: removed; ``main``: main content. ``fixed``: removed as the site's template.
    """

    key: str
    path: int
    tag: str = ""
    level: int = 0
    subject: bool = False
    content: bool = False
    said: bool = False
    named: bool = False
    noise: bool = False
    main: bool = False
    fixed: bool = False
    text: str | None = None
    children: list[Node] = field(default_factory=list)


KEPT, WORDS, TAG, GONE = range(4)


@dataclass
class Names:
    """What an element's tag, role and class names say: its style key, level, whether it is declared main content, and see ``Node``."""

    key: str
    level: int = KEPT
    main: bool = False
    subject: bool = False
    content: bool = False
    inline: bool = False  # goes even inside a line


def _declared(tag: str, raw: str, in_main: bool) -> Names:
    """Names say nothing, boilerplate by class names, boilerplate by tag or role, or that the element goes; of a page as a whole they say nothing.

    Names of an article or main element count only as whole words of its class: ``social-policy`` is a subject there, ``comment`` is not.
    """
    level = GONE if tag in CHANGING else TAG if tag in REPEATED or tag == "header" and not in_main else KEPT
    main = tag in ("article", "main")
    if not raw or raw.isspace() or tag in ("html", "body"):
        return Names(tag, level, main and level == KEPT, content=main)
    a = {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    names = f"{a.get('class', '')} {a.get('id', '')}"
    role = a.get("role", "").lower()
    main = main or role in ("main", "article") or a.get("itemprop") == "articleBody"
    words = {w.lower() for w in names.split()}
    if not main:
        words |= {w.lower() for w in _SPLIT.split(names) if w} | {w for w in re.split(r"[^a-z0-9]+", names.lower()) if w}
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
    subject = False
    if hidden or role in CHANGING_ROLES:
        level = GONE
    elif words & CHANGING_WORDS or any(re.fullmatch(r"(?:comment|reply|ad)[-_]?\d+", w) for w in words) or not main and any(w.startswith(CHANGING_STARTS) and not w.startswith("commentar") or w.endswith(CHANGING_ENDS) for w in words):
        subject = level != GONE and not any(_all_of_a_part(w) for w in names.split())
        level = GONE
    elif level < TAG and role in REPEATED_ROLES:
        level = TAG
    elif level == KEPT and (words & REPEATED_WORDS or not main and any(w.startswith(REPEATED_STARTS) or w.endswith(REPEATED_ENDS) for w in words)):
        level = WORDS
    elif level == KEPT and "header" in words and not words & CONTENT_WORDS and not in_main:
        level = WORDS
    content = main or bool({w.lower() for w in names.split()} & CONTENT_WORDS) and level == KEPT
    return Names(f"{tag}.{'.'.join(sorted(a.get('class', '').split()))}", level, main and level == KEPT, subject, content, hidden or bool(words & ADVERT_WORDS))


def _all_of_a_part(name: str) -> bool:
    """Whether a class name is nothing but words for a part of a page that goes, as ``comment-list`` and ``sidebar2``; ``with-sidebar`` isn't."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    goes = [w.rstrip("0123456789") in CHANGING_WORDS or w.startswith(CHANGING_STARTS) or w.endswith(CHANGING_ENDS) for w in words]
    return any(goes) and all(g or w in PART_WORDS or w in CONTENT_WORDS or w.isdigit() for g, w in zip(goes, words, strict=True))


def settle(root: Node) -> None:
    """Turns what names say into what goes, by the page as a whole.

    An element whose names say that it goes stays, as if they said nothing, where the page has no content elsewhere: no element called content that holds a tenth
    of the text and isn't itself in boilerplate. Then it stays if declared main content lies in it, or if it holds most of the page's text and either an element called
    content lies in it, or it is an article or main element, or its names may be about its subject.
    """
    order = [root]
    for n in order:
        order += [c for c in n.children if c.text is None]
    chars: dict[int, int] = {}
    inside: dict[int, tuple[bool, bool]] = {}  # declared main content, something called content
    for n in reversed(order):
        below = [c for c in n.children if c.text is None]
        chars[id(n)] = sum(len(c.text) for c in n.children if c.text is not None) + sum(chars[id(c)] for c in below)
        open_ = [c for c in below if c.level != GONE]
        inside[id(n)] = any(c.main and chars[id(c)] > 0 or inside[id(c)][0] for c in open_), any(c.content or inside[id(c)][1] for c in open_)
    total = chars[id(root)]
    free = [root]
    for n in free:
        free += [c for c in n.children if c.text is None and c.level not in (GONE, TAG)]
    elsewhere = any((n.main or n.content) and 10 * chars[id(n)] >= total > 0 for n in free)
    todo = [(root, KEPT)]
    while todo:
        n, above = todo.pop()
        most = 2 * chars[id(n)] > total
        stays = n.level == GONE and not elsewhere and above < TAG and (inside[id(n)][0] or most and (inside[id(n)][1] or n.tag in ("article", "main") or n.subject))
        level = KEPT if stays else n.level
        n.main = (n.main or stays and n.tag in ("article", "main")) and above < TAG
        whole = KEPT if n.main else max(level, above)
        n.said, n.named, n.noise = level in (WORDS, TAG), whole in (WORDS, TAG), whole == GONE
        for c in n.children:
            if c.text is None:
                todo.append((c, whole))
            else:
                c.named = n.named


def parse(source: str) -> Node:
    """The block structure of a page: elements other than inline ones, and blocks of decoded text with white space turned into one space.

    Elements nest without a limit. Inside boilerplate by tag or role nothing is main content.
    """
    root = Node("", 0)
    stack: list[tuple[str, Node, bool]] = [("", root, False)]  # tag, node, in main
    open_tags: Counter = Counter()
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1][1]
                top.children.append(Node("#", top.path, text=text))

    def pop(n: int) -> None:
        flush()
        open_tags.subtract(t for t, *_ in stack[n:])
        del stack[n:]

    def innermost(tags: frozenset[str], until: frozenset[str] = frozenset()) -> int:
        """Place of the innermost open element with one of the tags, 0 if there is none or one of ``until`` comes first."""
        if any(open_tags[t] > 0 for t in tags):
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] in until:
                    break
                if stack[n][0] in tags:
                    return n
        return 0

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        tag = m[1] or m[4]
        if tag:
            if m[4] and not source.endswith(">", 0, at):
                continue  # cut off in the middle of a tag
            tag = tag.lower()
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end if close is None else close.end()
                if tag not in ("svg", "math"):
                    continue
                parts.append(" ")
            elif tag == "br":
                parts.append(" ")
            elif tag in INLINE or tag in VOID and tag != "hr":
                raw = m[2] or m[5] or ""
                if tag not in VOID and ("class" in raw or "hidden" in raw or "style" in raw or "id=" in raw) and _declared(tag, raw, stack[-1][2]).inline:
                    at = _skip(source, at, tag)
            else:
                if tag in CLOSES and (n := innermost(CLOSES[tag], HOLDS.get(tag, frozenset()))):
                    pop(n)
                if n := innermost(_PARAGRAPH):  # any block element ends an open paragraph
                    pop(n)
                flush()
                _, top, in_main = stack[-1]
                if tag == "hr":
                    continue
                names = _declared(tag, m[2] or m[5] or "", in_main)
                path = xxhash.xxh64_intdigest(f"{top.path}/{names.key}") - (1 << 63)
                node = Node(names.key, path, tag, names.level, names.subject, names.content, main=names.main)
                top.children.append(node)
                open_tags[tag] += 1
                stack.append((tag, node, in_main or names.main))
        elif m[3]:
            tag = m[3].lower()
            if tag not in INLINE and tag not in VOID and tag not in RAW and (n := innermost(frozenset((tag,)))):
                pop(n)
    pop(1)
    settle(root)
    return root


def _skip(source: str, at: int, tag: str) -> int:
    """Place after the end tag that belongs to an element opened before ``at``."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(source)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without its port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _spot(above: int, n: Node) -> int:
    """Where an element stands in its site's template: under which ones, and with which kinds of children, so that divisions without names are told apart. ``html`` and ``body`` are what they are with any children."""
    kinds = "" if n.tag in ("", "html", "body") else "|".join(dict.fromkeys(c.key for c in n.children))
    return xxhash.xxh64_intdigest(f"{above}/{n.key}[{kinds}]") - (1 << 63)


def _sequence(keys: list[str]) -> str:
    """All child keys in turn, runs of one key by the binary length of their number: six links are as many as five, thirty paragraphs aren't."""
    return "|".join(f"{k}*{sum(1 for _ in run).bit_length()}" for k, run in groupby(keys))


def _features(root: Node, short: int = 20) -> Iterator[tuple[int, int, int, str, bool]]:
    """(path, kind, hash, tag, named): kind 0 is the sequence of distinct child keys of an element, kind 1 a block of text.

    Outside main content and boilerplate by name, kind 2 is the ``_sequence`` of all child keys and kind 3 a word of a block of at most ``short`` words, both by spot.
    """
    todo = [(root, False, _spot(0, root))]
    while todo:
        n, main, spot = todo.pop()
        if n.noise:
            continue
        keys = [c.key for c in n.children]
        yield n.path, 0, xxhash.xxh64_intdigest("|".join(dict.fromkeys(keys))) - (1 << 63), n.tag if n.tag in _TAGS else "", n.named
        main = main or n.main
        free = not main and not n.named
        if free:
            yield spot, 2, xxhash.xxh64_intdigest(_sequence(keys)) - (1 << 63), "", False
        for c in n.children:
            if c.text is None:
                todo.append((c, main, _spot(spot, c) if free else 0))
            else:
                yield n.path, 1, xxhash.xxh64_intdigest(c.text) - (1 << 63), "", False
                if free and len(words := c.text.split()) <= short:
                    for w in words:
                        yield spot, 3, xxhash.xxh64_intdigest(w) - (1 << 63), "", False


def site_trees(pages: DataFrame, prior: float = 2.0, main_prior: float = 16.0, noisy_below: float = 0.5, least_pages: int = 8, fixed_below: float = 0.4, on_most: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``(host, styles, noise, main_noise, fixed, words)``, and ``(tag, importance)`` over all hosts.

    ``styles`` holds pages, presentation importance and number of styles by path, of elements in named boilerplate, which are the ones it decides on. Counts
    are taken over distinct pages' features, combined in each task before they are shuffled. A block that only
    copies of one and the same page have says nothing: it must be on pages of differing content. A block's importance over m pages is
    mixed with ``prior`` pages of importance 1, in declared main content with ``main_prior``. ``noise`` lists
    ``path ^ text hash`` of blocks with importance below ``noisy_below``, ``main_noise`` those where it is even by the prior of main content.

    Of elements without such names, ``fixed`` lists the spots on at least ``least_pages`` pages whose presentation importance, taken over whole sequences of
    children, is below ``fixed_below``, and ``words`` lists ``spot ^ word hash`` of words that short blocks there show on a share of ``on_most`` of its pages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            seen: dict[tuple, list[int]] = {}
            for host, source in zip(b["host"], b["html"], strict=True):
                page = xxhash.xxh64_intdigest(source) - (1 << 63)
                for f in set(_features(parse(source))):
                    k = (host, *f)
                    found[k] += 1
                    s = seen.setdefault(k, [page, page])
                    s[0], s[1] = min(s[0], page), max(s[1], page)
            if found:
                yield pd.DataFrame([(*k, n, *seen[k]) for k, n in found.items()], columns=["host", "path", "kind", "feature", "tag", "named", "n", "low", "high"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    f = rows.mapInPandas(count, "host string, path long, kind int, feature long, tag string, named boolean, n long, low long, high long")
    f = f.groupBy("host", "path", "kind", "feature").agg(F.max("tag").alias("tag"), F.max("named").alias("named"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    f = written(f.where("kind IN (0, 2) OR n > 1 AND low <> high"), "features")
    sequences = f.where("kind = 2").groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.min("low").alias("low"), F.max("high").alias("high"))
    sequences = sequences.where((F.col("m") >= least_pages) & (F.col("low") != F.col("high")))
    fixed = written(sequences.where((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m") < fixed_below).select("host", "path", "m"), "fixed")
    words = f.where("kind = 3").join(fixed, ["host", "path"]).where(F.col("n") >= on_most * F.col("m")).groupBy("host").agg(F.collect_set(F.col("path").bitwiseXOR(F.col("feature"))).alias("words"))
    # presentation: entropy of the styles of a path to the base of its pages
    styles = f.where("kind = 0").groupBy("host", "path").agg(F.max("tag").alias("tag"), F.max("named").alias("named"), F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count(F.lit(1)).alias("styles")).where("m > 1")
    styles = styles.withColumn("importance", F.greatest(F.lit(0.0), (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")))
    styles = written(styles.select("host", "path", "tag", "named", "m", "importance", "styles"), "styles")
    mixed = lambda own, pages: (F.lit(pages) + F.col("m") * own) / (F.lit(pages) + F.col("m"))
    blocks = f.where("kind = 1").join(styles.select("host", "path", "m"), ["host", "path"])
    low = 1 - F.least(F.lit(1.0), F.col("n") / F.col("m")) * F.log("n") / F.log("m")
    block = F.col("path").bitwiseXOR(F.col("feature"))
    below = [F.collect_set(F.when(mixed(low, p) < noisy_below, block)).alias(name) for p, name in ((prior, "noise"), (main_prior, "main_noise"))]
    noise = blocks.where(mixed(low, min(prior, main_prior)) < noisy_below).groupBy("host").agg(*below)
    entry = F.struct("path", F.struct("m", "importance", "styles"))
    own = styles.where("named").groupBy("host").agg(F.map_from_entries(F.collect_list(entry)).alias("styles"))
    # at most one row for each name in a fixed list of tags
    tags = written(styles.where("tag <> ''").groupBy("tag").agg((F.sum(F.col("m") * F.col("importance")) / F.sum("m")).alias("importance")), "tags")
    fixed_of = fixed.groupBy("host").agg(F.collect_set("path").alias("fixed"))
    trees = own.join(noise, "host", "full").join(fixed_of, "host", "full").join(words, "host", "full")
    trees = written(trees.select("host", "styles", "noise", "main_noise", "fixed", "words"), "trees")
    discard(f, styles, fixed)
    return trees, tags


@dataclass
class SiteTree:
    """What the merged pages of a host say: ``styles`` by path as (pages, presentation importance, number of styles), blocks that fall, importance by tag, paths and words of its template."""

    styles: dict = field(default_factory=dict)
    noise: set = field(default_factory=set)
    main_noise: set = field(default_factory=set)
    tags: dict = field(default_factory=dict)
    fixed: set = field(default_factory=set)
    words: set = field(default_factory=set)

    def falls(self, node: Node, main: bool) -> bool:
        noise = self.main_noise if main else self.noise
        return bool(noise) and node.path ^ (xxhash.xxh64_intdigest(node.text) - (1 << 63)) in noise


def weigh(root: Node, tree: SiteTree, names: float = 0.25, pages: float = 8.0, decay: float = 0.6, noisy_below: float = 0.5) -> None:
    """Marks the elements in named boilerplate as noise that, with all elements below them, have an importance under ``noisy_below``.

    What lies in an element that reaches it stays with it, but for elements that are called boilerplate themselves.

    Composite importance is ``(1 - decay^l) own + decay^l mean of what lies below``, l being the number of styles of the path; own is
    the host's presentation importance, mixed with ``pages`` pages as important as elements of that tag are on all hosts (0 if none is known).
    A block has 1, or 0 if it falls. ``1 - names`` of the result count, as the names' own word is 0. Below other elements nothing is decided: there
    blocks fall one by one. Without recursion, so any depth will do.
    """
    order = [root]
    for n in order:
        order += [c for c in n.children if c.text is None and not c.noise]
    composite: dict[int, float] = {}
    peak: dict[int, float] = {}
    for n in reversed(order):
        if not n.named:  # declared main content inside boilerplate keeps the elements around it
            peak[id(n)] = composite[id(n)] = 1.0
            continue
        below = [(0.0 if tree.falls(c, False) else 1.0) if c.text is not None else composite.get(id(c), 0.0) for c in n.children]
        m, own, kinds = tree.styles.get(n.path, (0, 0.0, 1))
        own = (pages * tree.tags.get(n.tag, 0.0) + m * own) / (pages + m)
        share = decay**kinds
        composite[id(n)] = (1 - share) * own + share * (sum(below) / len(below) if below else 0.0)
        peak[id(n)] = max((1 - names) * composite[id(n)], *(peak.get(id(c), 0.0) for c in n.children if c.text is None), 0.0)
    safe: set[int] = set()
    for n in order:
        stays = n.named and (1 - names) * composite[id(n)] >= noisy_below or id(n) in safe
        n.noise = not stays and peak[id(n)] < noisy_below
        if stays:
            safe.update(id(c) for c in n.children if not c.said)
    _template(root, tree)


def _template(root: Node, tree: SiteTree, share: float = 0.25, alone: float = 0.1, known: float = 0.15) -> None:
    """Marks elements without telling names that the host lays out alike on all pages: its template, which names have no part in.

    Such an element lies outside main content, and neither it nor any element below it differs in its children from page to page. If it has at least two
    elements below it, as a list of links, that is enough; one that holds text alone also needs three words, and a share of ``known`` of all, on nearly all of the
    host's pages. What has more than ``share`` of the page's text stays, ``alone`` where no main content is declared; and all stays if together they had more than half.
    """
    if not tree.fixed:
        return
    order, main, spot = [root], {id(root): False}, {id(root): _spot(0, root)}
    for n in order:
        below = [c for c in n.children if c.text is None and not c.noise]
        main |= {id(c): main[id(n)] or c.main for c in below}
        spot |= {id(c): _spot(spot[id(n)], c) for c in below if not c.named and not main[id(c)]}
        order += below
    chars: dict[int, int] = {}
    elements: dict[int, int] = {}  # below an element of the template, -1 for others
    for n in reversed(order):
        below = [c for c in n.children if c.text is None and not c.noise]
        chars[id(n)] = sum(len(c.text) for c in n.children if c.text is not None) + sum(chars[id(c)] for c in below)
        alike = not n.named and not main[id(n)] and spot.get(id(n)) in tree.fixed and all(elements[id(c)] >= 0 for c in below)
        elements[id(n)] = sum(elements[id(c)] + 1 for c in below) if alike else -1
    total = chars[id(root)]
    most = (share if any(n.main and chars[id(n)] for n in order) else alone) * total
    found, lost, todo = [], 0, [root]
    while todo:
        n = todo.pop()
        if elements[id(n)] >= 0 and 0 < chars[id(n)] <= most:
            words = [w for c in n.children if c.text is not None for w in c.text.split()]
            same = sum(spot[id(n)] ^ (xxhash.xxh64_intdigest(w) - (1 << 63)) in tree.words for w in words)
            if elements[id(n)] >= 2 or same >= max(3, known * len(words)):
                found.append(n)
                lost += chars[id(n)]
                continue
        todo += [c for c in n.children if c.text is None and not c.noise]
    if 2 * lost <= total:
        for n in found:
            n.fixed = n.noise = True


def removed(root: Node, tree: SiteTree) -> tuple[int, int, int]:
    """Branches that the tree removes from a page, blocks that fall by it, and branches that names alone declare gone."""
    by_tree = blocks = by_name = 0
    weigh(root, tree)
    todo = [(c, False) for c in root.children]
    while todo:
        n, main = todo.pop()
        if n.text is not None:
            blocks += tree.falls(n, main)
        elif n.noise:
            by_tree, by_name = by_tree + (n.named or n.fixed), by_name + (not n.named and not n.fixed)
        else:
            todo += [(c, main or n.main) for c in n.children]
    return by_tree, blocks, by_name


def _blocks(root: Node, tree: SiteTree, fall_in_main: bool) -> tuple[list[str], bool]:
    """The blocks of the page that are left, and whether one is inside an article or main element."""
    left: list[str] = []
    inside = False
    todo = [(root, False)]
    while todo:
        n, main = todo.pop()
        if n.text is not None:
            if main and not fall_in_main or not tree.falls(n, main):
                left.append(n.text)
                inside = inside or main
        elif not n.noise:
            todo += [(c, main or n.main) for c in reversed(n.children)]
    return left, inside


def main_text(source: str, styles: dict | None = None, noise: set | None = None, main_noise: set | None = None, tags: dict | None = None, fixed: set | None = None, words: set | None = None) -> str:
    """The blocks of the page that are left, one to a line, inside declared main content and beside it.

    If nothing in article and main elements were left, as on a host of near copies, what they hold stays. Without a tree names decide.
    """
    root, tree = parse(source), SiteTree(styles or {}, noise or set(), main_noise or set(), tags or {}, fixed or set(), words or set())
    weigh(root, tree)
    left, inside = _blocks(root, tree, True)
    if tree.main_noise and not inside:
        left, _ = _blocks(root, tree, False)
    return "\n".join(left)


def extract(pages: DataFrame, broadcast_hosts: int = 20_000, **tree) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page.

    Null html is empty, and so is its text; null urls and urls without a host share the empty host; repeated rows give repeated
    results; other columns are ignored. An empty table gives an empty table. Trees are broadcast if at most ``broadcast_hosts`` hosts
    have one (and at most fifty times as many entries); beyond that they are joined by host, where the adaptive skew join splits
    hosts with many pages. Pages are processed whole, in batches; an element may nest to any depth.
    """
    trees, tags = site_trees(pages, **tree)
    of_tag = {r["tag"]: r["importance"] for r in tags.collect()}  # at most len(_TAGS) rows
    listed = ("noise", "main_noise", "fixed", "words")
    entries = trees.select("host", F.map_keys("styles").alias("paths"), F.map_values("styles").alias("values"), *listed)
    size = entries.agg(F.count(F.lit(1)), F.sum(sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("paths", *listed)))).first()
    small = size[0] <= broadcast_hosts and (size[1] or 0) <= 50 * broadcast_hosts
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = p.join(F.broadcast(entries) if small else entries, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, styles, sets = None, {}, []
        for b in batches:
            texts = []
            for host, source, paths, values, *marked in zip(b["host"], b["html"], b["paths"], b["values"], *(b[c] for c in listed), strict=True):
                if host != last:
                    last, sets = host, [set() if m is None else {int(x) for x in m} for m in marked]
                    styles = {} if paths is None else {int(k): (v["m"], v["importance"], v["styles"]) for k, v in zip(paths, values, strict=True)}
                noise, main_noise, fixed, words = sets
                texts.append(main_text(source or "", styles, noise, main_noise, of_tag, fixed, words))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
