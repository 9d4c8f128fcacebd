"""Site style trees against a plain recomputation, and what the trees decide."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import xxhash

from loomgraph.llm import style_tree as st
from loomgraph.llm.style_tree import SiteTree


def _walk(node):
    yield node
    for c in node.children:
        if c.text is None and not c.noise:
            yield from _walk(c)


def _plain_tree(pages):
    """Styles by (host, path), and blocks with an importance under one half, from the definitions."""
    shown, blocks, tag_of, named = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}, set()
    for k, host, html in pages:
        for n in _walk(st.parse(html)):
            shown[host, n.path]["|".join(dict.fromkeys(c.key for c in n.children))].add(k)
            tag_of[host, n.path] = n.tag
            if n.named:
                named.add((host, n.path))
            for c in n.children:
                if c.text is not None:
                    blocks[host, n.path][c.text].add(k)
    html_of = {k: html for k, _, html in pages}
    styles, by_tag = {}, defaultdict(list)
    for at, kinds in shown.items():
        m = sum(map(len, kinds.values()))
        if m > 1:
            h = -sum(len(x) / m * math.log(len(x) / m) for x in kinds.values()) / math.log(m)
            by_tag[tag_of[at]].append((m, h))
            styles[at] = m, h, len(kinds)
    noise = defaultdict(set)
    for at, texts in blocks.items():
        for text, on in texts.items():
            if len(on) > 1 and len({html_of[k] for k in on}) > 1:
                m, n = styles[at][0], len(on)
                low = 1 - min(1, n / m) * math.log(n) / math.log(m)
                for kind, w in (("noise", 2), ("main_noise", 16)):
                    if (w + m * low) / (w + m) < 0.5:
                        noise[at[0], kind].add(at[1] ^ (xxhash.xxh64_intdigest(text) - (1 << 63)))
    tags = {t: sum(m * h for m, h in x) / sum(m for m, _ in x) for t, x in by_tag.items()}
    return {at: s for at, s in styles.items() if at in named}, noise, tags


def _importance(n, tree):
    """Composite importance of an element in named boilerplate, and the largest weighed one at or below it, by recursion."""
    if not n.named:
        return 1.0, 1.0
    parts, peaks = [], [0.0]
    for c in n.children:
        if c.text is not None:
            parts.append(0.0 if tree.falls(c, False) else 1.0)
        else:
            own, peak = (0.0, 0.0) if c.noise else _importance(c, tree)
            parts.append(own)
            peaks.append(peak)
    m, own, kinds = tree.styles.get(n.path, (0, 0.0, 1))
    own = (8 * tree.tags.get(n.tag, 0.0) + m * own) / (8 + m)
    whole = (1 - 0.6**kinds) * own + 0.6**kinds * (sum(parts) / len(parts) if parts else 0.0)
    return whole, max(0.75 * whole, *peaks)


def _trees(df):
    trees, tags = st.site_trees(df)
    out = {}
    of_tag = {r["tag"]: r["importance"] for r in tags.collect()}
    for r in trees.collect():
        styles = {k: (v["m"], v["importance"], v["styles"]) for k, v in (r["styles"] or {}).items()}
        out[r["host"]] = SiteTree(styles, set(r["noise"] or ()), set(r["main_noise"] or ()), of_tag, set(r["fixed"] or ()), set(r["words"] or ()))
    return out, of_tag


def _made(n=40):
    page = """<body><nav><ul><li>Home</li><li>Page {k}</li></ul></nav><div class="legal-affairs">{body}</div>
<div class="notice"><p>Offer of day {k}</p></div><div><p>Same on all</p></div><section><p>Own {k}</p></section></body>"""
    parts = ["<h2>a{k}</h2>", "<p>b{k}</p>", "<ul><li>c{k}</li></ul>", "<table><tr><td>d{k}</td></tr></table>", "<pre>e{k}</pre>", "<blockquote>f{k}</blockquote>"]
    return [(k, f"http://made.example/{k}", page.format(k=k, body="".join(p.format(k=k) for j, p in enumerate(parts) if k + 1 >> j & 1))) for k in range(n)]


def test_trees_match_the_definitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame([(10_000 + k, u, h) for k, u, h in _made()], "page_id long, url string, html string"))
    rows = df.select("page_id", st.host_of(df.url).alias("host"), "html").collect()
    pages = [(r["page_id"], r["host"], r["html"] or "") for r in rows]
    styles, noise, tags = _plain_tree(pages)
    got, of_tag = _trees(df)
    assert {(h, p): (m, round(i, 9), n) for h, t in got.items() for p, (m, i, n) in t.styles.items()} == {at: (m, round(i, 9), n) for at, (m, i, n) in styles.items()}
    assert {(h, kind): x for h, t in got.items() for kind in ("noise", "main_noise") if (x := getattr(t, kind))} == dict(noise)
    assert set(of_tag) == {t for t in tags if t in st._TAGS} and all(abs(of_tag[t] - tags[t]) < 1e-9 for t in of_tag)
    by_tree = blocks = 0
    for _, host, html in pages:
        tree = got.get(host, SiteTree(tags=of_tag))
        root, again = st.parse(html), st.parse(html)
        st.weigh(root, tree)
        assert [n.noise for n in _walk_all(root)] == _plain_marks(again, tree, False)
        a, b, _ = st.removed(st.parse(html), tree)
        by_tree, blocks = by_tree + a, blocks + b
    on_sf = [st.removed(st.parse(html), got.get(host, SiteTree(tags=of_tag)))[0] for k, host, html in pages if k < 10_000]
    assert min(on_sf) > 0  # navigation and footer of every page fall to their tree
    assert by_tree > sum(on_sf) and blocks > 0


def _walk_all(node):
    yield node
    for c in node.children:
        if c.text is None and not (c.noise and not c.named):
            yield from _walk_all(c)


def _plain_marks(n, tree, safe):
    """Whether each element goes, in the order of ``_walk_all``."""
    whole, peak = _importance(n, tree)
    stays = safe or n.named and 0.75 * whole >= 0.5
    marks = [n.named and not stays and peak < 0.5]
    for c in n.children:
        if c.text is None and not c.noise:
            marks += _plain_marks(c, tree, stays and not c.said)
    return marks


def test_names_alone_remove_nothing_repeated(spark):
    df = spark.createDataFrame(_made(60), "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in st.extract(df).collect()}
    assert got[62 - 8] == ["a54", "b54", "c54", "e54", "f54", "Own 54"]  # the body is called legal-affairs, and differs from page to page
    assert all("Same on all" not in t and not any(x.startswith(("Offer", "Home", "Page")) for x in t) for t in got.values())
    one = {r["page_id"]: r["text"] for r in st.extract(df.limit(1)).collect()}
    assert "Same on all" in one[0] and "Offer" not in one[0]  # one page: names and other hosts' tags are all there is


def test_subjects_in_class_names_and_deep_pages():
    text = st.main_text
    for names in ("post social-policy", "article search-engines", "news legal-affairs", "story related-work"):
        assert text(f'<nav>m</nav><article class="{names}"><p>Body</p></article><footer>f</footer>') == "Body"
    assert text("<main><h1>T</h1></main><div><p>Long body</p></div>") == "T\nLong body"
    assert text('<article class="comment">x</article><article id="comment-7">z</article><div class="commentary">y</div>') == "y"
    assert text("<footer><article>teaser</article></footer>k") == "k"
    deep = "<div>" * 3000
    assert text(f"{deep}<nav>MENU</nav><p>x{'</div>' * 3000}y") == "x\ny"


def test_repeated_rows_and_empty_tables(spark):
    rows = [(k % 5, f"http://h.example/{k % 5}", f"<body><div>Line</div><p>Own {k % 5}</p></body>") for k in range(50)]
    df = spark.createDataFrame([*rows, (None, None, None), (9, "http://h.example/9", "")], "page_id long, url string, html string")
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in st.extract(df).collect())
    assert len(got) == 52 and [t for k, t in got if k in (-1, 9)] == ["", ""] and [t for k, t in got if k == 3] == ["Own 3"] * 10
    assert st.extract(df.limit(0)).count() == 0 and st.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_content_inside_telling_names_stays():
    """Where nothing else on the page is content, names of what lies around it don't take it away."""
    for page in (
        '<form id="aspnetForm"><main><p>Text here</p></main></form>', '<form><div class="content"><p>Text here</p></div></form>', '<body class="single-post comments-open"><article><p>Text here</p></article></body>',
        '<html class="no-js search"><body><p>Text here</p></body></html>', '<div class="layout with-sidebar"><div class="content"><p>Text here</p></div><div class="sidebar">no</div></div>',
        '<div class="hfeed site comments-closed"><article>Text here</article></div>', '<main id="search">Text here</main>', '<article class="news social">Text here</article>', '<article class="post related">Text here</article>',
        '<div class="social-policy">Text here</div>', '<article>Text here</article><section class="comments"><article>a reader who has far more to say than the article</article></section>',
    ):
        assert st.main_text(page) == "Text here", page
    assert st.main_text('<p>Text <span class="share">100 shares</span> here <span class="ad">buy</span></p>') == "Text 100 shares here"
    rest = '<div class="comments"><div class="content">a reader who has far more to say than the page itself</div></div>'
    assert st.main_text(f'<div id="content">Text here, and more</div>{rest}') == "Text here, and more"
    assert st.main_text('<div class="sidebar-left"><p>one two three</p></div><p>x</p>') == "x"


def _without_names(html):
    html = re.sub(r' (?:class|id|role)="[^"]*"', "", html)
    return re.sub(r"<(/?)(?:nav|header|footer)\b", r"<\1div", html)


def test_the_tree_removes_the_template_of_pages_without_names(spark, sf_dir):
    """Navigation and footer are divisions like any other here, and their texts differ from page to page."""
    rows = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/pages.parquet").select("page_id", "url", "html", st.host_of("url").alias("host")).collect()
    on_host = Counter(r["host"] for r in rows)
    df = spark.createDataFrame([(r["page_id"], r["url"], _without_names(r["html"])) for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in st.extract(df).collect()}
    seen = 0
    for r in rows:
        alone = st.main_text(_without_names(r["html"])).split("\n")
        nav = re.findall(r"<a [^>]*>([^<]*)</a>", r["html"].split("</nav>")[0]) if "<nav>" in r["html"] else []
        body = st.main_text(r["html"]).split("\n")
        if on_host[r["host"]] < 8 or not nav or len("".join(nav)) > 0.1 * len("".join(body)):
            continue
        seen += 1
        left = got[r["page_id"]]
        assert alone[: len(nav)] == nav and left[: len(nav)] != nav and len(left) < len(alone)
        assert not any(x.startswith("©") for x in left)
        it = iter(left)
        assert all(any(x == y for y in it) for x in body)  # the main text is all there, in order
    assert seen > 40


def test_template_against_the_definitions(spark):
    page = "<body><div><ul><li>{a}</li><li>{b}</li></ul></div><div>{body}</div><div>Made by {b} for all</div><p>" + "Long text {a} {b} that is most of the page. " * 8 + "</p></body>"
    rows = [(k, "http://t.example/", page.format(a=k * 7, b=k % 5, body="".join(f"<b>{k}.{j}</b><p>x{k}.{j}</p>" for j in range(k % 4)))) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    (tree,) = _trees(df)[0].values()
    paths = defaultdict(list)

    def walk(n, above):
        spot = st._spot(above, n)
        paths[spot].append(n)
        for c in n.children:
            if c.text is None:
                walk(c, spot)

    for _, _, html in rows:
        walk(st.parse(html), 0)
    fixed = set()
    for p, nodes in paths.items():
        kinds = Counter(st._sequence([c.key for c in n.children]) for n in nodes)
        m = len(nodes)
        if m >= 8 and -sum(v / m * math.log(v / m) for v in kinds.values()) / math.log(m) < 0.4:
            fixed.add(p)
    assert tree.fixed == fixed and fixed
    assert {"Made", "by", "for", "all"} == {w for w in "Made by for all 3 14".split() for p in fixed if p ^ (xxhash.xxh64_intdigest(w) - (1 << 63)) in tree.words}
    got = {r["page_id"]: r["text"].split("\n") for r in st.extract(df).collect()}
    for k in range(20):
        assert got[k][-1] == " ".join([f"Long text {k * 7} {k % 5} that is most of the page."] * 8) and not any("Made by" in x for x in got[k])
        assert got[k][:-1] == [x for j in range(k % 4) for x in (f"{k}.{j}", f"x{k}.{j}")]
    copies = spark.createDataFrame([(k, "http://c.example/", rows[0][2]) for k in range(20)], "page_id long, url string, html string")
    assert all("Made by" in r["text"] for r in st.extract(copies).collect())  # copies of one page say nothing of a template
