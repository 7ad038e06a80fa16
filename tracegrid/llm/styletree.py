"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged (Yi, Liu and Li, KDD 2003). Nodes with the same path of tags and classes are one
style node. An element node counts the sequences of its children (presentation), the text right inside an element is a
leaf of its own and counts its contents. A node's importance is the entropy of these counts, scaled by the most that its
number of pages allows: 0 where all pages show the same, 1 where all differ; copies of a page count once for each host.
Hosts with few pages lean on the tree of all hosts. The importance of a branch is the largest of its nodes, and branches
of low importance leave every page that shows them. All nodes are in the tree, whatever their names.

Entropy cannot tell a reader's comment from an article, as both differ on every page. So names (tag, class, id, role) are
claims about branches: that one is no main text (menus, headers, footers, adverts, forms, comments, ...; block or inline),
or that one is the main element. The tree decides whether a claim holds on a host:

* A main element holds, and rules out all outside it, unless its branch is of low importance. If it is, what lies outside
  is left to entropy. Text inside a main element is never removed by entropy.
* A claim of noise fails if it would leave pages with no text: if at least half of the pages that show it have no
  important branch without such a claim, and their largest important text lies under it. For claims by a tag, or of
  comments, a main element must lie under it as well. Few pages lean on all hosts, and without those the claim holds.

Counts go up by groupBy, so a hot host costs no task more than its share. Verdicts travel back to the pages by
template (the set of a page's leaves), so that what a page receives is bounded by its own nodes. Elements and their nodes
are told apart at any depth. A path of ``DEEPEST`` elements goes on from its digest, so that names stay short; the nodes
above such a digest are no part of the branches below it. Of claims of noise within each other the ``NESTED`` outermost
are told apart, and the last of these speaks for those in it.

Defined results: null and blank pages give the empty text; tables of one page have no tree and keep all neutral
nodes; repeated rows give the same text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .urlfilter import host_of

#: Nodes of lower importance leave; pages that a host needs for half the say; pages below which no tree speaks; share of pages that fails a claim.
LOW, LEAN, LEAST, FAILS = 0.35, 32, 8, 0.5

#: Claims: elements by name, and words of class, id and role attributes, that are no main text.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg canvas button select textarea input label dialog menu header".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: What these words claim is said of the text and not of a layout.
FIRM_WORDS = frozenset(["comment", "comments"])
#: Inside a main element these hold its title.
TITLE_WORDS = frozenset(["header", "masthead"])
MAIN_TAGS = frozenset(["article", "main"])
#: Elements in the path of a style node, of which a digest then stands for those so far.
DEEPEST = 64
#: Claims of noise around a leaf that are told apart.
NESTED = 8
#: Ends of a leaf, and of claims: a main element, noise by a word of a layout, noise by a tag or of comments.
LEAF, MAIN, NOISE, FIRM = "#", "*", "!", "!!"
#: Between a leaf and its claims; the last of a leaf that has a main element inside its innermost claim of noise.
THEN, WITHIN = "\t", "+"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^<>]*+)>|<[!?][^<>]*+>|(?P<text>[^<]+|<)""" % "|".join(RAW), re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _style(tag: str, words: list[str]) -> str:
    name = ".".join([tag, *dict.fromkeys(words)])
    return name if len(name) <= 100 else f"{name[:80]}.{hashlib.blake2b(name.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def _below(over: Element, style: str) -> tuple[str, int]:
    """The style node of an element within ``over`` and the length of its path."""
    if over.level < DEEPEST:
        return f"{over.node}/{style}" if over.node else style, over.level + 1
    return f"%{hashlib.blake2b(over.node.encode('utf-8', 'replace'), digest_size=12).hexdigest()}/{style}", 2


class Element(NamedTuple):
    """An open element: its style node, the claims of noise around it or of itself from outside in, the outermost claim of a
    main element if any, and whether a main element lies between it and the innermost claim of noise."""

    tag: str
    node: str
    noise: tuple[str, ...]
    main: str | None
    within: bool
    level: int
    inline: bool = False
    code: bool = False


class Leaf(NamedTuple):
    """A leaf of the style tree with the nodes of its branch from the root and what names claim of them."""

    nodes: list[str]
    noise: list[str]
    main: str | None
    within: bool


def _claimed(over: Element, node: str, tag: str, words: list[str]) -> tuple[str, ...]:
    """The claims of noise of an element within ``over`` that makes one itself."""
    if len(over.noise) >= NESTED:
        return over.noise
    return (*over.noise, f"{node}/{FIRM if tag in NOISE_TAGS or not FIRM_WORDS.isdisjoint(words) else NOISE}")


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(leaf of the style tree with its claims, text) of every block of a page, in order."""
    blocks: list[tuple[Element, str]] = []
    top = Element("", "", (), None, False, 0)
    stack, text, hidden = [top], [], []
    opened: Counter[str] = Counter()

    def close(pieces: list[str], owner: Element) -> None:
        if block := _SPACE.sub(" ", html.unescape("".join(pieces))).strip():
            blocks.append((owner, block))
        pieces.clear()

    def flush() -> None:
        if text:
            close(text, next(x for x in reversed(stack) if not x.inline))
        if hidden:
            close(hidden, stack[-1])

    def pop(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        if not any(opened[t] for t in tags):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in tags:
                if not all(x.inline for x in stack[at:]):
                    flush()
                elif hidden:
                    close(hidden, stack[-1])
                opened.subtract(x.tag for x in stack[at:])
                del stack[at:]
                return
            if stack[at].tag in stop:
                return

    for m in _TOKEN.finditer(page):
        if (piece := m["text"]) is not None:
            (hidden if stack[-1].inline else text).append(piece)
            continue
        if (tag := m["tag"]) is None:
            continue
        tag, over = tag.lower(), stack[-1]
        inline = tag in INLINE
        if inline and tag in VOID:
            if tag == "br":
                (hidden if over.inline else text).append(" ")
            continue
        if m["end"]:
            if not inline:
                flush()
            if not inline or over.inline:
                pop((tag,))
            continue
        attrs = m["attrs"]
        words = _WORDS.findall(" ".join(a or b or c for a, b, c in _NAMED.findall(attrs)).lower()) if attrs and "=" in attrs else []
        if inline:
            # inline elements are styles of their own only if they claim to be noise; what they hold leaves the line
            if over.inline or (words and not over.code and not NOISE_WORDS.isdisjoint(words) and not (over.main and NOISE_WORDS.intersection(words) <= TITLE_WORDS)):
                node, level = _below(over, _style(tag, words))
                noise = over.noise if over.inline else _claimed(over, node, tag, words)
                stack.append(Element(tag, node, noise, over.main, over.inline and over.within, level, True, over.code))
                opened[tag] += 1
            continue
        flush()
        if tag in VOID:
            continue
        pop(("p",), ("td", "th", "li", "body", "article", "main", "section", "div", "table", "blockquote"))
        if tag in CLOSES:
            pop(CLOSES[tag], ("ul", "ol", "dl", "table", "select", "div"))
        over = stack[-1]
        noise = (tag in NOISE_TAGS or (tag not in ("html", "body") and not NOISE_WORDS.isdisjoint(words))) and not (over.main and {tag, *words} & NOISE_WORDS <= TITLE_WORDS and tag not in NOISE_TAGS - TITLE_WORDS)
        node, level = _below(over, _style(tag, words))
        main = tag in MAIN_TAGS or "main" in words
        claims = _claimed(over, node, tag, words) if noise else over.noise
        stack.append(Element(tag, node, claims, over.main or (f"{node}/{MAIN}" if main else None), bool(claims) and (main or (over.within and not noise)), level, False, over.code or tag == "pre"))
        opened[tag] += 1
    flush()
    return [(THEN.join([f"{x.node}/{LEAF}", *x.noise, *([x.main] if x.main else ()), *([WITHIN] if x.within else ())]), block) for x, block in blocks]


def branch(leaf: str) -> list[str]:
    """The style nodes from the root to ``leaf``."""
    steps = leaf.partition(THEN)[0].split("/")
    return ["/".join(steps[:n]) for n in range(1, len(steps) + 1) if n > 1 or steps[0]]


def leaf_of(leaf: str) -> Leaf:
    claims = leaf.split(THEN)[1:]
    return Leaf(branch(leaf), [x for x in claims if x.endswith(NOISE)], next((x for x in claims if x.endswith(MAIN)), None), WITHIN in claims)


def _digest(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _tree(found: list[tuple[str, str]]) -> dict[str, tuple[int, int]]:
    """Style node to (digest, characters) in one page's blocks: of its contents for a leaf, of its children for an element."""
    contents: dict[str, list[str]] = {}
    children: dict[str, list[str]] = {}
    above: dict[str, list[str]] = {}
    for leaf, text in found:
        if leaf not in above:
            above[leaf] = branch(leaf)
        contents.setdefault(above[leaf][-1], []).append(text)
        for node, kid in zip(above[leaf], above[leaf][1:]):
            kids = children.setdefault(node, [])
            if not kids or kids[-1] != kid:
                kids.append(kid)
    return {leaf: (_digest(x), sum(map(len, x))) for leaf, x in contents.items()} | {node: (_digest(x), 0) for node, x in children.items()}


def style_nodes(page: str) -> dict[str, int]:
    """Style node to digest in one page, whatever names claim."""
    return {node: digest for node, (digest, _) in _tree(blocks_of(page)).items()}


def main_text(page: str | None, low: frozenset[str] | None = None) -> str:
    """The blocks of a page that stay, one a line. ``low``: nodes whose branches leave and claims that hold; without it all
    claims of the page hold."""
    found = blocks_of(page or "")
    leaves = {leaf: leaf_of(leaf) for leaf, _ in found}
    if low is None:
        low = frozenset(x for leaf in leaves.values() for x in (*leaf.noise, leaf.main) if x)
    quiet = {leaf for leaf, x in leaves.items() if low.isdisjoint(x.noise)}
    has_main = any(leaves[leaf].main in low for leaf in quiet)
    return "\n".join(text for leaf, text in found if leaf in quiet and (leaves[leaf].main or (not has_main and low.isdisjoint(leaves[leaf].nodes))))


TREES = "host string, payload binary, template long, leaves array<string>, nodes array<struct<node:string,digest:bigint,chars:bigint>>"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest of the page, its template, its leaves with their claims, its style nodes) of every page."""
    node = pa.struct([("node", pa.string()), ("digest", pa.int64()), ("chars", pa.int64())])
    kinds = [pa.field("host", pa.string()), pa.field("payload", pa.binary()), pa.field("template", pa.int64()), pa.field("leaves", pa.list_(pa.string())), pa.field("nodes", pa.list_(node))]
    for batch in batches:
        hosts, payloads, templates, leaves, trees = [], [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = blocks_of(page or "")
            hosts.append(host)
            payloads.append(hashlib.sha256((page or "").encode("utf-8", "replace")).digest())
            leaves.append(sorted({leaf for leaf, _ in found}))
            templates.append(_digest(leaves[-1]))
            trees.append([{"node": n, "digest": d, "chars": c} for n, (d, c) in _tree(found).items()])
        yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip((hosts, payloads, templates, leaves, trees), kinds)], names=[k.name for k in kinds])


def _entropy(counts: DataFrame, *by: str) -> DataFrame:
    """(by, m pages, h, chars) of counts n; h is 1 for a single page."""
    x = counts.groupBy(*by).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("chars").alias("chars"))
    return x.select(*by, "m", F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0).alias("h"), "chars")


def _importance(once: DataFrame) -> DataFrame:
    nodes = once.select("host", F.explode("nodes").alias("x")).select("host", "x.node", "x.digest", "x.chars")
    seen = cut(nodes.groupBy("host", "node", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "nodes")
    own = _entropy(seen, "host", "node")
    every = _entropy(seen.groupBy("node", "digest").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), "node").select("node", F.when(F.col("m") >= LEAN, F.col("h")).otherwise(1.0).alias("all_h"), F.col("m").alias("all_m"))
    blended = (F.col("m") * F.col("h") + LEAN * F.col("all_h")) / (F.col("m") + LEAN)
    nodes = own.join(every, "node").select("host", "node", F.greatest("m", F.least("all_m", F.lit(LEAST))).alias("pages"), blended.alias("importance"), "chars")
    # the importance of a branch goes up to all nodes above it
    steps = F.split("node", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    lifted = nodes.select("host", F.explode(up).alias("above"), "node", "pages", "importance", "chars")
    itself = F.col("node") == F.col("above")
    return lifted.groupBy("host", F.col("above").alias("node")).agg(F.max(F.when(itself, F.col("pages"))).alias("pages"), F.max("importance").alias("importance"), F.max(F.when(itself, F.col("chars"))).alias("chars"))


def _once(trees: DataFrame) -> DataFrame:
    """The trees of a host's different pages."""
    return trees.groupBy("host", "payload").agg(*(F.first(c).alias(c) for c in ("template", "leaves", "nodes")))


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance, chars) of the branches of the style trees of ``pages`` (host, html). A host's copies of
    a page count once."""
    return _importance(_once(cut(pages.select("host", "html").mapInArrow(_trees, TREES), "trees")))


def needed_claims(leaves: list[str], low: set[str], chars: dict[str, int]) -> tuple[list[str], list[str], list[str]]:
    """(claims of noise, those of them under which alone a page of these leaves has important text, mains that hold)."""
    read = [leaf_of(leaf) for leaf in leaves]
    noise = sorted({x for leaf in read for x in leaf.noise})
    mains = sorted({leaf.main for leaf in read if leaf.main and leaf.main.rpartition("/")[0] not in low})
    there = [leaf for leaf in read if low.isdisjoint(leaf.nodes) or (leaf.main and not leaf.noise)]
    if any(not leaf.noise for leaf in there):
        return noise, [], mains
    under: Counter[tuple[str, ...]] = Counter()
    held = set()
    for leaf in there:
        under[tuple(leaf.noise)] += chars.get(leaf.nodes[-1], 0)
        if leaf.within:
            held.add(tuple(leaf.noise))
    open_ = [x for x in under if x in held or not any(claim.endswith(FIRM) for claim in x)]
    return noise, list(min(open_, key=lambda x: (x not in held, len(x), -under[x], x), default=())), mains


CLAIMS = "host string, template long, n long, noise array<string>, needed array<string>, low array<string>"


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, template, pages n, claims of noise, those that its pages' text needs to fail, low nodes and mains that hold)."""
    names = pa.list_(pa.string())
    for batch in batches:
        out = []
        for leaves, seen in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            low = {x["node"] for x in seen or () if x["low"]}
            noise, needed, mains = needed_claims(leaves, low, {x["node"]: x["chars"] or 0 for x in seen or ()})
            out.append((noise, needed, [*sorted(low), *mains]))
        columns = [pa.array([x[k] for x in out], names) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["host", "template", "n", "noise", "needed", "low"])


def _failed(claims: DataFrame) -> DataFrame:
    """(host, claim) of the claims of noise that the trees overrule."""
    asked = claims.select(F.explode("needed").alias("claim")).distinct()
    shown = claims.select("host", "n", "needed", F.explode("noise").alias("claim")).join(asked, "claim", "left_semi")
    own = shown.groupBy("host", "claim").agg(F.sum("n").alias("m"), F.sum(F.when(F.array_contains("needed", F.col("claim")), F.col("n")).otherwise(0)).alias("k"))
    every = own.groupBy("claim").agg(F.sum("m").alias("all_m"), F.sum("k").alias("all_k"))
    lean = F.when(F.col("all_m") >= LEAN, F.col("all_k") / F.col("all_m")).otherwise(0.0)
    return own.join(every, "claim").filter((F.col("k") + LEAN * lean) / (F.col("m") + LEAN) >= FAILS).select("host", "claim")


def low_branches(trees: DataFrame) -> DataFrame:
    """(host, template, low): the style nodes of a template whose branches leave and the claims that hold; at most as many
    as a page has nodes and claims."""
    once = _once(trees)
    low = (F.col("importance") < LOW) & (F.col("pages") >= LEAST)
    judged = _importance(once).select("host", "node", low.alias("low"), "chars")
    templates = cut(once.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.first("leaves").alias("leaves"), F.first("nodes.node").alias("nodes")), "templates")
    nodes = templates.select("host", "template", F.explode("nodes").alias("node"))
    seen = nodes.join(judged, ["host", "node"]).groupBy("host", "template").agg(F.collect_list(F.struct("node", "low", "chars")).alias("seen"))
    claims = cut(templates.drop("nodes").join(seen, ["host", "template"], "left").mapInArrow(_claims, CLAIMS), "claims")
    failed = claims.select("host", "template", F.explode("noise").alias("claim")).join(_failed(claims), ["host", "claim"]).groupBy("host", "template").agg(F.collect_set("claim").alias("failed"))
    holding = F.array_except("noise", F.coalesce("failed", F.array().cast("array<string>")))
    return claims.join(failed, ["host", "template"], "left").select("host", "template", F.array_sort(F.concat("low", holding)).alias("low")).filter(F.size("low") > 0)


BLOCKS = "page_id long, url string, host string, template long, nodes array<string>, leaves array<struct<nodes:array<int>,noise:array<string>,main:string>>, blocks array<struct<leaf:int,text:string>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, template, the page's nodes, the branches of its leaves with their claims, its blocks by leaf) of every page."""
    names = pa.list_(pa.string())
    leaf_kind, block_kind = pa.list_(pa.struct([("nodes", pa.list_(pa.int32())), ("noise", names), ("main", pa.string())])), pa.list_(pa.struct([("leaf", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            templates, nodes, leaves, blocks = [], [], [], []
            for page in part.column(3).to_pylist():
                found = blocks_of(page or "")
                index = {leaf: n for n, leaf in enumerate(dict.fromkeys(leaf for leaf, _ in found))}
                templates.append(_digest(sorted(index)))
                # a main element keeps its text, whatever its nodes
                at: dict[str, int] = {}
                leaves.append([{"nodes": [] if x.main else [at.setdefault(n, len(at)) for n in x.nodes], "noise": x.noise, "main": x.main} for x in map(leaf_of, index)])
                nodes.append(list(at))
                blocks.append([{"leaf": index[leaf], "text": text} for leaf, text in found])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(templates, pa.int64()), pa.array(nodes, names), pa.array(leaves, leaf_kind), pa.array(blocks, block_kind)], names=["page_id", "url", "host", "template", "nodes", "leaves", "blocks"])


def extract_text(pages: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text) of every page; ``low`` (host, template, low) takes the place of the pages' own trees."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    if low is None:
        low = cut(low_branches(cut(hosted.select("host", "html").mapInArrow(_trees, TREES), "trees")), "low")
    gone = F.coalesce("low", F.array().cast("array<string>"))
    quiet = F.filter("leaves", lambda x: ~F.arrays_overlap(x.noise, gone))
    has_main = F.exists(quiet, lambda x: F.coalesce(F.array_contains(gone, x.main), F.lit(False)))
    told = F.array(F.struct(has_main.alias("has_main"), F.transform("nodes", lambda n: F.array_contains(gone, n)).alias("low")))
    own = lambda x, page: ~page["has_main"] & ~F.exists(x.nodes, lambda at: page["low"][at])
    stays = F.transform(told, lambda page: F.transform("leaves", lambda x: ~F.arrays_overlap(x.noise, gone) & (x.main.isNotNull() | own(x, page))))[0]
    text = F.transform(F.array(stays), lambda stay: F.array_join(F.transform(F.filter("blocks", lambda b: stay[b.leaf]), lambda b: b.text), "\n"))[0]
    return hosted.mapInArrow(_blocks, BLOCKS).join(low, ["host", "template"], "left").select("page_id", "url", text.alias("text"))
