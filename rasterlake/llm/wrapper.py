"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page becomes a tree of its block elements in which equal siblings are merged; the
distinct trees of a host are aligned to its most frequent one by simple tree matching (the largest order-preserving
matching of equal labels, then of equal tags with names found on one side alone), so that nodes of differing pages become
one slot. Over all pages of the host, block texts that
stand in a slot on nearly every differing page are constant and become template; slots made of links are navigation; the
other slots vary and are content. Elements whose name, role or class says menu, header, footer, side bar, notice, advert,
form or comment are no content whatever varies in them.

The slots below the same ``article``, else the same ``main``, else neither, are a region. Over all pages of the host that
vary in it, a region has a mean amount of varying text, which counts ``MARKED`` times if an element marks it. Content of a
page is what varies in its heaviest region, and in those at least ``BESIDE`` as heavy.

Trees and counts are grouped by host with partial sums and every tree is aligned by itself, so a host with most of the
pages is no single task. The second pass joins the decisions (a few paths per host) to the pages by host.

Defined cases: a null page is empty and has the empty text; a null or odd URL belongs to the host "" ; repeated rows are
pages of their own; an unclosed tag or script ends with its parent or the page; nesting below ``DEPTH`` levels counts as
that level; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.session import cut

DEPTH = 64
CONSTANT = 0.9  # share of a host's differing pages
FEWEST = 3  # pages that show what is constant
LINKED = 0.5  # share of a slot's text in links
MARKED = 2.0  # weight of a region marked as article or main
BESIDE = 0.5  # weight of a further region, against the heaviest of the page

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = "script|style|textarea|title|noscript|template|iframe|object|svg|math|canvas|audio|video|button"
OUTSIDE = frozenset("aside dialog fieldset footer form head menu nav search select option optgroup".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CLOSES = {t: frozenset(c.split()) for t, c in {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
    "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th",
}.items()}
_STOPS = frozenset("ul ol dl table article section main body div".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NO_CONTENT = re.compile(
    r"(?:site|page|global|top|main|post|entry|article|user|reader)?[-_]?(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?"
    r"|popup|modal|overlay|sidebar|side|aside|menu\w*|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|discussion|repl(?:y|ies)|disqus"
    r"|footer|masthead|share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter|subscri\w*|signup|login|search\w*|widgets?|toolbar|paginat\w*|pager|skip)(?:[-_].*)?",
    re.I,
)
_HEADER = re.compile(r"(?:site|page|global|top|main)?[-_]?header(?:[-_].*)?", re.I)


@lru_cache(100_000)
def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, no content, a header) of an element."""
    names, outside, header = [], tag in OUTSIDE, tag == "header"
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if key.lower() == "role":
            outside |= value.strip().lower() in OUTSIDE_ROLES
            continue
        for name in value.split():
            names.append(re.sub(r"\d+", "0", name))
            if tag not in ("html", "body", "main"):
                outside |= _NO_CONTENT.fullmatch(name) is not None
                header |= _HEADER.fullmatch(name) is not None
    return tag + "".join(f".{n}" for n in sorted(set(names))).replace("/", "_"), outside, header


class Block:
    __slots__ = ("inside", "links", "outside", "path", "text")

    def __init__(self, path, inside, outside, text, links):
        self.path, self.inside, self.outside, self.text, self.links = path, inside, outside, text, links


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. ``inside``: 2 in an article, 1 in a main element; ``outside``: no content by name."""
    out: list[Block] = []
    stack = [("", "", 0, False)]  # tag, path, inside, outside
    text: list[str] = []
    linked = anchors = 0

    def flush():
        nonlocal text, linked
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                _, path, inside, outside = stack[-1]
                joined = " ".join(words)
                out.append(Block(path, inside, outside, joined, min(linked, len(joined))))
            text, linked = [], 0

    def add(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if anchors else 0

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if m[2] else 1
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if m[2]:
            if any(s[0] == tag for s in stack[1:]):
                while stack.pop()[0] != tag:
                    pass
            continue
        if stack[-1][0] == "p":  # a block ends an open paragraph
            stack.pop()
        closes = CLOSES.get(tag)
        if closes:
            while stack[-1][0] in closes:
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _STOPS and not (tag in ("tr", "td", "th") and stack[k][0] == "div"):
                    break
                if stack[k][0] in closes:
                    del stack[k:]
                    break
        if tag == "hr":
            continue
        _, path, inside, outside = stack[-1]
        label, no, header = _label(tag, m[4])
        inner = 2 if tag == "article" else max(inside, 1) if tag == "main" else inside
        # a header inside an article is its headline
        stack.append((tag, path if len(stack) > DEPTH else f"{path}/{label}", inner, outside or no or (header and not inside)))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def tree(paths: list[str]) -> dict:
    """Merged tree: label -> subtree, in order of appearance."""
    root: dict = {}
    for path in paths:
        node = root
        for label in path.split("/")[1:]:
            node = node.setdefault(label, {})
    return root


def _aligned(a: dict, b: dict, path_a: str, path_b: str) -> tuple[tuple[int, int], list]:
    """Best alignment of two forests: (nodes of equal label, nodes) and its tree of matched paths."""
    left, right = list(a.items()), list(b.items())
    best = [[((0, 0), None)] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, (la, sa) in enumerate(left):
        for j, (lb, sb) in enumerate(right):
            got = max((best[i][j + 1][0], "up"), (best[i + 1][j][0], "side"))
            same = la == lb
            if same or (la.split(".", 1)[0] == lb.split(".", 1)[0] and la not in b and lb not in a):
                at, to = f"{path_a}/{la}", f"{path_b}/{lb}"
                (equal, size), below = _aligned(sa, sb, at, to)
                before = best[i][j][0]
                score = before[0] + equal + same, before[1] + size + 1
                if score >= got[0]:
                    got = (score, (at, to, below))
            best[i + 1][j + 1] = got
    i, j, found = len(left), len(right), []
    while i and j:
        how = best[i][j][1]
        if how == "up":
            i -= 1
        elif how == "side":
            j -= 1
        else:
            found.append(how)
            i, j = i - 1, j - 1
    return best[-1][-1][0], found


def match(a: dict, b: dict) -> tuple[int, list[tuple[str, str]]]:
    """Simple tree matching of two forests: its size, and the matched paths.

    Elements of equal label match first. One whose names stand nowhere beside the other's siblings, as names made up for
    each page do, may match an element of the same tag in the same place.
    """
    (_, size), todo = _aligned(a, b, "", "")
    pairs = []
    while todo:
        at, to, below = todo.pop()
        pairs.append((at, to))
        todo += below
    return size, pairs


_PASS1 = "host string, page long, lead int, shape_id long, shape string, path string, chars long, links long, seen array<struct<text:long,chars:long>>"


def _shapes(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(9)]
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = blocks(page.as_py() or "")
            paths: dict[str, list] = {}
            for b in found:
                slot = paths.setdefault(b.path, [0, 0, {}])
                slot[0] += len(b.text)
                slot[1] += b.links
                if not b.outside:
                    slot[2][_hash(b.text)] = len(b.text)
            shape = json.dumps(tree(list(paths)), separators=(",", ":"))
            shape_id, whole = _hash(shape), _hash("\n".join(b.text for b in found if not b.outside))
            for k, (path, (chars, links, seen)) in enumerate(paths.items()):
                for c, v in zip(cols, (host, whole, int(k == 0), shape_id, shape, path, chars, links, [{"text": t, "chars": n} for t, n in sorted(seen.items())])):
                    c.append(v)
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("text", pa.int64()), ("chars", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in _PASS1.split(", ")])


def _align(batches):
    for batch in batches:
        rows = []
        for host, n, shape, reference in zip(*(c.to_pylist() for c in batch.columns)):
            mine = json.loads(shape)
            slots = dict(match(mine, json.loads(reference))[1])
            todo = [("", "", mine)]
            while todo:
                path, slot, node = todo.pop()
                for label, inner in node.items():
                    at = f"{path}/{label}"
                    to = slots.get(at, f"{slot}/{label}")
                    todo.append((at, to, inner))
                    rows.append((host, n, at, to))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["host", "n", "path", "slot"]
        )


def _region(slot: Column) -> Column:
    """The path of the slot's innermost article, else of its innermost main element, else nothing."""
    article, main = (F.regexp_extract(slot, rf"^(.*/{tag}(?:\.[^/]*)?)(?:/|$)", 1) for tag in ("article", "main"))
    return F.when(article != "", article).otherwise(main)


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of (host, html): for each path of the host its share of link text, the template's texts there and
    the weight of its region."""
    seen = cut(pages.select("host", "html").mapInArrow(_shapes, _PASS1))
    shapes = seen.groupBy("host", "shape_id").agg(F.sum("lead").alias("n"), F.min("shape").alias("shape"))
    shapes = cut(shapes)
    reference = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape_id")).alias("reference"))
    aligned = shapes.join(reference, "host").select("host", "n", "shape", "reference").mapInArrow(_align, "host string, n long, path string, slot string")
    votes = aligned.groupBy("host", "path", "slot").agg(F.sum("n").alias("n"))
    slots = cut(votes.groupBy("host", "path").agg(F.max_by("slot", F.struct("n", "slot")).alias("slot")))
    sums = seen.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    by_slot = sums.join(slots, ["host", "path"]).groupBy("host", "slot").agg((F.sum("links") / F.sum("chars")).alias("linked"))
    differing = seen.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    texts = seen.select("host", "path", "page", F.explode("seen").alias("t")).select("host", "path", "page", "t.text", "t.chars").distinct()
    texts = cut(texts.join(slots, ["host", "path"]).select("host", "slot", "page", "text", "chars").distinct())
    often = texts.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"))
    constant = often.join(differing, "host").filter((F.col("pages") >= FEWEST) & (F.col("n") >= CONSTANT * F.col("pages")))
    constant = cut(constant.select("host", "slot", "text"))
    fixed = constant.groupBy("host", "slot").agg(F.collect_list("text").alias("template"))  # at most a page's blocks / CONSTANT
    varying = texts.join(constant, ["host", "slot", "text"], "left_anti").groupBy("host", "slot", "page").agg(F.sum("chars").alias("chars"))
    varying = varying.join(by_slot.filter(F.col("linked") <= LINKED), ["host", "slot"], "left_semi")
    varying = varying.groupBy("host", _region(F.col("slot")).alias("region"), "page").agg(F.sum("chars").alias("chars"))
    weights = varying.groupBy("host", "region").agg((F.avg("chars") * F.when(F.col("region") != "", MARKED).otherwise(1.0)).alias("weight"))
    table = slots.join(by_slot, ["host", "slot"]).join(fixed, ["host", "slot"], "left").withColumn("region", _region(F.col("slot")))
    table = table.join(weights, ["host", "region"], "left")
    return cut(table.groupBy("host").agg(F.collect_list(F.struct("path", "linked", "template", "weight")).alias("wrapper")))


def main_text(page: str, wrapper: dict[str, tuple[float, frozenset, float]]) -> str:
    varying = []
    for b in blocks(page):
        linked, template, weight = wrapper.get(b.path, (0.0, frozenset(), 0.0))
        if not b.outside and linked <= LINKED and not (template and _hash(b.text) in template):
            varying.append((weight, b.text))
    least = BESIDE * max((weight for weight, _ in varying), default=0.0)
    return "\n".join(text for weight, text in varying if weight >= least)


def _extract(batches):
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for host, page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = {w["path"]: (w["linked"] or 0.0, frozenset(w["template"] or ()), w["weight"] or 0.0) for w in wrapper.as_py() or ()}
            texts.append(main_text(page.as_py() or "", known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    joined = rows.join(induce(rows), "host", "left").select("page_id", "url", "host", "html", "wrapper")
    return joined.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
