"""Main text of web pages, with removal of site templates.

Each page is parsed once for the hashes of its container subtrees: of the subtree with its texts and, as menus and
notices change their words from page to page, of its shape alone. Spark counts with how many different contents of a host each
stands, and the page is parsed again without the subtrees that recur across many of them. What is left goes through
rules on tags, roles and class names. A page's articles, or else its main part or body, are read.

Copies of a page have the same content and count once, so what recurs with one article alone is not a template. A shape
counts where links hold most of its text, and never for what lies in an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_batches

#: A subtree is a site's template if it stands with so many contents of the host at least, and with this share of them: one
#: share for containers outside of articles, one for what stands in them or is no container. The shares bound how many a host can have.
TEMPLATE_PAGES = 5
OUTSIDE_SHARE, INSIDE_SHARE = 0.05, 0.3
#: A shape can be a template if links hold this share of the subtree's text.
LINKED_SHARE = 0.5

# Tags of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("aside div dl fieldset figure footer form header menu nav ol section table ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input menu nav noembed noframes noscript object script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "marks", "kids", "digest", "shape", "chars", "linked")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.kids, self.digest, self.shape, self.chars, self.linked = tag, marks, [], 0, 0, 0, 0

    def measure(self) -> None:
        """Hash of the subtree, hash of it without texts and repeats, characters in all and in links."""
        inner, shapes = [], []
        for k in self.kids:
            if isinstance(k, str):
                inner.append(k)
                self.chars += len(k.strip())
            else:
                inner.append(str(k.digest))
                if not shapes or shapes[-1] != k.shape:
                    shapes.append(k.shape)
                self.chars += k.chars
                self.linked += k.linked
        if self.tag == "a":
            self.linked = self.chars
        self.digest, self.shape = (
            xxhash.xxh64_intdigest(f"{self.tag}\x02{self.marks}\x02{x}".encode("utf-8", "replace"), seed) - (1 << 63) for seed, x in enumerate(("\x01".join(inner), shapes))
        )

    def is_linked(self) -> bool:
        return self.chars > 0 and self.linked >= LINKED_SHARE * self.chars


def parse(source: str, digests: bool = False) -> Node:
    """The element tree; with `digests`, each element has the hash of its subtree (tag, class, id, role and text)."""
    root = Node("")
    stack, opened = [root], Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag] -= 1
            if digests:
                node.measure()

    def text(piece: str) -> None:
        if piece:
            stack[-1].kids.append(html.unescape(piece) if "&" in piece else piece)

    at = 0
    while token := _TOKEN.search(source, at):
        text(source[at : token.start()])
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            depth = len(stack) - 1
            while opened[tag] and stack[depth].tag != tag:
                depth -= 1
            if opened[tag]:
                close(depth)
            continue
        if tag in BLOCK and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[depth].tag == "p":
                    close(depth)
                elif stack[depth].tag in BLOCK:
                    break
        if tag in CLOSED_BY:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in LIMITS[tag]:
                    break
                if stack[depth].tag in CLOSED_BY[tag]:
                    close(depth)
                    if tag != "tr":
                        break
        marks = ""
        if token[3]:
            marks = " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in _ATTRIBUTE.finditer(token[3]))
        node = Node(tag, marks)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            if digests:
                node.measure()
            if tag in ("title", "textarea"):
                continue
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
        elif digests:
            node.measure()
    text(source[at:])
    close(1)
    if digests:
        root.measure()
    return root


def subtree_hashes(source: str) -> tuple[list[tuple[int, bool]], int]:
    """What may be a template of the page's site, each with whether it is held to INSIDE_SHARE, and the hash of the page's content.

    The content is the articles and main parts, or all where there are none. In these, and where there are none, any block may
    be a template; elsewhere containers may.
    """
    tree = [parse(source, digests=True)]
    parent = [-1]
    for at, node in enumerate(tree):  # the list grows: every element stands behind its parent
        kids = [k for k in node.kids if not isinstance(k, str)]
        tree += kids
        parent += [at] * len(kids)
    holds, within, content = [n.tag in ("article", "main") for n in tree], [False] * len(tree), []
    for at in range(1, len(tree)):
        within[at] = within[parent[at]] or holds[parent[at]]
        if holds[at] and not within[at]:
            content.append(str(tree[at].digest))
    for at in range(len(tree) - 1, 0, -1):
        holds[parent[at]] |= holds[at]
    found: dict[int, bool] = {}
    for node, has, inside in zip(tree, holds, within):
        container = node.tag in CONTAINERS
        if has or not (container or node.tag in BLOCK and not content and node.tag not in ("html", "body")):
            continue
        strict = inside or not container
        found[node.digest] = found.get(node.digest, False) or strict
        if container and not inside and node.is_linked():
            found.setdefault(node.shape, False)
    whole = xxhash.xxh64_intdigest(" ".join(content).encode()) - (1 << 63) if content else tree[0].digest
    return list(found.items()), whole


def unwanted(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    if not node.marks or node.tag in ("html", "body", "main") or node.tag in HEADINGS:
        return False
    for part in node.marks.split(" "):
        name, _, value = part.partition("=")
        if name in ("hidden",) and value != "until-found" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return any(w.lower() in MARKS for w in _NAME.findall(re.sub(r"(?:^| )(?:class|id|role|hidden|aria-hidden)=", " ", node.marks)))


def is_header(node: Node) -> bool:
    return node.tag == "header" or "header" in (w.lower() for w in _NAME.findall(node.marks)) and node.tag not in HEADINGS and node.tag in BLOCK


def blocks(top: Node, dead: frozenset[int]) -> list[str]:
    """Texts of the blocks below, in page order."""
    inside = top.tag in ("article", "main")
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            if whole := " ".join("".join(held).split()):
                out.append(whole)
            held.clear()

    todo: list = [(top, False)]
    while todo:
        item, header = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item is not top and (unwanted(item) or item.digest in dead or not inside and item.shape in dead and item.is_linked()):
            if item.tag in BLOCK:
                flush()
        elif item.tag == "br":
            held.append(" ")
        else:
            header = header or item is not top and is_header(item)
            heading = item.tag in HEADINGS
            kids = [(k, header and not heading) for k in item.kids if not (header and not heading and isinstance(k, str))]
            if item.tag in BLOCK:
                flush()
                todo.append((None, False))
            todo += reversed(kids)
    flush()
    return out


def main_text(source: str | None, templates: list[int] | None = None) -> str:
    """Blocks of the article joined by newlines; several articles that stand side by side follow each other."""
    if not source:
        return ""
    dead = frozenset(templates or ())
    root = parse(source, digests=bool(dead))
    found: list[Node] = []
    for wanted in ("article", "main"):
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == wanted and not unwanted(node):
                found.append(node)
            elif not unwanted(node) or node is root:
                todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
        if found:
            break
    return "\n".join(block for n in found or [root] for block in blocks(n, dead))


def host(url: str) -> Column:
    """Lower-case host of a URL column, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame) -> DataFrame:
    """(site, digest): subtrees of `pages` (site long, html) that recur with many contents of their site."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        site, digest, strict, content = [], [], [], []
        for s, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, whole = subtree_hashes(source) if source else ([], 0)
            # One row more stands for the content itself, so that a site's contents can be counted.
            for d, inside in [*found, (None, False)]:
                site.append(s)
                digest.append(d)
                strict.append(inside)
                content.append(whole)
        return pa.table({"site": pa.array(site, pa.int64()), "digest": pa.array(digest, pa.int64()), "strict": pa.array(strict, pa.bool_()), "content": pa.array(content, pa.int64())})

    each = map_batches(pages.select("site", "html"), run, "site long, digest long, strict boolean, content long")
    once = each.groupBy("site", "digest", "content").agg(F.max("strict").alias("strict"))
    counted = once.groupBy("site", "digest").agg(F.count("*").alias("contents"), F.max("strict").alias("strict"))
    many = counted.where(F.col("digest").isNull() | (F.col("contents") >= TEMPLATE_PAGES))
    of_site = F.max(F.when(F.col("digest").isNull(), F.col("contents")))
    sites = many.groupBy("site").agg(of_site.alias("all_contents"))
    share = F.when(F.col("strict"), INSIDE_SHARE).otherwise(OUTSIDE_SHARE)
    return many.where("digest IS NOT NULL").join(sites, "site").where(F.col("contents") >= F.col("all_contents") * share).select("site", "digest")


def extract_pages(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """`pages` without `source`, with `text`: its main text (empty for null, empty or textless pages).

    Columns named `text` or `__site` that `pages` brings are replaced. Repeated rows, and pages of the same content, count
    once and get the same text. Pages without a host share one. No rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "html")
    sited = pages.drop("text", "__site").withColumn("__site", F.xxhash64(host(url)))
    found = site_templates(sited.select(F.col("__site").alias("site"), F.col(source).alias("html")))
    # A site's templates go to its pages as one list, no longer than a page's subtrees by the smaller share.
    lists = scratch.write(found.groupBy("site").agg(F.collect_list("digest").alias("templates")), "templates")
    joined = sited.join(lists.select(F.col("site").alias("__site"), "templates"), "__site", "left")
    kept = [c for c in sited.columns if c not in (source, "__site")]
    schema = sited.select(*kept).schema.add("text", "string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, t) for h, t in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    return map_batches(joined.select(*kept, F.col(source).alias("__html"), "templates"), run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
