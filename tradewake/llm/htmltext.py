"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of tags and class names from the root. For each
node two counts tell how much the pages differ there, as entropies over the pages that have it:

* content: of the text blocks at the node, how evenly a block is spread over the pages. A menu entry that is
  on all pages carries nothing; text that is on one page only carries everything.
* presentation: of the sequences of child tags, how evenly pages choose among them. A fixed
  layout carries nothing; free writing carries much.

Pages of a host whose allowed text is the same but for headings count once, so copies don't pass for menus. A node with text has
the importance of its content, one without text that of its presentation and of the nodes
beneath. Branches below ``LEAST_IMPORTANCE`` go, except inside an article or main element. Hosts with few pages lean on the tree of all
hosts, by weight of pages. Elements that by their tag, or by a whole name of their class, id or role, are not main text (scripts, forms, menus,
adverts, comments and the like) go in any case; but names decide nothing about an article or main element, or what lies around one, unless they say it is a
reader's comment.

The tree is built by counting, with map-side combining; pages then meet the unimportant paths of their host in a join that can be split
at run time. So a host with a third of all pages is spread over tasks. A host's tree has one row per path and is never gathered.

Defined cases: null, empty and tagless html is text as it stands, without markup; unclosed and stray tags are tolerated; a page whose every branch
would go keeps what the fixed rules leave; null urls are one host; equal rows give equal rows; no pages,
no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tradewake.llm.common import small_batches, table
from tradewake.session import cut_lineage

LEAST_IMPORTANCE = 0.3
# Pages of a host at which its own tree counts as much as that of all hosts.
EVEN_PAGES = 30
# Depth and length of a path; what lies deeper counts for its ancestor.
DEEPEST = 24

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table body html article section div main nav aside footer header td th".split())
# Elements that never are main text, by tag and by a word of class, id or role.
NOT_TEXT = frozenset("head script style noscript template form nav aside footer button select option textarea iframe svg math object menu dialog input label".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead topbar header toolbar "
    "comment comments disqus respond reply replies share sharing social related recommended subscribe subscription newsletter signup login search pagination pager tags".split()
)
# In a name of several words the last one says what it is, but for words for a container; a first word of these turns it round.
CONTAINERS = frozenset("list box bar container wrapper wrap area block links section thread inner item items body form panel".split())
STATES = frozenset("no has with without not is".split())
COMMENT_WORDS = frozenset("comment comments respond reply replies".split())
# Within an article its own heading lines are text.
HEADED = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Comments, declarations and tags; what is left open reaches to the end, so a page is read once.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")


# Why an element is no main text.
BY_NAME, FIRM = 1, 2


class Node:
    """An open element. ``banned`` is 0, BY_NAME or FIRM; the first can be lifted by an article inside."""

    __slots__ = ("tag", "path", "depth", "banned", "headed")

    def __init__(self, tag: str, path: str, depth: int, banned: int, headed: bool):
        self.tag, self.path, self.depth, self.banned, self.headed = tag, path, depth, banned, headed


def meant(name: str) -> str:
    """The word of a class name, id or role that says what the element is; empty if it only says what it has or lacks."""
    words = WORDS.findall(name)
    if not words or (len(words) > 1 and words[0] in STATES):
        return ""
    while len(words) > 1 and words[-1] in CONTAINERS:
        words.pop()
    return words[-1]


def opened(parent: Node, tag: str, attributes: str) -> Node:
    """The node of an element below its parent."""
    names = ""
    banned = FIRM if tag in NOT_TEXT or (tag == "header" and not parent.headed) else parent.banned
    if attributes:
        found = CLASS.search(attributes)
        if found:
            names = DIGITS.sub("N", ".".join(sorted((found[1] or found[2] or found[3] or "").lower().split())))
        if banned < FIRM and tag not in ("html", "body"):
            said = {meant(name) for a, b, c in NAMES.findall(attributes) for name in (a or b or c).lower().split()}
            if HIDDEN.search(attributes):
                banned = FIRM
            elif not said.isdisjoint(COMMENT_WORDS if tag in HEADED else NOT_TEXT_WORDS):
                banned = FIRM if tag in HEADED else BY_NAME
    headed = parent.headed or tag in HEADED
    if parent.depth >= DEEPEST:
        return Node(tag, parent.path, parent.depth, banned, headed)
    return Node(tag, f"{parent.path}/{tag}{'.' + names if names else ''}", parent.depth + 1, banned, headed)


def blocks(page: str) -> tuple[list[tuple[Node, str]], dict[str, list[str]]]:
    """Text blocks of a page as (node, text) in page order, and the child tags of each path.

    One pass over the tags; text is gathered until a block begins or ends.
    """
    root = Node("", "", 0, 0, False)
    stack, found, children = [root], [], {}
    # How often each tag is open, so that an end tag without a beginning costs nothing.
    open_tags: Counter = Counter()
    pending: list[str] = []
    owner = root

    def flush() -> None:
        nonlocal pending
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                found.append((owner, text))
            pending = []

    def cut(at: int) -> None:
        open_tags.subtract(node.tag for node in stack[at:])
        del stack[at:]

    def close(tags: tuple[str, ...], fences: frozenset[str]) -> None:
        if not any(open_tags[tag] > 0 for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                cut(i)
                return
            if stack[i].tag in fences:
                return

    def block_owner() -> Node:
        for node in reversed(stack):
            if node.tag in BLOCKS or node.banned or not node.tag:
                return node
        return root

    at = 0
    while True:
        token = TOKEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if text:
            if not pending:
                owner = block_owner()
            pending.append(text)
        if not token:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCKS:
                flush()
            if tag not in VOID and open_tags[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if stack[i].banned != stack[i - 1].banned:
                            flush()
                        cut(i)
                        break
                    if tag not in BLOCKS and stack[i].tag in BLOCKS:
                        break
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
        if tag in CLOSES_P:
            close(("p",), FENCES)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], FENCES - frozenset(SIBLINGS[tag]))
        # Formatting that was left open ends with its block.
        if tag in BLOCKS:
            while len(stack) > 1 and stack[-1].tag not in BLOCKS and not stack[-1].banned:
                cut(len(stack) - 1)
        if tag in HEADED and not stack[-1].headed:
            flush()
        node = opened(stack[-1], tag, token[3])
        if tag in BLOCKS:
            children.setdefault(stack[-1].path, []).append(tag)
        if tag in RAW:
            if not token[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in HEADED and not stack[-1].headed and node.banned == BY_NAME:
            # What holds an article isn't a sidebar, whatever its name.
            for above in (*stack, node):
                above.banned = 0
        if node.banned and not stack[-1].banned:
            flush()
        stack.append(node)
        open_tags[tag] += 1
    flush()
    return found, children


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_styles(pages: DataFrame) -> DataFrame:
    """(host, body, style, place), written out: hash of the allowed text without headings, and packed (path, kind, feature) of every page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, styles = [], []
            for page in batch["html"]:
                found, children = blocks(page)
                seen = {(node.path, 0, 0) for node, _ in found} | {(path, 0, 0) for path in children}
                seen |= {(node.path, 1, xxh64_intdigest(text) - 2**63) for node, text in found}
                for path, tags in children.items():
                    # Repeats of a tag are one step, so that the number of paragraphs makes no new style.
                    style = " ".join(t for t, before in zip(tags, [""] + tags) if t != before)
                    seen.add((path, 2, xxh64_intdigest(style) - 2**63))
                bodies.append(xxh64_intdigest("\n".join(text for node, text in found if not node.banned and node.tag not in HEADINGS)) - 2**63)
                styles.append(zlib.compress(json.dumps(list(seen)).encode(), 1))
            yield pd.DataFrame({"host": batch["host"], "body": bodies, "style": styles})

    rows = pages.select(host(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return cut_lineage(rows.mapInPandas(parse, "host string, body long, style binary").withColumn("place", F.monotonically_increasing_id()))


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n): bodies that have a path (kind 0), a text block there (1), a child sequence there (2).

    A body counts once per host, by the first page that has it, and once for the host "*", the tree of all hosts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: Counter = Counter()
            for site, style, anew in zip(batch["host"], batch["style"], batch["anew"]):
                seen = json.loads(zlib.decompress(style))
                sums.update((site, *s) for s in seen)
                if anew:
                    sums.update(("*", *s) for s in seen)
            yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["host", "path", "kind", "feature", "n"])

    styles = page_styles(pages)
    firsts = cut_lineage(styles.groupBy("host", "body").agg(F.min("place").alias("place")))
    everywhere = firsts.groupBy("body").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("anew"))
    chosen = cut_lineage(firsts.select("place").join(everywhere, "place", "left").select("place", F.coalesce("anew", F.lit(False)).alias("anew")))
    counted = styles.join(chosen, "place").select("host", "style", "anew").mapInPandas(count, "host string, path string, kind int, feature long, n long")
    return counted.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, pages, content, layout): importance of the nodes of each host's tree."""
    counts = style_counts(pages)
    # Per node: pages with it, and sums over features of n and of n * log n.
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.log(F.col("n").cast("double")))).alias("text_logs"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("styles"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * F.log(F.col("n").cast("double")))).alias("style_logs"),
    )
    whole = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    content = F.when(F.col("texts") > 0, F.lit(1.0) - F.col("text_logs") / F.col("texts") / whole)
    layout = F.when(F.col("styles") > 0, (F.log(F.col("styles").cast("double")) - F.col("style_logs") / F.col("styles")) / whole)
    return sums.select("host", "path", "pages", content.alias("content"), layout.alias("layout"))


def unimportant(nodes: DataFrame) -> DataFrame:
    """(host, path) of nodes with text that are below LEAST_IMPORTANCE, as is all beneath them.

    A node without text has the importance of its layout, and none less than a node beneath it.
    """
    value = F.coalesce("content", "layout", F.lit(0.0))
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    above = nodes.filter(value >= LEAST_IMPORTANCE).select("host", F.explode(above).alias("path")).distinct()
    low = nodes.filter((value < LEAST_IMPORTANCE) & F.col("own_text") & (F.col("path") != "")).select("host", "path")
    return low.join(above, ["host", "path"], "left_anti")


def main_text(page: str, dropped: Collection[str]) -> str:
    """Text of the blocks outside of the dropped paths, one block per line. Articles stay whole."""
    found, _ = blocks(page)
    allowed = [(node, text) for node, text in found if not node.banned]
    chosen = [text for node, text in allowed if node.headed or node.path not in dropped]
    return "\n".join(chosen or [text for _, text in allowed])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    nodes = cut_lineage(importances(pages))
    own = nodes.filter("host <> '*'").alias("o")
    every = nodes.filter("host = '*'").select("path", F.col("pages").alias("p"), F.col("content").alias("c"), F.col("layout").alias("l"))
    weight = F.col("pages") / (F.col("pages") + F.lit(float(EVEN_PAGES)))

    def mixed(mine, all_):
        return F.when(mine.isNull(), all_).when(all_.isNull(), mine).otherwise(weight * mine + (1 - weight) * all_)

    nodes = own.join(every, "path", "left").select(
        "host", "path", mixed(F.col("content"), F.col("c")).alias("content"), mixed(F.col("layout"), F.col("l")).alias("layout"), F.col("content").isNotNull().alias("own_text")
    )
    lists = cut_lineage(unimportant(cut_lineage(nodes)).groupBy("host").agg(F.collect_list("path").alias("dropped")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    joined = rows.withColumn("host", host(F.col("url"))).join(lists, "host", "left").select("page_id", "url", "host", "html", F.to_json("dropped").alias("dropped"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, frozenset[str]] = {}
        for batch in batches:
            texts = []
            for site, page, dropped in zip(batch["host"], batch["html"], batch["dropped"]):
                if site not in known:
                    if len(known) > 500:
                        known.clear()
                    known[site] = frozenset(json.loads(dropped or "[]"))
                texts.append(main_text(page, known[site]))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(read, "page_id long, url string, text string, n_chars long")


def op8_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
