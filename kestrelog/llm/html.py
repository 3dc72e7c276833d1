"""Operator 7: main text by site style trees.

The pages of a host are merged into one tree of styles: a node is a path of block elements with their
names and classes. The content of a node is worth 1 minus the entropy of what stands there over the
host's pages: what most pages share (menus, notices, footers) tells nothing about a page, what differs
from page to page is content. The importance of a node is composed over its branch: the mean of the
contents of all nodes in it, weighted by their characters, and, with the small weight 1 - DECAY, the
entropy of the node's own inner markup. A branch is as important as its most important node, so a
text goes with its node if that is the top of an unimportant branch or lies in one. A text at a node has an importance of its own,
1 - log n / log m if n of the m pages with the node hold it. A page counts for the nodes it has, whatever
else its host holds, and pages with equal blocks count once.

The role that the markup states is a prior, worth WORTH pages, of the importance of what stands there:

    posterior = (WORTH * prior + (pages - 1) * importance) / (WORTH + pages - 1)

with the pages that have the node and the importance measured on them. A block goes if its posterior is below
LEAST. There is no number of pages from which on another rule holds: few pages leave the prior, many override it.

- PRIOR of a block without a role is in the middle: it goes with a low branch, or if its text is shared;
- inside article or main it is high, and only the text's own importance counts;
- in menus, headers, footers, sidebars, forms and notices (by element or by a name in class, id or role), in an
  article or on pages without one, it is 0: such blocks stay where their branch differs from page to page;
- on pages that mark an article, what lies outside it goes: menus of links differ from page to page as articles do;
- reader comments and adverts, too, differ from page to page by nature: they go whatever their importance, and so
  does what is hidden.

An article or main inside a noise element is the page's article if there is no other. A page of which nothing would
stay keeps its blocks without a noise role.

A name in class, id or role counts if it is one of NOISE_WORDS or HARD_WORDS, or joins some of them with
none but PARTS ("site-footer", "comment-list", but not "ad-hoc" or "has-sidebar"), and not at headings. Attributes
are parsed; a value never counts as another attribute.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and
joined by line feeds in page order. Null html is empty. A null or odd url is its own host. Pages
without tags are one block of text. Repeated pages are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, materialize

#: Weight of the content, pages that a prior is worth, and the posterior importance of what stays.
DECAY, WORTH, LEAST = 0.9, 4, 0.3
#: Elements nested deeper stand beside each other in the tree, as in browsers.
DEPTH = 512
#: Roles of blocks, and the priors of those that importance judges.
PLAIN, GONE, INSIDE, NOISY = range(4)
PRIOR = {PLAIN: 0.5, INSIDE: 0.9, NOISY: 0.0}
#: Verdicts: what a node or a text does to blocks of a role.
DROP_PLAIN, DROP_INSIDE, KEEP_NOISY = 1, 2, 4

BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; xmp holds text without markup.
RAW = set("iframe noembed noframes noscript script style svg template textarea title xmp".split())
NOISE = set("aside button dialog footer form header menu nav search select".split())
MAIN = set("article main".split())
#: Names in class, id and role of what importance may override, of what it may not, and what they are
#: joined with (fixed values).
NOISE_WORDS = set("banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended subscribe subscription newsletter signup login search form pagination pager toolbar skip contentinfo complementary promo promotion reply".split())
HARD_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments disqus replies respond".split())
PARTS = set("site page main post article blog global primary secondary top bottom left right inner outer area section wrapper wrap container box block list item items link links bar row col column group panel text results thread".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Tags that a start tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that bound such closing.
SCOPE = {"ul", "ol", "dl", "table", "select", "menu", "body", "html", "article", "main", "div", "section"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_NAME = re.compile(r"[^\W_]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_SPACE = re.compile(r"\s+")


def named(role: str) -> int:
    """2 if a name in the classes, ids and roles of an element says comment or advert, 1 if it says menu,
    footer and the like, else 0."""
    found = 0
    for name in role.split():
        parts = set(_NAME.findall(name))
        if (words := parts & (NOISE_WORDS | HARD_WORDS)) and parts - words <= PARTS:
            found = max(found, 2 if words & HARD_WORDS else 1)
    return found


def attributes(rest: str) -> tuple[str, bool]:
    """The lower-cased class, id and role of a tag, and whether it is hidden."""
    role, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            role.append(value.lower())
        elif name == "hidden" and value.lower() != "until-found" or name == "style" and _UNSHOWN.search(value):
            hidden = True
    return " ".join(filter(None, role)), hidden


def blocks(page: str) -> list[tuple[tuple[int, ...], str, str, int, int]]:
    """(nodes, style, text, noise, article) of each text block in page order. nodes: keys of the elements
    that hold it, its own last; noise: 1 in a noise element, 2 in one that always goes; article: 1 in
    article or main, 2 in one that is a noise element or lies in one."""
    out: list[tuple[tuple[int, ...], str, str, int, int]] = []
    # name, nodes, noise, article
    stack: list[tuple[str, tuple[int, ...], int, int]] = [("", (_key(""),), 0, 0)]
    text: list[str] = []
    marks: list[str] = []
    inline: list[tuple[str, int]] = []
    hidden = 0  # open inline noise elements

    def flush():
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line:
                _, nodes, noise, article = stack[-1]
                out.append((nodes, ",".join(marks), line, noise, article))
            text.clear()
        marks.clear()

    at, n = 0, len(page)
    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            open_at = n
        if open_at > at and not hidden:
            piece = page[at:open_at]
            text.append(entities.unescape(piece) if "&" in piece else piece)
        if open_at == n:
            break
        after = page[open_at + 1 : open_at + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", open_at):
                end = page.find("-->", open_at + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
            continue
        found = _TAG.match(page, open_at) or _LOOSE.match(page, open_at)
        if not found:
            if (after.isalpha() or after == "/") and page.find(">", open_at) < 0:
                break  # a tag cut off at the end of the page
            if not hidden:
                text.append("<")
            at = open_at + 1
            continue
        at = found.end()
        closing, name, rest = found[1], found[2].lower(), found[3]
        if closing:
            if name in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        flush()
                        del stack[i:]
                        inline.clear()
                        hidden = 0
                        break
                else:
                    flush()
            elif hidden:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == name:
                        hidden -= sum(h for _, h in inline[i:])
                        del inline[i:]
                        break
            continue
        if name in RAW:
            if not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                end = n if close is None else close.start()
                if name == "xmp" and not hidden:
                    flush()
                    text.append(page[at:end])
                    flush()
                at = end
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            continue
        if name == "br":
            text.append(" ")
            continue
        role, unshown = attributes(rest) if rest and not rest.isspace() else ("", False)
        noise = 2 if unshown else max(int(name in NOISE), named(role) if role and name not in HEADINGS else 0)
        if name in BLOCK:
            flush()
            inline.clear()
            hidden = 0
            closes = CLOSES.get(name)
            if stack[-1][0] == "p" and name != "p" or name == "p":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPE or stack[i][0] in ("li", "td", "th", "blockquote"):
                        break
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPE:
                        break
            if name in VOID or rest.endswith("/"):
                continue
            _, nodes, was, article = stack[-1]
            if name == "header" and article and not unshown:  # an article's own header holds its title
                noise = named(" ".join(x for x in role.split() if "header" not in x))
            if name in ("html", "body", "main") and not unshown:
                noise = 0
            noise = max(was, noise)
            if name in MAIN and noise < 2:
                noise, article = 0, 2 if noise else article or 1
            above = nodes if len(nodes) < DEPTH else nodes[:-1]
            stack.append((name, (*above, _key(f"{above[-1]}/{name}.{role}")), noise, article))
        else:
            marks.append(name)
            if name not in VOID and not rest.endswith("/"):
                inline.append((name, int(noise > 0)))
                hidden += noise > 0
    flush()
    return out


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else (url or "")


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def roles(found: list[tuple[tuple[int, ...], str, str, int, int]]) -> list[int]:
    """The role of each block of a page: PLAIN, INSIDE an article, NOISY, or GONE whatever its importance."""
    marked = {article for _, _, _, noise, article in found if article and not noise}
    own = min(marked, default=0)  # articles in noise elements count where there is no other
    out = []
    for _, _, _, noise, article in found:
        if noise == 2:
            out.append(GONE)
        elif noise:
            out.append(NOISY if article == own else GONE)
        else:
            out.append(PLAIN if not article else INSIDE if article == own else GONE)
    return out


PARSED = "page_id long, url string, host string, digest long, nodes array<long>, whats array<long>, styles array<long>, roles array<int>, sizes array<int>, lower array<long>, upper array<long>, texts array<string>"


def parse(pages: DataFrame) -> DataFrame:
    """A row per page with its blocks as arrays; equal digests stand for equal blocks."""
    longs, ints, strings = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
    names = [part.split()[0] for part in PARSED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), longs, longs, longs, ints, ints, longs, longs, strings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = blocks(page.as_py() or "")
                digest = _key("\0".join(str(x) for path, style, text, noise, article in found for x in (path[-1], style, text, noise, article)))
                own, nodes = roles(found), [b[0][-1] for b in found]
                links = {(path[-1], x) for path in {b[0] for b in found} for x in path[:-1]}
                keys = [_key(b[2]) for b in found], [_key(b[1]) for b in found], own, [len(b[2]) for b in found]
                rows.append((page_id, url, host_of(url), digest, nodes, *keys, [x for x, _ in links], [x for _, x in links], ["" if role == GONE else b[2] for role, b in zip(own, found)]))
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, PARSED)


def counts(distinct: DataFrame) -> DataFrame:
    """(host, node, kind, what, n, size): on how many pages a node (kind 0, size: its characters), a text
    (1) or a style (2) at it stands, and with which node above it (3).

    Of a page come one row per node and distinct content, style or link, folded per batch; the tree is
    merged by aggregation alone, so a host with any number of pages is spread over the cluster.
    """
    ddl = "host string, node long, kind int, what long, n long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, int] = {}
            chars: dict[tuple, int] = {}
            for host, nodes, whats, styles, sizes, lower, upper in zip(*(c.to_pylist() for c in batch.columns)):
                seen = {(host, a, 3, b) for a, b in zip(lower, upper)}
                for node, what, style, size in zip(nodes, whats, styles, sizes):
                    own = (host, node, 0, 0)
                    chars[own] = chars.get(own, 0) + size
                    seen.update((own, (host, node, 1, what), (host, node, 2, style)))
                for item in seen:
                    total[item] = total.get(item, 0) + 1
            columns = list(zip(*total)) if total else [[]] * 4
            columns += [list(total.values()), [chars.get(item, 0) for item in total]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_type(ddl).types)], schema=arrow_type(ddl))

    rows = distinct.select("host", "nodes", "whats", "styles", "sizes", "lower", "upper").mapInArrow(run, ddl)
    return rows.groupBy("host", "node", "kind", "what").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def importances(seen: DataFrame) -> DataFrame:
    """(host, node, pages, importance, most) of every node with text of every host's style tree; most is
    the highest importance in its branch."""
    # a feature on n of m pages, once each, has the entropy log n / log m; styles are one distribution
    log = F.log(F.col("n").cast("double"))
    nodes = seen.filter("kind < 3").groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.max(F.when(F.col("kind") == 0, F.col("size"))).alias("chars"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * log)).alias("text_logs"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("styles"),
        F.sum(F.when(F.col("kind") == 2, F.col("n") * log)).alias("style_logs"),
    )
    m = F.log(F.col("pages").cast("double"))
    content = F.when(F.col("pages") > 1, 1 - F.col("text_logs") / F.col("texts") / m).otherwise(1.0)
    style = F.when(F.col("pages") > 1, (F.log(F.col("styles").cast("double")) - F.col("style_logs") / F.col("styles")) / m).otherwise(1.0)
    nodes = materialize(nodes.select("host", "node", "pages", "chars", content.alias("content"), F.least(style, F.lit(1.0)).alias("style")), "nodes")
    # a node's branch: itself and the nodes below it
    below = seen.filter("kind = 3").select("host", F.col("what").alias("top"), "node")
    branch = below.union(nodes.select("host", F.col("node").alias("top"), "node"))
    parts = branch.join(nodes, ["host", "node"]).groupBy("host", "top").agg((F.sum(F.col("chars") * F.col("content")) / F.sum("chars")).alias("branch"))
    tree = nodes.join(parts, (nodes.host == parts.host) & (nodes.node == parts.top)).select(nodes.host, nodes.node, "pages", (DECAY * F.col("branch") + (1 - DECAY) * F.col("style")).alias("importance"))
    tree = materialize(tree, "tree")
    most = branch.join(tree, ["host", "node"]).groupBy("host", F.col("top").alias("node")).agg(F.max("importance").alias("most"))
    return tree.join(most, ["host", "node"])


def posterior(role: int, importance: Column) -> Column:
    more = F.col("pages") - 1
    return (WORTH * PRIOR[role] + more * importance) / (WORTH + more)


def verdicts(seen: DataFrame) -> DataFrame:
    """(host, node, what, verdict) of nodes (what is 0) and texts that change what their role would do."""
    tree = importances(seen)
    of_node = F.when(posterior(PLAIN, F.col("most")) < LEAST, DROP_PLAIN).otherwise(0) + F.when(posterior(NOISY, F.col("importance")) >= LEAST, KEEP_NOISY).otherwise(0)
    nodes = tree.select("host", "node", F.lit(0).cast("long").alias("what"), of_node.alias("verdict"))
    # a text of one page has the importance 1
    own = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double"))
    texts = seen.filter("kind = 1 and n > 1").join(tree, ["host", "node"])
    of_text = F.when(posterior(PLAIN, own) < LEAST, DROP_PLAIN).otherwise(0) + F.when(posterior(INSIDE, own) < LEAST, DROP_INSIDE).otherwise(0)
    return nodes.union(texts.select("host", "node", "what", of_text.alias("verdict"))).filter("verdict <> 0")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    parsed = materialize(parse(pages), "parsed")
    # equal pages once, as hashes alone; a hot page is folded before it moves
    distinct = parsed.groupBy("host", "digest").agg(*[F.first(c).alias(c) for c in ("nodes", "whats", "styles", "roles", "sizes", "lower", "upper")])
    seen = materialize(counts(distinct), "seen")
    judged = materialize(verdicts(seen), "judged")
    # verdicts meet single blocks, so no list grows with a host; what comes back is as long as a page
    blocks_of = F.filter(F.arrays_zip("nodes", "whats", "roles"), lambda x: x["roles"] != GONE)
    asks = F.array(*map(F.lit, (DROP_PLAIN, 0, DROP_INSIDE, DROP_PLAIN | KEEP_NOISY)))  # by role

    def probe(what):
        return lambda x: F.struct(x["nodes"].alias("node"), what(x).alias("what"), F.get(asks, x["roles"]).alias("asks"))

    of_node = F.transform(F.filter(blocks_of, lambda x: x["roles"] != INSIDE), probe(lambda x: F.lit(0).cast("long")))
    probes = F.array_distinct(F.concat(of_node, F.transform(blocks_of, probe(lambda x: x["whats"]))))
    asked = distinct.select("host", "digest", F.explode(probes).alias("p")).select("host", "digest", "p.node", "p.what", "p.asks")
    told = asked.join(judged, ["host", "node", "what"]).filter(F.col("verdict").bitwiseAND(F.col("asks")) != 0)
    told = told.groupBy("host", "digest").agg(F.collect_set(F.struct("node", "what", "verdict")).alias("told"))
    told = materialize(told, "told")
    ddl = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for nodes, whats, kinds, texts, given in zip(*(c.to_pylist() for c in batch.columns[2:])):
                verdict = {(x["node"], x["what"]): x["verdict"] for x in given or ()}
                stays = [role != GONE and _stays(role, verdict.get((node, 0), 0), verdict.get((node, what), 0)) for node, what, role in zip(nodes, whats, kinds)]
                if not any(stays):
                    stays = [role in (PLAIN, INSIDE) for role in kinds]
                out.append("\n".join(text for text, stay in zip(texts, stays) if stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=arrow_type(ddl))

    return parsed.join(told, ["host", "digest"], "left").select("page_id", "url", "nodes", "whats", "roles", "texts", "told").mapInArrow(run, ddl)


def _stays(role: int, node: int, text: int) -> bool:
    if role == INSIDE:
        return not text & DROP_INSIDE
    return not (node | text) & DROP_PLAIN and (role == PLAIN or bool(node & KEEP_NOISY))
