"""Main text by template deduction.

Pages are read as tokens: tags with their structural path, and text blocks with
theirs. On each host, and among its pages of one structure, tokens with the same
occurrence vector over the distinct contents form an equivalence class. A class
that covers enough pages and nests with the structure belongs to the template;
texts in it are boilerplate. What remains fills the template's slots, one for
each path. A slot is the main text's or not as a whole: markup, links and length
on all pages of the template are evidence, summed over the pages, and the slot's
blocks on every page follow. Vectors are compared by a sum of page hashes
weighted by occurrences, which adds up in any order, so classes and evidence
come from one grouped aggregation whatever a host's size.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Share of a group's contents that a template class covers, and contents it needs at least.
COVER, LEAST_PAGES = 0.3, 3
#: Share that a page's own text has of itself and a template class.
DIFFER = 0.1
#: A slot is a menu if links hold this share of its text.
LINKED = 2 / 3

# Names of HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button", "object", "canvas", "math"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog"}
MAIN = {"article", "main"}
#: By a start tag: what it closes without an end tag, and what may lie open inside that
IMPLIED = {
    "li": ({"li"}, {"p"}), "option": ({"option"}, set()), "dt": ({"dt", "dd"}, {"p"}), "dd": ({"dt", "dd"}, {"p"}), "td": ({"td", "th"}, {"p"}), "th": ({"td", "th"}, {"p"}),
    "tr": ({"tr"}, {"td", "th", "p"}), **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"tr", "td", "th", "p"})),
}
# Class, id and role words of what is no main text
OUTSIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "replies", "social", "share", "sharing", "related", "recommended", "subscribe", "newsletter", "signup", "login", "search", "widget", "toolbar"}

# Of those, what marks an advert also on an inline element; words before which a mark says nothing of the element's text; tags whose marks are the page's
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo"}
NEGATIONS = {"no", "not", "non", "with", "without", "has", "have", "hide", "show"}
WHOLE_PAGE = {"html", "body"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Block:
    __slots__ = ("path", "text", "links", "outside", "main", "weak")

    def __init__(self, path: str, text: str, links: int, outside: bool, main: bool, weak: tuple[int, ...]):
        self.path, self.text, self.links, self.outside, self.main, self.weak = path, text, links, outside, main, weak


class _Open:
    __slots__ = ("name", "path", "outside", "main", "weak")

    def __init__(self, name: str, path: str, outside: bool, main: bool, weak: tuple[int, ...]):
        self.name, self.path, self.outside, self.main, self.weak = name, path, outside, main, weak


def _marks(attrs: str) -> tuple[list[str], set[str]]:
    """The class, id and role words, sorted; and the words they are made of, without those of a negated one (`no-comments`, `with-sidebar`)."""
    words = sorted({w for m in _MARK.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()})
    parts = [[x for x in _SPLIT.split(w) if x] for w in words]
    return words, {x for p in parts if p and p[0] not in NEGATIONS for x in p}


def read(html: str | None) -> tuple[list[Block], list[str]]:
    """The text blocks of a page in order, and its structural tags with their paths. Broken markup never fails.

    A block is outside if a tag around it says so (nav, footer) or a class word
    does; but class words of an element that holds the page's first article, or
    its main element, are void, as are those of html and body. Inline adverts
    are no text.
    """
    blocks: list[Block] = []
    tags: list[str] = []
    stack = [_Open("", "", False, False, ())]
    opened: Counter = Counter()  # by name, on the stack
    parts: list[str] = []
    void: set[int] = set()  # elements whose class words are void
    elements = articles = links = anchors = 0
    muted: list | None = None  # an inline advert: name, open elements of that name in it, height of the stack

    def close(k: int) -> None:
        nonlocal muted
        opened.subtract(x.name for x in stack[k:])
        del stack[k:]
        if muted and len(stack) < muted[2]:
            muted = None

    def flush() -> None:
        nonlocal links, anchors
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            top = stack[-1]
            blocks.append(Block(top.path, text, min(links, len(text)), top.outside, top.main, top.weak))
        links = anchors = 0

    page, at = html or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if m[4]:
            if not muted:
                parts.append(m[4])
                links += len(m[4]) if anchors else 0
        elif not name:
            continue
        elif name in RAW:
            if name in ("button", "title"):
                flush()
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else at if name in ("button", "object", "svg", "select") else len(page)
        elif name in INLINE:
            if muted:
                if name == muted[0]:
                    muted[1] += -1 if m[1] else 1
                    if not muted[1]:
                        muted = None
            elif name == "br":
                parts.append(" ")
            elif not m[1] and m[3] and name not in VOID and ADVERTS & set(_marks(m[3])[0]):
                muted = [name, 1, len(stack)]
            elif name == "a":
                anchors = 0 if m[1] else 1
        else:
            flush()
            if m[1]:
                if opened[name] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            else:
                if name in CLOSES_P and stack[-1].name == "p":
                    close(len(stack) - 1)
                ends, within = IMPLIED.get(name, ((), ()))
                k = len(stack) - 1
                while ends and stack[k].name in within:
                    k -= 1
                if stack[k].name in ends:
                    close(k)
                words, marks = _marks(m[3]) if m[3] else ([], set())
                top = stack[-1]
                path = f"{top.path}/{name}" + "".join("." + w for w in words)
                if len(path) > 1000:  # keeps the paths of deep pages short
                    path = f"#{_key(path)}"
                tags.append(path)
                if name not in VOID and not m[3].endswith("/"):
                    opened[name] += 1
                    elements += 1
                    weak = (*top.weak, elements) if marks & OUTSIDE_WORDS and name not in WHOLE_PAGE else top.weak
                    outside, main = top.outside or name in OUTSIDE, top.main or name in MAIN or "main" in marks
                    articles += name == "article"
                    if not outside and (name == "main" or (name == "article" and articles == 1)):
                        void.update(top.weak)
                    stack.append(_Open(name, path, outside, main, weak))
    flush()
    for x in blocks:
        x.outside = x.outside or any(e not in void for e in x.weak)
    return blocks, tags


def _key(x: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >= 1 << 63 else h


def _host_of(url: str | None) -> str:
    return (url or "").partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower()


def good(blocks: list[Block]) -> list[bool]:
    """What markup says of each block: neither outside, nor beside the element that a page marks as its main text."""
    marked = any(x.main for x in blocks if not x.outside)
    return [not x.outside and x.main == marked for x in blocks]


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """__id, __url, __host, structure, content, blocks, tokens of each row.

    structure is a hash of the set of tag paths; content is one of the blocks that aren't
    outside. blocks have their text's token and their path's. tokens are tags and text blocks
    with their counts: chars is the length of a text block that isn't outside, else 0; of a
    path, chars, links and good are the lengths of its blocks, of links in them (but in what
    markup calls the main text), and of those that markup is for.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    block_type = pa.struct([("token", pa.int64()), ("path", pa.int64()), ("text", pa.string())])
    token_type = pa.struct([("token", pa.int64()), ("is_text", pa.bool_()), ("n", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("good", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, structures, contents, chosen, tokens = [], [], [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                blocks, tags = read(html)
                keys = [_key(f"{x.path}\n{x.text}") for x in blocks]
                paths = {t: _key(t) for t in {*tags, ""}}
                chars = {k: 0 if x.outside else len(x.text) for k, x in zip(keys, blocks, strict=True)}
                slots: dict[str, list[int]] = {}
                for x, fit in zip(blocks, good(blocks), strict=True):
                    slot = slots.setdefault(x.path, [0, 0, 0])
                    slot[0] += len(x.text)
                    slot[1] += 0 if fit and x.main else x.links
                    slot[2] += len(x.text) if fit else 0
                hosts.append(_host_of(url))
                structures.append(_key("\n".join(sorted(set(tags)))) | 1)  # 0 stands for the whole host
                contents.append(_key(" ".join(str(k) for k, x in zip(keys, blocks, strict=True) if not x.outside)) >> 16)
                chosen.append([{"token": k, "path": paths[x.path], "text": x.text} for k, x in zip(keys, blocks, strict=True)])
                counts = Counter(tags)
                counts[""] = 1  # text outside all tags
                count = [dict(zip(("token", "is_text", "n", "chars", "links", "good"), (paths[t], False, n, *slots.get(t, (0, 0, 0))), strict=True)) for t, n in counts.items()]
                count += [{"token": k, "is_text": True, "n": n, "chars": chars[k], "links": 0, "good": 0} for k, n in Counter(keys).items()]
                tokens.append([{"token": 0, "is_text": False, "n": 1, "chars": 0, "links": 0, "good": 0}, *count])
            arrays = [pa.array(hosts, pa.string()), pa.array(structures, pa.int64()), pa.array(contents, pa.int64()), pa.array(chosen, pa.list_(block_type)), pa.array(tokens, pa.list_(token_type))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["__id", "__url", "__host", "structure", "content", "blocks", "tokens"])

    schema = f"__id {kinds[0]}, __url {kinds[1]}, __host string, structure bigint, content bigint, blocks array<struct<token: bigint, path: bigint, text: string>>, "
    schema += "tokens array<struct<token: bigint, is_text: boolean, n: bigint, chars: bigint, links: bigint, good: bigint>>"
    own = [F.col(f"`{c}`").alias(n) for c, n in ((id_col, "__id"), (url_col, "__url"), (html_col, "__html"))]
    return pages.select(*own).mapInArrow(work, schema)


def occurrences(rows: DataFrame) -> DataFrame:
    """__host, structure, token, is_text, pages, total, vector, chars, low, high and the sums text, links, good: each token's occurrences
    over a host's distinct contents (structure 0) and over those of each structure. Token 0 stands for the page itself; low and high are two of the contents."""
    page = F.struct("structure", F.xxhash64("tokens").alias("h"), "tokens")
    distinct = rows.groupBy("__host", "content").agg(F.min_by("tokens", page["h"]).alias("tokens"), F.min_by("structure", page["h"]).alias("structure"))
    each = distinct.select("__host", "content", F.explode(F.array(F.lit(0).cast("bigint"), "structure")).alias("structure"), "tokens").select("__host", "content", "structure", F.inline("tokens"))
    vector = F.sum(F.pmod(F.col("n") * F.pmod("content", F.lit(1 << 40)), F.lit(1 << 40)))
    return each.groupBy("__host", "structure", "token", "is_text").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), F.pmod(vector, F.lit(1 << 40)).alias("vector"), F.max("chars").alias("chars"), F.min("content").alias("low"), F.max("content").alias("high"),
        F.sum("chars").alias("text"), F.sum("links").alias("links"), F.sum("good").alias("good"),
    )


def _covering(seen: DataFrame) -> DataFrame:
    """Tokens on enough contents of their group. A content has a bounded number of distinct tokens, so a group of whatever size has at most 1 / COVER times their mean."""
    sizes = seen.where("token = 0").select("__host", "structure", F.col("pages").alias("group_pages"))
    return seen.where("token <> 0").join(sizes, ["__host", "structure"]).where(F.col("pages") >= COVER * F.col("group_pages"))


def templates(seen: DataFrame) -> DataFrame:
    """__host, structure, texts: the text tokens of the template of each host (structure 0) and of each structure on it.

    A class is the tokens of one occurrence vector. It is valid if it covers
    enough of the group's contents, nests (occurs as often as a structural class
    does or evenly on its pages), and the pages differ beside it: on two of them
    text found on fewer than LEAST_PAGES contents of the host is at least the
    share DIFFER of that text and the class together. Near copies fail that.
    """
    wide = _covering(seen).where(F.col("pages") >= LEAST_PAGES)
    texts = F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("texts")
    chars = F.sum(F.when(F.col("is_text"), F.col("chars")).otherwise(0)).alias("chars")
    classes = wide.groupBy("__host", "structure", "pages", "total", "vector", "low", "high").agg(texts, F.max((~F.col("is_text")).cast("int")).alias("tagged"), chars)
    nested = classes.where((F.size("texts") > 0) & ((F.col("tagged") == 1) | (F.col("total") % F.col("pages") == 0)))
    rare = seen.where((F.col("structure") == 0) & F.col("is_text") & (F.col("chars") > 0) & (F.col("pages") < LEAST_PAGES))
    own = rare.select("__host", "chars", F.explode(F.array_distinct(F.array("low", "high"))).alias("content")).groupBy("__host", "content").agg(F.sum("chars").alias("own"))
    for end in ("low", "high"):
        nested = nested.join(own.withColumnsRenamed({"content": end, "own": f"own_{end}"}), ["__host", end], "left")
    least = F.least(*(F.coalesce(f"own_{end}", F.lit(0)) for end in ("low", "high")))
    valid = nested.where(least >= DIFFER * (least + F.col("chars")))
    return valid.groupBy("__host", "structure").agg(F.flatten(F.collect_list("texts")).alias("texts"))


def slots(seen: DataFrame) -> DataFrame:
    """__host, structure, kept, dropped: the paths whose text is the main text's, and the others.

    On the whole host only paths of LEAST_PAGES contents up that cover enough of
    them are slots; within a structure, each path with text is one, so a page
    alone is a template of its own. Evidence is summed over the contents: markup
    has to be for half of the slot's characters, and a slot full of links is a
    menu where three contents or more show it.
    """
    wide = _covering(seen).where(~F.col("is_text") & (F.col("text") > 0) & ((F.col("structure") != 0) | (F.col("pages") >= LEAST_PAGES)))
    fits = (2 * F.col("good") > F.col("text")) & ((F.col("links") < LINKED * F.col("text")) | (F.col("pages") < LEAST_PAGES))
    pick = lambda what: F.collect_list(F.when(what, F.col("token")))
    return wide.groupBy("__host", "structure").agg(pick(fits).alias("kept"), pick(~fits).alias("dropped"))


def main_text(html: str | None, boilerplate: set[int]) -> str:
    """The main text of a page that is a template of its own, without boilerplate."""
    blocks = read(html)[0]
    return "\n\n".join(x.text for x, fit in zip(blocks, good(blocks), strict=True) if fit and _key(f"{x.path}\n{x.text}") not in boilerplate)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars.

    Null and empty html give an empty text. Urls without a host share the host
    ''. Pages with the same content count once. The host's slots decide, where
    they are many enough, else those of the page's structure. Rows stay one for
    one. Templates are joined by host and by structure; Spark broadcasts them only
    if they are small, and splits a hot host otherwise; their arrays are bounded
    by the tokens of a page, not by the host.
    """
    small_batches(pages.sparkSession)
    rows = parsed(pages, id_col, url_col, html_col)
    seen = written(occurrences(rows.select("__host", "structure", "content", "tokens")), "occurrences")
    found = written(slots(seen).join(templates(seen), ["__host", "structure"], "full"), "templates")
    names = ("texts", "kept", "dropped")
    whole = found.where("structure = 0").select("__host", *(F.col(c).alias(f"host_{c}") for c in names))
    joined = rows.drop("content", "tokens").join(whole, "__host", "left").join(found.where("structure <> 0"), ["__host", "structure"], "left")
    has = lambda column, x: F.coalesce(F.array_contains(column, x), F.lit(False))
    fits = lambda x: has("host_kept", x["path"]) | (~has("host_dropped", x["path"]) & has("kept", x["path"]))
    main = F.filter("blocks", lambda x: fits(x) & ~has("host_texts", x["token"]) & ~has("texts", x["token"]))
    text = F.array_join(F.transform(main, lambda x: x["text"]), "\n\n")
    return joined.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
