"""Main text of web pages by template deduction from the pages of a host.

Each page is read once, as a sequence of tokens: its elements at their tag paths, and its text blocks at theirs. Over a host's different
pages, tokens with the same occurrence vector (how often they occur in which page; kept as a sum of page hashes, which equal vectors
share) form an equivalence class. A class is valid if it has CLASS_TOKENS tokens and LEAST_PAGES pages at least, if its tokens come in one
order on every page, and if on every page it lies in one slot of the class around it, which must be valid itself. The valid classes, nested
so, are the host's template; pages of several layouts give classes of their own. Texts of the template that stand on a good share of the
pages that have the element around them are not content; what stands in the slots is extracted, if the slot is of the article and not of
a menu, header, footer, sidebar, notice, advert, form or comments.

What a slot is, elements say first. Names in class, id and role count only where all parts of a name say so ("cookie-notice", not
"no-sidebar"), never for an element that holds the article, and within an article only for containers: a heading or paragraph there goes
only if it is mostly links too.

Occurrence vectors are aggregated, so a host of any size is never gathered in one place; equal pages count once.

Defined results: null and empty html give an empty text; html may be cut off or unbalanced anywhere (an inline element is looked for
through INLINE_DEPTH open ones, a limit of reading, not of content); a null url has the empty host; a page of a host without others is
read without a template; repeated rows are extracted each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, hinted, shared_dir, table, written

#: Tokens and pages that a class has at least, and the share of the pages with the element around it on which a text of the template stands.
CLASS_TOKENS, LEAST_PAGES, SHARE = 2, 4, 0.5
#: Template texts up to which the template is sent to every executor, and rows up to which other small tables are; more are joined by a shuffle.
BROADCAST_TOKENS, BROADCAST_ROWS = 200_000, 1_000_000

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math)\b(?P<rawattrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")

#: Elements by what they are (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NO_CONTENT = frozenset("head nav footer aside button select option datalist menu dialog audio video canvas object title".split())
FORMS = frozenset("form fieldset".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
CLOSES_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Parts of a class, id or role that say that an element is no content, and parts that may stand beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup login "
    "share sharing social sidebar related recommended recommendations comment comments commentlist reply replies respond disqus discussion breadcrumb breadcrumbs menu menubar nav navbar "
    "navigation footer masthead popup modal overlay pagination pager toolbar complementary contentinfo banner outbrain taboola".split()
)
NEUTRAL = frozenset("box block wrap wrapper container list area section bar button buttons link links widget top bottom left right inner outer main page site item items thread form slot unit panel primary secondary 1 2 3".split())
HEADERS = frozenset("header topbar".split())
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post|post-?body|post-?content|entry|entry-?content|main|main-?content|story|content)(?:$|[\s_-])", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W_A-Z]+")


def says(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names consists of words, or of words and neutral parts."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if any(p in words for p in parts) and all(p in words or p in NEUTRAL for p in parts):
            return True
    return False


#: Open inline elements through which an element is looked for that a new one closes.
INLINE_DEPTH = 64


class Block(NamedTuple):
    """A run of text without a block border in it."""

    token: int
    text: str
    links: int  # code points of it that are links
    element: int  # number of the element around it, in page order
    doubtful: bool  # only its name speaks against it


class Token(NamedTuple):
    """A token of a page; above is the token of the element around it."""

    token: int
    above: int
    text: bool
    n: int
    first: int
    last: int


class Page(NamedTuple):
    tokens: list[Token]  # the distinct ones
    blocks: list[Block]  # those that may be content
    parents: list[int] | None  # of each element the one around it (which is smaller; the page itself is 0); None if there is an article


class _Open(NamedTuple):
    tag: str
    path: int
    element: int


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _hash(*parts: object) -> int:
    raw = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


#: What speaks against an element: what it is; that it is a form, or its name; its name, where it is a leaf; that it is a header.
_ELEMENT, _NAME, _LEAF, _HEADER = 1, 2, 3, 4


def read(source: str | None) -> Page:
    """The tokens of a page and its blocks that may be content. The time is linear in the page's length."""
    out: list[tuple[int, str, int, int]] = []  # token, text, links, element
    parents, flags, kinds = [0], [0], [0]  # of each element; kind: 2 an article, 1 named so
    order: list[tuple[int, int, bool]] = []
    stack = [_Open("", 0, 0)]
    count: dict[str, int] = {}
    paths: dict[tuple[int, str, str], int] = {}
    parts: list[str] = []
    links = 0

    def end() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                top = stack[-1]
                token = _hash(top.path, text)
                out.append((token, text, min(links, len(text)), top.element))
                order.append((token, top.path, True))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        for x in stack[k:]:
            count[x.tag] -= 1
        del stack[k:]

    def upwards():
        """Places in the stack from the top, through inline elements up to the first other."""
        for k in range(len(stack) - 1, max(0, len(stack) - 1 - INLINE_DEPTH), -1):
            yield k
            if stack[k].tag not in INLINE:
                return

    for m in _TOKEN.finditer(source or ""):
        text = m["text"]
        if text is not None:
            if count.get("a"):
                links += len(text.strip())
            parts.append(text)
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            end()
        if m["close"] or m["close2"]:
            if count.get(tag):
                places = upwards() if tag in INLINE else range(len(stack) - 1, 0, -1)  # an inline element ends no block
                k = next((k for k in places if stack[k].tag == tag), 0)
                if k:
                    close(k)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            ends = CLOSES_ITSELF.get(tag, ()) + (("p",) if tag in BLOCKS else ())
            k = next((k for k in upwards() if stack[k].tag in ends), 0)
            if k:
                close(k)
        top = stack[-1]
        raw = m["attrs"] or m["attrs2"]
        own = _attributes(raw) if raw else {}
        names = f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".strip() if own else ""
        flag = kind = 0
        if tag in NO_CONTENT or own and ("hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()):
            flag = _ELEMENT
        elif tag == "header" or names and says(names, HEADERS):
            flag = _HEADER
        elif tag in FORMS or names and tag not in ("html", "body", "main") and says(names, BOILERPLATE):
            flag = _LEAF if tag in LEAVES else _NAME
        if tag in ("article", "main"):
            kind = 2
        elif names and tag in ("div", "section", "td") and _ARTICLE.search(names):
            kind = 1
        path = top.path
        if tag not in INLINE:
            key = (path, tag, names)
            path = paths.get(key) or paths.setdefault(key, _hash(*key))
            order.append((path, top.path, False))
        stack.append(_Open(tag, path, len(parents)))
        parents.append(top.element)
        flags.append(flag)
        kinds.append(kind)
        count[tag] = count.get(tag, 0) + 1
    end()
    tokens: dict[int, Token] = {}
    for k, (token, above, is_text) in enumerate(order):
        was = tokens.get(token)
        tokens[token] = Token(token, above, is_text, 1, k, k) if was is None else was._replace(n=was.n + 1, last=k)
    found, article = _content(out, parents, flags, kinds)
    return Page(list(tokens.values()), found, None if article else parents)


def _content(out: list[tuple[int, str, int, int]], parents: list[int], flags: list[int], kinds: list[int]) -> tuple[list[Block], bool]:
    """The blocks that may be content, and whether they are those of an article."""

    def kept(level: int, exempt: list[bool] | None) -> list[Block]:
        """Blocks not in boilerplate and, from level 1 on, in an article of that kind. exempt: elements whose name doesn't count."""
        inside, bad, doubtful = [False] * len(parents), [False] * len(parents), [False] * len(parents)
        for e in range(1, len(parents)):
            p, flag = parents[e], flags[e]
            article = inside[p] or kinds[e] > 0
            inside[e] = inside[p] or level > 0 and kinds[e] >= level
            named = flag == _NAME or flag == _LEAF and not article
            bad[e] = bad[p] or flag == _ELEMENT or flag == _HEADER and not inside[p] or named and not (exempt and exempt[e])
            doubtful[e] = doubtful[p] or flag == _LEAF
        return [Block(t, text, links, e, doubtful[e]) for t, text, links, e in out if not bad[e] and (inside[e] or not level)]

    size = [0] * len(parents)
    for _, text, _, e in out:
        size[e] += len(text)
    for e in range(len(parents) - 1, 0, -1):
        size[parents[e]] += size[e]
    for level in (2, 1):
        if max(kinds) < level:
            continue
        if found := kept(level, None):
            return found, True
        # every article stands in what is named so: the name of what holds the largest one doesn't count
        holds = [False] * len(parents)
        e = max((e for e, k in enumerate(kinds) if k >= level), key=lambda e: size[e])
        while e:
            holds[e] = True
            e = parents[e]
        if found := kept(level, holds):
            return found, True
    if found := kept(0, None):
        return found, False
    # all of it stands in what is named so: what holds most of the text is the page itself
    return kept(0, [2 * n > size[0] for n in size]), False


def chosen(blocks: list[Block], parents: list[int] | None, constant: frozenset[int] | set[int] = frozenset()) -> str:
    """The text in content slots: the blocks of the article, or all in the smallest element that holds every block which is not mostly links."""
    kept = [b for b in blocks if b.token not in constant and not (b.doubtful and 2 * b.links >= len(b.text))]
    prose = [b.element for b in kept if len(b.text) > 2 * b.links]
    if parents is not None and prose:
        holds = [0] * len(parents)
        for e in prose:
            holds[e] += 1
        for e in range(len(parents) - 1, 0, -1):
            holds[parents[e]] += holds[e]
        best = max(e for e, n in enumerate(holds) if n == len(prose))
        below = [e == best for e in range(len(parents))]
        for e in range(best + 1, len(parents)):
            below[e] = below[parents[e]]
        kept = [b for b in kept if below[b.element]]
    return "\n\n".join(b.text for b in kept)


def main_text(source: str | None, constant: frozenset[int] | set[int] = frozenset()) -> str:
    page = read(source)
    return chosen(page.blocks, page.parents, constant)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_TOKENS = "array<struct<token: long, above: long, text: boolean, n: int, first: int, last: int>>"
_PARSED = f"uid long, page_id string, url string, host string, same binary, tokens {_TOKENS}, blocks array<struct<token: long, text: string, links: int, element: int, doubtful: boolean>>, parents array<int>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pages = [read(s) for s in pdf["html"]]
        same = [hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in pdf["html"]]
        yield pd.DataFrame(
            {"uid": pdf["uid"], "page_id": pdf["page_id"], "url": pdf["url"], "host": pdf["host"], "same": same, "tokens": [[t._asdict() for t in p.tokens] for p in pages],
             "blocks": [[b._asdict() for b in p.blocks] for p in pages], "parents": [p.parents for p in pages]}
        )


def parsed(pages: DataFrame, folder: str) -> DataFrame:
    """Every page (page_id, url, html), read; uid tells rows apart."""
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("string").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return written(rows.mapInPandas(_parse, _PARSED), "parsed", folder)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """host, class, order (hash of its tokens in the page's order), parent (class around it; null at the top), nested (whether it lies in one slot of that): a row for each class of each page."""
    for pdf in batches:
        rows = []
        for host, own in zip(pdf["host"], pdf["own"], strict=True):
            own = sorted(own, key=lambda t: t["first"])
            by: dict[int, list] = {}
            at = {t["token"]: t for t in own}
            for t in own:
                by.setdefault(t["class"], []).append(t)
            for c, tokens in by.items():
                low, high = tokens[0]["first"], max(t["last"] for t in tokens)
                around = at.get(tokens[0]["above"])
                while around is not None and around["class"] == c:
                    around = at.get(around["above"])
                parent = None if around is None else around["class"]
                inside = parent is None or not any(low < t[k] < high for t in by[parent] for k in ("first", "last"))
                rows.append((host, c, _hash(*[t["token"] for t in tokens]), parent, inside))
        names = ["host", "class", "order", "parent", "nested"]
        values = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in names}
        yield pd.DataFrame(values | {"parent": pd.array(values["parent"], "Int64")})  # as whole numbers, though some are null


def template(pages: DataFrame, folder: str | None = None, share: float = SHARE, least: int = LEAST_PAGES, size: int = CLASS_TOKENS) -> DataFrame:
    """host, token, text, class, parent, pages, constant: the tokens of each host's valid equivalence classes, and which of them are no content.

    pages: what parsed() gives."""
    folder = folder or shared_dir(pages.sparkSession)
    full = pages.where("size(tokens) > 0")
    # equal pages of a host count once
    copies = full.groupBy("host", "same").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = full.select("host", "same", "uid").join(hinted(written(copies.withColumnRenamed("uid", "first"), "copies", folder), BROADCAST_ROWS), ["host", "same"]).where("uid <> first").select("uid")
    once = full.join(hinted(written(again, "again", folder), BROADCAST_ROWS), "uid", "left_anti").select("host", "uid", "tokens")
    tokens = once.select("host", "uid", F.inline("tokens"))
    vector = F.sum(F.xxhash64("uid", "n").cast("decimal(38,0)"))
    stats = tokens.groupBy("host", "token", "above", "text").agg(F.count(F.lit(1)).alias("pages"), vector.alias("vector")).where(F.col("pages") >= least)
    stats = stats.select("host", "token", "above", "text", "pages", F.xxhash64("vector", "pages").alias("class"))
    stats = written(stats, "stats", folder)
    large = stats.groupBy("host", "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).select("host", "class")
    found = written(stats.join(large, ["host", "class"], "left_semi"), "found", folder)
    own = tokens.join(hinted(found.select("host", "token", "class"), BROADCAST_ROWS), ["host", "token"])
    own = own.groupBy("host", "uid").agg(F.collect_list(F.struct("token", "above", "class", "first", "last")).alias("own")).select("host", "own")
    each = own.mapInPandas(_classes, "host string, class long, order long, parent long, nested boolean")
    judged = each.groupBy("host", "class").agg(
        F.min("order").alias("o"), F.max("order").alias("p"), F.min("nested").alias("nested"), F.min("parent").alias("parent"), F.max("parent").alias("last"), F.count("parent").alias("n"), F.count(F.lit(1)).alias("all")
    )
    ordered = written(judged.where("o = p AND nested AND parent <=> last AND n IN (0, all)").select("host", "class", "parent"), "ordered", folder)
    around = ordered.select("host", F.col("class").alias("parent"))
    valid = ordered.where("parent IS NULL").unionByName(ordered.join(around, ["host", "parent"], "left_semi").select("host", "class", "parent"))
    above = stats.where("NOT text").select("host", F.col("token").alias("above"), F.col("pages").alias("there"))
    out = found.join(valid, ["host", "class"]).join(above, ["host", "above"], "left")
    constant = F.col("text") & (F.col("pages") >= share * F.coalesce("there", "pages"))
    return written(out.select("host", "token", "text", "class", "parent", "pages", constant.alias("constant")), "template", folder)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession)
    rows = columns(pages, page_id=id_col, url=url_col, html=html_col)
    kind = rows.schema["page_id"].dataType
    own = parsed(rows, folder)
    constant = template(own, folder).where("constant").select("host", "token")
    known: dict[str, set[int]] = {}
    if constant.count() <= broadcast_tokens:
        for r in constant.toLocalIterator():
            known.setdefault(r.host, set()).add(r.token)
        own = own.withColumn("gone", F.lit(None).cast("array<long>"))
    else:  # block by block, so that a large host's template goes with no page
        said = own.select("uid", "host", F.explode("blocks.token").alias("token")).distinct().join(constant, ["host", "token"], "left_semi")
        own = own.join(said.groupBy("uid").agg(F.collect_set("token").alias("gone")), "uid", "left")
    shared = spark.sparkContext.broadcast({host: frozenset(t) for host, t in known.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none: frozenset[int] = frozenset()
        for pdf in batches:
            text = []
            for host, blocks, parents, gone in zip(pdf["host"], pdf["blocks"], pdf["parents"], pdf["gone"], strict=True):
                own = [Block(b["token"], b["text"], b["links"], b["element"], b["doubtful"]) for b in blocks]
                text.append(chosen(own, None if parents is None else list(parents), shared.value.get(host, none) if gone is None else set(gone)))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    out = own.select("page_id", "url", "host", "blocks", "parents", "gone").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
