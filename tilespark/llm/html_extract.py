"""Operator 9: main text of web pages by wrappers, union-free regular expressions inferred for each host."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, join_counted, materialize, replace_columns, table

# Elements of HTML by the part that they play, and words of class, id and role that name boilerplate.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select button title datalist audio video".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus reply replies respond widget widgets toolbar pagination pager login search skip alert paywall topbar".split())
HEADER_WORDS = frozenset("header masthead".split())
COMMENT_HEADS = frozenset("comments comment kommentare kommentar comentarios comentario commentaires commentaire".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}

#: Share of the text that a container must hold where no element is marked as the article, most share of link text
#: in a slot of it, pages of a host from which on text that never changes counts as part of its wrapper.
CONTAINER, LINKS, CONSTANT_PAGES = 0.7, 0.5, 5
#: Longest repeated group, in slots. Wrappers of all hosts are broadcast up to this size.
GROUP, BROADCAST_BYTES = 8, 16 << 20
#: Open elements that a path names, the outermost ones; structures of pages that a task keeps before it aligns them;
#: wrappers of a host that are aligned by one task.
DEPTH, STRUCTURES, FAN_IN = 64, 500, 64

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"h[1-6]\b")
_LEAF = re.compile(r"(p|li|h[1-6]|blockquote|pre|td|tr|dd|dt)\b")


def _element(name: str, attrs: str) -> tuple[str, bool, bool]:
    """(key of an element in a path, whether it is boilerplate, whether it holds the main text)."""
    words: list[str] = []
    if attrs:
        for m in _ATTR.finditer(attrs):
            words += [w.lower() for w in _WORDS.findall(m[2] or m[3] or m[4] or "")]
    boiler = name in BOILER_TAGS or not BOILER_WORDS.isdisjoint(words)
    if name == "header" or not HEADER_WORDS.isdisjoint(words):
        name = f"header~{name}" if name != "header" else name
    main = name in ("article", "main") or {"article", "body"} <= set(words) or "main" in words
    return f"{name}.{'.'.join(sorted(set(words)))[:60]}" if words else name, boiler, main


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags of a page, and comments and declarations under the name ''.

    One pass: a tag ends at the first `>` outside quotes. The first tag that has none ends at its first `>`, and so do
    all after it, as its quotes don't match; `<` without any `>` behind it, or without a name, is text.
    """
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    while 0 <= (start := page.find("<", at)):
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        name = _NAME.match(page, start + 1)
        if start > last:
            return
        if not name:
            if page[start + 1] in "!?":
                at = page.find(">", start) + 1
                yield start, at, "", False, ""
            else:
                at = start + 1
            continue
        end = name.end()
        while quotes:
            m = _STOP.search(page, end)
            if m is None or (m[0] != ">" and (close := page.find(m[0], m.end())) < 0):
                quotes = False
            elif m[0] == ">":
                end = m.start()
                break
            else:
                end = close + 1
        if not quotes:
            end = page.find(">", name.end())
        at = end + 1
        yield start, at, name[0].lstrip("/").lower(), name[0][0] == "/", page[name.end() : end]


def blocks(page: str | None) -> list[tuple[str, bool, str, int]]:
    """(path, boilerplate, text, length of link text) of every text block of a page, in page order."""
    out: list[tuple[str, bool, str, int]] = []
    stack: list[tuple[str, str, bool]] = []  # (name, path, boilerplate here or above)
    count: dict[str, int] = {}  # open elements by name
    buffer: list[str] = []
    links = [0, 0]  # characters within links, open links
    page = page or ""

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((*(stack[-1][1:] if stack else ("", False)), text, links[0]))
        links[0] = 0

    def close(depth: int) -> None:
        for s in stack[depth:]:
            count[s[0]] -= 1
        del stack[depth:]

    at = 0
    for start, end, name, closing, attrs in tags(page):
        if start < at:
            continue
        if start > at:
            buffer.append(page[at:start])
            if links[1]:
                links[0] += start - at
        at = end
        if not name:
            continue
        if name in SILENT and not closing:
            if not attrs.rstrip().endswith("/"):
                found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = found.end() if found else len(page)
            if name not in INLINE:
                buffer.append(" ")
            continue
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            elif name == "a":
                links[1] = max(0, links[1] + (-1 if closing else 1))
            if closing or name in VOID or not attrs or not _element(name, attrs)[1]:
                if not (closing and count.get(name)):
                    continue
        flush()
        if closing:
            if count.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            links[1] = 0
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in CLOSES and any(count.get(x) for x in CLOSES[name]):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in SCOPES[name]:
                    break
                if stack[depth][0] in CLOSES[name]:
                    close(depth)
                    break
        if not attrs.rstrip().endswith("/"):
            key, boiler, main = _element(name, attrs)
            path, above = stack[-1][1:] if stack else ("", False)
            if name == "header" or key.startswith("header~"):
                boiler = boiler or not (path.startswith("*") or "/*" in path)
            if len(stack) < DEPTH:
                key = f"*{key}" if main and not boiler else key
                path = f"{path}/{key}" if stack else key
            stack.append((name, path, above or boiler))
            count[name] = count.get(name, 0) + 1
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- wrappers
# A wrapper is a list of nodes [keys, repeated, optional, pages, characters, link characters, constant texts];
# keys is a tuple of slot paths: one for a slot, more for a repeated group. Constant texts are those that all pages which
# have the node hold in it, as (number of the key, hash, length); a node without any is a text slot.
def fold(page: list[tuple[str, bool, str, int]]) -> list[list]:
    """Nodes of one page: tandem repeats of slots become repeated groups."""
    keys = [f"!{p}" if b else p for p, b, _, _ in page]
    nodes: list[list] = []
    i = 0
    while i < len(keys):
        size, times = 1, 1
        for s in range(1, GROUP + 1):
            n = 1
            while keys[i : i + s] == keys[i + n * s : i + (n + 1) * s] and i + (n + 1) * s <= len(keys):
                n += 1
            if n > 1 and (times == 1 or n * s > size * times):
                size, times = s, n
        own = page[i : i + size * times]
        texts = sorted({(j % size, _hash(x[2]), len(x[2])) for j, x in enumerate(own)})
        nodes.append([tuple(keys[i : i + size]), times > 1, False, 1, sum(len(x[2]) for x in own), sum(x[3] for x in own), texts])
        i += size * times
    return nodes


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _both(a: list, b: list) -> list:
    """Texts that both lists hold."""
    return a if a == b else [x for x in a if x in set(b)]


def _unify(a: list, b: list) -> list:
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] + b[4], a[5] + b[5], _both(a[6], b[6])]


def _refold(nodes: list[list], groups: list[tuple]) -> list[list]:
    """Runs of slots that are a group elsewhere become one occurrence of it."""
    for group in groups:
        i = 0
        while i + len(group) <= len(nodes):
            run = nodes[i : i + len(group)]
            if tuple(k for n in run for k in n[0]) == group and all(len(n[0]) == 1 for n in run):
                nodes[i : i + len(group)] = [[group, False, any(n[2] for n in run), run[0][3], sum(n[4] for n in run), sum(n[5] for n in run), [(j, *t[1:]) for j, n in enumerate(run) for t in n[6]]]]
            i += 1
    return nodes


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers: equal nodes unify (texts that differ become slots), others become optional."""
    if not a or not b:
        return a or b
    a = _refold(list(a), [n[0] for n in b if len(n[0]) > 1])
    b = _refold(list(b), [n[0] for n in a if len(n[0]) > 1])
    out: list[list] = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [n[0] for n in a], [n[0] for n in b], autojunk=False).get_opcodes():
        if tag == "equal":
            out += [_unify(x, y) for x, y in zip(a[i1:i2], b[j1:j2])]
        else:
            out += [[*n[:2], True, *n[3:]] for n in a[i1:i2] + b[j1:j2]]
    # the same optional node twice in a row is one that repeats
    folded: list[list] = []
    for n in out:
        if folded and folded[-1][0] == n[0] and n[2] and folded[-1][2]:
            last = folded[-1]
            folded[-1] = [n[0], True, True, last[3] + n[3], last[4] + n[4], last[5] + n[5], _both(last[6], n[6])]
        else:
            folded.append(n)
    return folded


def _containers(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[: i + 1]) for i in range(len(parts))]


def roles(wrapper: list[list], pages: int) -> tuple[str | None, frozenset]:
    """(path of the element that holds the main text, texts that belong to the wrapper itself, with their paths).

    On a host of enough pages, text that nearly all pages hold in a node is the wrapper's own wherever it stands, and
    the main text lies where the text that changes does. A marked element decides where it holds most of that text.
    """
    fixed = frozenset((n[0][j], h) for n in wrapper if pages >= CONSTANT_PAGES and n[3] >= 0.9 * pages for j, h, _ in n[6])
    chars_of: dict[str, float] = {}
    order: list[str] = []
    for keys, _, _, _, chars, link, own in wrapper:
        constant = sum(size for j, h, size in own if (keys[j], h) in fixed) * pages
        rest = max(0, chars - link - constant)
        for key in keys:
            if key.startswith("!") or link > LINKS * chars or not rest:
                continue
            chars_of[key] = chars_of.get(key, 0) + rest / len(keys)
            order.append(key)
    if not chars_of:
        # nothing changes: one page again and again, or too few pages; then nothing is the wrapper's own
        return (None, frozenset()) if not fixed else roles(wrapper, 0)
    size: dict[str, float] = {}
    for key, own in chars_of.items():
        for c in _containers(key):
            size[c] = size.get(c, 0) + own
    total = sum(chars_of.values())
    marked = [c for c in size if c.rsplit("/", 1)[-1].startswith("*") and size[c] >= 0.5 * total]
    if marked:
        # the innermost marked element of nearly all marked text: an article in a main element
        most = max(size[c] for c in marked)
        place = max((c for c in marked if size[c] >= 0.9 * most), key=lambda c: (c.count("/"), size[c]))
        return place, fixed
    place = max((c for c in size if size[c] >= CONTAINER * total), key=lambda c: (c.count("/"), size[c]), default="")
    last = place.rsplit("/", 1)
    if len(last) > 1 and _LEAF.match(last[1]):
        place = last[0]
    # a heading of the article may stand before the element of its text
    while "/" in place:
        up = place.rsplit("/", 1)[0]
        beside = [k for k in chars_of if k.startswith(f"{up}/") and not (k == place or k.startswith(f"{place}/"))]
        if not beside or not all(_HEADING.match(k.rsplit("/", 1)[-1]) for k in beside):
            break
        place = up
    return place, fixed


def extract(page: list[tuple[str, bool, str, int]], place: str | None, fixed: frozenset) -> str:
    """Texts of the blocks that lie in the main element, in page order, without the wrapper's own."""
    if place is None or not any(p == place or p.startswith(f"{place}/") for p, b, _, _ in page if not b):
        place, _ = roles(fold(page), 1)
        if place is None:
            return ""
    out, comments = [], None
    marked = place.rsplit("/", 1)[-1].startswith("*")
    for path, boiler, text, link in page:
        if boiler or not (path == place or path.startswith(f"{place}/") or not place):
            continue
        depth = path.rsplit("/", 1)
        if comments is not None and path.startswith(comments):
            continue
        if _HEADING.match(depth[-1]) and text.lower().strip(":0123456789 ()") in COMMENT_HEADS:
            comments = f"{depth[0]}/" if depth[0] != place else f"{place}/"
            continue
        if (fixed and (path, _hash(text)) in fixed) or (not marked and link > LINKS * len(text)):
            continue
        out.append(text)
    return "\n".join(out)


def _pack(wrapper: list[list], pages: int) -> str:
    return json.dumps([pages, wrapper], ensure_ascii=False)


def _open(packed: str) -> tuple[int, list[list]]:
    pages, wrapper = json.loads(packed)
    return pages, [[tuple(n[0]), *n[1:6], list(map(tuple, n[6]))] for n in wrapper]


class _Hosts:
    """Wrappers of the hosts of one task. A structure seen before only adds its counts to the nodes that it met."""

    def __init__(self):
        self.known: dict[str, tuple[int, list[list]]] = {}
        self.seen: dict[tuple, list[list]] = {}

    def add(self, host: str, page: list) -> None:
        nodes = fold(page)
        key = (host, tuple((n[0], n[1]) for n in nodes))
        if key in self.seen:
            self.seen[key] = [[a[0], a[1], a[2], a[3] + b[3], a[4] + b[4], a[5] + b[5], _both(a[6], b[6])] for a, b in zip(self.seen[key], nodes)]
        else:
            self.seen[key] = nodes

        if len(self.seen) >= STRUCTURES:
            self.settle()

    def settle(self) -> None:
        """Align the structures that were met to their hosts' wrappers, so that a task keeps a bounded number of them."""
        for (host, _), nodes in self.seen.items():
            pages, wrapper = self.known.get(host, (0, []))
            more = max((n[3] for n in nodes), default=0)
            self.known[host] = pages + more, align(wrapper, nodes) if pages else nodes
        self.seen = {}

    def rows(self) -> list[tuple[str, str]]:
        self.settle()
        return [(h, _pack(w, n)) for h, (n, w) in self.known.items()]


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, n, wrapper): of all pages of every host, n the pages with text. Tasks align their own pages, then the wrappers
    of FAN_IN tasks are aligned at a time until one is left, so no task sees more of a host with very many pages."""

    def first(batches):
        hosts = _Hosts()
        at = TaskContext.get().partitionId()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if page.as_py():
                    hosts.add(host, blocks(page.as_py()))
        rows = hosts.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([at] * len(rows), pa.int32()), pa.array([r[1] for r in rows])], names=["host", "at", "wrapper"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pages, wrapper = 0, []
        for packed in pdf.sort_values("at")["wrapper"]:
            n, w = _open(packed)
            pages, wrapper = pages + n, align(wrapper, w) if pages else w
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "at": [int(pdf["at"].min()) // FAN_IN], "wrapper": [_pack(wrapper, pages)]})

    schema = "host string, at int, wrapper string"
    own = pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("page")).mapInArrow(first, schema)
    own = materialize(own, "html-wrappers")
    most = own.agg(F.max("at")).first()[0]
    while most:
        own = materialize(own.groupBy("host", F.expr(f"at div {FAN_IN}").alias("part")).applyInPandas(merge, schema), "html-wrappers")
        most //= FAN_IN
    return own.select("host", F.get_json_object("wrapper", "$[0]").cast("long").alias("n"), "wrapper")


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with main_text and main_chars: the article of every page.

    Each host's pages are aligned to a wrapper: slots by their place, repeated groups, optional parts, texts that
    never change. The wrapper tells the element that holds the article, by where text changes, and what in it is the
    host's own; every page is then read in full along it. A page without that element is judged by its own structure.

    Cases: a null or empty page gives an empty text, as does one without text in the article; null urls are one
    host; repeated rows get equal results; an empty table gives an empty result; unclosed elements end with the
    page, `<` that starts no tag is text, and paths name the outermost DEPTH elements; a page is read in one pass, so
    long and malformed ones take time in proportion; input columns named like the added ones are replaced.
    """
    pages = replace_columns(pages, ["main_text", "main_chars"])
    wrappers = infer_wrappers(pages, url_col, html_col)
    host, wrapper = free_name(pages, "html_host"), free_name(pages, "html_wrapper")
    total, n_pages = wrappers.agg(F.sum(F.length("wrapper")), F.sum("n")).first()
    wrappers = wrappers.select(F.col("host").alias(host), "n", F.col("wrapper").alias(wrapper))
    keyed = pages.withColumn(host, _host(F.col(f"`{url_col}`")))
    if (total or 0) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(wrappers.drop("n")), host, "left")
    else:  # a host of very many pages isn't brought together
        empty = F.coalesce(F.length(F.col(f"`{html_col}`")) == 0, F.lit(True))
        joined = join_counted(keyed.where(~empty), wrappers, [host], n_pages, [wrapper]).unionByName(keyed.where(empty).withColumn(wrapper, F.lit(None).cast("string")))
    memory: dict[str, tuple] = {}

    def read(batch: pa.RecordBatch) -> dict:
        texts = []
        column = batch.column(batch.schema.get_field_index(html_col))
        for page, packed in zip(column, batch.column(batch.schema.get_field_index(wrapper))):
            page, packed = page.as_py(), packed.as_py()
            if packed not in memory:
                if len(memory) > 1000:
                    memory.clear()
                n, w = _open(packed) if packed else (0, [])
                memory[packed] = roles(w, n)
            texts.append(extract(blocks(page), *memory[packed]) if page else "")
        return {"main_text": pa.array(texts, pa.string()), "main_chars": [len(t) for t in texts]}

    return add_columns(joined, read, [T.StructField("main_text", T.StringType()), T.StructField("main_chars", T.LongType())], drop=(host, wrapper))


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))
