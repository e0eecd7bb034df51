"""Operator 7: main text of web pages by wrappers inferred per host.

A page is a stream of tokens: container tags (with class and id) and texts.
For every host a wrapper, a regular expression without unions, is inferred
from all its distinct pages: equal sibling subtrees collapse into a repeated
group, then every task aligns its pages of a host one after the other, and the
wrappers of the tasks are aligned; tags that only some pages have become
optional, texts that differ become slots, texts that are the same on 90 % of the
pages of their node (``TEMPLATE_PAGES`` at least) stay template.

A slot holds main text unless its path says otherwise (menus, headers,
footers, sidebars, notices, adverts, forms and comments by tag, role, class or
id), it consists of links, or it is template.  Where a page has an article or
main element, this frame is evidence: slots outside it count only if the
wrapper knows their path as prose (``PROSE`` characters a block on average, on
``TEMPLATE_PAGES`` pages at least), and texts inside that are template stay
where template is more than half of the frame (pages that are near copies of
one another).  Every page is read with its host's
wrapper; a path the wrapper does not know is judged by the same rules on the
page alone.

Text: character references are decoded, white space in a block becomes one
space, blocks are joined in page order by two newlines.

Results in corner cases: a null or empty html, or a page without main text,
gives an empty string; unclosed and stray tags are tolerated; pages without a
host share one wrapper.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.graph import written

HOSTS_HELD = 512        # hosts whose wrappers a task holds at once
TEMPLATE_PAGES = 6      # distinct pages needed before a constant text counts as template
TEMPLATE_VOTES = 0.8    # votes for a text, less those against it, of the pages of its node: on 90 % of them
LINK_SHARE = 0.6
PROSE = 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|select|textarea|head|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")

_CONTAINERS = set("html body div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr figure details dialog menu fieldset blockquote".split())
_BLOCKS = _CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre address figcaption summary hr center caption legend option button label".split())
_BAD_TAGS = set("nav footer aside form menu dialog button label legend".split())
_BAD_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
_BAD_WORDS = set("""ad ads advert advertisement adverts adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar topnav
breadcrumb breadcrumbs header masthead topbar footer colophon sidebar side aside rail widget widgets comment comments commentlist respond replies reply
disqus discussion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share
sharing social related recommended recommendations pagination pager search form copyright legal toolbar skip hidden""".split())
_COMMENT_WORDS = set("comment comments commentlist respond replies reply disqus".split())
_LAYOUT_WORDS = set("no has with without".split())      # "no-sidebar" and "with-sidebar" tell of the layout, not of the element


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def _signature(tag: str, attrs: str) -> str:
    """tag, its class and id, and marks: ``!`` boilerplate, ``*`` main content."""
    found = {m[1].lower(): m[2].strip("\"'") for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    named = [_words(n) for n in (found.get("class", "") + " " + found.get("id", "")).split()]
    names, evidence = [w for n in named for w in n], {w for n in named if not _LAYOUT_WORDS & set(n) for w in n}
    bad = tag in _BAD_TAGS or found.get("role", "").lower() in _BAD_ROLES or found.get("aria-hidden", "") == "true"
    bad |= tag == "header"
    if tag in ("article", "main"):          # other names of a frame tell of its parts; comments are articles on many hosts
        bad |= bool(evidence & _COMMENT_WORDS) and not evidence & {"article", "articlebody"}
    elif tag not in ("html", "body"):
        bad |= bool(evidence & _BAD_WORDS)
    bad |= bool(re.search(r"display\s*:\s*none", found.get("style", ""))) or bool(re.search(r"\bhidden\b(?!\s*=)", attrs))
    good = tag in ("article", "main") or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"
    return tag + "".join("." + w for w in names) + ("!" if bad else "*" if good else "")


def read_blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of each block, in page order."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, in_link, leaf = 0, False, ""
    at, page = 0, page or ""

    def flush():
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            path = "/".join([s for _, s in stack] + ([leaf] if leaf else []))
            out.append((path, joined, linked))
        text.clear()
        linked = 0

    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = entities.unescape(page[at:m.start() if m else len(page)])
        if piece:
            text.append(piece)
            if in_link:
                linked += len(_SPACE.sub("", piece))
        if not m:
            break
        at = m.end()
        if m["raw"]:
            end = re.compile(rf"</{m['raw']}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page) if m["raw"].lower() in ("script", "style") else at
            text.append(" ")
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            in_link = not m["close"]
        elif tag in ("br", "img", "wbr"):
            text.append(" " if tag != "wbr" else "")
        if tag not in _BLOCKS:
            continue
        flush()
        in_link = False
        if tag not in _CONTAINERS:
            leaf = "" if m["close"] else _signature(tag, m["attrs"])
        elif m["close"]:
            leaf = ""
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif not m["attrs"].rstrip().endswith("/"):
            leaf = ""
            stack.append((tag, _signature(tag, m["attrs"])))
    flush()
    return out


def _stream(blocks: list[tuple[str, str, int]]) -> list[tuple[str, str, bool]]:
    """(path, text, repeated): runs of blocks, or of equal groups of blocks,
    on the same paths collapse into one group."""
    out: list[tuple[str, str, bool]] = []
    i, paths = 0, [b[0] for b in blocks]
    while i < len(blocks):
        for width in (1, 2, 3, 4):
            n = 1
            while paths[i + n * width:i + (n + 1) * width] == paths[i:i + width]:
                n += 1
            if n > 1:
                out += [(paths[i + k], "\0".join(b[1] for b in blocks[i + k:i + n * width:width]), True) for k in range(width)]
                i += n * width
                break
        else:
            out.append((paths[i], blocks[i][1], False))
            i += 1
    return out


def _nodes(blocks: list[tuple[str, str, int]]) -> list[dict]:
    """The wrapper of a single page."""
    return [{"path": p, "text": t, "optional": False, "repeated": r, "top": t, "votes": 1, "n": 1} for p, t, r in _stream(blocks)]


def _align(wrapper: list[dict], other: list[dict]) -> list[dict]:
    """One wrapper for the pages of both.  A node has the number of its pages
    (n) and the majority vote over their texts (top, votes): texts other than
    ``top`` are on at most (n - votes) / 2 of them."""
    merged: list[dict] = []
    match = difflib.SequenceMatcher(None, [n["path"] for n in wrapper], [n["path"] for n in other], autojunk=False)
    for kind, a, b, c, d in match.get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[a:b], other[c:d]):
                x, y = (x, y) if x["votes"] >= y["votes"] else (y, x)
                votes, n = x["votes"] + (y["votes"] if x["top"] == y["top"] else -y["votes"]), x["n"] + y["n"]
                merged.append({"path": x["path"], "text": x["top"] if votes == n else None, "top": x["top"] if votes else None,
                               "votes": votes, "n": n, "optional": x["optional"] or y["optional"],
                               "repeated": x["repeated"] or y["repeated"]})
        else:
            merged += [node | {"optional": True} for node in wrapper[a:b] + other[c:d]]
    return merged


def infer_wrapper(pages: list[list[tuple[str, str, int]]]) -> list[dict]:
    """The wrapper of aligned pages: nodes with path, text (None: a slot),
    optional and repeated."""
    return reduce(_align, map(_nodes, pages)) if pages else []


def _key(text: str) -> str:
    """A text as wrappers hold it: long ones by their digest."""
    return text if len(text) <= 40 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _learn(blocks: list[tuple[str, str, int]]) -> dict:
    """What one page tells of its host: wrapper nodes and, for each path, its
    characters, those in links, and its blocks."""
    chars: dict[str, list[int]] = {}
    for path, text, linked in blocks:
        n = chars.setdefault(path, [0, 0, 0])
        n[0], n[1], n[2] = n[0] + len(text.replace(" ", "")), n[1] + linked, n[2] + 1
    return {"nodes": _nodes([(p, _key(t), k) for p, t, k in blocks]), "chars": chars}


def _join(one: dict | None, other: dict) -> dict:
    if one is None:
        return other
    for path, n in other["chars"].items():
        one["chars"][path] = [x + y for x, y in zip(one["chars"].get(path, (0, 0, 0)), n)]
    return {"nodes": _align(one["nodes"], other["nodes"]), "chars": one["chars"]}


def _is_bad(path: str) -> bool:
    """A boilerplate element encloses the block; a header inside an article
    holds its title and counts as part of it, and a form around an article or
    main element holds the page."""
    parts = path.split("/")
    frames = [i for i, part in enumerate(parts) if part.endswith("*")]
    for i, part in enumerate(parts):
        if part.endswith("!"):
            tag, *names = part[:-1].split(".")
            title = tag == "header" and frames and frames[0] < i and not set(names) & _BAD_WORDS - {"header"}
            whole = tag == "form" and frames and i < frames[-1]
            if not title and not whole:
                return True
    return False


def _summary(learnt: dict) -> str:
    """The parts of a host's wrapper that reading a page needs, as JSON."""
    links = sorted(p for p, (n, linked, _) in learnt["chars"].items() if linked >= LINK_SHARE * n)
    template = sorted({f"{n['path']}\n{t}" for n in learnt["nodes"]
                       if n["top"] and n["n"] >= TEMPLATE_PAGES and n["votes"] >= TEMPLATE_VOTES * n["n"]
                       for t in n["top"].split("\0")})
    pages: dict[str, int] = {}
    for n in learnt["nodes"]:
        pages[n["path"]] = max(pages.get(n["path"], 0), n["n"])
    prose = sorted(p for p, (n, _, blocks) in learnt["chars"].items()
                   if "*" not in p and not _is_bad(p) and pages.get(p, 0) >= TEMPLATE_PAGES and n >= PROSE * blocks)
    return json.dumps({"known": sorted(learnt["chars"]), "links": links, "template": template, "prose": prose})


def main_text(page: str | None, wrapper: dict) -> str:
    """The main text of a page, read with its host's wrapper."""
    blocks = read_blocks(page)
    framed = any("*" in path and not _is_bad(path) for path, _, _ in blocks)
    known, links, template = wrapper["known"], wrapper["links"], wrapper["template"]
    prose, slots, inside, constant = wrapper.get("prose", ()), [], 0, 0
    for path, text, linked in blocks:
        if _is_bad(path):
            continue
        n = len(text.replace(" ", ""))
        only_links = path in links if path in known else linked >= LINK_SHARE * n
        if only_links or framed and "*" not in path and path not in prose:
            continue
        fixed = f"{path}\n{_key(text)}" in template
        if "*" in path:
            inside, constant = inside + n, constant + n * fixed
        slots.append((text, fixed, "*" in path))
    near_copies = framed and 2 * constant > inside
    return "\n\n".join(text for text, fixed, marked in slots if not fixed or near_copies and marked)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    distinct = rows.filter("html is not null and html <> ''").select("host", "html").distinct()

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts: dict[str, dict] = {}
        for pdf in batches:
            for name, page in zip(pdf["host"], pdf["html"]):
                hosts[name] = _join(hosts.get(name), _learn(read_blocks(page)))
                if len(hosts) >= HOSTS_HELD:
                    yield pd.DataFrame({"host": list(hosts), "learnt": [json.dumps(x) for x in hosts.values()]})
                    hosts.clear()
        yield pd.DataFrame({"host": list(hosts), "learnt": [json.dumps(x) for x in hosts.values()]}, dtype=object)

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [_summary(reduce(_join, map(json.loads, sorted(pdf["learnt"]))))]})

    # a written table has a known size, by which the planner joins it
    learnt = distinct.mapInPandas(learn, "host string, learnt string")
    wrappers = written(learnt.groupBy("host").applyInPandas(infer, "host string, wrapper string"), "wrappers")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, dict] = {}
        for pdf in batches:
            texts = []
            for page, raw in zip(pdf["html"], pdf["wrapper"]):
                raw = raw or '{"known": [], "links": [], "template": []}'
                if raw not in parsed:
                    if len(parsed) > 256:
                        parsed.clear()
                    parsed[raw] = {k: set(v) for k, v in json.loads(raw).items()}
                texts.append(main_text(page, parsed[raw]))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInPandas(read, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
