"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into leaf blocks (runs of text between the tags that make blocks), each with its ancestors. Features are the
ancestors' tags and the words of their classes and ids, and the shape of the text. The field is trained on labelled
pages that labelled_pages() writes from many layouts (seeded, so every driver trains the same weights), and
Viterbi decodes each page's blocks into article and rest.

Blocks: character references are decoded, white space becomes one space, ends are trimmed, empty blocks go; the
article's blocks are joined by line breaks. Scripts, styles, head, comments of the markup and the choices and fields of
forms are no text at all. Nothing else is dropped or capped.

Defined results: html null is empty; a page without blocks has the text ''; broken markup is read as far as tags can be
told (a tag that never ends is text); rows with equal page_id are apart; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm._shared import ship
from newsloom.llm.crf import fit_field, viterbi

TRAIN_PAGES = 2_500
SEED = 7

# Every alternative stops at a '<' that opens something, so a page of broken tags is still read in one pass.
_VALUE = r"\"(?:[^\"<]|<(?![a-zA-Z/!]))*+\"|'(?:[^'<]|<(?![a-zA-Z/!]))*+'"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|{_VALUE})*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript iframe select textarea title head button datalist".split())
#: Elements that can be closed by a slash in their opening tag.
FOREIGN = frozenset("svg math".split())
#: What can stand in a head; any other tag, or text, ends one that is open.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that make blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these, if no element of the second set lies between.
_LIST, _TABLE = frozenset("ul ol menu".split()), frozenset(["table"])
ENDS = {"li": (frozenset(["li"]), _LIST), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), _TABLE), "td": (frozenset("td th".split()), _TABLE | {"tr"}), "th": (frozenset("td th".split()), _TABLE | {"tr"}), "option": (frozenset(["option"]), _LIST)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH, HOLDERS = frozenset(["p"]), frozenset("table td th li div section article form blockquote aside header footer main nav".split())
_SHUT = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """Leaf blocks in page order: (text, its ancestors' marks, share of its characters inside links)."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    marks: dict[str, int] = {}  # of the open elements, with how many have each
    text: list[str] = []
    linked: list[bool] = []
    at, silent, links = 0, 0, 0

    def flush() -> None:
        if not text:
            return
        parts = [entities.unescape(t) if "&" in t else t for t in text]
        whole = " ".join("".join(parts).split())
        if whole:
            inside = sum(len(p) for p, x in zip(parts, linked, strict=True) if x)
            own = next((t for t, _ in reversed(stack) if t in BLOCK), "none")
            out.append((whole, (*marks, f"own:{own}"), inside / max(1, sum(map(len, parts)))))
        text.clear()
        linked.clear()

    def close(n: int) -> None:
        nonlocal silent, links
        for tag, more in stack[n:]:
            silent -= tag in SILENT
            links -= tag == "a"
            for m in (tag, *more):
                marks[m] -= 1
                if not marks[m]:
                    del marks[m]
        del stack[n:]

    def innermost(those: frozenset[str], bound: frozenset[str]) -> int:
        """Where the innermost open element of those stands, if none of bound is inside it; else -1."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in those:
                return i
            if stack[i][0] in bound:
                return -1
        return -1

    def say(t: str) -> None:
        if silent and stack[-1][0] == "head" and t.strip():
            close(len(stack) - 1)
        if not silent and t:
            text.append(t)
            linked.append(links > 0)

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag in marks:
                i = innermost(frozenset([tag]), frozenset())
                if tag not in BLOCK and any(t in BLOCK for t, _ in stack[i:]):
                    continue  # an inline end tag doesn't end blocks
                if tag in BLOCK or any(t in BLOCK for t, _ in stack[i:]):
                    flush()
                close(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag not in IN_HEAD and stack and stack[-1][0] == "head":
            close(len(stack) - 1)
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS:
                those, bound = ENDS[tag]
                # cells end with their row's other cells: the outermost of them goes
                while (i := innermost(those, bound)) >= 0:
                    close(i)
            # a paragraph or heading ends at any block
            if (i := innermost(PARAGRAPH | HEADINGS if tag in HEADINGS else PARAGRAPH, HOLDERS)) >= 0:
                close(i)
        if tag in RAW:
            shut = _SHUT[tag].search(page, at)
            at = shut.end() if shut else end
            continue
        attrs = m[3] if m[2] else m[6]
        if attrs and attrs.rstrip().endswith("/") and (tag in SILENT or tag in FOREIGN):
            continue
        more: tuple[str, ...] = ()
        if attrs and "=" in attrs:
            more = tuple(f"w:{w}" for _, v in _ATTR.findall(attrs) for w in _WORD.findall(v.lower()))
        stack.append((tag, more))
        for x in (tag, *more):
            marks[x] = marks.get(x, 0) + 1
        silent += tag in SILENT
        links += tag == "a"
    flush()
    return out


def features(text: str, marks: tuple[str, ...], link_share: float) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    f = [f"len:{min(n, 2000).bit_length()}", f"words:{min(words, 200).bit_length()}", f"link:{int(link_share * 3.99)}"]
    f.append("end:" + ("stop" if text[-1] in ".!?…" else "comma" if text[-1] in ",;:" else "none"))
    if "©" in text or "copyright" in text.lower():
        f.append("copyright")
    if any(c.isdigit() for c in text):
        f.append("digit")
    f += [f"in:{m}" if not m.startswith("own:") else m for m in marks]
    return f


# ---- labelled pages

GOOD, BAD = "\ue000", "\ue001"
_NAMES = {
    "ad": "ad ads advert advertisement adbox banner sponsor sponsored promo promotion promoted adslot".split(),
    "notice": "cookie cookies consent notice banner gdpr alert popup modal overlay privacy newsletter subscribe paywall".split(),
    "menu": "menu nav navbar navigation topnav links breadcrumb breadcrumbs tabs toc skip".split(),
    "head": "header masthead top topbar site-header brand logo tagline".split(),
    "foot": "footer foot bottom site-footer copyright legal colophon credits".split(),
    "side": "sidebar side aside rail right left widget widgets related recommended trending popular more tags archive".split(),
    "share": "share sharing social follow buttons toolbar tools actions meta".split(),
    "form": "form search login signup subscribe contact newsletter poll".split(),
    "comment": "comments comment replies reply discussion disqus respond feedback reader-comments user-comments responses".split(),
    "main": "content main article post entry story body text page-content post-content article-body entry-content single".split(),
    "plain": "row col wrap wrapper container inner box block grid section page layout outer".split(),
}


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages whose every piece of text ends in GOOD or BAD, in many layouts."""
    r = random.Random(seed)
    vowels, others = "aeiouéüó", "bcdfghlmnprstvz"

    def word() -> str:
        return "".join(r.choice(others) + r.choice(vowels) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def sentence() -> str:
        return words(1, r.choice((3, 12, 25))).capitalize() + r.choice("....!?")

    def prose() -> str:
        text = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 6))))
        x = r.random()  # what an article may hold besides sentences: rows, capitals, signs, no full stop, one word
        if x < 0.05:
            return text.replace(" ", " | ")
        if x < 0.08:
            return text.upper() + "!!"
        if x < 0.11:
            return text.replace(" ", r.choice(("*** ", "$$$ ", "### ", " 12 ")))
        if x < 0.17:
            return text.rstrip(".!?")
        if x < 0.21:
            return f"{words(1, 3)} {r.choice(('&copy;', '&#169;', 'copyright', '&reg;'))} {text}"
        return text if x < 0.95 else word().capitalize() + "."

    def attr(kind: str, chance: float = 1.0) -> str:
        if r.random() > chance:
            return ""
        names = r.sample(_NAMES[kind], r.choice((1, 1, 2)))
        return f' {r.choice(("class", "class", "id"))}="{r.choice((" ", "-")).join(names)}"'

    def links(lo: int, hi: int, mark: str = BAD) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}{mark}</a></li>' for _ in range(r.randint(lo, hi)))

    def para(mark: str, body: str | None = None) -> str:
        body = (body or prose()) + mark
        if r.random() < 0.15:
            body = f'{words(1, 4)} <a href="#">{words(1, 3)}</a> {body}'
        if r.random() < 0.08:
            return f"<p><b>{body}<br>"
        return f"<p>{body}" + ("</p>" if r.random() < 0.9 else "")

    def bad_box(kind: str, tag: str | None = None) -> str:
        tag = tag or r.choice(("div", "div", "section", "aside"))
        inner = r.choice((lambda: prose() + BAD, lambda: para(BAD), lambda: f"<ul>{links(2, 6)}</ul>", lambda: f"<h3>{words(1, 3)}{BAD}</h3><p>{prose()}{BAD}</p>", lambda: f'<a href="#">{words(1, 6)}{BAD}</a>'))()
        return f"<{tag}{attr(kind)}>{inner}</{tag}>"

    def comments() -> str:
        tag = r.choice(("section", "div", "aside"))
        one = r.choice(("article", "div", "li"))
        body = "".join(f'<{one}{attr("comment", 0.7)}><{"h4" if r.random() < 0.3 else "span"}>{words(1, 2)}{BAD}</{"h4" if r.random() < 0 else "span"}>{para(BAD)}</{one}>' for _ in range(r.randint(1, 5)))
        if one == "li":
            body = f"<ol>{body}</ol>"
        return f'<{tag}{attr("comment")}><h2>{words(1, 2)}{BAD}</h2>{body}</{tag}>'

    def form() -> str:
        label = f"<label>{words(1, 3)}{BAD}</label>" if r.random() < 0.7 else ""
        text = para(BAD) if not label or r.random() < 0.5 else ""
        return f'<form{attr("form", 0.6)}>{label}{text}<input name="q"><button>{word()}</button></form>'

    def inside() -> str:
        """What interrupts an article."""
        kind = r.choice(("ad", "ad", "side", "share", "notice", "form", "comment", "aside"))
        if kind == "form":
            return form()
        if kind == "aside":
            return f"<aside>{para(BAD)}</aside>"
        box = bad_box(kind)
        return box if r.random() < 0.5 else f"<div{attr(kind)}>{''.join(para(BAD) for _ in range(r.randint(1, 3)))}</div>"

    def article() -> str:
        parts = []
        if r.random() < 0.85:
            h1 = f"<h1>{sentence()}{GOOD}</h1>"
            parts.append(f'<header{attr("main", 0.3)}>{h1}</header>' if r.random() < 0.15 else h1)
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            x = r.random()
            if x < 0.7:
                parts.append(para(GOOD))
            elif x < 0.78:
                parts.append(f"<h{r.choice('23')}>{words(1, 7).capitalize()}{GOOD}</h{r.choice('23')}>")
            elif x < 0.82:
                parts.append(f"<ul>{''.join(f'<li>{sentence()}{GOOD}</li>' for _ in range(r.randint(2, 5)))}</ul>")
            elif x < 0.85:
                parts.append(f"<blockquote>{para(GOOD)}</blockquote>")
            elif x < 0.87:
                parts.append(f"<table><tr><td>{words(1, 4)}{GOOD}</td><td>{words(1, 4)}{GOOD}</td></tr></table>")
            elif x < 0.89:
                parts.append(f"<figure><img src=x><figcaption>{sentence()}{GOOD}</figcaption></figure>")
            elif x < 0.90:
                parts.append(f"<pre>{words(3, 9)}{GOOD}</pre>")
            elif x < 0.92:
                parts.append(f"<div>{prose()}{GOOD}</div>")
            else:
                parts.append(inside())
        return "".join(parts)

    for _ in range(n):
        before, after = [], []
        for chance, make in ((0.4, lambda: bad_box("notice")), (0.6, lambda: f'<header{attr("head", 0.6)}><{"h1" if r.random() < 0.15 else "div"}{attr("head", 0.5)}>{words(1, 5)}{BAD}</div></header>' if r.random() < 0.6 else f'<div{attr("head")}>{words(1, 6)}{BAD}</div>')):
            if r.random() < chance:
                before.append(make())
        if r.random() < 0.85:
            nav = f"<ul>{links(2, 8)}</ul>"
            before.append(r.choice((f"<nav{attr('menu', 0.3)}>{nav}</nav>", f"<div{attr('menu')}>{nav}</div>", f"<nav>{nav}</nav>")))
        if r.random() < 0.45:
            before.append(bad_box("ad", "div"))
        if r.random() < 0.25:
            before.append(bad_box("side"))
        if r.random() < 0.15:
            before.append(form())
        r.shuffle(before)
        for chance, make in ((0.35, comments), (0.35, lambda: bad_box("side")), (0.2, lambda: bad_box("ad")), (0.2, form), (0.15, lambda: bad_box("share"))):
            if r.random() < chance:
                after.append(make())
        r.shuffle(after)
        foot = f"&copy; {word()}.example {r.choice(('&middot; ', ''))}{prose()}{BAD}"
        if r.random() < 0.85:
            after.append(r.choice((f"<footer>{foot}</footer>", f"<footer{attr('foot', 0.5)}><p>{foot}</p></footer>", f"<div{attr('foot')}>{foot}</div>")))
        open_, shut = r.choice((("<article>", "</article>"), (f"<article{attr('main')}>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{attr('main')}>", "</div>"), (f"<section{attr('main')}>", "</section>"), (f"<div{attr('main')}><div{attr('plain')}>", "</div></div>"), (f"<table><tr><td{attr('main')}>", "</td></tr></table>")))
        if r.random() < 0.15:  # comments and the like inside the article's element
            shut = "".join(x() for x in r.sample((comments, lambda: bad_box("side"), lambda: bad_box("share"), form), 2)) + shut
        whole = "".join(before) + open_ + article() + shut + "".join(after)
        if r.random() < 0.4:
            whole = f"<div{attr('plain')}>{whole}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{whole}</body></html>"


@cache
def model(n: int = TRAIN_PAGES, seed: int = SEED) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, weights and transitions, fitted on labelled_pages(n, seed)."""
    rows, per, y = [], [], []
    for page in labelled_pages(n, seed):
        k = 0
        for text, marks, share in blocks(page):
            if GOOD not in text and BAD not in text:
                continue
            clean = text.replace(GOOD, "").replace(BAD, "").strip() or "x"
            rows.append(features(clean, marks, share))
            y.append(int(GOOD in text))
            k += 1
        if k:
            per.append(k)
    seen: dict[str, int] = {}
    for f in rows:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    number = {x: i for i, x in enumerate(sorted(x for x, c in seen.items() if c >= 3))}
    w, trans = fit_field(_matrix(rows, number), np.array(per), np.array(y), np.ones(len(per)), len(number) + 1, steps=250, penalty=0.1)
    return number, w, trans


def _matrix(rows: list[list[str]], number: dict[str, int]) -> np.ndarray:
    none = len(number)
    wide = max(map(len, rows))
    return np.array([[number.get(x, none) for x in f] + [none] * (wide - len(f)) for f in rows], np.int64)


def main_texts(pages: list[str | None], trained: tuple[dict[str, int], np.ndarray, np.ndarray]) -> list[str]:
    number, w, trans = trained
    weight = {x: float(w[i]) for x, i in number.items()}
    found, unary, per = [], [], []
    for page in pages:
        own = blocks(page or "")
        found.append(own)
        per.append(len(own))
        unary += [sum(weight.get(x, 0.0) for x in features(*b)) for b in own]
    label = viterbi(np.array(unary, float), np.array(per, np.int64), trans)
    out, at = [], 0
    for own in found:
        out.append("\n".join(b[0] for b, y in zip(own, label[at : at + len(own)], strict=True) if y))
        at += len(own)
    return out


def _extract(trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(2).to_pylist(), trained)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    p = pages.select("page_id", "url", "html")
    kinds = [f"{c} {p.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return p.mapInArrow(_extract(model()), ", ".join([*kinds, "text string", "n_chars long"]))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
