"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: the text between two block tags. A block is described by the tags and the words of
class, id and role of its ancestors, whether one of them is hidden, its own tag, and its text. Two labels, kept and dropped, form a chain in page
order; the field is trained on labelled pages by gradient steps on the exact likelihood (forward-backward), and a
page is decoded by Viterbi. Scripts, styles, forms' controls and other things that are never text are no blocks.

Labelled pages come from two places. Pages of the table that mark their article by a tag of its own (article, main)
label themselves; each is learnt twice, once with these tags hidden, so that the rest of the description has to tell.
The patterns of ``patterns`` add arrangements that a table may lack: every usual name of a menu, notice, advert,
sidebar, form or comment list, around and inside an article.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages of the table that are learnt from, the first by a hash; and the most blocks that such a page has.
TRAINING_PAGES = 300
TRAINING_BLOCKS = 200
#: Longer pages, in characters, are not drawn for training; with TRAINING_PAGES this bounds what the driver gets.
TRAINING_LENGTH = 100_000
STEPS = 250
RATE = 0.1
DECAY = 1e-3
SEED = 11

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)(?:>|\Z)", re.S)
#: A whole name and its whole value, one after the other.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAMING = frozenset("class id role itemprop aria-label".split())
#: Stands among the names of an element with the attribute hidden, or that is not displayed; no name is written so.
HIDDEN = "(hidden)"
NAME = re.compile(r"[a-z]+")
#: Their content is never text of the page.
OPAQUE = frozenset("script style noscript template iframe object svg annotation canvas select textarea button title datalist audio video".split())
#: Of these, everything up to the end tag is raw text.
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var nobr output math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mover munder "
                   "semantics".split())
#: Tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt tr td th".split())
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
SCOPES = frozenset("ul ol dl table menu".split())
ARTICLE = frozenset(("article", "main"))
NEVER = frozenset("nav aside footer form".split())
BOILER = frozenset("advert menu side notice comment form share foot".split())
#: Words of names that mean the same to a reader.
FAMILIES = {
    "advert": "ad ads advert adverts advertisement adsense banner promo promotion promoted sponsor sponsored sponsors outbrain taboola dfp gpt affiliate",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pager pagination paging toc sitemap topbar toolbar skip tabs",
    "head": "header masthead head brand logo hero",
    "foot": "footer foot colophon copyright legal bottom imprint credits",
    "side": "sidebar aside side rail widget widgets related recommended recommendations popular trending more sidecol secondary complementary",
    "notice": "cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay dialog banner paywall disclaimer warning message toast",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread responses feedback reader review reviews",
    "form": "form forms search login signin signup register subscribe subscription newsletter contact poll survey input",
    "share": "share sharing social follow tweet facebook twitter buttons tools actions like print",
    "meta": "meta byline author date published timestamp tags tag tagline category categories posted credit info",
    "body": "article content post entry story main body text page prose copy maincontent articlebody entrycontent postbody",
}
FAMILY = {word: name for name, words in FAMILIES.items() for word in words.split()}


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


@dataclass
class Element:
    tag: str
    names: tuple[str, ...] = ()
    hidden: bool = False


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order, character references decoded and white space made one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(e.tag for e in stack), tuple(n for e in stack for n in e.names), linked))
            parts.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not any(e.hidden for e in stack):
            text = entities.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                take(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = bool(m[1])
        if name in OPAQUE:
            if name in RAW and not closing and not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif closing:
                while stack and any(e.tag == name for e in stack) and stack.pop().tag != name:
                    pass
            elif not m[0].endswith("/>"):
                stack.append(Element(name, (), True))
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if closing:
            if any(e.tag == name for e in stack):
                while stack.pop().tag != name:
                    pass
            continue
        if name in ENDS_P and stack and stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in SCOPES:
                break
            if stack[i].tag in SIBLINGS.get(name, ()):
                del stack[i:]
                break
        if re.fullmatch("h[1-6]", name) and stack and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        if m[0].endswith("/>") and name in ("path", "use", "image"):
            continue
        names = []
        for key, value in ATTRIBUTE.findall(m[3]):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                names.append(HIDDEN)
            elif key in NAMING:
                names += NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))
        stack.append(Element(name, tuple(names)))
    flush()
    return out


def place_features(block_tags: tuple[str, ...], names: tuple[str, ...], hide: frozenset = frozenset()) -> set[str]:
    """The features that the ancestors give. Tags in ``hide`` count as div."""
    tags = ["div" if t in hide else t for t in block_tags]
    out = {"bias", "tag:" + (tags[-1] if tags else "none")}
    out |= {"in:" + t for t in tags if t not in ("html", "body", "div")}
    families = [FAMILY.get(n) or next((FAMILY[n[i:]] for i in range(1, len(n) - 3) if n[i:] in FAMILY), None) for n in names]
    families = [f for f in families if f]
    out |= {"family:" + f for f in families} | {"name:" + n for n in names if n not in FAMILY}
    if NEVER.intersection(tags):
        out.add("never")
    if BOILER.intersection(families):
        out.add("boiler")
    if families:
        out.add("nearest:" + families[-1])
    if "header" in tags and ("article" in tags or "main" in tags):
        out.add("article header")
    if tags.count("article") > 1:
        out.add("article in article")
    if not any(t in ("p", "pre", "blockquote", "li", "td") or re.fullmatch("h[1-6]", t) for t in tags):
        out.add("bare")
    return out


def text_features(block: Block, before: Block | None) -> set[str]:
    """The features that the text gives, and the block before."""
    out = {f"words:{min(5, int(math.log2(block.text.count(' ') + 2)))}"}
    share = block.linked / max(1, len(block.text))
    out.add("links:" + ("most" if share > 0.6 else "some" if share > 0.2 else "few"))
    if block.text[-1] in ".!?:;\"')":
        out.add("ends")
    if "\u00a9" in block.text:
        out.add("copyright")
    if before is None:
        out.add("first")
    elif before.tags[:-1] == block.tags[:-1]:
        out.add("sibling")
    return out


@dataclass
class Field:
    """Feature -> its weight for label 1 against label 0; the score of a step from label to label."""
    weights: dict[str, float] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        weight, seen, out = self.weights.get, {}, []
        for b, p in zip(blocks, [None, *blocks[:-1]]):
            where = (b.tags, b.names)
            if where not in seen:
                seen[where] = sum(weight(f, 0.0) for f in sorted(place_features(*where)))
            out.append(seen[where] + sum(weight(f, 0.0) for f in sorted(text_features(b, p))))
        return np.array(out)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels."""
        if not blocks:
            return []
        s = self.steps.tolist()
        emitted = self.emissions(blocks).tolist()
        best, back = (0.0, emitted[0]), []
        for e in emitted[1:]:
            to0 = (best[0] + s[0][0], best[1] + s[1][0])
            to1 = (best[0] + s[0][1], best[1] + s[1][1])
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            best = (max(to0), max(to1) + e)
        label = best[1] > best[0]
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[set[str]], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Pages of (features, labels) -> a field, by Adam on the mean negative log likelihood.

    All chains are walked together; the shorter ones end earlier.
    """
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    if not pages:
        return Field({"bias": -1.0, "in:article": 4.0, "in:main": 4.0})
    names = sorted({f for page, _ in pages for block in page for f in block})
    place = {f: i for i, f in enumerate(names)}
    row = np.concatenate([[i] * len(block) for i, block in enumerate(b for page, _ in pages for b in page)]).astype(int)
    column = np.array([place[f] for page, _ in pages for block in page for f in sorted(block)])
    lengths = np.array([len(p) for p, _ in pages])
    total, longest, count = int(lengths.sum()), int(lengths[0]), len(pages)
    # Longest first: at each place the chains that go on are a prefix.
    on = [int((lengths > i).sum()) for i in range(longest)]
    where = np.concatenate([np.arange(n) * count + i for i, n in enumerate(lengths)])
    label = np.zeros(longest * count, int)
    label[where] = np.concatenate([y for _, y in pages])
    label = label.reshape(longest, count)
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    m1, m2 = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, steps + 1):
        emit = np.zeros(longest * count)
        emit[where] = np.bincount(row, w[column], minlength=total)
        emit = np.stack((np.zeros((longest, count)), emit.reshape(longest, count)), axis=2)
        forward = [emit[0]]
        for i in range(1, longest):
            f = forward[-1][:on[i]]
            forward.append(np.logaddexp(f[:, 0, None] + t[0], f[:, 1, None] + t[1]) + emit[i, :on[i]])
        z = np.empty(count)
        one = np.zeros((longest, count))
        gt = np.zeros((2, 2))
        ahead = np.zeros((0, 2))
        for i in range(longest - 1, -1, -1):
            later = len(ahead)
            back = np.zeros((on[i], 2))
            if later:
                reach = ahead + emit[i + 1, :later]
                back[:later] = np.logaddexp(t[:, 0] + reach[:, 0, None], t[:, 1] + reach[:, 1, None])
            f = forward[i]
            z[later:on[i]] = np.logaddexp(f[later:, 0], f[later:, 1])
            one[i, :on[i]] = np.exp(f[:, 1] + back[:, 1] - z[:on[i]])
            if later:
                gt += np.exp(f[:later, :, None] + t + reach[:, None, :] - z[:later, None, None]).sum(0)
                np.subtract.at(gt, (label[i, :later], label[i + 1, :later]), 1)
            ahead = back
        off = (one - label).reshape(-1)[where] / total
        g = np.concatenate((np.bincount(column, off[row], minlength=len(names)) + decay * w / total, gt.ravel() / total))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        w, t = w - move[:-4], t - move[-4:].reshape(2, 2)
    return Field(dict(zip(names, w.tolist())), t)


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article by a tag, or None."""
    if not any(ARTICLE & set(b.tags) for b in blocks):
        return None
    out = []
    for b in blocks:
        inside = [i for i, t in enumerate(b.tags) if t in ARTICLE]
        inner = set(b.tags[inside[0]:]) if inside else set()
        out.append(int(bool(inside) and not inner & NEVER and not BOILER & {FAMILY.get(n) for n in b.names}
                       and HIDDEN not in b.names))
    return out


def patterns(seed: int = SEED, pages: int = 400) -> list[tuple[list[Block], list[int]]]:
    """Labelled arrangements: every family's names around, before, after and inside an article of some kind."""
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def text(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        words = ["".join(pick("aeioustnrlcd") for _ in range(int(rng.integers(2, 9)))) for _ in range(n)]
        return " ".join(words).capitalize() + pick([".", ".", ".", "!", "", "?"])

    def boiler(inside: bool) -> str:
        family = pick(["advert", "menu", "side", "notice", "comment", "form", "share", "foot", "head"][: 8 if inside else 9])
        word = pick(FAMILIES[family].split())
        attribute = f'{pick(["class", "class", "id"])}="{pick(["", "site-", "js ", "block "])}{word}{pick(["", "-box", "-area", " wrap"])}"'
        if family == "menu":
            items = "".join(f'<li><a href="/">{text(1, 3)}</a></li>' for _ in range(int(rng.integers(2, 8))))
            return pick([f"<nav><ul>{items}</ul></nav>", f"<div {attribute}><ul>{items}</ul></div>", f"<nav {attribute}>{items}</nav>"])
        if family == "side":
            inner = f"<h3>{text(1, 4)}</h3>" + pick([f"<p>{text(4, 40)}</p>", f'<ul><li><a href="/">{text(3, 9)}</a></li><li><a href="/">{text(3, 9)}</a></li></ul>'])
            return pick([f"<aside>{inner}</aside>", f"<aside {attribute}>{inner}</aside>", f"<div {attribute}>{inner}</div>", f"<section {attribute}>{inner}</section>"])
        if family == "comment":
            notes = "".join(pick([f"<p>{text(3, 60)}</p>", f'<li class="comment"><b>{text(1, 2)}</b> <p>{text(3, 60)}</p></li>',
                                  f'<div class="comment"><p>{text(3, 60)}</p></div>', f'<article class="comment"><p>{text(3, 60)}</p></article>'])
                            for _ in range(int(rng.integers(1, 6))))
            return pick([f"<section {attribute}><h2>{text(1, 3)}</h2>{notes}</section>", f"<div {attribute}>{notes}</div>", f"<ol {attribute}>{notes}</ol>"])
        if family == "form":
            inner = f"<label>{text(1, 4)}</label><input name=q><p>{text(3, 20)}</p>"
            return pick([f"<form>{inner}</form>", f"<form {attribute}>{inner}</form>", f"<div {attribute}><p>{text(3, 20)}</p></div>"])
        if family == "foot":
            inner = pick([f"&copy; {text(2, 12)}", f"<p>&copy; {text(2, 12)}</p>", f"<p>{text(3, 30)}</p>"])
            return pick([f"<footer>{inner}</footer>", f"<div {attribute}>{inner}</div>"])
        if family == "head":
            inner = pick([f"<p>{text(1, 8)}</p>", f"<h1>{text(1, 4)}</h1>", f"<div>{text(1, 6)}</div><p>{text(2, 12)}</p>"])
            return pick([f"<header>{inner}</header>", f"<header {attribute}>{inner}</header>", f"<div {attribute}>{inner}</div>"])
        inner = pick([text(2, 40), f"<p>{text(2, 40)}</p>", f"<span>{text(2, 40)}</span>", f"<p>{text(4, 30)}</p><p>{text(4, 30)}</p>"])
        return f"<{(tag := pick(['div', 'div', 'section', 'p']) if not inner.startswith('<p') else 'div')} {attribute}>{inner}</{tag}>"

    mark = "\ue000"  # stands in the text of kept blocks

    def kept() -> str:
        one = f"<p>{mark}{text(1, 90)}</p>"
        return pick([one] * 8 + [f"<h2>{mark}{text(1, 8)}</h2>", f"<ul><li>{mark}{text(2, 25)}</li><li>{mark}{text(2, 25)}</li></ul>",
                                 f"<blockquote>{mark}{text(5, 40)}</blockquote>", f"<blockquote><p>{mark}{text(5, 40)}</p></blockquote>",
                                 f"<pre>{mark}{text(3, 30)}</pre>", f"<table><tr><td>{mark}{text(1, 6)}</td><td>{mark}{text(1, 6)}</td></tr></table>",
                                 f"<p>{mark}{text(2, 20)} <a href='/'>{text(1, 4)}</a> {text(2, 20)}</p>", f"<figure><figcaption>{mark}{text(3, 15)}</figcaption></figure>",
                                 f"<p><b>{mark}{text(2, 50)}<br>", f"<h3>{mark}{text(1, 6)}</h3>"])

    def add(page: str) -> None:
        blocks = leaf_blocks(page)
        labels = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "") or "."
        out.append((blocks, labels))

    out = []
    for _ in range(pages):
        title = f"<h1>{mark}{text(2, 14)}</h1>"
        title = pick([title, title, f"<header>{title}</header>", f"<div>{title}</div>"])
        body = title + "".join(boiler(True) if rng.random() < 0.12 else kept() for _ in range(int(rng.integers(1, 14))))
        word = pick(FAMILIES["body"].split())
        body = pick([f"<article>{body}</article>", f"<article class='{word}'>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>",
                     f"<div class='{word}'>{body}</div>", f"<div id='{word}'>{body}</div>", f"<section class='{word}-wrap'>{body}</section>", f"<div>{body}</div>",
                     f"<div role='main'>{body}</div>"])
        around = ["".join(boiler(False) for _ in range(int(rng.integers(0, 4)))) for _ in range(2)]
        page = f"<html><body>{around[0]}{body}{around[1]}</body></html>"
        if rng.random() < 0.3:
            page = page.replace("<body>", "<body><div class='wrapper'><div class='container'>").replace("</body>", "</div></div></body>")
        add(page)
    # What is hidden looks like any text.
    for _ in range(pages // 8):
        parts = [kept() for _ in range(int(rng.integers(2, 9)))]
        hidden = "".join(kept() for _ in range(int(rng.integers(1, 4)))).replace(mark, "")
        how = pick(["hidden", "hidden=''", "style='display: none'", "style='display:none;color:red'"])
        parts.insert(int(rng.integers(0, len(parts) + 1)), f"<{(tag := pick(['div', 'section']))} {how}>{hidden}</{tag}>")
        tag = pick(["article", "main", "div class='content'"])
        add(f"<html><body>{boiler(False)}<{tag}>{''.join(parts)}</{tag.split()[0]}>{boiler(False)}</body></html>")
    return out


def described(blocks: list[Block], hide: frozenset = frozenset()) -> list[set[str]]:
    return [place_features(b.tags, b.names, hide) | text_features(b, p) for b, p in zip(blocks, [None, *blocks[:-1]])]


def drawn(pages: DataFrame, key: str, html: str, number: int) -> list[str]:
    """At most ``number`` pages of at most TRAINING_LENGTH characters, those with the smallest hashes of key and length. Only
    keys are put in order; the pages of the chosen ones are fetched in a second pass."""
    fit = pages.select(F.col(key).alias("key"), F.length(html).alias("size"), F.col(html).alias("html")).filter(F.col("size") <= TRAINING_LENGTH)
    mark = F.xxhash64(F.col("key").cast("string"), F.col("size"))
    chosen = fit.select("key", "size", mark.alias("mark")).orderBy("mark", "key").limit(number).collect()
    if not chosen:
        return []
    wanted = pages.sparkSession.createDataFrame(
        sorted({tuple(r) for r in chosen}, key=str), f"k {fit.schema['key'].dataType.simpleString()}, s int, m bigint")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("size") == F.col("s"))
    met = fit.filter(mark <= max(r["mark"] for r in chosen)).join(F.broadcast(wanted), same)  # at most `number` rows
    found = met.groupBy("m", "k", "s").agg(F.min("html").alias("html")).collect()  # rows of one key and length count once
    return [r["html"] for r in sorted(found, key=lambda r: (r["m"], str(r["k"]), r["s"]))]


def learnt(pages: DataFrame, key: str = "page_id", html: str = "html", training_pages: int = TRAINING_PAGES, **settings) -> Field:
    """The field of a table: from a bounded sample of its pages, as far as they label themselves, and the patterns."""
    learn = [(described(blocks), labels) for blocks, labels in patterns()]
    for page in drawn(pages, key, html, training_pages):
        blocks = leaf_blocks(page)
        labels = own_labels(blocks)
        if labels and len(blocks) <= TRAINING_BLOCKS:
            learn += [(described(blocks), labels), (described(blocks, ARTICLE), labels)]
    return train(learn, **settings)


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, model.decode(blocks)) if keep)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Field | None = None,
              **settings) -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars.

    A missing or empty page, or one without a main text, has the empty text. Rows that repeat each other give equal
    rows. No rows give no rows. Other columns may have any name.
    """
    model = model or learnt(pages, key, html, **settings)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(p, model) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())],
                                             names=["key", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = rows.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars bigint")
    return made.withColumnsRenamed({"key": key, "url": url})
