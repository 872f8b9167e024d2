"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks: runs of text between the borders of block elements, with character
references decoded and white space made single; heads, scripts, styles and comments have no text.
Each block has features of its ancestors (tags, words of class, id and role) and of its text
(length, link density, closing punctuation, ...). A two-label chain says main text or not;
its weights come from maximum likelihood (forward-backward) on labelled pages, and Viterbi decodes.

The labelled pages are drawn by `labelled_pages`: many layouts, with and without semantic tags and telling
class names, whose every block is known to be article or not.

Defined results: a null or empty page has no text (""); a page whose blocks are all rejected likewise;
repeated rows are treated each by itself; an empty table gives an empty result; broken markup is
read as far as it can be, in time linear in its length, a "<" that begins no tag being text; other columns are not looked at.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, ship

_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
#: The usual tag: no "<" before its end. Possessive, so that a failed match costs no more than one look at its characters.
_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_MARK = re.compile(r"[<>\"']")
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "title", "template", "textarea", "iframe", "svg", "canvas"}
#: Of these, all but the last two run to the end of the page if nothing closes them.
_TO_END = _RAW - {"svg", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "button", "label", "option", "select"}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
_APART = {"nav", "header", "footer", "aside", "form", "button", "label", "menu", "dialog", "select", "fieldset"}
_WORD = re.compile(r"[a-z]+")
#: Elements opened deeper than this count as siblings at that depth; their text stays.
DEPTH = 128
_ENDS = re.compile(r"[<>]")


class Tags:
    """Finds the end of tags in one page, in time linear in the page whatever it holds."""

    def __init__(self, page: str):
        self.page, self.last, self.lone = page, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
        self.bad: set[int] = set()  # where quotes began in tags that came to nothing

    def end(self, at: int) -> int:
        """The place of the ">" that ends the tag whose name ends at `at`; -1 if it is none."""
        if at > self.last:
            return -1
        k, opened = at, []
        while m := _MARK.search(self.page, k):
            k, c = m.start(), m.group()
            if c == ">":
                return k
            if c == "<" or k in self.bad:
                break
            opened.append(k)
            k = k + 1 if k == self.lone[c] else self.page.index(c, k + 1) + 1  # the last quote of its kind quotes nothing
        self.bad.update(opened)
        m = _ENDS.search(self.page, at)  # quotes that don't pair up are characters like others
        return m.start() if m and m.group() == ">" else -1


def path(node: tuple | None) -> list[tuple[str, str]]:
    """The open elements of a block as (tag, words of its attributes), outermost first."""
    out = []
    while node:
        node, element = node
        out.append(element)
    return out[::-1]


def blocks(page: str | None) -> list[tuple[str, tuple | None, int, str]]:
    """(text, node of the open elements, characters in links, own tag) of each leaf block."""
    out: list = []
    stack: list[tuple[str, str]] = []
    nodes: list[tuple] = []  # for each open element (the node around it, its tag and words), shared by all blocks within
    parts: list[str] = []
    in_link = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, nodes[-1] if nodes else None, link_chars, stack[-1][0] if stack else ""))
            parts.clear()
        link_chars = 0

    page = page or ""
    at, end = 0, len(page)
    tags, over, unclosed = Tags(page), {}, set()
    while at < end:
        if page[at] != "<":
            k = page.find("<", at)
            text, at = page[at : k if k >= 0 else end], k if k >= 0 else end
            parts.append(text)
            if in_link:
                link_chars += len(text)
            continue
        if page.startswith("<!--", at):
            k = page.find("-->", at + 4)
            at = k + 3 if k >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at) and at < tags.last:
            at = page.index(">", at) + 1
            continue
        m = _TAG.match(page, at)
        if m:
            closing, name, attrs, at = m.group("close"), m.group("name").lower(), m.group("attrs"), m.end()
        else:
            m = _NAME.match(page, at)
            stop = tags.end(m.end()) if m else -1
            if stop < 0:  # no tag begins here
                parts.append("<")
                link_chars += bool(in_link)
                at += 1
                continue
            closing, name, attrs, at = m.group(1), m.group(2).lower(), page[m.end() : stop], stop + 1
        alone = attrs.endswith("/")
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in _BLOCK:
                flush()
                if over.get(name):
                    over[name] -= 1
                    continue
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:], nodes[k:]
                        break
            continue
        if name in _RAW:
            if not alone and name not in unclosed:
                raw = re.compile(f"</{re.escape(name)}\\s*+>", re.I).search(page, at)
                at = raw.end() if raw else end if name in _TO_END else at
                if not raw:
                    unclosed.add(name)
            continue
        if name == "a":
            in_link = 1
        if name in ("br", "hr", "img"):
            parts.append(" ")
            if name == "hr":
                flush()
            continue
        if name in _VOID or name not in _BLOCK:
            continue
        flush()
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:], nodes[k:]
                    break
                if stack[k][0] in ("td", "th", "button", "li", "div", "section", "article"):
                    break
        if name in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[name]:
                    break
                if stack[k][0] == name or (name in ("dt", "dd") and stack[k][0] in ("dt", "dd")) or (name in ("td", "th") and stack[k][0] in ("td", "th")):
                    del stack[k:], nodes[k:]
                    break
        words = " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).lower() if "=" in attrs else ""
        if not alone:
            if len(stack) < DEPTH:
                stack.append((name, words))
                nodes.append((nodes[-1] if nodes else None, stack[-1]))
            else:
                over[name] = over.get(name, 0) + 1
        in_link = 0 if name in ("article", "main", "section", "body") else in_link
    flush()
    return [b for b in out if not any(t == "head" for t, _ in path(b[1]))]


def features(found: list) -> list[list[str]]:
    """Feature names of each block of a page."""
    out = []
    n = len(found)
    for k, (text, node, links, own) in enumerate(found):
        stack = path(node)
        f = ["bias", f"own={own}"]
        tags = {t for t, _ in stack}
        f.extend(f"in={t}" for t in tags)
        words = set()
        for _, w in stack:
            if w:
                words.update(_WORD.findall(w))
        f.extend(f"word={w}" for w in words)
        f.extend(f"kind={k}" for k, known in _KINDS.items() if words & known)
        zone = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("article", "main")), None)
        if zone is not None:
            under = stack[zone + 1 :]
            clean = not any(w for _, w in under) and not any(t in _APART for t, _ in under) and not any(t in _APART for t, _ in stack[:zone])
            f.append("zone=clean" if clean else "zone=mixed")
            f.extend(f"inner={w}" for _, ws in under for w in _WORD.findall(ws))
        near = next((t for t, _ in reversed(stack) if t in _APART or t in ("article", "main", "section")), "none")
        f.append(f"near={near}")
        size = len(text)
        f.append(f"size={min(9, size.bit_length())}")
        density = links / max(1, size)
        f.append("links=none" if not links else "links=few" if density < 0.3 else "links=half" if density < 0.7 else "links=all")
        f.append("ends=stop" if text[-1] in ".!?…»”\"'。" else "ends=colon" if text[-1] == ":" else "ends=open")
        if "©" in text or "(c)" in text.lower():
            f.append("copyright")
        f.append(f"spaces={min(6, text.count(' ').bit_length())}")
        f.append("place=first" if k == 0 else "place=last" if k == n - 1 else f"place={4 * k // n}")
        if not tags & {"article", "main", "nav", "header", "footer", "aside", "form"}:
            f.append("plain")
            f.append(f"plain,size={min(9, size.bit_length())}")
        out.append(f)
    return out


class Chain:
    """Weights of a linear chain with labels 0 (other) and 1 (main text)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, between: np.ndarray):
        self.names, self.weights, self.between = names, weights, between
        self.table = {k: float(weights[i]) for k, i in names.items()}

    def emissions(self, feats: list[list[str]]) -> list[float]:
        get = self.table.get
        return [sum([get(x, 0.0) for x in f]) for f in feats]

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi; label 0 has emission score 0."""
        if not feats:
            return []
        (aa, ab), (ba, bb) = self.between.tolist()
        e = self.emissions(feats)
        zero, one, back = 0.0, e[0], []
        for x in e[1:]:
            p, q = int(one + ba > zero + aa), int(one + bb > zero + ab)
            back.append((p, q))
            zero, one = (one + ba if p else zero + aa), (one + bb if q else zero + ab) + x
        label = int(one > zero)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 220, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Maximum likelihood with an L2 penalty, by AdaGrad on the exact gradient from forward-backward."""
    names: dict[str, int] = {}
    rows, cols, length = [], [], [len(y) for _, y in pages]
    steps, count = max(length), len(pages)
    for i, (feats, _) in enumerate(pages):
        for t, f in enumerate(feats):
            for x in f:
                rows.append(t * count + i)
                cols.append(names.setdefault(x, len(names)))
    rows_, cols_ = np.array(rows), np.array(cols)
    gold, mask = np.zeros((steps, count)), np.zeros((steps, count), bool)
    for i, (_, y) in enumerate(pages):
        gold[: len(y), i], mask[: len(y), i] = y, True
    w, between = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_b = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    gold_pairs = np.zeros((2, 2))
    both = mask[1:] & mask[:-1]
    for a in (0, 1):
        for b in (0, 1):
            gold_pairs[a, b] = ((gold[:-1] == a) & (gold[1:] == b) & both).sum()
    for _ in range(rounds):
        e = np.zeros((steps, count, 2))
        e[..., 1] = np.bincount(rows_, w[cols_], steps * count).reshape(steps, count)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            nxt = np.logaddexp(alpha[t - 1][:, 0, None] + between[0], alpha[t - 1][:, 1, None] + between[1]) + e[t]
            alpha[t] = np.where(mask[t][:, None], nxt, alpha[t - 1])
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        pairs = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            ahead = e[t + 1] + beta[t + 1]
            nxt = np.logaddexp(between[:, 0] + ahead[:, 0, None], between[:, 1] + ahead[:, 1, None])
            beta[t] = np.where(mask[t + 1][:, None], nxt, 0.0)
            joint = alpha[t][:, :, None] + between[None] + ahead[:, None, :] - total[:, None, None]
            pairs += (np.exp(np.minimum(joint, 0)) * mask[t + 1][:, None, None]).sum(axis=0)
        p = np.where(mask, np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - total[None], 0)), 0.0)
        grad_w = np.bincount(cols_, (p - gold).ravel()[rows_], len(names)) / count + decay * w
        grad_b = (pairs - gold_pairs) / count + decay * between
        seen_w += grad_w**2
        seen_b += grad_b**2
        w -= rate * grad_w / np.sqrt(seen_w)
        between -= rate * grad_b / np.sqrt(seen_b)
    return Chain(names, w, between)


_SYLLABLES = {"en": "th er on in tion st nd re at en ing or es ti ha ou ble ly", "de": "ein sch ver ung ge lich heit ach te be pf tz ü ä er", "fr": "eau re ment é tion ou ai le an oi è queux pa vi", "es": "ción mente do ra ll ar os as que ñ í ez ga ja"}
_SMALL = {"en": "the of and to in a is that for it", "de": "der die und in den das mit sich des auf", "fr": "de la le et les des en un du que", "es": "de la que el en y a los se del"}
_JUNK = {
    "nav": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs links pager pagination toc", "header": "header masthead branding topbar logo site hero", "footer": "footer foot bottom copyright legal colophon", "sidebar": "sidebar side aside widget rail related recommended popular trending more",
    "notice": "cookie consent notice banner gdpr alert popup modal overlay message", "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox adslot", "form": "form login search newsletter subscribe signup register contact", "comments": "comments comment replies reply discussion responses disqus thread", "share": "share social sharing tags meta byline author toolbar",
}
_MAIN = "content main article post entry story body text page body-text post-content entry-content articlebody"
_KINDS = {k: set(_WORD.findall(v)) for k, v in (_JUNK | {"main": _MAIN}).items()}


#: Labelled pages with more blocks are not used: training goes through all pages block by block.
_MOST_BLOCKS = 40
_split = lru_cache(maxsize=None)(str.split)


class _Draw(random.Random):
    """The few draws that the pages need; much faster for single values than numpy's."""

    def integers(self, low: int, high: int) -> int:
        return self.randrange(low, high)

    def choice(self, items, n: int | None = None):
        return items[int(self.random() * len(items))] if n is None else [items[int(self.random() * len(items))] for _ in range(n)]


def labelled_pages(count: int = 900, seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks of `count` drawn pages."""
    rng = _Draw(seed)
    pick = lambda words: rng.choice(_split(words) if isinstance(words, str) else words)
    out = []
    for _ in range(count):
        main: set[str] = set()
        other: set[str] = set()

        def words(n: int, lang: str) -> str:
            made = [pick(_SMALL[lang]) if rng.random() < 0.35 else "".join(rng.choice(_SYLLABLES[lang].split(), int(rng.integers(1, 5)))) for _ in range(n)]
            return " ".join(made)

        def sentence(lang: str, low: int = 4, high: int = 18) -> str:
            style = rng.random()
            s = words(int(rng.integers(low, high)), lang).capitalize()
            if style < 0.05:
                s = " ".join(f"{x}{pick('*** ### $$$ %%%')}" for x in s.split())
            elif style < 0.1:
                s = s.upper() + "!!"
            return s + pick(". . . . ! ? .")

        def say(to: set[str], text: str) -> str:
            to.add(" ".join(html.unescape(text).split()))
            return text

        lang = pick(list(_SYLLABLES))
        semantic = rng.random() < 0.6
        telling = rng.random() < 0.85

        def attrs(kind: str) -> str:
            if not telling and rng.random() < 0.8:
                return pick([' class="c1"', ' id="x2"', "", ' class="row col"'])
            w = pick(_JUNK.get(kind, _MAIN))
            if rng.random() < 0.3:
                w = f"{pick('site page the box block l')}-{w}"
            return f' {pick("class id class")}="{w}"'

        def wrap(kind: str, inner: str) -> str:
            tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "notice": pick("div section dialog aside"), "ad": pick("div aside"), "comments": pick("section div"), "share": pick("div ul p")}[kind]
            if not semantic and kind != "form":
                tag = "div"
            bare = semantic and kind in ("nav", "header", "footer", "sidebar", "form") and rng.random() < 0.6
            return f"<{tag}{'' if bare else attrs(kind)}>{inner}</{tag}>"

        def links(n: int) -> str:
            items = [f'<a href="/{k}">{say(other, words(int(rng.integers(1, 4)), pick(list(_SYLLABLES))))}</a>' for k in range(n)]
            form = rng.random()
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if form < 0.6 else "".join(f"<p>{x}</p>" for x in items) if form < 0.8 else "".join(f"<div>{x}</div>" for x in items)

        def junk(kind: str) -> str:
            other_lang = pick(list(_SYLLABLES))
            text = lambda a, b: say(other, " ".join(sentence(other_lang) for _ in range(int(rng.integers(a, b)))))
            if kind == "nav":
                return wrap(kind, links(int(rng.integers(2, 9))))
            if kind == "header":
                return wrap(kind, f"<{pick('h1 h2 div p')}>{say(other, words(int(rng.integers(1, 5)), lang))}</{pick('h1 h2 div p')}>" + (links(3) if rng.random() < 0.4 else ""))
            if kind == "footer":
                if rng.random() < 0.5:
                    return wrap(kind, say(other, f"&copy; {words(2, lang)} &middot; " + sentence(other_lang)))
                return wrap(kind, f"<p>{text(1, 3)}</p>" + (links(2) if rng.random() < 0.5 else ""))
            if kind == "sidebar":
                return wrap(kind, f"<h3>{say(other, words(2, lang))}</h3>" + (links(int(rng.integers(2, 6))) if rng.random() < 0.6 else f"<p>{text(1, 4)}</p>"))
            if kind == "form":
                return wrap(kind, f"<label>{say(other, words(2, lang))}</label><input type=text><button>{say(other, words(1, lang))}</button>")
            if kind == "comments":
                inner = "".join(f"<{t}{attrs(kind)}>{text(1, 4)}</{t}>" for t in [pick("div p li article")] for _ in range(int(rng.integers(1, 5))))
                return wrap(kind, (f"<h3>{say(other, words(1, lang))}</h3>" if rng.random() < 0.6 else "") + inner)
            if kind == "share":
                return wrap(kind, say(other, words(int(rng.integers(1, 5)), lang)))
            inner = text(1, 3)
            return wrap(kind, inner if rng.random() < 0.6 else f"<p>{inner}</p>")

        paragraphs = []
        for k in range(1 if rng.random() < 0.15 else int(rng.integers(1, 14))):
            kind = rng.random()
            if k and kind < 0.12:
                paragraphs.append(f"<{pick('h2 h3')}>{say(main, words(int(rng.integers(1, 7)), lang).capitalize())}</{pick('h2 h3')}>")
            elif kind < 0.17:
                paragraphs.append("<ul>" + "".join(f"<li>{say(main, sentence(lang, 2, 12))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.21:
                paragraphs.append(f"<blockquote>{say(main, sentence(lang))}</blockquote>")
            elif kind < 0.24:
                paragraphs.append("<table><tr>" + "".join(f"<td>{say(main, words(2, lang))}</td>" for _ in range(4)) + "</tr></table>")
            elif kind < 0.27:
                paragraphs.append(f"<pre>{say(main, sentence(lang))}</pre>")
            else:
                body = say(main, " ".join(sentence(lang) for _ in range(rng.choice([1, 1, 2, 3, 5, 8]))) if rng.random() < 0.75 else words(int(rng.integers(1, 5)), lang).capitalize() + pick([".", ".", "", "!"]))
                if rng.random() < 0.15:
                    body = f'<a href="/x">{body[:20]}</a>{body[20:]}'
                paragraphs.append(f"<p>{body}</p>" if rng.random() < 0.85 else f"<div>{body}</div>" if rng.random() < 0.5 else f"<p>{body}<br>")
        head = f"<h1>{say(main, words(int(rng.integers(1, 10)), lang).capitalize())}</h1>" if rng.random() < 0.75 else ""
        inside = "".join(paragraphs)
        if rng.random() < 0.5 and len(paragraphs) > 1:
            cut = int(rng.integers(1, len(paragraphs)))
            inside = "".join(paragraphs[:cut]) + junk(pick("ad ad ad share form sidebar notice")) + "".join(paragraphs[cut:])
        if rng.random() < 0.15:
            inside += junk(pick("comments share ad"))
        form = rng.random()
        if semantic:
            body = f"<article>{head}{inside}</article>" if form < 0.5 else f"<main>{head}{inside}</main>" if form < 0.75 else f"<main><article{attrs('main')}>{head}{inside}</article></main>"
        else:
            body = f"<div{attrs('main')}>{head}{inside}</div>" if form < 0.9 else head + inside
        before = [junk(k) for k in ("notice", "header", "nav", "ad", "form", "nav") if rng.random() < 0.4]
        after = [junk(k) for k in ("share", "ad", "comments", "sidebar", "form", "footer", "notice") if rng.random() < 0.4]
        if rng.random() < 0.3:
            before.append(junk("sidebar"))
        if rng.random() < 0.08:
            before, after = [], []
        page = f"<html><head><title>{words(3, lang)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
        found = blocks(page)
        labels = [int(b[0] in main and b[0] not in other) for b in found]
        if 0 < len(found) <= _MOST_BLOCKS:
            out.append((features(found), labels))
    return out


@lru_cache(maxsize=2)
def model(count: int = 900, seed: int = 5) -> Chain:
    return fit(labelled_pages(count, seed))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for b, y in zip(found, chain.decode(features(found))) if y)


def extract(df: DataFrame, html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """df with a column `text` (replacing one of that name) that holds the main text of each page; no shuffle."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(chain or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [main_text(h, sent.value) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=part.schema.names)

    keep = [c for c in df.columns if c != "text" and c != html_col]
    picked = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), F.col(f"`{html_col}`").cast("string").alias("t"))
    done = picked.mapInArrow(run, type(picked.schema)([*picked.schema.fields[:-1], *schema_of("t string").fields]))
    return done.toDF(*keep, "text")
