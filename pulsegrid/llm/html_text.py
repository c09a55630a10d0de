"""Main-text extraction: a recurrent labeller over the blocks of a page.

A page is cut into leaf blocks (runs of text between block-level tags) with
the path of open block elements.  Each block becomes a vector: its hashed path
(tags, class and id words), its hashed words, and its length, link share and
punctuation.  A bidirectional LSTM in numpy reads the blocks of a whole page
and labels each as main text or not.

The labeller is trained here, on pages that ``synthetic_page`` writes with
their labels: articles in several layouts among menus, headers, footers,
sidebars, notices, adverts, forms, comments and lists of links.  Training takes
a few seconds, is the same at every run, and its result is a fixed size.

Defined results: a null or empty page, or one without text, has an empty text;
comments and the raw text of scripts, styles and frames never become blocks, and
what other elements hold (formulas, fallbacks of media and scripts) is text;
markup that is cut short or badly nested is read as far as it goes, in time
that is linear in the page; repeated rows are each extracted; other columns are
not looked at.  A page is read whole whatever its length: its blocks meet the
network in steps, and only the network's states are kept for all of them.
"""

from __future__ import annotations

import functools
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

PATHS, WORDS, HIDDEN = 512, 32, 24
#: Open elements that a path names; what is nested deeper has the path of this depth, and only its tags are kept, so that end tags close what they belong to.
DEEP = 200
#: Blocks that meet the network at once.
STEPS = 4096
STEP_BYTES = 1 << 22
PAGES = 900

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page (fixed by the HTML standard).
RAW = frozenset("script style iframe noembed noframes".split())
#: An open element of these is closed by an opening tag of its group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open paragraph is closed by any block; these scopes stop the search for what to close.
SCOPE = frozenset("article aside body div table ul ol dl section main nav header footer form blockquote".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
VALUE = re.compile(r">|=\s*+")
LOOSE = re.compile(r"</?[a-zA-Z][^>]*>?")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-zA-Z]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class Tags:
    """The tags of a page in order, in one pass: quotes hide ``>`` in values of attributes, unless they are never closed."""

    def __init__(self, page: str):
        self.page, self.plain = page, False
        self.last = {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """Behind the ``>`` of the tag whose name ends at ``at``, or -1."""
        page, begin = self.page, at
        while not self.plain:
            m = VALUE.search(page, at)
            if m is None:  # a quote ran over the rest of the page: from here on quotes hide nothing
                self.plain = True
                break
            at = m.end()
            if m[0] == ">":
                return at
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                at = page.find(quote, at + 1) + 1 if at < self.last[quote] else at + 1
        return page.find(">", begin) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first tag or comment from ``at`` on: its start and end, ``/`` or nothing, its name (empty: a comment), its attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if m := TAG.match(page, start):
                end = self._end(m.end())
                return (start, end, m[1], m[2].lower(), page[m.end() : end - 1]) if end > 0 else None
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                return (start, end + 1, "", "", "") if end > 0 else None
            at = start + 1
        return None


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>?", re.I)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; a path is a tuple of (tag, name words)."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    deep: list[str] = []  # open elements beyond the path
    places: dict[str, list[int]] = {}  # where in them each tag stands
    scopes: list[int] = []  # for each of them, the innermost scope up to it, or -1
    linked, anchor, at, tags = 0, False, 0, Tags(page)

    def shed(size: int) -> None:
        while len(deep) > size:
            places[deep.pop()].pop()
            scopes.pop()

    def cut(size: int) -> None:
        shed(0)
        del stack[size:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            held.append(raw)
            if anchor:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(stack), text, linked))
            held.clear()
        linked = 0

    while (found := tags.next(at)) is not None:
        start, end, close, tag, rest = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        if close:
            if tag == "a":
                anchor = False
            elif tag in BLOCK:
                flush()
                if places.get(tag):
                    shed(places[tag][-1])
                    continue
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        cut(i)
                        break
            continue
        if tag in RAW:
            shut = _raw_end(tag).search(page, at)
            at = len(page) if shut is None else shut.end()
            held.append(" ")
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            anchor = True
        elif tag in BLOCK:
            flush()
            shut = CLOSES.get(tag, set()) | {"p"}
            if tag == "body":
                shed(0)
                stack[:] = [s for s in stack if s[0] == "html"]
            elif tag not in ("head", "title", "noscript"):  # a head that is never closed ends at the first block
                stack[:] = [s for s in stack if s[0] not in ("head", "title")]
            scope = scopes[-1] if deep else -1
            near = max((places[t][-1] for t in shut if places.get(t)), default=-1)
            if near > scope:
                shed(near)
            elif scope < 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut:
                        cut(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
            if tag in VOID:
                continue
            if deep or len(stack) >= DEEP:
                places.setdefault(tag, []).append(len(deep))
                scopes.append(len(deep) if tag in SCOPE else scopes[-1] if deep else -1)
                deep.append(tag)
            else:
                names = " ".join(a or b or c for a, b, c in NAMES.findall(rest)) if rest else ""
                stack.append((tag, tuple(x.lower() for x in PARTS.findall(names))))
    rest = page[at:]
    if (end := rest.rfind("<")) >= 0 and LOOSE.fullmatch(rest[end:]):
        rest = rest[:end]  # a tag that the end of the page cuts short
    add(rest)
    flush()
    return [b for b in out if not any(tag in ("head", "title") for tag, _ in b.path)]


@functools.lru_cache(200_000)
def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(50_000)
def _path(path: tuple) -> np.ndarray:
    x = np.zeros(PATHS, np.float32)
    for depth, (tag, names) in enumerate(reversed(path)):
        for token in (tag, *(f".{n}" for n in names), *((f"leaf {tag}",) if depth == 0 else ())):
            x[_bucket(token, PATHS)] = 1
    return x


def _rest(page: list[Block]) -> np.ndarray:
    """Hashed words, length, share of linked text, punctuation, and a one."""
    out = np.zeros((len(page), WORDS + 4), np.float32)
    for row, b in zip(out, page, strict=True):
        words = b.text.split()
        row[:WORDS] = np.bincount([_bucket(w, WORDS) for w in words], minlength=WORDS) / len(words)
        row[-4] = np.log1p(len(b.text)) / 5
        row[-3] = b.linked / max(1, len(b.text))
        row[-2] = sum(map(b.text.count, ".,;:!?")) / len(words)
        row[-1] = 1
    return out


def vectors(page: list[Block]) -> np.ndarray:
    return np.concatenate([np.stack([_path(b.path) for b in page]) if page else np.zeros((0, PATHS), np.float32), _rest(page)], 1)


NOISE = {
    "nav": ["nav", "ul menu", "div navbar", "div breadcrumb", "div id:menu", "div topmenu", "ol breadcrumbs"],
    "header": ["header", "div header", "div masthead", "div site title", "div id:top"],
    "footer": ["footer", "div footer", "div id:footer", "div copyright", "div legal"],
    "aside": ["aside", "div sidebar", "aside related", "div related posts", "div widget", "section recommended", "div trending", "div tags", "ul tag list"],
    "notice": ["div cookie notice", "div banner", "div consent", "div notice", "div alert", "div popup modal", "div gdpr", "div newsletter", "div subscribe"],
    "ad": ["div ad", "div ads", "div advert", "div sponsored", "aside promo", "div advertisement", "div adsbygoogle", "div banner ad"],
    "form": ["form", "form search", "form login", "div signup form"],
    "comments": ["section comments", "div comments", "div id:comments", "ol comment list", "div comment thread", "article comment", "div disqus replies"],
    "share": ["div share", "ul social links", "div byline meta", "div pagination", "div author bio"],
}
MAIN = ["div id:main", "main id:main", "div story", "td", "div page", "section content", "article", "main", "main > article", "div content", "div post body", "section story", "div article body", "div entry content", "div id:content", "article post", "div text", "section", "div", "div", ""]


def synthetic_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    syllables = "an er on the in ou st re ti ble shed nor kal mi tor ö ä ver lich ción que eau tre no da".split()
    labels: list[bool] = []
    #: Names that tell nothing, on some pages of all noise, on some of the article too.
    opaque, opaque_main = rng.random() < 0.08, rng.random() < 0.15

    def name() -> str:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 7)))

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(low, high + 1)))

    def sentence() -> str:
        text = words(3, 18)
        return text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "?", "!"])

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.integers(low, high + 1)))

    def leaf(tag: str, text: str, main: bool) -> str:
        labels.append(main)
        return f"<{tag}>{text}" if tag in ("p", "li") and rng.random() < 0.15 else f"<{tag}>{text}</{tag}>"

    def opened(what: str, blind: bool = False) -> tuple[str, str]:
        tag, *names = what.split()
        if blind and names:
            names = [name()]
        ids = [n[3:] for n in names if n.startswith("id:")]
        classes = "-".join(n for n in names if not n.startswith("id:"))
        return f"<{tag}" + (f' class="{classes}"' if classes else "") + (f' id="{ids[0]}"' if ids else "") + ">", f"</{tag}>"

    def noise(kind: str) -> str:
        start, end = opened(str(rng.choice(NOISE[kind])), opaque and kind != "comments")
        body = ""
        if kind in ("nav", "share") or kind in ("aside", "footer", "header") and rng.random() < 0.5:
            items = [leaf("li", f'<a href="/{rng.integers(99)}">{words(1, 3)}</a>', False) for _ in range(rng.integers(2, 9))]
            body = ("" if start.startswith(("<ul", "<ol")) else "<ul>") + "".join(items) + ("" if start.startswith(("<ul", "<ol")) else "</ul>")
        elif kind == "form":
            labels.append(False)
            body = f"<label>{words(1, 3)}</label><input name=q>"
            labels.append(False)
            body += f"<button>{words(1, 2)}</button>"
        elif kind == "comments":
            if rng.random() < 0.6:
                body += leaf("h3", words(1, 2), False)
            for _ in range(rng.integers(1, 5)):
                inner, shut = opened(str(rng.choice(["div comment", "div reply", "div"])))
                body += inner + leaf("p", prose(1, 4), False) + shut
        elif rng.random() < 0.5:
            labels.append(False)
            body = prose(1, 2) if rng.random() < 0.6 else f"&copy; {words(2, 5)} &middot; {prose(1, 1)}"
        else:
            body = "".join(leaf("p", prose(1, 3), False) for _ in range(rng.integers(1, 4)))
        return start + body + end

    def article() -> str:
        tags = [opened(w, opaque_main) for w in str(rng.choice(MAIN)).split(" > ") if w]
        odd = rng.random() < 0.25  # an article of scraps: repeated lines, lone words, capitals
        again = prose(1, 1)
        parts = []
        short = rng.random() < 0.15
        if rng.random() < (0.4 if short else 0.8):
            parts.append(leaf("h1", words(2, 9), True))
        if rng.random() < 0.1:
            labels.append(True)
            parts.append(f'<p class="byline">{words(1, 4)}</p>')
        for _ in range(rng.integers(1, 3) if short else rng.integers(15, 50) if rng.random() < 0.1 else rng.integers(1, 14)):
            kind = rng.random()
            if odd and rng.random() < 0.6:
                parts.append(leaf("p", str(rng.choice([again, words(1, 1), words(1, 3), prose(1, 2).upper(), f"{words(1, 1)} " * 9])), True))
            elif kind < 0.7:
                parts.append(leaf("p", prose(), True))
            elif kind < 0.76:
                parts.append(leaf(str(rng.choice(["h2", "h3"])), words(1, 6), True))
            elif kind < 0.81:
                parts.append("<ul>" + "".join(leaf("li", prose(1, 2), True) for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.85:
                parts.append("<blockquote>" + leaf("p", prose(1, 3), True) + "</blockquote>")
            elif kind < 0.87:
                parts.append(leaf("pre", words(3, 12), True))
            elif kind < 0.89:
                parts.append("<figure><img src=x>" + leaf("figcaption", words(2, 8), True) + "</figure>")
            elif kind < 0.92:
                parts.append("<table>" + "".join("<tr>" + leaf("td", words(1, 3), True) + leaf("td", words(1, 3), True) + "</tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif kind < 0.95:
                labels.append(True)
                parts.append(f"<p><b>{prose(1, 2)}<br>")
            elif kind < 0.975:
                parts.append(f"<p>{words(2, 4)} <a href=x>{words(1, 3)}</a> {prose(1, 2)}</p>")
                labels.append(True)
            else:
                parts.append(noise(str(rng.choice(["ad", "aside", "notice", "share"]))))
        return "".join(t[0] for t in tags) + "".join(parts) + "".join(t[1] for t in reversed(tags))

    def some(kinds: list[str], chance: float) -> str:
        return "".join(noise(k) for k in kinds if rng.random() < chance)

    before = list(rng.permutation(["header", "nav", "notice", "ad", "aside", "form"]))
    after = list(rng.permutation(["aside", "comments", "form", "share", "ad", "notice", "nav"]))
    bare = 0 if rng.random() < 0.08 else 1  # a page of nothing but its article
    body = some(before, 0.5 * bare) + article() + some(after, 0.4 * bare) + some(["footer"], 0.8 * bare)
    for _ in range(rng.integers(0, 3)):
        name = rng.choice(["page", "wrapper", "root", "container", "wrap", "outer", "site", "layout", "row", "".join(rng.choice(list("abcdefghiklmnoprstu"), 5))])
        body = f'<div {rng.choice(["id", "class"])}="{name}">{body}</div>'
    if not bare and rng.random() < 0.5:
        return body, labels
    return f"<html><head><title>{words(2, 6)}</title><script>var a='</p>';</script></head><body>{body}</body></html>", labels


class Lstm:
    """A bidirectional LSTM with one output for each step."""

    def __init__(self, size: int, rng: np.random.Generator):
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {f"{d}{k}": v for d in "fb" for k, v in (("x", draw(size, 4 * HIDDEN)), ("h", draw(HIDDEN, 4 * HIDDEN)), ("b", np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)))}
        self.w["o"] = draw(2 * HIDDEN + 1, 1)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray):
        """x: steps by pages by size, in reading order of this direction."""
        steps, pages, _ = x.shape
        drive = x @ self.w[d + "x"] + self.w[d + "b"]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        kept = []
        for t in range(steps):
            z = drive[t] + h @ self.w[d + "h"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            kept.append((h, c, i, f, o, g, tanh := np.tanh(new)))
            c = new
            h = o * tanh * m
            kept[-1] = (*kept[-1], h)
        return kept

    def states(self, x: np.ndarray, mask: np.ndarray):
        forward = self._pass("f", x, mask)
        backward = self._pass("b", x[::-1], mask[::-1])
        h = np.concatenate([np.stack([k[-1] for k in forward]), np.stack([k[-1] for k in backward])[::-1], np.ones((*mask.shape, 1), np.float32)], 2)
        return forward, backward, h

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.states(x, mask)[2] @ self.w["o"])[:, :, 0]))

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text: the same as ``probabilities`` of their vectors above a half.

        What a path contributes is computed once for each different path, and
        the states of both directions are all that is kept for every block.
        """
        steps, n = max(map(len, pages)), len(pages)
        known: dict[tuple, int] = {}
        path, rest, mask = np.zeros((steps, n), np.int32), np.zeros((steps, n, WORDS + 4), np.float32), np.zeros((steps, n), np.float32)
        for i, page in enumerate(pages):
            path[: len(page), i] = [known.setdefault(b.path, len(known)) for b in page]
            rest[: len(page), i], mask[: len(page), i] = _rest(page), 1
        x = np.stack([_path(p) for p in known])
        score = np.full((steps, n), self.w["o"][-1, 0], np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            by_path, w = x @ self.w[d + "x"][:PATHS], self.w[d + "x"][PATHS:]
            h = c = np.zeros((n, HIDDEN), np.float32)
            order = np.arange(steps) if d == "f" else np.arange(steps)[::-1]
            for k in range(0, steps, STEPS):
                some = order[k : k + STEPS]
                drive = by_path[path[some]] + rest[some] @ w + self.w[d + "b"]
                for t, z in zip(some.tolist(), drive, strict=True):
                    z = z + h @ self.w[d + "h"]
                    gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                    m = mask[t][:, None]
                    c = (gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])) * m
                    h = gate[:, 2 * HIDDEN :] * np.tanh(c) * m
                    score[t] += (h @ self.w["o"][part])[:, 0]
        return [score[: len(page), i] > 0 for i, page in enumerate(pages)]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        forward, backward, h = self.states(x, mask)
        wrong = (1 / (1 + np.exp(-(h @ self.w["o"])[:, :, 0])) - y) * mask / mask.sum()
        grad = {"o": np.einsum("tph,tp->h", h, wrong)[:, None]}
        back = wrong[:, :, None] * self.w["o"][:, 0]
        for d, kept, part, seen in (("f", forward, back[:, :, :HIDDEN], x), ("b", backward, back[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1])):
            order = mask if d == "f" else mask[::-1]
            dz = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(self.w[d + "h"])
            for t in reversed(range(len(kept))):
                h0, c0, i, f, o, g, tanh, _ = kept[t]
                m = order[t][:, None]
                dh = (dh + part[t]) * m
                dc = (dc + dh * o * (1 - tanh**2)) * m
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], 1)
                gh += h0.T @ dz[t]
                dh, dc = dz[t] @ self.w[d + "h"].T, dc * f
            grad |= {d + "x": np.einsum("tps,tpz->sz", seen, dz, optimize=True), d + "h": gh, d + "b": dz.sum((0, 1))}
        return grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


@functools.lru_cache(1)
def labeller(pages: int = PAGES, epochs: int = 10, seed: int = 5) -> Lstm:
    """Train on synthetic pages (Adam, batches of 20 pages)."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = synthetic_page(rng)
        found = blocks(page)
        assert len(found) == len(labels), page
        data.append((vectors(found), np.array(labels, np.float32)))
    net = Lstm(data[0][0].shape[1], rng)
    mean, square, step = {k: np.zeros_like(v) for k, v in net.w.items()}, {k: np.zeros_like(v) for k, v in net.w.items()}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(pages), pages // 20):
            x, mask = _padded([data[i][0] for i in part])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(part):
                y[: len(data[i][1]), k] = data[i][1]
            x[:, :, :PATHS] *= rng.random((1, 1, PATHS)) > 0.08  # names that training knows may be missing elsewhere
            x[:, :, PATHS : PATHS + WORDS] *= rng.random((1, len(part), 1)) > 0.5  # and so may words
            step += 1
            rate = 0.01 * (1 - 0.9 * step / (epochs * (pages // 20)))
            for k, g in net.gradients(x, y, mask).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(pages: list[str], net: Lstm) -> list[str]:
    """The main text of each page; pages of like length are read together."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    begin = 0
    while begin < len(order):
        end, most = begin, 0
        while end < len(order) and end - begin < 256 and (most := len(found[order[end]])) * (end - begin + 1) <= 16_384 or end == begin:
            end += 1
        part = order[begin:end]
        for i, main in zip(part, net.labels([found[i] for i in part]), strict=True):
            out[i] = "\n".join(b.text for b, keep in zip(found[i], main.tolist(), strict=True) if keep)
        begin = end
    return out


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in ``keep`` and ``text`` for every row."""
    net = labeller()
    source = pages.select(*keep, F.col(html_col).alias("__html"))
    n = len(keep)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, n, STEP_BYTES):
                text = main_texts([x or "" for x in part.column(n).to_pylist()], net)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(text, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n])
    return source.mapInArrow(run, f"{kinds}, text string")


def op5_recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
