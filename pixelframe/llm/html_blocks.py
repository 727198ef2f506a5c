"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the starts and ends of block elements. Each leaf is
a vector: the mean of hashed vectors of its tag path (elements, classes, ids), the mean of hashed word vectors,
and its length, link share, punctuation and place. A bidirectional LSTM in numpy reads all leaves of a
page in order, so that every block is classified with the whole page as context.

The network is trained here, on `TRAINING_PAGES` pages that `page` makes from a seed: layouts drawn from common
element and class names, with known labels; `trained()` makes it again, and its weights lie beside this module as text. It has
a fixed size and goes to the tasks in their closure.

Defined results. Null and empty html have no blocks: the text is empty. Cut-off markup at the end of a page is
dropped. Repeated pages are read row by row. An empty table gives an empty table. Only page_id, url, html are read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var time wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea".split())
#: Elements that a start tag ends, where one is open in the same container.
ENDS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPE = frozenset("ul ol table body html div article section main aside nav form dl select".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")

Leaf = tuple[str, tuple[str, ...], float]


def leaves(page: str) -> list[Leaf]:
    """(text, path, share of its characters in links) of every nonempty block, in page order."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(x for _, names in stack for x in names)
                out.append((text, path, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    def close(name: str) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if any(x[0] not in INLINE for x in stack[k:]):
                    flush()
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                return

    def text(s: str) -> None:
        nonlocal linked
        if s:
            s = html.unescape(s) if "&" in s else s
            parts.append(s)
            if links:
                linked += len(s)

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            close(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            if name in ENDS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ENDS[name]:
                        close(stack[k][0])
                        break
                    if stack[k][0] in SCOPE:
                        break
            flush()
            close("p")
        if name in VOID:
            continue
        names = [f"<{name}>"] if name not in INLINE else []
        attributes = m[3] or m[6] or ""
        if attributes and name not in INLINE:
            for v in _NAMES.findall(attributes):
                names += [x.lower() for x in _PART.findall(" ".join(v))]
        stack.append((name, tuple(names)))
        links += name == "a"
    flush()
    return out


PATHS, PATH_DIM, WORDS, WORD_DIM, NUMBERS, HIDDEN = 2048, 16, 4096, 8, 6, 16
INPUT = PATH_DIM + WORD_DIM + NUMBERS


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(100_000)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    """Slots of a path's tokens, and of its last element once more under another name."""
    last = [x for x in path if x[0] == "<"][-1:]
    return np.array([_slot(x, PATHS) for x in path] + [_slot(f"last {x}", PATHS) for x in last] or [0])


@lru_cache(200_000)
def _word_slot(word: str) -> int:
    return _slot(word.lower(), WORDS)


class Sequence:
    """A page's leaves as slots and numbers."""

    def __init__(self, page: list[Leaf]) -> None:
        n = len(page)
        words = [[_word_slot(w) for w in text.split(" ")] for text, _, _ in page]
        paths = [_path_slots(path) for _, path, _ in page]
        self.words, self.word_at = np.array([x for w in words for x in w]), np.cumsum([0, *map(len, words)])[:-1]
        self.paths, self.path_at = np.concatenate(paths), np.cumsum([0, *map(len, paths)])[:-1]
        size = np.array([len(w) for w in words], float)
        self.numbers = np.stack(
            [
                np.log1p(size) / 4,
                np.array([x[2] for x in page]),
                np.array([min(1.0, sum(x[0].count(c) for c in ".!?,;:") / (len(x[0]) + 1) * 10) for x in page]),
                np.arange(n) / max(1, n - 1),
                np.array([x[0][-1] in ".!?\"'" for x in page], float),
                np.ones(n),
            ],
            1,
        )


def _means(table: np.ndarray, slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(np.concatenate((at, [len(slots)])))
    return np.add.reduceat(table[slots], at, axis=0) / size[:, None], size


class Labeller:
    """Embeddings, two LSTMs (gates in order: in, forget, out, candidate) and a logistic output."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "paths": r.normal(0, 0.3, (PATHS, PATH_DIM)),
            "words": r.normal(0, 0.02, (WORDS, WORD_DIM)),
            "out": r.normal(0, 0.3, 2 * HIDDEN),
            "bias": np.zeros(1),
        }
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.2, (INPUT + HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, pages: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        n = [len(s.numbers) for s in pages]
        x = np.zeros((max(n), len(pages), INPUT), np.float32)
        mask = np.zeros((max(n), len(pages), 1), np.float32)
        for b, s in enumerate(pages):
            path, _ = _means(self.p["paths"], s.paths, s.path_at)
            word, _ = _means(self.p["words"], s.words, s.word_at)
            x[: n[b], b] = np.concatenate((path, word, s.numbers), 1)
            mask[: n[b], b] = 1
        return x, mask

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        w, c0 = self.p[f"w{d}"], self.p[f"c{d}"]
        t, b, _ = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        out, kept = np.zeros((t, b, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = np.concatenate((x[k], h), 1)
            g = z @ w + c0
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            a = np.tanh(g[:, 3 * HIDDEN :])
            cn = (f * c + i * a) * mask[k]
            tc = np.tanh(cn)
            kept.append((k, z, i, f, o, a, c, tc))
            h, c = o * tc * mask[k], cn
            out[k] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        f, kf = self._pass(x, mask, "f")
        b, kb = self._pass(x, mask, "b")
        h = np.concatenate((f, b), 2)
        return 1 / (1 + np.exp(-(h @ self.p["out"] + self.p["bias"]))), h, {"f": kf, "b": kb}

    def predict(self, pages: list[Sequence]) -> list[np.ndarray]:
        x, mask = self.inputs(pages)
        y = self.forward(x, mask)[0]
        return [y[: len(s.numbers), b] for b, s in enumerate(pages)]

    def gradients(self, pages: list[Sequence], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask = self.inputs(pages)
        y, h, kept = self.forward(x, mask)
        want = np.zeros_like(y)
        for b, v in enumerate(labels):
            want[: len(v), b] = v
        dy = (y - want) * mask[:, :, 0] / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["bias"] = np.einsum("tb,tbh->h", dy, h), np.array([dy.sum()], np.float32)
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for k, z, i, f, o, a, c, tc in reversed(kept[d]):
                dh = (dh + dy[k][:, None] * self.p["out"][part]) * mask[k]
                dc = (dc + dh * o * (1 - tc * tc)) * mask[k]
                g = np.concatenate((dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)), 1)
                grad[f"w{d}"] += z.T @ g
                grad[f"c{d}"] += g.sum(0)
                dz = g @ self.p[f"w{d}"].T
                dx[k] += dz[:, :INPUT]
                dh, dc = dz[:, INPUT:], dc * f
        for b, s in enumerate(pages):
            n = len(s.numbers)
            for name, slots, at, part in (("paths", s.paths, s.path_at, slice(0, PATH_DIM)), ("words", s.words, s.word_at, slice(PATH_DIM, PATH_DIM + WORD_DIM))):
                size = np.diff(np.concatenate((at, [len(slots)])))
                np.add.at(grad[name], slots, np.repeat(dx[:n, b, part] / size[:, None], size, axis=0))
        return grad

    def train(self, pages: list[Sequence], labels: list[np.ndarray], epochs: int, rate: float = 0.02, batch: int = 64, seed: int = 11) -> Labeller:
        """Adam on shuffled batches of pages of similar length, with a falling rate and a pull of word vectors to 0."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, last = 0, epochs * (len(pages) // batch)
        for _ in range(epochs):
            order = np.array(sorted(range(len(pages)), key=lambda k: (len(pages[k].numbers), r.random())))
            for block in r.permutation([order[k : k + batch] for k in range(0, len(order) // batch * batch, batch)]):
                step += 1
                for k, g in self.gradients([pages[i] for i in block], [labels[i] for i in block]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (1 - 0.97 * step / last) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                self.p["words"] *= np.float32(1 - WORD_PULL)
        return self


#: Pages and passes of the training, the seed of both, and how much word vectors shrink at each step.
TRAINING_PAGES, EPOCHS, SEED, WORD_PULL = 3000, 5, 3, 0.01

_MAIN = ["article", "main", "div.content", "div.post", "div#main", "div.entry-content", "section.article-body", "div.story", "div.text", "section", "div", "td.body"]
_SIDE = ["aside", "div.sidebar", "div.related", "aside.widget", "div#sidebar", "section.recommended", "div.popular", "div.side", "ul.links", "div.tags", "div.author-box", "div.trending"]
_ADS = ["div.ad", "div.advert", "div.ads", "div.advertisement", "div.banner", "div.sponsored", "div.promo", "ins.adsbygoogle", "aside.ad", "section.sponsor", "div.ad-slot", "p.ad"]
_NOTICE = ["div.cookie-notice", "div.notice", "div.alert", "div#cookies", "div.consent", "div.gdpr", "div.popup", "div.modal", "div.paywall", "section.notice", "div.message", "p.notice", "div.cookie", "div.cookie-banner"]
_COMMENTS = ["section.comments", "div.comments", "div#comments", "ol.commentlist", "div.discussion", "div.replies", "section#comments", "div.reader-comments", "ul.comments", "div.comment"]
_HEADER = ["header", "div.header", "div#header", "div.masthead", "header.site-header", "div.top", "div.logo", "div.breadcrumb"]
_FOOTER = ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom", "div.legal"]
_MENU = ["nav", "div.menu", "ul.nav", "div#nav", "nav.main-menu", "div.navigation", "div.navbar", "ul.menu", "div.pagination", "div.share"]
_PHRASES = {
    "notice": "we use cookies to improve your experience accept all cookies privacy policy consent agree settings subscribe to continue reading",
    "footer": "copyright all rights reserved terms of use privacy contact about us imprint",
    "menu": "home news sport about contact login sign in search next previous share tweet",
    "ads": "advertisement sponsored buy now sale offer discount shop click here free trial",
    "comments": "reply says posted by comment likes report anonymous user thanks great article",
    "form": "email address name subscribe newsletter submit search password sign up send",
    "side": "related stories read more most popular latest recommended tags about the author",
}
_SYLLABLES = "an er in on th re st ed or ti he en nd at ou ea ha ng al it is as le ve ra ro li ne me de co ta ri io ic ll la el ma ie ch ut no ur di em ca ec oc om un be we ad fo ge il no su po pe wh ac ly".split()


def made_words(r: np.random.Generator, n: int = 20_000) -> np.ndarray:
    return np.array(["".join(r.choice(_SYLLABLES, k)) for k in r.integers(1, 5, n)], object)


def page(r: np.random.Generator, pool: np.ndarray) -> tuple[str, list[int]]:
    """A made-up page of words from `pool` and the label of each of its blocks, in order: 1 for the article's own text."""
    out: list[str] = []
    labels: list[int] = []
    own = r.random() < 0.5

    style = r.random()

    def word() -> str:
        return str(pool[r.integers(len(pool))])

    def dress(w: str) -> str:
        """Some pages shout, some carry symbols or bars, some have no full stops."""
        return w.upper() + "!!" if style < 0.08 else w + "%&*#$"[len(w) % 5] * 3 if style < 0.16 else w + " |" if style < 0.22 else w

    def say(n: int, phrases: str | None = None, stop: float = 0.0) -> str:
        n = max(1, int(n))
        w = pool[r.integers(0, len(pool), n)].tolist()
        if phrases and r.random() < 0.6:
            own_words = _PHRASES[phrases].split()
            w = [own_words[k] if k < len(own_words) else x for x, k in zip(w, r.integers(0, int(1.4 * len(own_words)) + 1, n).tolist(), strict=True)]
        else:
            w = [dress(x) for x in w]
        text = " ".join(w)
        return text[0].upper() + text[1:] + ("." if style < 0.9 and r.random() < (0.85 if n > 4 else stop) else "")

    def put(tag: str, text: str, label: int) -> None:
        labels.append(label)
        inner = text
        if r.random() < 0.15:
            k = len(text) // 2
            inner = f"{text[:k]}<{(e := r.choice(['b', 'em', 'span', 'strong', 'i']))}>{text[k:]}</{e}>"
        out.append(f"<{tag}>{inner}</{tag}>")

    def box(kind: list[str], fill, wrap: float = 0.0) -> None:
        spec = str(r.choice(kind))
        name, mark, extra = re.match(r"(\w+)([.#]?)(.*)", spec).groups()
        attribute = f' {"class" if mark == "." else "id"}="{extra}"' if mark else ""
        if not mark and r.random() < 0.2:
            attribute = f' class="{word()}"'
        out.append(f"<{name}{attribute}>")
        fill(name)
        out.append(f"</{name}>")

    def links(phrases: str):
        def fill(name: str) -> None:
            if name not in ("ul", "ol") and r.random() < 0.7:
                out.append("<ul>")
                short = r.random() < 0.4
                for _ in range(r.integers(2, 9)):
                    put_link("li", word() if short else say(r.integers(1, 4), phrases))
                out.append("</ul>")
            else:
                for _ in range(r.integers(2, 7)):
                    put_link("li" if name in ("ul", "ol") else str(r.choice(["div", "p"])), say(r.integers(1, 6), phrases))

        return fill

    def put_link(tag: str, text: str) -> None:
        labels.append(0)
        out.append(f'<{tag}><a href="/{word()}">{text}</a></{tag}>')

    def prose(phrases: str, lo: int, hi: int):
        def fill(name: str) -> None:
            if name == "p" or r.random() < 0.5:
                labels.append(0)
                out.append(say(r.integers(lo, hi), phrases))
            else:
                for _ in range(r.integers(1, 4)):
                    put("p" if name not in ("ul", "ol") else "li", say(r.integers(lo, hi), phrases), 0)

        return fill

    def form() -> None:
        out.append("<form>")
        for _ in range(r.integers(1, 4)):
            put(str(r.choice(["label", "button", "p", "legend", "div"])), say(r.integers(1, 8), "form"), 0)
            out.append('<input type="text">')
        out.append("</form>")

    def noise() -> None:
        k = r.integers(6)
        if k < 3:
            box(_ADS, prose("ads", 2, 25))
        elif k == 3:
            box(_NOTICE, prose("notice", 3, 25))
        elif k == 4:
            box(_SIDE, links("side") if r.random() < 0.6 else prose("side", 3, 25))
        else:
            form()

    def article(name: str) -> None:
        if r.random() < 0.85:
            put("h1", say(r.integers(3, 12)), 1)
        soft = r.random() < 0.4
        for _ in range(r.integers(1, 14)):
            k = r.random()
            if k < 0.12:
                noise()
            elif k < 0.2:
                put(str(r.choice(["h2", "h3"])), say(r.integers(1, 9)), 1)
            elif k < 0.28:
                out.append("<ul>")
                for _ in range(r.integers(2, 5)):
                    put("li", say(r.integers(1, 25)), 1)
                out.append("</ul>")
            elif k < 0.33:
                put(str(r.choice(["blockquote", "pre", "figcaption"])), say(r.integers(3, 40)), 1)
            elif soft and k < 0.6:
                labels.append(1)
                out.append(f"<p><b>{say(r.integers(5, 80))}<br>")
            else:
                put("p", say(r.integers(1, 90) if r.random() < 0.7 else r.integers(1, 6), stop=0.8), 1)

    title = say(r.integers(2, 12))
    labels.append(0)
    out.append(f"<!DOCTYPE html><html><head><title>{title}</title></head><body>")
    if r.random() < 0.3:
        box(_NOTICE, prose("notice", 3, 25))
    if r.random() < 0.5:
        box(_HEADER, prose("menu", 1, 8))
    if r.random() < 0.85:
        box(_MENU, links("menu"))
    for _ in range(r.integers(0, 3)):
        noise()
    if own and r.random() < 0.3:
        out.append("<div class='page'>")
    box(_MAIN[:2] if r.random() < 0.5 else _MAIN, article)
    tail = [lambda: box(_COMMENTS, prose("comments", 2, 60)), lambda: box(_SIDE, links("side")), lambda: box(_SIDE, prose("side", 3, 40)), noise, noise, form]
    for k in r.permutation(len(tail))[: r.integers(0, 5)]:
        tail[k]()
    if r.random() < 0.85:
        box(_FOOTER, prose("footer", 2, 20))
    if r.random() < 0.9:
        out.append("</body></html>")
    return "".join(out), labels


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    r = np.random.default_rng(seed)
    pool = made_words(r)
    sequences, labels = [], []
    for _ in range(pages):
        text, want = page(r, pool)
        found = leaves(text)
        if found and len(found) == len(want):
            sequences.append(Sequence(found))
            labels.append(np.array(want, float))
    return Labeller().train(sequences, labels, epochs)


#: The weights that `trained()` gives, as text; made by `python -m pixelframe.llm.html_blocks`.
WEIGHTS = Path(__file__).with_name("html_labeller.txt")


def save(model: Labeller, path: Path = WEIGHTS) -> None:
    """A line for each parameter: its name, its shape and its values in order, rounded to four digits."""
    with open(path, "w", encoding="ascii") as f:
        for name, v in model.p.items():
            print(name, "x".join(map(str, v.shape)), *(f"{x:.4f}".rstrip("0").rstrip(".") for x in v.ravel().tolist()), file=f)


@lru_cache(1)
def labeller(path: Path = WEIGHTS) -> Labeller:
    """The saved model; without the file it is trained."""
    if not path.exists():
        return trained()
    model = Labeller()
    with open(path, encoding="ascii") as f:
        for line in f:
            name, shape, *values = line.split(" ")
            model.p[name] = np.array(values, np.float32).reshape([int(n) for n in shape.split("x")])
    return model


#: Bytes of pages that are labelled together; a longer page is alone.
PAGES_BYTES = 4 << 20


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars (long, code points) for every row of pages(page_id, url, html)."""
    model = model or labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", PAGES_BYTES):
            found = [leaves(h or "") for h in batch["html"].to_pylist()]
            texts = [""] * len(found)
            order = sorted((k for k, x in enumerate(found) if x), key=lambda k: len(found[k]))
            for k in range(0, len(order), 64):
                block = order[k : k + 64]
                for i, y in zip(block, model.predict([Sequence(found[i]) for i in block]), strict=True):
                    texts[i] = "\n".join(leaf[0] for leaf, v in zip(found[i], y, strict=True) if v >= 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


if __name__ == "__main__":
    save(trained())
