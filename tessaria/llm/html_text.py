"""Operator 7, main text of pages by a linear-chain conditional random field.

A page is read into leaf blocks: runs of text between block-level tags, with the tags and attributes above them. Each
block has features of its ancestors, its text and its links; a chain over the blocks of a page says which are main
text, which are reader comments and which are neither, with weights for features and for neighbouring labels, and
Viterbi decoding picks the likeliest labelling. That comments go on once they have begun is a weight of the chain.

The field is trained by maximum likelihood on labelled pages: a bounded sample of the given pages, labelled where
their mark-up says what a block is (an article or main element, against navigation, header, footer, side and form
elements), and small pages written and labelled here, which show what the given ones may lack: other wraps, comments
without a mark, articles with sections named as comments are. The marks that the labels came from are hidden in much of
the training, so text, links, place and neighbours learn to speak without them. Words of headings and other short blocks
are features; which of them tell is learned.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements that start and end a block (fixed list).
BLOCK = frozenset(
    "address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main map menu nav noscript object ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page. Those that hold raw text end at their own end tag only, or with the
#: page; the others, if they are never closed, are read as if their start tag were not there.
RAW = frozenset("script style template noscript iframe svg object canvas audio video".split())
RAW_TEXT = frozenset("script style".split())
#: Opening one of the key closes an open one of the values.
CLOSES = {t: frozenset({"p"}) for t in BLOCK - {"html", "head", "body", "button", "td", "th", "option", "legend", "summary", "li", "dd", "dt"}} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
SCOPE = frozenset("html body table ul ol dl article aside nav section div main header footer form".split())
KEPT = frozenset({"article", "main"})
DROPPED = frozenset("nav header footer aside form menu dialog select button textarea fieldset title head option".split())
#: Words of class, id and role attributes, and what they stand for (fixed list).
HINTS = {
    "ad": "ad", "ads": "ad", "advert": "ad", "advertisement": "ad", "banner": "ad", "sponsor": "ad", "sponsored": "ad", "promo": "ad", "promotion": "ad",
    "nav": "nav", "navbar": "nav", "navigation": "nav", "menu": "nav", "breadcrumb": "nav", "breadcrumbs": "nav", "pagination": "nav", "pager": "nav", "toc": "nav", "tabs": "nav",
    "footer": "foot", "foot": "foot", "copyright": "foot", "legal": "foot", "header": "head", "masthead": "head", "topbar": "head", "logo": "head",
    "sidebar": "side", "side": "side", "aside": "side", "widget": "side", "related": "side", "recommended": "side", "share": "side", "social": "side", "newsletter": "side", "subscribe": "side", "popular": "side", "complementary": "side",
    "cookie": "note", "cookies": "note", "consent": "note", "gdpr": "note", "notice": "note", "popup": "note", "modal": "note", "overlay": "note", "alert": "note", "paywall": "note",
    "comment": "comment", "comments": "comment", "reply": "comment", "replies": "comment", "disqus": "comment", "respond": "comment",
    "form": "form", "search": "form", "login": "form", "signup": "form", "contentinfo": "foot",
    "content": "main", "article": "main", "post": "main", "entry": "main", "story": "main", "body": "main", "text": "main", "main": "main",
}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SHORT = re.compile(r"[^\W\d_]+|\d+")


def blocks_of(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(marks of the elements above, text with white space collapsed, characters in links) of each leaf block."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        body = " ".join("".join(text).split())
        if body:
            out.append((tuple(m for _, marks in stack for m in marks), body, linked))
        text.clear()
        linked = 0

    page = page or ""
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m[0] == "<":
                text.append(html.unescape(m[0]))
                if any(t == "a" for t, _ in stack):
                    linked += len(m[0].strip())
            continue
        tag = tag.lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCK:
                end()
                if tag == "p" and k is None:
                    continue
            if k is not None:
                # An inline end tag does not close the block elements opened since.
                if tag in BLOCK or all(t not in BLOCK for t, _ in stack[k:]):
                    del stack[k:]
                else:
                    del stack[k]
            continue
        if tag in RAW and not m[0].endswith("/>"):
            close = _CLOSE[tag].search(page, at)
            if close or tag in RAW_TEXT:
                at = close.end() if close else len(page)
                continue
            if tag in BLOCK:
                end()
            continue
        if tag in BLOCK:
            end()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
            # A block does not inherit formatting left open by the one before.
            while stack and stack[-1][0] not in BLOCK and stack[-1][0] != "a":
                stack.pop()
        if tag == "br":
            text.append("\n")
        if tag in VOID:
            continue
        marks = [f"<{tag}>"]
        for a in _ATTR.finditer(m[3]):
            marks += {f"hint:{HINTS[w]}" for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower()) if w in HINTS}
        if _HIDDEN.search(m[3]):
            marks.append("hint:hidden")
        if not m[0].endswith("/>") or tag in BLOCK:
            stack.append((tag, tuple(marks)))
    end()
    return out


def features(blocks: list[tuple[tuple[str, ...], str, int]], hide: frozenset[str] = frozenset()) -> list[list[str]]:
    """The features of each block; marks in `hide` are left out."""
    out = []
    shapes: list[str] = []
    for i, (marks, text, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        size = min(7, int(math.log2(words)))
        f = {"bias", f"words:{size}", f"links:{min(4, int(5 * linked / max(1, len(text))))}"}
        own = [m for m in marks if m[0] == "<" and m[1:-1] in BLOCK]
        own = f"own:{own[-1]}" if own else "own:none"
        f.add(own)
        f |= {f"in:{m}" for m in marks if m not in hide}
        ends = text[-1] in ".!?:;…。！？\"”»'"
        f.add(f"stop:{ends}")
        if "©" in text or "copyright" in text.lower():
            f.add("copyright")
        if words <= 8 and not ends:
            title = "heading" if words <= 6 and own[5:7] in ("<h", "<s") else "short"
            said = _SHORT.findall(text.lower())
            f |= {f"{title} word:{'#' if w[0].isdigit() else w}" for w in said} | {f"{title} words:{min(4, len(said))}, {own}"}
        elif ":" in text[:40]:
            f |= {"speaker"} | {f"speaker word:{w}" for w in _SHORT.findall(text[: text.index(":")].lower())}
        elif words <= 8:
            f |= {f"short sentence word:{w}" for w in _SHORT.findall(text.lower())}
        shapes.append(f"{own} {words <= 5}")
        if i:
            f.add(f"after:{shapes[i - 1]}, words:{size}")
        if i > 1 and shapes[i] == shapes[i - 2] != shapes[i - 1]:
            f.add(f"alternates:{shapes[i]}")
        if i == 0:
            f.add("first")
        if i == len(blocks) - 1:
            f.add("last")
        out.append(sorted(f))
    return out


#: Labels of blocks.
OTHER, MAIN, COMMENT = range(3)


class Field:
    """A chain over labels: weight[feature][a] speaks for label a, turn[a, b] for label b after label a."""

    def __init__(self, weight: dict[str, tuple[float, ...]], turn: np.ndarray) -> None:
        self.weight, self.turn = weight, turn

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        turn = self.turn.T.tolist()
        labels = range(len(turn))
        none = (0.0,) * len(turn)
        back: list[list[int]] = []
        best: list[float] = []
        for f in rows:
            here = [sum(x) for x in zip(none, *(self.weight[x] for x in f if x in self.weight))]
            if best:
                come = [[best[a] + row[a] for a in labels] for row in turn]
                back.append([max(labels, key=x.__getitem__) for x in come])
                here = [h + max(x) for h, x in zip(here, come)]
            best = here
        if not rows:
            return []
        out = [max(labels, key=best.__getitem__)]
        for p in reversed(back):
            out.append(p[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.3, l2: float = 1e-3, least: int = 4) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adagrad over whole passes; forward-backward in numpy over all pages
    of a length at once. Features of fewer than `least` pages are left out."""
    seen: dict[str, int] = {}
    for rows, _ in pages:
        for x in {x for f in rows for x in f}:
            seen[x] = seen.get(x, 0) + 1
    names = sorted(x for x, n in seen.items() if n >= least)
    index = {x: i for i, x in enumerate(names)}
    labels = range(3)
    weight, turn = np.zeros((3, len(names))), np.zeros((3, 3))
    gw, gt = np.full(weight.shape, 1e-8), np.full(turn.shape, 1e-8)
    groups: dict[int, list] = {}
    for rows, y in pages:
        if rows:
            groups.setdefault(len(rows), []).append(([[index[x] for x in f if x in index] for f in rows], y))
    packed = []
    for n, members in groups.items():
        flat = [x for rows, _ in members for f in rows for x in f]
        owner = np.repeat(np.arange(len(members) * n), [len(f) for rows, _ in members for f in rows])
        packed.append((n, np.array(flat, np.int64), owner, np.array([y for _, y in members])))
    total = sum(len(y) for *_, y in packed)
    for _ in range(rounds):
        dw, dt = -l2 * weight * total, -l2 * turn * total
        for n, flat, owner, y in packed:
            m = len(y)
            e = np.stack([np.bincount(owner, weight[a][flat], minlength=m * n).reshape(m, n) for a in labels], axis=2)
            fwd, bwd = np.zeros((m, n, 3)), np.zeros((m, n, 3))
            fwd[:, 0] = e[:, 0]
            for i in range(1, n):
                fwd[:, i] = np.logaddexp.reduce(fwd[:, i - 1, :, None] + turn[None], axis=1) + e[:, i]
            for i in range(n - 2, -1, -1):
                bwd[:, i] = np.logaddexp.reduce(turn[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + bwd - z[:, None, None])
            for a in labels:
                dw[a] += np.bincount(flat, ((y == a) - p[..., a]).ravel()[owner], minlength=len(names))
            if n > 1:
                pair = np.exp(fwd[:, :-1, :, None] + turn + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
                dt -= pair.sum(axis=(0, 1))
                np.add.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        gw += dw * dw
        gt += dt * dt
        weight += rate * dw / np.sqrt(gw)
        turn += rate * dt / np.sqrt(gt)
    return Field({x: tuple(map(float, weight[:, i])) for x, i in index.items() if np.abs(weight[:, i]).max() > 1e-6}, turn)


def labels_by_markup(blocks: list[tuple[tuple[str, ...], str, int]]) -> list[int] | None:
    """Labels of a page whose mark-up tells: None if it has no article or main element."""
    out = []
    for marks, _, _ in blocks:
        tags = {m[1:-1] for m in marks if m[0] == "<"}
        bad = any(m in ("hint:ad", "hint:nav", "hint:foot", "hint:side", "hint:note", "hint:comment", "hint:form", "hint:hidden") for m in marks)
        out.append(int(bool(tags & KEPT) and not tags & (DROPPED - {"header"}) and not bad))
    return out if any(out) else None


_SENTENCE = "The river rose in the night and by the morning the lower fields were under water, as the farmers had feared."
_LONG = f"{_SENTENCE} Nobody in the village could remember a flood so late in the year. {_SENTENCE}"
#: Parts of pages and their labels: 1 for main text, 2 for reader comments. Written here.
PARTS: tuple[tuple[str, int], ...] = (
    ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>", 0),
    ("<div class='menu'><a href='/a'>About us</a> <a href='/c'>Contact</a></div>", 0),
    ("<header><div class='logo'>The Daily Valley</div></header>", 0),
    ("<div id='cookie-notice'><p>We use cookies to make this site better. By reading on you agree to our policy.</p><button>Accept</button></div>", 0),
    ("<div class='ad'>Save half on all shoes this week only.</div>", 0),
    ("<aside><h3>Most read</h3><ul><li><a href='/1'>A storm is coming</a></li><li><a href='/2'>The bridge is closed</a></li></ul></aside>", 0),
    ("<div class='sidebar'><p>Sign up for our letter and get the news of the valley every week.</p></div>", 0),
    ("<form action='/q'><label>Search this site</label><input name='q'><button>Go</button></form>", 0),
    ("<div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div>", 0),
    ("<h1>A late flood</h1>", 1),
    (f"<p>{_LONG}</p>", 1),
    (f"<p>{_SENTENCE}</p>", 1),
    (f"<div>{_LONG}</div>", 1),
    ("<h2>What comes next</h2>", 1),
    (f"<blockquote>{_SENTENCE}</blockquote>", 1),
    ("<ul><li>Keep away from the river banks.</li><li>Store water for three days, as the pumps may fail.</li></ul>", 1),
    ("<table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3.2 m</td></tr></table>", 1),
    ("<p>It was over by noon.</p>", 1),
    ("<div class='share'><a href='/f'>Share</a> <a href='/m'>Mail</a></div>", 0),
    ("<div class='related'><h3>Related</h3><a href='/3'>Floods of the past</a></div>", 0),
    (f"<div class='comments'><h3>2 comments</h3><div class='comment'><p>Anna: {_SENTENCE}</p></div><div class='comment'><p>So sorry to hear this!</p></div></div>", 2),
    (f"<section id='comments'><p>{_LONG}</p></section>", 2),
    # Comments without a mark of their own, as they may stand inside an article.
    (f"<section><h3>Comments</h3><p>{_SENTENCE}</p><p>So sorry to hear this!</p></section>", 2),
    (f"<h3>3 comments</h3><ul><li>Ben wrote: {_SENTENCE}</li><li>{_LONG}</li></ul>", 2),
    (f"<h4>Reader comments</h4><p><b>Carla</b> 3 days ago</p><p>{_SENTENCE}</p><p>Reply</p>", 2),
    (f"<div><div>Discussion (12)</div><div>{_SENTENCE}</div><div>Great article, thanks for sharing.</div></div>", 2),
    (f"<div><p>Dora said: {_SENTENCE}</p><p><a href='#r'>Reply</a></p></div>", 2),
    ("<footer>&copy; 2020 The Daily Valley. All rights reserved.</footer>", 0),
    ("<div class='footer'><p>Copyright The Daily Valley</p></div>", 0),
)
WRAPS = ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='post'>{}</div>", "<div>{}</div>", "<section>{}</section>", "{}")


def written_pages(n: int, seed: int) -> list[tuple[list, list[int]]]:
    """Pages put together from the labelled parts, with their blocks and labels."""
    rng = np.random.default_rng(seed)
    before, inside, after = PARTS[:9], PARTS[9:18], (*PARTS[18:], *PARTS[4:7])
    talk = [part for part in PARTS if part[1] == COMMENT and "class='comments'" not in part[0] and "id='comments'" not in part[0]]
    out = []
    for _ in range(n):
        blocks, labels = [], []
        body = [(inside[0][0], 1)] * int(rng.random() < 0.8) + [inside[i] for i in rng.integers(0, len(inside), rng.integers(1, 9))]
        wrap = WRAPS[rng.integers(len(WRAPS))]
        if rng.random() < 0.3:
            body.insert(int(rng.integers(0, len(body) + 1)), PARTS[[4, 5, 7, 18][rng.integers(4)]])
        if rng.random() < 0.35:
            body.append(talk[int(rng.integers(len(talk)))])
        groups = [[before[i] for i in rng.integers(0, len(before), rng.integers(0, 5))], body, [after[i] for i in rng.integers(0, len(after), rng.integers(0, 5))]]
        for g, parts in enumerate(groups):
            for part, y in parts:
                got = blocks_of("<body>" + (wrap.format(part) if g == 1 else part))
                blocks += got
                labels += [y] * len(got)
        if blocks:
            out.append((blocks, labels))
    return out


#: Marks that the labels of given pages are made from, by element.
TELLING = tuple(f"<{t}>" for t in sorted(KEPT | DROPPED))
#: Headings of comments and of sections of articles that sound alike, names, times and controls of comments (written here).
_TALKS = ("Comments", "4 comments", "Comments (2)", "Reader comments", "Join the conversation", "Responses (7)", "Discussion (12)", "3 replies", "Kommentare", "Commentaires", "Comentarios")
_SECTIONS = ("Discussion", "Discussion of the results", "Results and discussion", "Comments on the method", "Comment", "Responses to the survey", "Replies of the ministry", "The conversation", "Diskussion", "Reader habits", "General comments on both")
_WHO = ("Anna", "Ben K.", "Carla_88", "Dora Maar", "user4711", "J. Smith", "Guest", "mike")
_WHEN = ("3 days ago", "2 hours ago", "1 week ago", "on March 4, 2021 at 10:22", "2020-05-06 12:30", "12 May 2019", "yesterday")
_DO = ("Reply", "Reply Report", "Like (3) Reply", "Flag", "Permalink")
_SAYS = ("So sorry to hear this!", "Thanks, this helped me a lot.", "I have read this twice and still can't agree.", "Great article.", "This is not what happened where I live, sadly.")


def _place(blocks: list, labels: list[int]) -> tuple[list[int], tuple[str, ...]]:
    main = [i for i, y in enumerate(labels) if y == MAIN]
    return main, tuple(m for m in blocks[main[-1]][0] if m not in ("<p>", "<li>", "<ul>"))


def commented(blocks: list, labels: list[int], rng: np.random.Generator) -> tuple[list, list[int]]:
    """A labelled page with unmarked reader comments at the end of its article: under a heading, or with who and when, or
    both; what they say is text of the page or written here."""
    main, marks = _place(blocks, labels)
    pick = lambda x: x[int(rng.integers(len(x)))]
    headed, signed = rng.random() < 0.75, rng.random() < 0.5
    added = [((*marks, pick(("<h2>", "<h3>", "<h4>"))), pick(_TALKS), 0)] if headed else []
    control = rng.random() < 0.4
    for i in rng.choice(main, size=min(len(main), int(rng.integers(1, 5)))):
        text = blocks[int(i)][1] if rng.random() < 0.6 else pick(_SAYS)
        text = text if rng.random() < 0.5 else text.split(". ")[0].rstrip(".") + "."
        if signed or not headed:
            added.append(((*marks, pick(("<p>", "<div>"))), f"{pick(_WHO)} {pick(_WHEN)}" if rng.random() < 0.7 else pick(_WHO), 0))
        added.append(((*marks, "<p>"), text, 0))
        if control:
            added.append(((*marks, "<p>"), pick(_DO), 0))
    at = main[-1] + 1
    return blocks[:at] + added + blocks[at:], labels[:at] + [COMMENT] * len(added) + labels[at:]


def sectioned(blocks: list, labels: list[int], rng: np.random.Generator) -> tuple[list, list[int]]:
    """A labelled page whose article has some more headings, which belong to it."""
    main, marks = _place(blocks, labels)
    for i in sorted({int(i) for i in rng.choice(main, size=min(len(main), int(rng.integers(1, 3))))}, reverse=True):
        head = ((*(m for m in marks if m[:2] != "<h"), ("<h2>", "<h3>", "<h4>")[int(rng.integers(3))]), _SECTIONS[int(rng.integers(len(_SECTIONS)))], 0)
        blocks, labels = blocks[:i] + [head] + blocks[i:], labels[:i] + [MAIN] + labels[i:]
    return blocks, labels


def fit(pages: DataFrame, sample: int = 400, page_chars: int = 100_000, written: int = 600, seed: int = 9) -> Field:
    """Trains on at most `sample` pages of at most page_chars characters, chosen by a hash of their id, and `written`
    pages made here. Labels of the given pages come from their mark-up; half the time the marks they came from are
    hidden, all or each by chance, so the field cannot only repeat that rule; some get comments without a mark, and some
    sections of the article under headings such as comments have."""
    chosen = pages.select("page_id", "html").filter(F.length("html") <= page_chars).orderBy(F.xxhash64("page_id", F.lit(seed)), "html").limit(sample).collect()
    given = [(b, [COMMENT if "hint:comment" in m and not z else z for (m, *_), z in zip(b, y)]) for r in chosen if (b := blocks_of(r["html"])) and (y := labels_by_markup(b))]
    rng = np.random.default_rng(seed)
    made = []
    for k, (blocks, y) in enumerate([*given, *given, *written_pages(written, seed)]):
        if MAIN in y and rng.random() < 0.5:
            blocks, y = sectioned(blocks, y, rng)
        if k < 2 * len(given) and rng.random() < 0.4:
            blocks, y = commented(blocks, y, rng)
        share = (0.0, 0.25, 1.0)[int(rng.integers(3))]
        hide = {t for t in TELLING if rng.random() < share}
        if rng.random() < share / 2:
            hide |= {m for marks, _, _ in blocks for m in marks if m.startswith("hint:")}
        made.append((features(blocks, frozenset(hide)), y))
    return train(made)


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b[1] for b, y in zip(blocks, field.decode(features(blocks))) if y == MAIN)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = [main_text(x.as_py(), field) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, **options) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    pages needs page_id, url and html; other columns are ignored. Character references are decoded, white space
    inside a block becomes one space, blocks are trimmed and joined by an empty line in page order. A null or empty
    html, or one without main text, gives an empty text. Repeated rows get equal texts, an empty table gives an empty
    result, and mark-up that is broken or never closed is read as far as it goes.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, **options))  # some hundred weights
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE = {}
