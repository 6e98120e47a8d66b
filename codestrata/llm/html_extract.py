"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores the learned log odds of its place (paragraph, heading, item, cell, link
...), a tag the learned log odds of its name, at most 0. Counts come from pages that label their own content by one article or
main element, at most about `LABELLED_PAGES` of them, those of the smallest hashes; words and tags in elements that are outside anyway are not
counted, so that the weights tell apart what markup alone does not. An article or main element is one more piece of
evidence: on a page that has one, words and tags within score INSIDE more, the others as much less. One linear scan over the
scores finds the contiguous run with the highest sum. Elements in the run that are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments are left out of its text.

Such an element is known by its tag, or by the sum of the weights of its own class, id, role and label: log odds of the words that stand
under them, learned from the same pages, starting from fixed priors. The parts of a compound name (`site-footer`) weigh less than a whole one,
those that say what a wrapper has (`has-sidebar`) nothing, those of paragraphs, headings and inline elements nothing; and
an element with nearly all words of a page is its frame, whatever it is called.

Every page is extracted by itself. Defined cases: null and empty html give an empty text; a page without a positive run gives an
empty text; without labelled pages the priors decide; tags and comments cut off at the end of a page are markup; text after an unclosed tag
belongs to it; character references are decoded once, after tags are taken out; repeated rows are extracted each; further columns are
ignored. Time is linear in the length of a page, open tags included.
"""

from __future__ import annotations

import html as html_
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import map_rows

#: Labelled pages that give the weights, whatever the size of the table.
LABELLED_PAGES = 2_000
#: Words, tags or elements that a prior counts as.
PRIOR_WEIGHT = 50
#: What an article or main element adds to words and tags within, and takes from others.
INSIDE = 8.0
#: A tag costs this at least, one in an element that is outside IN_OUTSIDE, a word there WORD_OUTSIDE.
LEAST_COST, IN_OUTSIDE, WORD_OUTSIDE = 0.05, 0.3, 0.1
#: An element with an attribute score at or below this is outside, unless it holds this share of the words of the page.
OUTSIDE_SCORE, FRAME = -1.0, 0.8

# Element names of HTML by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary "
    "table tbody td template tfoot th thead title tr ul video audio canvas object svg math".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TAGS = frozenset("head script style title noscript template textarea iframe object svg math canvas audio video select option button datalist".split())
OUTSIDE_TAGS = frozenset("nav aside footer form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
#: Containers, whose parts of compound names count.
CONTAINERS = frozenset("div section ul ol dl table tbody header details figure fieldset center".split())
#: Prior score of a word by its place, the nearest of these elements; OTHER elsewhere.
PLACES = {"p": 1.0, "h": 1.0, "li": 0.4, "td": 0.4, "th": 0.4, "dd": 0.5, "dt": 0.4, "blockquote": 1.0, "pre": 0.8, "figcaption": 0.5, "caption": 0.5, "a": 0.0}
OTHER = 0.6
#: Prior score of a tag: elements of running text part it little, others more.
TEXT_TAGS = frozenset("p br b i em strong u s small sub sup span a abbr cite code pre q mark time blockquote h ul ol li dl dt dd figure figcaption img table tr td th tbody thead tfoot caption wbr".split())
UNSEEN_TEXT, UNSEEN = -0.05, -1.0
#: Names of class, id, role and aria-label that mark what is not main text, and their prior as a whole name and as a part.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer masthead header topbar toolbar cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe subscription "
    "signup login register share sharing social related recommended recommendations popular trending comment comments respond reply replies disqus discussion "
    "pagination pager popup modal overlay widget search copyright complementary contentinfo".split()
)
WHOLE, PART = -2.0, -1.2
#: Parts before which a name says what a wrapper has, is or lacks.
HAS = frozenset("has with without no is show hide layout".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[A-Za-z/!?][^>]*(?:>|\Z)"  # declarations, and tags with a stray quote or cut off
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW_TAGS}
_STOPS = frozenset("ul ol table div section article main body blockquote dl select td th".split())
_SELF_CLOSING = frozenset("li p td th tr dt dd option".split())


def _kind(name: str) -> str:
    """Headings of all levels are one kind of tag."""
    return "h" if len(name) == 2 and name[0] == "h" and name[1].isdigit() else name


def names_of(name: str, attrs: str) -> tuple[bool, list[tuple[str, float]]]:
    """Whether an element is hidden, and the names in its attributes with their prior scores."""
    found: dict[str, float] = {}
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True, []
        if key == "style":
            continue
        for whole in value.split():
            if whole.lower() in OUTSIDE_NAMES:
                found[whole.lower()] = WHOLE
                continue
            parts = [p.lower() for p in _PARTS.findall(whole)]
            marks = name in CONTAINERS and not HAS.intersection(parts) and OUTSIDE_NAMES.intersection(parts)
            found.setdefault(whole.lower(), PART if marks else 0.0)
    return False, list(found.items())


class Page:
    """A page as events, text or tag, each with the element that it stands in, and the tree of elements."""

    def __init__(self, page: str):
        self.events: list[tuple[str, int, str]] = []  # (text, element, text), (break or space or tag, element, tag name)
        self.name, self.parent, self.attrs, self.words = [""], [0], [""], [0]
        never = [False]
        stack = [0]
        open_: Counter = Counter()
        words = 0
        pos, n = 0, len(page)

        def close(at: int) -> None:
            for e in stack[at:]:
                self.words[e] += words
                open_[self.name[e]] -= 1
            del stack[at:]

        def close_open(name: str) -> None:
            """End an open element whose end tag was left out, up to the nearest container."""
            for k in range(len(stack) - 1, 0, -1):
                if self.name[stack[k]] == name:
                    close(k)
                    return
                if self.name[stack[k]] in _STOPS:
                    return

        while pos < n:
            m = _TOKEN.match(page, pos)
            pos = m.end()
            text = m["text"]
            if text is not None:
                if not never[stack[-1]]:
                    words += len(text.split())
                    self.events.append(("text", stack[-1], text))
                continue
            if m["name"] is None:
                continue
            name = m["name"].lower()
            block = name in BLOCK_TAGS
            kind = "break" if block else "space" if name == "br" else "tag"
            if m["close"]:
                if open_[name] > 0:
                    at = len(stack) - 1
                    while self.name[stack[at]] != name:
                        at -= 1
                    close(at)
                self.events.append((kind, stack[-1], name))
                continue
            if name in _SELF_CLOSING and open_[name] > 0:
                close_open(name)
            elif block and open_["p"] > 0:
                close_open("p")
            self.events.append((kind, stack[-1], name))
            if name in RAW_TAGS:
                end = _RAW_END[name].search(page, pos)
                pos = end.end() if end else n
                continue
            attrs = m["attrs"] or ""
            if name in VOID_TAGS or (attrs.endswith("/") and not block):
                continue
            e = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(attrs)
            self.words.append(-words)
            never.append(never[stack[-1]] or name in NEVER_TAGS)
            stack.append(e)
            open_[name] += 1
        close(0)
        self.never = never

    def placed(self, odds: dict) -> None:
        """outside, inside (of an article or main element) and place of each element."""
        n, total = len(self.name), max(1, self.words[0])
        self.outside, self.inside, self.place = [False] * n, [False] * n, [""] * n
        for e in range(1, n):
            up, name = self.parent[e], self.name[e]
            out = self.outside[up] or self.never[e]
            if not out:
                out = name in OUTSIDE_TAGS or (name == "header" and not self.inside[up])
                if not out and self.attrs[e] and name not in ("html", "body", "article", "main"):
                    out = self._marked(e, odds) and self.words[e] < FRAME * total
            self.outside[e] = out
            self.inside[e] = self.inside[up] or (name in CONTENT_TAGS and not out)
            kind = _kind(name)
            self.place[e] = kind if kind in PLACES else self.place[up] if name not in BLOCK_TAGS else ""
        self.labelled = any(i and self.words[e] for e, i in enumerate(self.inside))

    def _marked(self, e: int, odds: dict) -> bool:
        hidden, names = names_of(self.name[e], self.attrs[e])
        return hidden or sum(odds.get(("name", x), prior) for x, prior in names) <= OUTSIDE_SCORE


def count(pages: list[str | None]) -> Counter:
    """Words by place, tags by name and words by attribute names, inside and outside the content of the pages that label it."""
    seen: Counter = Counter()
    for text in pages:
        if not text:
            continue
        page = Page(text)
        if sum(name in CONTENT_TAGS for name in page.name) != 1:
            continue
        page.placed({})
        content = next(e for e, name in enumerate(page.name) if name in CONTENT_TAGS)
        around, e = set(), content
        while e:
            e = page.parent[e]
            around.add(e)
        for e in range(1, len(page.name)):
            if page.attrs[e] and e not in around and e != content and page.words[e]:
                for x, _ in names_of(page.name[e], page.attrs[e])[1]:
                    seen["name", x, page.inside[e]] += page.words[e]
        for kind, e, value in page.events:
            if not page.outside[e]:
                if kind == "text":
                    seen["word", page.place[e], page.inside[e]] += len(value.split())
                else:
                    seen["tag", _kind(value), page.inside[e]] += 1
    return seen


def weights(seen: Counter) -> dict[tuple[str, str], float]:
    """Log odds of inside against outside, with a prior that counts as PRIOR_WEIGHT observations."""
    out: dict[tuple[str, str], float] = {}
    for kind, name in {(k, n) for k, n, _ in seen}:
        if kind == "word":
            prior = PLACES.get(name, OTHER)
        elif kind == "tag":
            prior = UNSEEN_TEXT if name in TEXT_TAGS else UNSEEN
        else:
            prior = WHOLE if name in OUTSIDE_NAMES else PART if OUTSIDE_NAMES.intersection(_PARTS.findall(name)) and not HAS.intersection(_PARTS.findall(name)) else 0.0
        out[kind, name] = math.log((seen[kind, name, True] + PRIOR_WEIGHT * math.exp(prior / 2)) / (seen[kind, name, False] + PRIOR_WEIGHT * math.exp(-prior / 2)))
    return out


def scores(page: Page, odds: dict) -> list[float]:
    """The score of each event."""
    out = []
    for kind, e, value in page.events:
        lean = 0.0 if not page.labelled else INSIDE if page.inside[e] else -INSIDE
        if kind == "text":
            n = len(value.split())
            if page.outside[e]:
                out.append(-WORD_OUTSIDE * n)
            else:
                out.append(n * (odds.get(("word", page.place[e]), PLACES.get(page.place[e], OTHER)) + lean) if n else 0.0)
        elif page.outside[e]:
            out.append(-IN_OUTSIDE if not page.inside[e] else -LEAST_COST)
        else:
            name = _kind(value)
            cost = odds.get(("tag", name), UNSEEN_TEXT if name in TEXT_TAGS else UNSEEN)
            out.append(min(-LEAST_COST if lean <= 0 else 0.0, cost + lean))
    return out


def best_run(score: list[float]) -> tuple[int, int]:
    """From and to of the contiguous run with the highest positive sum; of equal ones that which ends first, then the longest."""
    best, found = 0.0, (0, 0)
    here, start = 0.0, 0
    for at, s in enumerate(score):
        here += s
        if here < 0:
            here, start = 0.0, at + 1
        elif here > best:
            best, found = here, (start, at + 1)
    return found


def extract(page: str | None, odds: dict[tuple[str, str], float]) -> str:
    if not page:
        return ""
    read = Page(page)
    read.placed(odds)
    a, b = best_run(scores(read, odds))
    blocks: list[str] = []
    parts: list[str] = []
    for kind, e, value in read.events[a:b]:
        if kind == "break":
            _end(blocks, parts)
        elif kind == "space":
            parts.append(" ")
        elif kind == "text" and not read.outside[e] and not (read.labelled and not read.inside[e]):
            parts.append(value)
    _end(blocks, parts)
    return "\n".join(blocks)


def _end(blocks: list[str], parts: list[str]) -> None:
    text = " ".join(html_.unescape("".join(parts)).split())
    if text:
        blocks.append(text)
    parts.clear()


def learn(pages: DataFrame) -> dict[tuple[str, str], float]:
    """Weights from the LABELLED_PAGES pages of the smallest hashes, the same whatever the order of rows."""
    n = pages.count()
    # about twice as many by a hash threshold, then the smallest: no sort of all pages
    h = F.xxhash64("page_id", "url", "html")
    share = min(1.0, 2 * LABELLED_PAGES / max(1, n))
    sample = pages.select(h.alias("h"), "html").where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = sample.orderBy("h", "html").limit(LABELLED_PAGES).select("html")

    def start():
        def step(html):
            return [list(c) for c in zip(*[(k, name, inside, v) for (k, name, inside), v in count(html).items()])] or [[], [], [], []]

        return step

    # counts by place, tag and attribute name: at most what LABELLED_PAGES pages hold
    rows = map_rows(sample, start, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return weights(Counter({(r["kind"], r["name"], r["inside"]): r["n"] for r in rows.collect()}))


def extracted(pages: DataFrame, odds: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    odds = learn(pages) if odds is None else odds

    def start():
        def step(page_ids, urls, html):
            texts = [extract(h, odds) for h in html]
            return page_ids, urls, texts, [len(t) for t in texts]

        return step

    return map_rows(pages.select("page_id", "url", "html"), start, "page_id long, url string, text string, n_chars long", rows=128)
