"""Operator 6: main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. A word scores by the element it stands in (its nearest
structural ancestor), a tag by its name; the best contiguous region of the page is the one with the
largest sum, found by one linear scan. Boilerplate elements that lie inside the region (forms,
adverts, menus, comments, ...) are left out of its text. A name or name part marks an element only as
far as its contents agree: the mark goes if the element holds all of the page's article, main or content
elements, if only a name part says it and prose outweighs the rest, or if most of the page is prose in it.

Weights come from labelled pages: pages that mark their content themselves, with an ``article`` or
``main`` element, say for each kind of token how often it stood inside and outside. The counts over all
pages are summed by Spark (a few hundred kinds at most: kinds are a fixed list of element names and
roles), and a kind's weight is the log-odds of being content, added to its starting weight: words +1, tags below zero.
Words of lists and tables are of two kinds, in links and not: menus teach the first only. Within article or
main no words weigh less than LEAST and tags hardly part, so lists, tables, code and link lists of an article stay.

Text: character references are decoded, white space within a block becomes one space, blocks are
joined by one space in page order. Inline tags join what they separate; ``br`` and block tags part it.

Edge cases: null or empty html gives an empty text; a page without words of positive weight gives an
empty text; unclosed elements end with their parent or at the next element that implies it (p, li);
ties go to the first region; null page_ids are kept; repeated rows give one row each; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, whole raw-text elements, other tags, text; a stray "<" counts as text.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg(?![^>]*/>)|iframe|object|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mspace semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: Elements whose text is never content.
OUTSIDE = frozenset("nav footer aside form button menu dialog header head fieldset".split())
#: Name parts (of class, id, role) that mark an element as something else than the article.
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar",
    "head": "header masthead banner branding logo",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside widget related recommended recommendations popular trending more-stories teaser",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall subscribe subscription newsletter signup",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad",
    "form": "form search login signin contact",
    "share": "share sharing social follow",
    "reply": "comment comments commentlist disqus discussion reply replies respond reviews",
}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names.split()}
CONTENT_ROLES = frozenset("article main content post entry story body articlebody entry-content post-content article-body maincontent".split())
#: Headers inside an article hold its headline, so they count as part of it.
HEADED = frozenset(("header",))
KINDS = frozenset("p li a td th h1 h2 h3 h4 h5 h6 div span section article main ul ol dl table tr blockquote pre br hr img figure b i em strong body html".split())
#: Elements of lists and tables: what is learned from menus made of them says nothing about an article's own.
LISTS = frozenset("ul ol li dl table tr td th pre blockquote".split())
#: Words outside of links in these weigh so much at least, and so do all words within article or main.
LEAST = 0.5


#: Words of a text run from which it counts as prose.
PROSE = 12


def role_of(attributes: str) -> tuple[str, bool]:
    """The first role that class, id or role attributes name, "" if none does; and if a whole name says so."""
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split():
            if name in ROLE_OF:
                return ROLE_OF[name], True
            if name in CONTENT_ROLES:
                return "content", True
            for part in name.split("-"):
                if part in ROLE_OF:
                    return ROLE_OF[part], False
    return "", True


class Mark:
    """What stands in an element that its name, or a name part, marks as something else than the article."""

    def __init__(self, at: int, role: str, whole: bool, around: int, own: bool):
        self.at, self.role, self.whole, self.around = at, role, whole, around
        self.prose = self.other = 0
        self.contents = int(own)

    def refuted(self, words: int, contents: int) -> bool:
        """If the contents speak against the mark. words, contents: of the page; around: content elements
        that the marked element stands in."""
        if self.role == "reply":
            return False
        if self.contents and self.contents + self.around >= contents and not (self.whole and self.around):
            return True
        if not self.role or self.prose <= self.other:
            return False
        return not self.whole or (2 * (self.prose + self.other) > words and contents <= self.contents + self.around)


def implied_end(stack: list[tuple], name: str) -> int | None:
    """Where the stack ends before a new block: at an open p with nothing but inline elements in it, or
    at the open li of the same list."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == "p":
            return i
        if stack[i][0] not in INLINE:
            break
    if name == "li":
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == "li":
                return i
            if stack[i][0] in ("ul", "ol", "menu"):
                break
    return None


def tokens(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """(what, kind, text, outside, inside) in page order; what: word run, block break, tag.

    kind is what weights are learned for; outside: within boilerplate; inside: within article or main.
    A mark that the element's contents refute is dropped; what stands in it is then read as unmarked.
    """
    marks: list[Mark] = []
    page_words = [0, 0]
    found = list(walk(page, frozenset(), marks, page_words))
    refuted = frozenset(m.at for m in marks if m.refuted(*page_words))
    return list(walk(page, refuted, [], [0, 0])) if refuted else found


def walk(page: str, refuted: frozenset[int], marks: list[Mark], seen: list[int]) -> Iterator[tuple[str, str, str, bool, bool]]:
    """tokens() without the marks at ``refuted``; fills marks and seen (words, content elements)."""
    stack: list[tuple[str, bool, bool, str, tuple[Mark, ...], int, int]] = []  # name, outside, inside, context for words, marks, in an item (1) or a link (2), content elements
    top = (False, False, "body", (), 0, 0)
    for m in PIECE.finditer(page):
        piece = m[0]
        outside, inside, context, within, linked, around = stack[-1][1:] if stack else top
        if piece[0] != "<" or piece == "<":
            text = html.unescape(piece)
            k = len(text.split())
            seen[0] += k
            for mark in within:
                if k >= PROSE and not linked:
                    mark.prose += k
                else:
                    mark.other += k
            yield "text", f"word:{context}{'-link' if linked == 2 and context in LISTS else ''}", text, outside, inside
            continue
        name = (m[3] or "").lower()
        if not name:  # comment, declaration, raw element
            if m[1]:
                yield "tag", "tag:raw", "", outside, inside
            continue
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
            yield ("inline" if name in INLINE else "tag"), f"tag:/{name if name in KINDS or name in OUTSIDE else 'other'}", "", outside, inside
            continue
        role, whole = role_of(m[4]) if m[4] else ("", True)
        if role != "content" and (name in ("html", "body") or m.start() in refuted):
            role = ""
        if name not in INLINE:  # a block ends an open paragraph, an item the item before it
            at = implied_end(stack, name)
            if at is not None:
                del stack[at:]
                outside, inside, context, within, linked, around = stack[-1][1:] if stack else top
        if role == "head" and inside:
            role, whole = "", True
        if role == "side" and inside and "teaser" in m[4].lower():  # an article's lead, if it is prose
            whole = False
        away = role not in ("", "content") or (name in OUTSIDE and m.start() not in refuted and not (name in HEADED and inside and not role))
        own = name in CONTENT or role == "content"
        if away or own or name in ("td", "li", "body"):
            context = role or (name if name in KINDS or name in OUTSIDE and away else "other")
        kind = f"tag:{role or (name if name in KINDS or name in OUTSIDE else 'other')}"
        yield ("inline" if name in INLINE and not role else "tag"), kind, "", outside or away, inside or own
        if own:
            seen[1] += 1
            for mark in within:
                mark.contents += 1
        if name not in VOID and not m[4].endswith("/"):
            if away:
                # An element's own kind is refuted by the content elements in it alone; a form also by prose.
                says = role or ("form" if name == "form" else "")
                marks.append(Mark(m.start(), says if name not in OUTSIDE or name == "form" else "", whole or name == "form", around, own))
                within = (*within, marks[-1])
            # Formatting that is never closed ends with its block.
            stack.append((name, outside or away, inside or own, context, within, max(linked, 2 if name == "a" else int(name == "li")), around + own))


def start_weight(kind: str) -> float:
    """Before learning: words count for, tags against, named boilerplate strongly against."""
    what, _, name = kind.partition(":")
    if what == "word":
        return -1.0 if name in ROLES or name in OUTSIDE else -0.5 if name.endswith("-link") else 1.0
    return -6.0 if name in ROLES or name in OUTSIDE else -0.25 if name.lstrip("/") in LISTS else -0.5


def page_weights(pages: DataFrame, text: str = "html", strength: float = 0.5) -> dict[str, float]:
    """Weights of all kinds from the pages that mark their content; counts summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = list(tokens(page or ""))
                if not any(t[4] for t in found):
                    continue
                for what, kind, own, away, within in found:
                    k = len(own.split()) if what == "text" else 1
                    (inside if within and not away else outside)[kind] += k
        kinds = sorted({*inside, *outside})
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "inside": pa.array([inside[k] for k in kinds], pa.int64()), "outside": pa.array([outside[k] for k in kinds], pa.int64())})

    counts = pages.select(text).mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    out = {}
    for r in counts:
        start = start_weight(r["kind"])
        learned = math.log((r["i"] + 1) / (r["o"] + 1))
        # Evidence moves a weight, within the sign its kind has: words for or against, tags against.
        moved = start + strength * max(-3.0, min(3.0, learned)) * (1 if r["kind"].startswith("word") else 0.5)
        name = r["kind"].partition(":")[2].lstrip("/")
        if r["kind"].startswith("word"):
            out[r["kind"]] = max(moved, LEAST) if name in LISTS else moved
        else:
            out[r["kind"]] = min(max(moved, start) if name in LISTS else moved, -0.05)
    return out


def token_scores(found: list[tuple[str, str, str, bool, bool]], weights: dict[str, float]) -> list[float]:
    """What every token adds to a region that holds it; 0 for text without words."""
    out = []
    for what, kind, text, away, inside in found:
        weight = weights.get(kind)
        if weight is None:
            weight = start_weight(kind)
        if inside and not away:  # the page itself says that this is content
            weight = max(weight, LEAST) if what == "text" else 0.1 * weight
        if what == "text":
            score = len(text.split()) * (-abs(weight) if away and weight > 0 else weight)
        else:
            score = weight
        # Left out of the text in any case: it should hardly part the content around it.
        out.append(score * 0.05 if away else score)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous run with the largest positive sum, the first of equals; (0, 0) if there is none."""
    best, total, begin, region = 0.0, 0.0, 0, (0, 0)
    for n, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, n
        total += score
        if total > best:
            best, region = total, (begin, n + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the page's best contiguous region."""
    found = list(tokens(page or ""))
    region = best_region(token_scores(found, weights))
    parts: list[str] = []
    for what, _, text, away, _ in found[region[0] : region[1]]:
        if what == "text":
            if not away:
                parts.append(text)
        elif what == "tag":
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, weights: dict[str, float] | None = None, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; weights are learned from the pages if not given."""
    known = pages.sparkSession.sparkContext.broadcast(page_weights(pages, text) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, known.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(text).alias("html")).mapInArrow(run, f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long")
