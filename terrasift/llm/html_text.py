"""Main text of web pages: the maximum-scoring run of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Attributes as HTML reads them: a quoted value runs to its quotation mark, any other one to white space or the tag's end,
# and a stray quotation mark is part of a name. Possessive, so that a tag without an end is given up in one pass.
_ATTRIBUTES = r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(script|style|template|noscript|textarea|iframe|svg|title|select)(?=[\s/>])" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRIBUTES + r")>|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Elements and names that mark content apart from the main text until the pages say otherwise, elements that do
# not end a block, elements without an end tag, and what a start tag closes (names, up to one of).
APART = frozenset("nav header footer aside form button dialog menu".split())
APART_NAMED = frozenset(
    "ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies "
    "footer menu modal navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Reader comments are never main text, whatever the pages say.
NEVER = frozenset("comment comments".split())
#: Elements that name the main text where a page has them; such pages are the labelled ones.
LABELS = ("article", "main")
#: Log odds from which an element is apart; what a fixed name counts for, and what a name that only the pages teach is lessened by.
APART_FROM, FIXED_COUNT, LEARNED_LESS = 3.0, 30, 1.0


@dataclass(frozen=True)
class Weights:
    """Every word scores +1; a tag scores minus scale times its weight. marks: log odds that an element so named is apart."""

    tags: dict[str, float] = field(default_factory=dict)
    unknown: float = 0.0
    scale: float = 8.0
    marks: dict[str, float] = field(default_factory=dict)

    def of(self, key: str) -> float:
        """Score of a tag; one whose names were never met weighs like the tag alone, one never met at all nothing."""
        weight = self.tags.get(key)
        if weight is None:
            weight = self.tags.get(key.split(".", 1)[0], self.unknown)
        return -self.scale * weight

    def mark(self, name: str, fixed: bool) -> float:
        if name in NEVER:
            return max(APART_FROM, self.marks.get(name, 0.0))
        return self.marks.get(name, math.log(FIXED_COUNT + 1) if fixed else 0.0)

    def apart(self, name: str, names: tuple[str, ...]) -> float:
        """Log odds that an element is apart: the most that its tag or a name says, a part of a name counting half."""
        odds = self.mark("<" + name, True) if name in APART else 0.0
        for n in names:
            odds = max(odds, self.mark(n, n in APART_NAMED))
            parts = re.split(r"[_-]+", n)
            if len(parts) > 1:
                odds = max(odds, sum(max(0.0, self.mark(p, p in APART_NAMED)) / 2 for p in parts))
        return odds


def _key(name: str, names: tuple[str, ...]) -> str:
    return ".".join([name, *names[:3]])


@dataclass
class Page:
    """Tokens in page order: start tags, end tags and texts; end: for a start tag the token after its element, else the next one."""

    keys: list[str] = field(default_factory=list)  # "" for a text
    texts: list[str] = field(default_factory=list)
    names: list[tuple[str, ...] | None] = field(default_factory=list)  # class, id and role names of a start tag with content
    inside: list[bool] = field(default_factory=list)  # in a labelled element
    end: list[int] = field(default_factory=list)

    def add(self, key: str, text: str, names: tuple[str, ...] | None, inside: bool) -> None:
        self.keys.append(key)
        self.texts.append(text)
        self.names.append(names)
        self.inside.append(inside)
        self.end.append(len(self.keys))


def parse(html: str) -> Page:
    """Tokens of a page. Elements without their end tag end with their parent, or where HTML implies it (p, li, td, ...)."""
    page, stack, times, labelled = Page(), [], Counter(), 0
    label = LABELS[0] if re.search(r"(?i)<article[\s>]", html) else LABELS[1]

    def close(depth: int) -> None:
        nonlocal labelled
        while len(stack) > depth:
            name, at = stack.pop()
            times[name] -= 1
            labelled -= name == label
            page.end[at] = len(page.keys)

    for m in _TOKEN.finditer(html):
        name = m.group(3)
        if name is None:
            if m.group(5) is not None:
                page.add("", m.group(5), None, labelled > 0)
            elif m.group(1):
                page.add(m.group(1).lower(), "", None, labelled > 0)
            continue
        name = name.lower()
        if m.group(2):
            at = -1
            if times[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name and not (name in INLINE and stack[depth][0] not in INLINE):
                    depth -= 1
                if stack[depth][0] == name:
                    at = stack[depth][1]
                    close(depth)
            page.add("/" + name, "", None, labelled > 0)
            if at >= 0:
                page.end[at] = len(page.keys)
            continue
        if name not in INLINE and times["p"]:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] == "p":
                close(depth)
        if name in CLOSES:
            closed, barrier = CLOSES[name]
            depth, lowest = len(stack) - 1, -1
            while depth >= 0 and stack[depth][0] not in barrier:
                lowest = depth if stack[depth][0] in closed else lowest
                depth -= 1
            if lowest >= 0:
                close(lowest)
        names = tuple(sorted({w for n in _NAMED.findall(m.group(4)) for w in "".join(n).lower().split()})) if m.group(4) else ()
        page.add(_key(name, names), "", None if name in VOID else names, labelled > 0)
        if name not in VOID:
            stack.append((name, len(page.keys) - 1))
            times[name] += 1
            labelled += name == label
    close(0)
    return page


def without_apart(page: Page, weights: Weights) -> list[int]:
    """Places of the tokens that are left without the content of elements apart; such an element counts as one tag.

    An element that holds the page's labelled content, its first heading or a nav element is a wrapper and never apart, nor
    is a header inside the labelled content. How large an element is doesn't matter.
    """
    navs = [i for i, k in enumerate(page.keys) if k.split(".", 1)[0] == "nav"]
    core = next((i for i, k in enumerate(page.keys) if k.split(".", 1)[0] in LABELS), None)
    heading = next((i for i, k in enumerate(page.keys) if k.split(".", 1)[0] == "h1"), None)
    out, at = [], 0
    while at < len(page.keys):
        out.append(at)
        names, end = page.names[at], page.end[at]
        if names is not None:
            name = page.keys[at].split(".", 1)[0]
            wrapper = any(x is not None and at < x < end for x in (core, heading)) or bisect_left(navs, end) > bisect_right(navs, at)
            if not wrapper and name not in ("html", "body", *LABELS) and not (name == "header" and page.inside[at]) and weights.apart(name, names) >= APART_FROM:
                at = end
                continue
        at += 1
    return out


def tokens(html: str, weights: Weights) -> list[tuple[str, str, bool]]:
    """(tag key or "", text, in a labelled element) in page order, without the content of elements apart."""
    page = parse(html)
    return [(page.keys[i], page.texts[i], page.inside[i]) for i in without_apart(page, weights)]


def _scores(found: list[tuple[str, str, bool]], weights: Weights) -> list[float]:
    return [weights.of(key) if key else float(len(text.split())) for key, text, _ in found]


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and past-last place of the run of greatest sum, the earliest and shortest such; (0, 0) if none is above 0."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def with_heading(found: list[tuple[str, str, bool]], first: int) -> int:
    """First place of a run together with the heading right before it, if no other text lies between."""
    at, inside = first - 1, ""
    while at >= 0:
        key, text, _ = found[at]
        if inside:
            if key.split(".", 1)[0] == inside:
                return at
        elif key[:2] == "/h" and key[2:].isdigit():
            inside = key[1:]
        elif text.strip():
            break
        at -= 1
    return first


def blocks(found: list[tuple[str, str, bool]]) -> list[str]:
    """Texts of the blocks: decoded, white space made one space, trimmed, empty ones left out."""
    out, parts = [], []

    def end() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    for key, text, _ in found:
        if not key:
            parts.append(text)
            continue
        name = key.lstrip("/").split(".", 1)[0]
        if name == "br":
            parts.append(" ")
        elif name not in INLINE:
            end()
    end()
    return out


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best run, and of the heading right before it, joined by an empty line."""
    if not page:
        return ""
    found = tokens(page, weights)
    first, last = best_run(_scores(found, weights))
    if last:
        first = with_heading(found, first)
    return "\n\n".join(blocks(found[first:last]))


def _overlaps(page: str, options: list[Weights]) -> list[tuple[int, int, int]]:
    """For weights that differ in scale alone: words in both the run and the labelled content, in the run, in the labelled content."""
    found = tokens(page, options[0])
    sizes = [len(text.split()) if text else 0 for _, text, _ in found]
    within = [n if inside else 0 for n, (_, _, inside) in zip(sizes, found)]
    weights = [options[0].of(key) / options[0].scale if key else 0.0 for key, _, _ in found]
    out = []
    for option in options:
        first, last = best_run([option.scale * w if w else float(n) for w, n in zip(weights, sizes)])
        out.append((sum(within[first:last]), sum(sizes[first:last]), sum(within)))
    return out


def _is_label(key: str) -> bool:
    return key.lstrip("/").split(".", 1)[0] in LABELS


def _counts(frame: DataFrame, count: Callable[[str, Counter, Counter], None]) -> DataFrame:
    """(key, n, o): how often each key was counted inside and outside the labelled content, added up in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter = Counter()
        outside: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                count(page.as_py(), inside, outside)
        keys = list(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["key", "n", "o"])

    return frame.mapInArrow(run, "key string, n long, o long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))


def _count_names(html: str, inside: Counter, outside: Counter) -> None:
    page = parse(html)
    core = [i for i, k in enumerate(page.keys) if _is_label(k)]
    for at, names in enumerate(page.names):
        if names is None or any(at <= c < page.end[at] for c in core):
            continue  # wrappers of the labelled content say nothing
        name = page.keys[at].split(".", 1)[0]
        found = {*names, *(p for n in names for p in re.split(r"[_-]+", n))} | ({"<" + name} if name in APART else set())
        (inside if page.inside[at] else outside).update(found)


def learn_weights(
    pages: DataFrame, *, html_col: str = "html", sample: int = 4000, tags_kept: int = 20_000, scales: tuple[float, ...] = (1, 2, 4, 8, 16, 32),
) -> Weights:
    """Weights from about `sample` labelled pages (those with an article or main element), chosen by hash; all if fewer.

    First the marks: how much more often elements of a name stand outside the labelled content than inside, the fixed names
    starting from FIXED_COUNT times outside. Then the tags, with their names, on what the marks leave: a tag weighs the
    logarithm of how much more often it stands outside than inside, and next to nothing if it stands inside more often. Of
    either the tags_kept most frequent are kept; others count as never met. The scale is that of `scales` whose runs
    match the labelled words best (F1) if the label tags themselves weigh nothing, the smallest of equals. Without
    labelled pages no tag weighs anything.
    """
    bound_batches(pages.sparkSession)
    raw = F.col(html_col)
    labelled = pages.where(raw.rlike("(?i)<(article|main)[ >]")).select(raw.alias("h"))
    share = min(1.0, sample / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    marks = {}
    for r in _counts(chosen, _count_names).orderBy(F.desc(F.col("n") + F.col("o")), "key").limit(tags_kept).collect():
        fixed = r["key"] in APART_NAMED or r["key"].startswith("<")
        odds = math.log((r["o"] + fixed * FIXED_COUNT + 1) / (r["n"] + 1))
        marks[r["key"]] = odds if fixed else odds - LEARNED_LESS
    marked = Weights(marks=marks)

    def count_tags(html: str, inside: Counter, outside: Counter) -> None:
        for key, _, within in tokens(html, marked):
            if key:
                (inside if within else outside)[key] += 1

    rows = _counts(chosen, count_tags).orderBy(F.desc(F.col("n") + F.col("o")), "key").limit(tags_kept).collect()
    if not rows:
        return marked
    tags = {r["key"]: max(0.001, math.log((r["o"] + 1) / (r["n"] + 1))) for r in rows}
    blind = {k: 0.0 if _is_label(k) else v for k, v in tags.items()}
    options = [Weights(blind, 0.0, float(s), marks) for s in scales]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0, 0, 0] for _ in options]
        for batch in batches:
            for page in batch.column(0):
                for total, found in zip(sums, _overlaps(page.as_py(), options)):
                    for k, n in enumerate(found):
                        total[k] += n
        columns = [list(range(len(options))), *map(list, zip(*sums))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k", "b", "p", "g"])

    match = chosen.mapInArrow(compare, "k long, b long, p long, g long").groupBy("k").agg((2 * F.sum("b") / F.greatest(F.sum("p") + F.sum("g"), F.lit(1))).alias("f")).collect()
    best = max(match, key=lambda r: (round(r["f"], 6), -r["k"]))
    return Weights(tags, 0.0, options[best["k"]].scale, marks)


def extract(pages: DataFrame, weights: Weights | None = None, *, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """pages with text_col and chars_col (its code points) instead of html_col; clashing columns are replaced.

    Weights are learned from pages unless given. Whole pages are read; null or empty ones, and pages without words, give
    an empty text. Repeated rows and ids play no part; an empty table gives an empty result.
    """
    weights = learn_weights(pages, html_col=html_col) if weights is None else weights
    bound_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text_col, chars_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(html_col)]
            table = pa.Table.from_batches([batch]).select(others)
            table = table.append_column(text_col, pa.array(texts, pa.string()))
            yield from table.append_column(chars_col, pa.array([len(t) for t in texts], pa.int64())).to_batches()

    types = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), f"`{text_col}` string", f"`{chars_col}` long"])
    return pages.select(*others, html_col).mapInArrow(run, schema)
