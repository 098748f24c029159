"""HTML main-text extraction by equivalence-class template deduction per host."""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .url_rules import host_of

#: Fixed values of HTML: elements without content, elements whose content is not markup, blocks, implied ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "del", "ins", "big", "strike", "label"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "div", "section"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figcaption", "figure", "caption"}
MAIN = {"article", "main"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}

#: Elements that never hold an article, and those that do so only if they hold most of the page (a form around all of it).
NEVER = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "svg", "canvas", "object"}
SELDOM = {"form", "header"}
#: Words of class, id or role for comments of readers, for other parts beside the article, and words that say nothing.
COMMENT_WORDS = set("comment comments commentlist commentform discussion disqus replies reply respond responses".split())
BESIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside notice notices alert cookie cookies consent gdpr banner popup modal form login signup "
    "subscribe newsletter share sharing social related search complementary contentinfo".split()
)
PLAIN_WORDS = set("area block bar body bottom box container content entry group inner item items left links list main outer page post posts right section site slot thread top unit widget wrap wrapper".split())
STATE_WORDS = {"has", "no", "not", "with", "without", "is"}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

#: A class is valid on this share of its host's pages; a slot is fixed if that share of its pages say what other pages say, on this many at least.
SUPPORT, FIXED_PAGES = 0.5, 3
#: A slot is descended into while it has this share of the text; beside an article's own element, slots under this share are left out.
DESCEND, LEAST = 0.6, 0.05
#: How much more the text of an article or main element counts than other text; how much less that of a slot with fixed or pooled texts.
PRIOR, FIXED, POOLED = 8.0, 0.05, 0.5
#: Siblings without marks are told apart by their number up to this one; elements below this depth have the role of the one there; longer marks are hashed.
NUMBERED, DEPTH, LONG = 9, 64, 60


@lru_cache(maxsize=100_000)
def kind_of(tag: str, marks: str) -> int:
    """2 for what never holds an article, 1 for what seldom does, 0 for all else.

    A mark counts if all its words are of a part beside the article or plain; marks of a state ("has-sidebar") and marks with
    other words ("social-science") say nothing, nor do those of html and body.
    """
    if tag in NEVER:
        return 2
    worst = 1 if tag in SELDOM else 0
    for mark in () if tag in ("html", "body") else marks.split():
        words = [w.lower() for w in WORDS.findall(mark)]
        if words and words[0] not in STATE_WORDS:
            beside = [w for w in words if w in BESIDE_WORDS or w in COMMENT_WORDS]
            if beside and all(w in PLAIN_WORDS for w in words if w not in beside):
                worst = max(worst, 2 if any(w in COMMENT_WORDS for w in beside) else 1)
    return worst


@dataclass
class Page:
    """A page as elements in document order (parent, tag, role) and its text in blocks (role, text, characters in links)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    role: list[str] = field(default_factory=lambda: [""])
    kind: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str, bool]] = field(default_factory=list)  # element, text (empty: a break), in a link

    def blocks(self) -> list[tuple[str, str, int]]:
        """Text outside noise elements; neighbours of one role are one block.

        An element that seldom holds an article counts as noise unless it holds an article, main or h1 element and half of the page's text,
        or is the header of an article with a heading in it.
        """
        n = len(self.parent)
        chars, holds = [0] * n, [t in MAIN or t == "h1" for t in self.tag]
        for at, text, _ in self.runs:
            chars[at] += len(text)
        heads = [t in HEADINGS for t in self.tag]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            holds[up] |= holds[i]
            heads[up] |= heads[i]
        noise, inside = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            own = self.kind[i] == 2 or self.kind[i] == 1 and not (holds[i] and 2 * chars[i] >= chars[0]) and not (inside[up] and heads[i] and "header" in self.role[i].rpartition("/")[2])
            noise[i] = noise[up] or own
            inside[i] = not noise[i] and (inside[up] or self.tag[i] in MAIN)
        out: list[list] = []
        for at, text, link in self.runs:
            if noise[at]:
                continue
            if not text:
                if out:
                    out[-1][1].append(" ")
            elif out and out[-1][0] == self.role[at]:
                out[-1][1].append(text)
                out[-1][2] += len(text) if link else 0
            else:
                out.append([self.role[at], [text], len(text) if link else 0])
        plain = ((role, " ".join("".join(said).split()), link) for role, said, link in out)
        return [(role, text, link) for role, text, link in plain if text]


def parse(page: str | None) -> Page:
    """The page's elements and text runs. Unclosed and crossed elements end as in browsers: with the parent, or where the next item, row or block begins.

    Inline elements have no role of their own unless they are marked as noise. A role is the path of open elements with their class, id and role
    (numbers in them aside); where an element has none, its number among such siblings tells it apart, as its place in the template would.
    """
    page = page or ""
    out = Page()
    stack = [0]
    opened: Counter[str] = Counter()
    seen: list[dict[str, int]] = [{}]
    at = link = 0

    def text(upto: int) -> None:
        if upto > at:
            out.runs.append((stack[-1], htmllib.unescape(page[at:upto]), link > 0))

    def push(tag: str, marks: str, kind: int) -> None:
        name = tag
        if marks:
            plain = DIGITS.sub("#", ".".join(sorted(marks.split()))).replace("/", "|")
            name = f"{tag}.{plain if len(plain) <= LONG else xxhash.xxh64_hexdigest(plain)}"
        if not marks and tag not in CONTENT and tag not in INLINE:
            number = seen[stack[-1]].get(tag, 0) + 1
            seen[stack[-1]][tag] = number
            name = name if number == 1 else f"{tag}:{min(number, NUMBERED)}"
        out.parent.append(stack[-1])
        out.tag.append(tag)
        out.role.append(f"{out.role[stack[-1]]}/{name}" if len(stack) <= DEPTH else out.role[stack[-1]])
        out.kind.append(kind)
        seen.append({})
        stack.append(len(out.parent) - 1)
        opened[tag] += 1

    def leave() -> str:
        tag = out.tag[stack.pop()]
        opened[tag] -= 1
        return tag

    def pop(names: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if out.tag[stack[k]] in names:
                while len(stack) > k:
                    leave()
                return
            if out.tag[stack[k]] in SCOPE:
                return

    for m in iter(lambda: MARKUP.search(page, at), None):
        text(m.start())
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            if not closing and m[3]:
                marks = " ".join(a or b or c for _, a, b, c in MARKS.findall(m[3]))
                if marks and kind_of(tag, marks):
                    push(tag, marks, 2)
            elif closing and opened[tag]:
                while out.tag[stack[-1]] in INLINE:
                    if leave() == tag:
                        break
            continue
        out.runs.append((stack[-1], "", False))
        link = 0
        if closing:
            if opened[tag]:
                while leave() != tag:
                    pass
            continue
        if tag in CLOSES_P:
            pop({"p"})
        if tag in IMPLIED:
            pop(IMPLIED[tag])
        marks = " ".join(a or b or c for _, a, b, c in MARKS.findall(m[3])) if m[3] else ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            push(tag, marks, kind_of(tag, marks))
            out.runs.append((stack[-1], "", False))
    text(len(page))
    return out


@dataclass
class Slot:
    """What is known of a role: pages it is on, how often it occurs there, text and link characters within, and how its text varies."""

    pages: int = 0
    occurs: int = 0
    chars: int = 0
    links: int = 0
    fixed: bool = False
    pooled: bool = False
    vector: tuple[int, int] = (0, 0)
    said: int = 0


def tag_of(role: str) -> str:
    return re.split(r"[.:]", role.rpartition("/")[2], maxsplit=1)[0]


def slots_of(page: Page, blocks: list[tuple[str, str, int]]) -> dict[str, Slot]:
    """The roles of one page; ``said`` is a hash of all text within."""
    out: dict[str, Slot] = {}
    for role in page.role:
        slot = out.setdefault(role, Slot(1))
        slot.occurs += 1
    for role, text, link in blocks:
        h = xxhash.xxh64_intdigest(text)
        at = len(role)
        while at >= 0:
            slot = out[role[:at]]
            slot.chars += len(text)
            slot.links += link
            slot.said = (slot.said * 0x9E3779B97F4A7C15 + h) & 0x3FFFFFFFFFFFFFFF
            at = role.rfind("/", 0, at) if at else -1
    return out


def choose(slots: dict[str, Slot]) -> tuple[str, list[str]]:
    """The main slot of a template, and the slots within it that aren't article.

    ``slots`` are the roles of valid classes, by path. From the root the slot that occurs once a page and holds most of the text is taken
    as long as it holds DESCEND of it and no heading of the article stands beside it. Text counts by how it varies over the pages: fixed texts hardly,
    texts from a pool less. Of slots that hold equal shares an article or main element is preferred. Slots within are left out if their text is fixed or (containers) from a pool,
    if they are mostly links or hold hardly any text and aren't in an article element. Tables stay, as what
    they have in common is what they say.
    """
    weight = {}
    for role, s in slots.items():
        prior = PRIOR if tag_of(role) in MAIN else 1.0
        weight[role] = (s.chars - s.links) * prior * (FIXED if s.fixed else POOLED if s.pooled else 1.0)
    below: dict[str, list[str]] = {}
    for role in slots:
        up = role
        while up:
            up = up.rpartition("/")[0]
            if up in slots:
                below.setdefault(up, []).append(role)
                break
    at = ""
    while at in below:
        once = [r for r in below[at] if slots[r].occurs <= slots[r].pages and tag_of(r) not in CONTENT]
        best = max(once, key=lambda r: (weight[r], r), default=None)
        rest = sum(weight[r] for r in below[at])
        if best is None or weight[best] <= 0 or weight[best] < DESCEND * max(rest, weight[at] / (PRIOR if tag_of(at) in MAIN else 1.0)):
            break
        titled = any(tag_of(r) in ("h1", "h2") and slots[r].chars and not slots[r].fixed for r in below[at])
        if tag_of(at) in MAIN or titled and tag_of(best) not in MAIN:
            break
        at = best
    inside = any(tag_of(at[: m.start()]) in MAIN for m in re.finditer("/|$", at))
    whole = max(1, slots[at].chars if at in slots else 1)
    drop = []
    for role in sorted(slots):
        if not role.startswith(f"{at}/") or any(role.startswith(f"{d}/") for d in drop):
            continue
        s, content = slots[role], tag_of(role) in CONTENT
        once = s.occurs <= s.pages
        linked = not inside and once and not content and s.chars and s.links >= 0.8 * s.chars and s.links < 0.5 * whole
        slight = not inside and not content and once and tag_of(role) not in ("html", "body", *MAIN) and s.chars < LEAST * whole
        if s.chars and tag_of(role) not in TABLE and (once and (s.fixed or s.pooled and not content) or linked or slight):
            drop.append(role)
    return at, drop


#: Rows of a batch that are parsed before the next is sent on, so that long pages don't pile up.
CHUNK = 256
BLOCKS = "array<struct<role:string,text:string>>"


def _parsed(id_type: str):
    """Per page its blocks, the choice the page would make alone, and per role what the host's template needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), CHUNK):
                pdf = whole.iloc[lo : lo + CHUNK]
                rows = []
                for page_id, url, host, key, text in zip(pdf.page_id, pdf.url, pdf.host, pdf.key, pdf.html, strict=True):
                    page = parse(text)
                    blocks = page.blocks()
                    slots = slots_of(page, blocks)
                    own, drop = choose(slots)
                    copy = slots[""].said
                    told = []
                    for role, s in slots.items():
                        h = xxhash.xxh64_intdigest(f"{key}:{s.occurs}")
                        told.append((role, s.said, s.occurs, s.chars, s.links, h & 0x7FFFFFFF, h >> 33))
                    rows.append((page_id, url, host, own, drop, [(r, t) for r, t, _ in blocks], told, copy))
                yield pd.DataFrame(rows, columns=["page_id", "url", "host", "own", "own_drop", "blocks", "roles", "copy"])

    roles = "array<struct<role:string,said:long,occurs:int,chars:long,links:long,lo:long,hi:long>>"
    return run, f"page_id {id_type}, url string, host string, own string, own_drop array<string>, blocks {BLOCKS}, roles {roles}, copy long"


def deduce_templates(parsed: DataFrame) -> DataFrame:
    """``host, main, drop``: each host's main slot and the slots within it that aren't article, from parsed pages.

    Roles whose occurrence vectors over the host's pages agree form an equivalence class. A vector is never laid out: the sum over pages of a hash of
    (page, count) stands for it and combines on the map side, so that a host with any share of all pages is one row per role, text and task. A
    class is valid if it is on SUPPORT of the host's pages; invalid classes aren't in the template, and text in them belongs to the slot of the nearest role around that is. Roles are paths, so valid classes
    nest by them. A slot's text is fixed if the class of its text is that of its element (each page says the same), and pooled if half of its pages say what
    another page says, where pages that agree as a whole are copies and don't count.
    """
    each = parsed.select("host", "copy", F.explode("roles").alias("r")).select("host", "copy", "r.*")
    sums = [F.sum(c).alias(c) for c in ("occurs", "chars", "links", "lo", "hi")]
    texts = each.groupBy("host", "role", "said").agg(F.count(F.lit(1)).alias("pages"), *sums, F.min("copy").alias("least"), F.max("copy").alias("most"))
    shared = (F.col("pages") > 1) & (F.col("least") < F.col("most"))
    more = [F.sum(c).alias(c) for c in ("pages", "occurs", "chars", "links", "lo", "hi")]
    roles = texts.groupBy("host", "role").agg(
        *more, F.max(F.when(shared, F.col("pages"))).alias("same"), F.sum(F.when(shared, F.col("pages")).otherwise(0)).alias("shared"),
        F.max(F.struct("pages", "lo", "hi")).alias("top"),
    )
    roles = materialize(roles, "roles")
    hosts = roles.where("role = ''").select(F.col("host").alias("h"), F.col("pages").alias("all"))
    enough = F.col("pages") >= FIXED_PAGES
    fixed = enough & (F.col("same") == F.col("pages")) & (F.col("top.lo") == F.col("lo")) & (F.col("top.hi") == F.col("hi"))
    valid = roles.join(hosts, F.col("host") == F.col("h")).where(F.col("pages") >= SUPPORT * F.col("all"))
    valid = valid.select(
        "host", "role", "pages", "occurs", "chars", "links", "lo", "hi",
        F.coalesce(fixed, F.lit(False)).alias("fixed"), F.coalesce(enough & (F.col("shared") >= SUPPORT * F.col("pages")), F.lit(False)).alias("pooled"),
    )

    def deduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        slots = {r.role: Slot(r.pages, r.occurs, r.chars, r.links, r.fixed, r.pooled, (r.lo, r.hi)) for r in pdf.itertuples()}
        main, drop = choose(slots)
        return pd.DataFrame({"host": [key[0]], "main": [main], "drop": [drop]})

    return valid.groupBy("host").applyInPandas(deduce, "host string, main string, drop array<string>")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    Null or empty html, and pages without main text, give an empty text. A null url has the host ``""``. A host of one page has a
    template of one page, and a page without its host's main slot is its own template. Rows that repeat are returned as often. An empty table gives an empty result. Whole pages are read.

    Pages are parsed once, to blocks of role and text, which are written; all else is built in. Templates hold a row per host, bounded by what an average
    page has; pages meet them in a join that Spark broadcasts only if the written templates are small, and else splits where a host is hot.
    """
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), "html")
    run, schema = _parsed(dict(pages.dtypes)["page_id"])
    parsed = materialize(named.mapInPandas(run, schema), "parsed", compression="zstd")
    templates = materialize(deduce_templates(parsed.select("host", "roles", "copy")), "templates").select(F.col("host").alias("h"), "main", "drop")
    joined = parsed.select("page_id", "url", "host", "own", "own_drop", "blocks").join(templates, F.col("host") == F.col("h"), "left")
    under = lambda role, top: (role == top) | F.startswith(role, F.concat(top, F.lit("/")))
    has = F.coalesce(F.exists("blocks", lambda b: under(b["role"], F.col("main"))), F.lit(False))
    picked = joined.select(
        "page_id", "url", "blocks", F.when(has, F.col("main")).otherwise(F.col("own")).alias("main"), F.when(has, F.col("drop")).otherwise(F.col("own_drop")).alias("drop")
    )
    kept = F.filter("blocks", lambda b: under(b["role"], F.col("main")) & ~F.exists("drop", lambda d: under(b["role"], d)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return picked.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
