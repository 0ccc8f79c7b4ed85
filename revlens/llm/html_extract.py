"""Main text of web pages: containers are scored per page, hosts vote, winners extract.

*Score.*  Each page is cut into text blocks with their open elements.  A container scores
the characters outside links of the blocks below it; blocks inside boilerplate (by tag,
class or id) give nothing.  A form, or an element that only its names mark, is no
boilerplate if it holds COVER of the page's text or the article or main element; if a page
would have no text at all, those with most of the text count, else all.  The deepest container with most of the page's score, and the
headings above it, is the page's vote.

*Vote.*  The vote is for a generalised path: the tags from the root with their classes and
ids, digits generalised.  Spark sums the votes per host and ranks the paths; a path needs
MIN_SHARE of its host's votes, and a host on which none has that share keeps its MOST_PATHS
best.

*Re-extract.*  Each page takes its host's best-ranked path that occurs in it (its own vote
if none does), and returns the blocks below these elements without boilerplate.

Texts: character references are decoded, white space inside a block is one space, blocks
are trimmed and joined in page order by a newline.  Nothing else is dropped or cut.

Defined results: null or empty html gives an empty text.  Pages without a usable url vote
together as one host.  Ties go to the smaller path.  Repeated rows and null page_ids give
a row each; extra columns are ignored.  Unclosed elements and a cut-off end are handled as
browsers do: open paragraphs end at the next block, an unfinished tag is dropped.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_SHARE = 0.05
MOST_PATHS = 20
COVER = 0.8         # part of the page's score that its container holds at least
HEAD_SLACK = 0.02
CONTAINERS = frozenset("html body main article section div center td".split())
HEADINGS = frozenset("h1 h2 h3".split())
BROADCAST_BYTES = 32 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z>][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}

# Fixed by the HTML standard: elements without content, blocks, and what ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul").split())
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
P_SCOPE = frozenset("button td th table caption html".split())

# Boilerplate, by tag or by a word of class or id.
OUTSIDE_TAGS = frozenset("nav footer aside form button select option dialog menu head svg object canvas audio video map search fieldset label legend".split())
OUTSIDE_WORDS = frozenset(("ad ads adv advert advertisement advertising adverts banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist "
                           "disqus replies reply respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
                           "login footer foot nav navbar navigation menu menus sidebar side aside widget widgets related recommended recommendations share sharing "
                           "social pagination pager skip toolbar masthead topbar copyright disclaimer announcement announcements paywall").split())
ASIDE_WORDS = frozenset("comment comments commentlist disqus replies reply respond related recommended recommendations".split())  # released only from empty pages
HAVING_WORDS = frozenset("with has no without not hide show is".split())
# What a boilerplate name may say besides: "ad-slot" and "site-footer" are marks, "ad-hoc" and "share-price" are not.
PART_WORDS = frozenset(("area article articles bar block blocks body bottom box btn button buttons cell center col column columns container content desktop field fixed "
                        "floating form global group header heading icon icons inner input item items label left link links list lists main media message mobile module "
                        "outer page panel post posts primary right row secondary section site slot sticky stories story strip tab tabs text title top unit view wrap "
                        "wrapper zone").split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
MARK_WORDS = OUTSIDE_WORDS | PART_WORDS
LONG_PATH = 300  # above this many characters the front of a path is replaced by its digest
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class Element:
    __slots__ = ("tag", "up", "depth", "path", "outside", "link", "head", "hard", "mark", "aside", "story")

    def __init__(self, tag: str, attrs: str, up: "Element | None"):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs else {}
        names = " ".join((found.get("class", ""), found.get("id", ""))).split()
        above = "" if up is None else f"{up.path}>" if len(up.path) <= LONG_PATH else f"#{hashlib.md5(up.path.encode()).hexdigest()}>"
        self.path = above + ".".join([tag, *sorted({_DIGITS.sub("#", x.lower()) for x in names})])
        # a name such as "with-sidebar" says what an element has, not what it is; one that says
        # anything beyond boilerplate and its layout is no mark
        parts = [set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())) for x in names]
        words = set().union(*(p for p in parts if p.isdisjoint(HAVING_WORDS) and p <= MARK_WORDS))
        role = found.get("role", "").lower()
        hard = tag in OUTSIDE_TAGS and tag != "form" or role in OUTSIDE_ROLES and role != "form" or found.get("aria-hidden", "").lower() == "true"
        here = hard or tag == "form" or role == "form" or not words.isdisjoint(OUTSIDE_WORDS)
        if tag in ("html", "body", "main", "article") and not (tag == "article" and not words.isdisjoint(("comment", "comments", "reply", "related", "ad"))):
            hard = here = False
        self.hard = hard or (up.hard if up else False)
        # nearest element marked by its names or as a form; whether an article or main stands below it
        marked = here and not hard
        self.mark = self if marked else (up.mark if up else None)
        self.aside = marked and not words.isdisjoint(ASIDE_WORDS)
        self.story = not here and (tag in ("main", "article") or (up.story if up else False))
        self.outside = here or (up.outside if up else False)
        self.link = tag == "a" or (up.link if up else False)
        self.head = tag == "header" or (up.head if up else False)
        if tag == "article":
            self.head = False


def blocks(page: str):
    """[(element, text, characters in links)] of a page, in order."""
    root = Element("html", "", None)
    stack, out, parts, linked, at = [root], [], [], 0, 0
    inside = Counter()  # open elements by tag, so that searches of a deep stack find something

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder = stack[-1]
                while holder.up is not None and holder.tag not in BLOCK:
                    holder = holder.up
                out.append((holder, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    def close(index):
        flush()
        drop(index)

    def drop(index):
        inside.subtract(e.tag for e in stack[index:])
        del stack[index:]

    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1) if inside[tag] else ():
                if stack[i].tag == tag:
                    if tag in BLOCK or any(e.tag in BLOCK for e in stack[i:]):
                        # an inline end tag does not close the blocks opened inside it
                        if tag in BLOCK:
                            close(i)
                    else:
                        drop(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag == "html" or (tag == "body" and inside["body"]):
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1) if inside["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in P_SCOPE:
                    break
        elif tag == "br":
            flush()
        if tag in ENDS and any(inside[t] for t in ENDS[tag]):
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    cut = i
                if stack[i].tag in SCOPE[tag]:
                    break
            if cut is not None:
                close(cut)
        if tag == "body" and len(stack) > 1:
            close(1)
        attrs = m[3] or m[6] or ""
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end()
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        stack.append(Element(tag, attrs, stack[-1]))
        inside[tag] += 1
    flush()
    release(out)
    return out


def release(found) -> None:
    """Lifts the marks of forms and named wrappers that hold the page itself (see above)."""
    marks: dict = {}  # marked element -> [element, text below it, of which in an article or main]
    clear = 0         # text outside all marks
    for holder, text, linked in found:
        weight = len(text) - linked
        if holder.hard or holder.head or weight <= 0:
            continue
        if holder.mark is None:
            clear += weight
            continue
        cell = marks.setdefault(id(holder.mark), [holder.mark, 0, 0])
        cell[1] += weight
        cell[2] += weight if holder.story else 0
    if not marks:
        return
    for element in [cell[0] for cell in marks.values()]:
        while element.up.mark is not None and id(element.up.mark) not in marks:
            element = element.up.mark
            marks[id(element)] = [element, 0, 0]
    inner = sorted(marks.values(), key=lambda c: -c[0].depth)
    own = {id(cell[0]): cell[1] for cell in inner}
    total = clear + sum(own.values())
    for element, weight, story in inner:
        if element.up.mark is not None:
            above = marks[id(element.up.mark)]
            above[1] += weight
            above[2] += story
    lifted = {id(e) for e, weight, _ in inner if not e.aside and weight >= COVER * total}

    def closed() -> dict:
        out: dict = {}
        for element, _, _ in reversed(inner):
            out[id(element)] = id(element) not in lifted or (element.up.mark is not None and out[id(element.up.mark)])
        return out

    # an article counts against the text that is outside marks by now
    clear += sum(own[i] for i, yes in closed().items() if not yes)
    lifted |= {id(e) for e, _, story in inner if not e.aside and story > clear}

    def shut():
        out = closed()
        for holder, _, _ in found:
            holder.outside = holder.hard or (holder.mark is not None and out.get(id(holder.mark), True))
        return not any(_usable(h) and len(text) > linked for h, text, linked in found)

    if shut():
        lifted |= {id(e) for e, weight, _ in inner if 2 * weight > total}
        if shut():
            lifted |= set(marks)
            shut()


def _usable(element: Element) -> bool:
    return not element.outside and not element.head


def vote(found) -> tuple[str, float]:
    """(path, score) of the best container; ("", 0) if no block counts.

    The score of a path is the text outside links below it, without boilerplate.  The deepest
    path with COVER of the page's score wins, or the article (else main) element around it;
    ancestors follow as long as they add nothing but headings, so that a title above the body
    is not lost."""
    own: dict = {}
    for holder, text, linked in found:
        weight = len(text) - linked
        if weight > 0 and _usable(holder):
            cell = own.setdefault(id(holder), [holder, 0, 0])
            cell[1] += weight
            cell[2] += weight if holder.tag in HEADINGS else 0
    for holder in [cell[0] for cell in own.values()]:
        up = holder.up
        while up is not None and id(up) not in own:
            own[id(up)] = [up, 0, 0]
            up = up.up
    paths: dict = {}  # path -> [score, of which headings, depth, path above]
    for element, weight, heads in sorted(own.values(), key=lambda c: -c[0].depth):
        cell = paths.setdefault(element.path, [0, 0, element.depth, element.up.path if element.up else None])
        weight, heads = own[id(element)][1:]
        cell[0] += weight
        cell[1] += heads
        if element.up is not None:
            own[id(element.up)][1] += weight
            own[id(element.up)][2] += heads
    if not paths:
        return "", 0.0
    total = max(cell[0] for cell in paths.values())
    tag = lambda p: p.rpartition(">")[2].partition(".")[0]
    best = min((p for p, cell in paths.items() if cell[0] >= COVER * total and tag(p) in CONTAINERS), key=lambda p: (-paths[p][2], p), default="html")
    lineage = [best]
    while paths[lineage[-1]][3] is not None:
        lineage.append(paths[lineage[-1]][3])
    best = next((p for name in ("article", "main") for p in lineage if tag(p) == name), best)
    above = paths[best][3]
    while above is not None:
        more, heads = paths[above][0] - paths[best][0], paths[above][1] - paths[best][1]
        if more > heads + HEAD_SLACK * total:
            break
        if more:
            best = above
        above = paths[above][3]
    return best, float(paths[best][0])


def extract(found, paths) -> str:
    """Text of the blocks below the first of ``paths`` that occurs (own vote if none does)."""
    def below(path):
        known: dict = {}  # element -> None if it is not below the path, else whether a header stands between

        def place(e):
            way = []
            while e is not None and id(e) not in known and e.path != path:
                way.append(e)
                e = e.up
            state = None if e is None else known.get(id(e), False)
            for x in reversed(way):
                state = state if state is None else state or x.tag == "header"
                known[id(x)] = state
            return state
        out = []
        for holder, text, _ in found:
            state = None if holder.outside else place(holder)
            if state is not None and (state or not holder.head):
                out.append(text)
        return out
    for path in paths or ():
        texts = below(path)
        if texts:
            return "\n".join(texts)
    own = vote(found)[0]
    return "\n".join(below(own)) if own else ""


def host_of(url: Column) -> Column:
    """Lower-cased host of a url, '' if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(batches):
    for batch in batches:
        rows = [vote(blocks(h.as_py() or "")) if h.is_valid else ("", 0.0) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                                         ["host", "path", "score"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's paths with MIN_SHARE of its votes, best first."""
    votes = (pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
             .mapInArrow(_votes, "host string, path string, score double").where("path <> ''")
             .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")))
    # a host keeps 1 / MIN_SHARE = MOST_PATHS paths at most
    best = votes.groupBy("host").agg(F.sum("votes").alias("total"), F.max("votes").alias("most"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    first = votes.withColumn("place", place).where(F.col("place") <= MOST_PATHS).drop("place")
    kept = first.join(best, "host").where((F.col("votes") >= MIN_SHARE * F.col("total")) | (F.col("most") < MIN_SHARE * F.col("total")))
    return kept.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path"))), lambda x: x["path"]).alias("paths"))


def _extracted(batches):
    for batch in batches:
        paths = batch.column("paths")
        texts = [extract(blocks(h.as_py() or ""), p.as_py()) if h.is_valid else "" for h, p in zip(batch.column("html"), paths)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    The path table is broadcast when it is at most BROADCAST_BYTES; a larger one is joined
    by host, where Spark splits the hosts with many pages."""
    from revlens.llm.store import stored

    paths = stored(host_paths(pages), "host-paths").withColumnRenamed("host", "h")
    size = paths.agg(F.sum(F.length("h") + F.length(F.array_join("paths", " ")) + 64)).first()[0] or 0
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(paths) if size <= BROADCAST_BYTES else paths, F.col("host") == F.col("h"), "left")
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_extracted, schema)
