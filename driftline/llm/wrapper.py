"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

1. A page becomes a stream of tokens, its tags and runs of text. Runs of text are slots; an element that repeats beside
   itself is folded into one repeated group, so a page of any length has a short expression.
2. A host's distinct expressions are aligned, a bounded number at a time, in rounds: equal parts stay, parts that only one side
   has become optional, parts that repeat become groups. The result, the host's wrapper, is again an expression of
   the same kind, so a host with any number of pages is reduced like a tree; no task holds a host's pages.
3. In the wrapper, the main region is the innermost container that leaves out nothing but links, boilerplate elements (navigation,
   headers, footers, forms, ...) and text that several pages of the host hold unchanged in the same place. A slot beside a
   container, one whose text varies, is article text, however short. Tables are containers only where they lay out the page. An
   `article` or `main` element that holds most of the text is preferred.
4. Extraction walks each page once and keeps the slots inside the region, block by block; without the region in a page, the
   slots outside of boilerplate.

Within a block white space is one space; character references are decoded; blocks are joined by one line feed. A null or empty page
has no text. A null url counts as an empty host. Pages of one host and equal html get equal texts. Unclosed elements end with the
element around them; a void element (`br`, `img`, ...) has no content. `noscript`, `template`, `svg` and `select` are left out up to their
end tag; where there is none, only the tag is.

An expression keeps PARTS parts of a sequence apart; a longer one becomes a repeated group of its different parts, and elements below
DEPTH levels count as their ancestor on that level. Both only make the region wider than it could be: no text is lost by them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, join_small
from .urls import parsed

#: Expressions aligned in one task at once.
FAN = 32
#: Parts of a sequence, and levels of elements, that an expression keeps apart.
PARTS, DEPTH = 48, 40
#: Wrappers that may be broadcast.
WRAPPERS = 50_000
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Left out up to their end tag; without one only the tag is.
HIDDEN = frozenset("noscript template svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose class says nothing about what they hold.
WHOLE = frozenset("html body article main".split())
#: Elements that can be a region.
CONTAINER = frozenset("html body div section center main article".split())
#: Elements that can be one where nothing but these is around them.
LAYOUT = frozenset("html body center table tbody tr td".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
NOTICE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|share|social|sidebar|side|"
    r"menu|nav\w*|breadcrumbs?|header|footer|masthead|comments?|comment-\w+|respon[ds]\w*|disqus|related|recommend\w*|widget|toolbar|login|search)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A tag that the end of the page cuts off.
CUT = re.compile(r"<[/!?a-zA-Z][^>]*\Z")
SPACES = re.compile(r"\s+")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, ""), ("text", text, "") in order; comments and raw content left out."""
    at, end = 0, len(page)
    unclosed: set[str] = set()
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", CUT.sub("", page[at:]), ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            yield "close", name, ""
            continue
        if name in HIDDEN:
            close = None if name in unclosed or m[3].endswith("/") else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif not m[3].endswith("/"):
                unclosed.add(name)          # none comes later either
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            yield "close", name, ""


def label(name: str, attributes: str) -> str:
    """An element as it stands in expressions: its name, and class or id if they mark boilerplate."""
    if attributes and name not in WHOLE:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if NOTICE.search(value):
                return f"{name}.{NOTICE.search(value)[0].strip(' _-').lower()}"
    return name


def walk(page: str) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(labels of the elements around, kind, text): kind is "text", or "block" at the edge of a block element."""
    stack: list[str] = []
    for kind, value, attributes in events(page):
        if kind == "text":
            yield tuple(stack), "text", value
        elif kind == "open":
            if value in BLOCK:
                yield tuple(stack), "block", ""
            if value == "p" and stack and "p" in (s.partition(".")[0] for s in stack):
                # A paragraph ends the one before it, with what is open inside.
                while stack:
                    if stack.pop().partition(".")[0] == "p":
                        break
            if value not in VOID and not attributes.endswith("/"):
                stack.append(label(value, attributes))
        else:
            if value in BLOCK:
                yield tuple(stack), "block", ""
            names = [s.partition(".")[0] for s in stack]
            if value in names:
                del stack[len(names) - 1 - names[::-1].index(value):]


def boilerplate(path: tuple[str, ...], trusted: frozenset = frozenset()) -> bool:
    return any(x in BOILERPLATE or ("." in x and x not in trusted) for x in path)


# -- expressions: [name, mark, parts]; mark "" once, "?" optional, "+" repeated, "*" both; the name of a slot is "#", of a group "" --

def written(x: list) -> str:
    return x[0] + (f"({' '.join(map(written, x[2]))})" if x[2] else "") + x[1]


def read_expression(text: str) -> list:
    """The inverse of `written`."""
    root: list = ["", "", []]
    stack = [root]
    for m in re.finditer(r"([^()\s?+*]*)(\()|(\))([?+*]?)|([^()\s?+*]+)([?+*]?)", text):
        if m[2]:
            node = [m[1], "", []]
            stack[-1][2].append(node)
            stack.append(node)
        elif m[3]:
            stack.pop()[1] = m[4]
        else:
            stack[-1][2].append([m[5], m[6], []])
    return root[2][0]


def _mark(a: str, b: str) -> str:
    many, may = ({"+", "*"} & {a, b}), ({"?", "*"} & {a, b})
    return "*" if many and may else "+" if many else "?" if may else ""


def _optional(x: list) -> list:
    return [x[0], _mark(x[1], "?"), x[2]]


def align(a: list[list], b: list[list]) -> list[list]:
    """One sequence for two: the longest common subsequence of names stays, what only one has becomes optional."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return fold(out)


def merge(a: list, b: list) -> list:
    return [a[0], _mark(a[1], b[1]), a[2] if a[2] == b[2] else align(a[2], b[2])]


def fold(parts: list[list]) -> list[list]:
    """Neighbours of one name become one repeated part; a long sequence one repeated group of optional parts."""
    out: list[list] = []
    for x in parts:
        if out and out[-1][0] == x[0] and x[0]:
            last = out[-1]
            mark = "*" if "?" in (last[1] + x[1]) and not ({last[1], x[1]} & {"", "+"}) else "+"
            out[-1] = [x[0], "" if x[0] == "#" else mark, last[2] if last[2] == x[2] else align(last[2], x[2])]
        else:
            out.append(x)
    if len(out) <= PARTS:
        return out
    flat: dict[str, list] = {}
    for x in out:
        for y in x[2] if x[0] == "" else [x]:
            flat[y[0]] = merge(flat[y[0]], y) if y[0] in flat else _optional(y)
    return [["", "+", list(flat.values())]]


def expression(page: str) -> tuple[str, dict[str, tuple[int, int | None]]]:
    """A page's own expression, and for each path of labels the characters of text below it (`a` marks text in links) and a hash
    of that text, none for different texts."""
    root: list = ["page", "", []]
    open_: list[list] = [root]
    path: tuple[str, ...] = ()
    weight: dict[str, int] = {}
    texts: dict[str, str | None] = {}
    for around, kind, text in walk(page):
        around = around[:DEPTH]
        if around != path:
            same = 0
            while same < min(len(around), len(path)) and around[same] == path[same]:
                same += 1
            # A block edge between two elements of one name comes with a shorter path, so it ends the first.
            while len(open_) > same + 1:
                done = open_.pop()
                done[2] = fold(done[2])
            for name in around[same:]:
                node = [name, "", []]
                open_[-1][2].append(node)
                open_.append(node)
            path = around
        if kind == "text" and not text.isspace():
            if not open_[-1][2] or open_[-1][2][-1][0] != "#":
                open_[-1][2].append(["#", "", []])
            key = "/".join(around)
            weight[key] = weight.get(key, 0) + len(text)
            texts[key] = text if texts.get(key, text) == text else None
    while open_:
        done = open_.pop()
        done[2] = fold(done[2])
    return written(root), {k: (n, None if texts[k] is None else _hash(texts[k])) for k, n in weight.items()}


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def region(wrapper: str, weight: dict[str, int], template: frozenset) -> tuple[list[str], list[str]]:
    """(path of the main region, labels that look like boilerplate but hold most of the text); the text of `template`, some of the
    paths, is the same on several pages: no slot of the wrapper."""
    paths = {tuple(k.split("/")) if k else (): n for k, n in weight.items()}
    plain = {p: n for p, n in paths.items() if not any(x in BOILERPLATE for x in p)}
    total = sum(plain.values())
    trusted = frozenset(x for x in {x for p in plain for x in p if "." in x} if 10 * sum(n for p, n in plain.items() if x in p) > 8 * total)
    text = {p: n for p, n in plain.items() if not boilerplate(p, trusted) and "a" not in p}
    total = sum(text.values())

    def held(path: tuple[str, ...]) -> int:
        return sum(n for p, n in text.items() if p[:len(path)] == path)

    own = {p: n for p, n in text.items() if "/".join(p) not in template}

    def spared(path: tuple[str, ...], child: tuple[str, ...]) -> bool:
        return not any(p[:len(path)] == path and p[:len(child)] != child for p in own)

    for name in ("article", "main"):
        tops = {p[:p.index(name) + 1] for p in text if name in p}
        if tops and 2 * max(map(held, tops)) > total:
            return list(max(sorted(tops), key=held)), sorted(trusted)
    node, path = read_expression(wrapper), ()
    while True:
        inner = [y for x in node[2] for y in (x[2] if x[0] == "" else [x]) if y[0] != "#"]
        allowed = CONTAINER | LAYOUT if all(x in LAYOUT for x in path) else CONTAINER
        inner = [x for x in inner if x[1] in ("", "?") and x[0].partition(".")[0] in allowed]
        best = max(inner, key=lambda x: held((*path, x[0])), default=None)
        # A text slot beside the child, on any page, belongs to the article as well, however short.
        if best is None or held((*path, best[0])) == 0 or not spared(path, (*path, best[0])):
            return list(path), sorted(trusted)
        node, path = best, (*path, best[0])


def main_text(page: str | None, root: tuple[str, ...], trusted: frozenset) -> str:
    """The blocks of the region, or of all that is not boilerplate if the page does not have the region."""
    inside: list[str] = []
    outside: list[str] = []
    block, rest = [], []
    for path, kind, text in walk(page or ""):
        if kind == "block":
            for parts, blocks in ((block, inside), (rest, outside)):
                if parts:
                    blocks.append(SPACES.sub(" ", html.unescape("".join(parts))).strip())
                    parts.clear()
        elif not boilerplate(path, trusted):
            (block if path[:len(root)] == root else rest).append(text)
    for parts, blocks in ((block, inside), (rest, outside)):
        if parts:
            blocks.append(SPACES.sub(" ", html.unescape("".join(parts))).strip())
    return "\n".join([b for b in inside if b] or [b for b in outside if b])


# -- jobs --

def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [expression(x.as_py() or "") for x in batch["html"]]
        yield pa.RecordBatch.from_arrays(
            [batch["host"], batch["page"], pa.array([e for e, _ in found], pa.string()),
             pa.array([[{"path": k, "chars": n, "hash": h} for k, (n, h) in w.items()] for _, w in found],
                      pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64()), ("hash", pa.int64())])))],
            names=["host", "page", "expression", "weights"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for each in batch["expressions"]:
            first, *others = sorted(each.as_py())
            whole = read_expression(first)
            for x in others:
                whole = merge(whole, read_expression(x))
            out.append(written(whole))
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(out, pa.string())], names=["host", "expression"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for e, each in zip(batch["expression"], batch["weights"]):
            ws = each.as_py()
            found.append(region(e.as_py(), {w["path"]: w["chars"] for w in ws}, frozenset(w["path"] for w in ws if w["template"])))
        yield pa.RecordBatch.from_arrays(
            [batch["host"], batch["expression"], pa.array([r for r, _ in found], pa.list_(pa.string())), pa.array([t for _, t in found], pa.list_(pa.string()))],
            names=["host", "wrapper", "region", "trusted"])


def wrappers(pages: DataFrame, store: Store) -> DataFrame:
    """host, wrapper, region, trusted from `pages` (host, html). Stored."""
    described = store.put(pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(
        _described, "host string, page long, expression string, weights array<struct<path:string,chars:long,hash:long>>"))
    live = store.put(described.select("host", "expression").distinct())
    while True:
        counts = store.put(live.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"))
        if counts.isEmpty():
            break
        # Groups of about FAN expressions of a host; a host of any size takes as many groups as it needs.
        group = F.pmod(F.xxhash64("expression"), F.ceil(F.col("n") / FAN))
        several = join_small(live, counts, "host", "inner").groupBy("host", group.alias("part")).agg(F.collect_list("expression").alias("expressions"))
        single = join_small(live, counts.select("host"), "host", "left_anti")
        after = store.put(several.select("host", "expressions").mapInArrow(_aligned, "host string, expression string").union(single).distinct())
        store.drop(live, counts)
        live = after
    # One text at a path, on pages that are not copies of each other.
    template = (F.count("hash") == F.count("*")) & (F.min("hash") == F.max("hash")) & (F.min("page") < F.max("page"))
    weights = (described.select("host", "page", F.inline("weights")).groupBy("host", "path")
               .agg(F.sum("chars").alias("chars"), F.coalesce(template, F.lit(False)).alias("template"))
               .groupBy("host").agg(F.collect_list(F.struct("path", "chars", "template")).alias("weights")))
    found = live.join(weights, "host", "left").withColumn("weights", F.coalesce("weights", F.expr("cast(array() as array<struct<path:string,chars:bigint,template:boolean>>)")))
    return store.put(found.mapInArrow(_regions, "host string, wrapper string, region array<string>, trusted array<string>"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), tuple(r.as_py() or ()), frozenset(t.as_py() or ()))
                 for h, r, t in zip(batch["html"], batch["region"], batch["trusted"])]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, store: Store | None = None) -> DataFrame:
    """page_id, url, text, n_chars: a row for each of `pages` (page_id, url, html)."""
    store = store or Store(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", parsed(F.col("url"))[0].alias("host"))
    known = wrappers(p, store).select("host", "region", "trusted")
    joined = join_small(p, known, "host", most=WRAPPERS).select("page_id", "url", "html", "region", "trusted")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
