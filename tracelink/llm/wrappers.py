"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

A page becomes a tree of block elements and text blocks (inline markup belongs to its block, character
references are decoded, a break is white space). A wrapper is such a tree with optional groups and
repeated groups in it. It is inferred by aligning the pages of a host one after the other: where
wrapper and page agree, text becomes a slot; a mismatch is resolved as a repetition, if what comes next
is what came just before, and as an optional group otherwise, found by searching the item of one side
further on in the other.

Every page takes part: pages are folded to their structure (repetitions collapsed), of which only the
distinct ones of a host are aligned - first in salted groups, then across groups, so a host with a large
part of all pages is neither shuffled whole nor held whole. Html itself is never shuffled unless the
wrappers outgrow ``broadcast_bytes``.

Then the strings are aligned: each page is walked along its host's wrapper, and a string that the same slot holds on every page of
the host (``least`` different pages or more) is a constant of the expression, template text and no main text; strings that
differ leave a text slot. Strings inside an article or main element are text by their mark and are not compared, nor are those in
elements that are dropped.

What a page's text slots hold is its main text, if no element around them is a menu, header, footer, sidebar, notice,
advert, form, script or comment section, and, where the page fills an article or main element, if they
lie in it. A page that the wrapper does not accept generalises it for itself first. Elements nested deeper than ``DEPTH`` are
not told apart from the one around them, unless they begin a dropped or a main part; their text stays.

Edge cases: null or empty html has empty text; a null url or one without a host belongs to the host '';
rows with the same page_id are pages of their own; unclosed and stray tags are repaired (a block
closes an open paragraph, a closing tag without an opening one is dropped, a dropped inline element ends with
its block at the latest); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import sized
from tracelink.session import written

RAW = "script|style|noscript|template|textarea|iframe|svg|math|canvas|object|select|title"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-z/][^<>]*+(?:>|\Z)|[^<]++|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, if it is the innermost block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

DROPPED_TAGS = frozenset("head nav header footer aside form button menu dialog option legend".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu header footer sidebar aside breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond replies widget toolbar pagination pager login banner".split()
)
#: Parts of a class or id that say where something stands, not what it is.
NEUTRAL_WORDS = frozenset(
    "area article author bar block body bottom box btn button buttons container content count entry feed first form global group header heading icon icons id inline inner item items last left level line link links list main media meta more now outer overlay page panel parent post posts primary reply right row secondary section site slot small stories story text thread title tool tools top unit us user view wrap wrapper".split()
)
#: What a nested article is not, if it is named so.
OTHER_ARTICLES = frozenset("ad advert advertisement comment comments promo promoted recommended related replies reply response sponsored teaser teasers".split())
MAIN = ("article", "main")
DEPTH = 64


def unwanted(word: str, words: frozenset = DROPPED_WORDS) -> bool:
    """Whether a class or id names what is none of the main text: a dropped word, alone or with parts that only say where it
    stands (related-posts; but not related-work)."""
    parts = [p for p in re.split(r"[-_\d]+", word) if p]
    return any(p in words for p in parts) and all(p in words or p in DROPPED_WORDS or p in NEUTRAL_WORDS for p in parts)


@lru_cache(maxsize=65_536)
def element(name: str, attrs: str) -> tuple[str, bool]:
    """Label (name, classes and id without digits) and whether the element is none of the main text."""
    words, role = [], ""
    for m in ATTRIBUTE.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = value.strip()
        else:
            words += value.split()
    dropped = name in DROPPED_TAGS or role in DROPPED_ROLES
    if name == "article":
        dropped |= any(unwanted(w, OTHER_ARTICLES) for w in words)
    elif name not in ("html", "body", "main"):
        dropped |= any(map(unwanted, words))
    label = ".".join([name, *sorted({re.sub(r"\d+", "0", w) for w in words})])
    return label + ("!" if dropped else ""), dropped


def tree(page: str) -> tuple[list, list[str]]:
    """The page's items - ["e", label, items] and ["t", number] - and its text blocks by number."""
    items: list = []
    texts: list[str] = []
    # name, items, level, inside a dropped element, inside an article or main element
    stack: list[tuple[str, list, int, bool, bool]] = [("", items, 0, False, False)]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1][1].append(["t", len(texts)])
                texts.append(text)

    def close(names) -> None:
        """Close the innermost open element of these names, and all within it."""
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                flush()
                del stack[depth:]
                return

    skipped: list[str] = []  # a dropped inline element and what is open in it; its block goes on after it

    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            raw = m.group()
            if not skipped and (raw[0] != "<" or raw == "<"):
                held.append(raw)
            continue
        name = name.lower()
        if skipped:
            if not m["end"]:
                if name not in VOID and not m["attrs"].endswith("/"):
                    skipped.append(name)
                continue
            if name in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(name) :]
                continue
            if name not in BLOCKS:
                continue
            skipped.clear()  # it was never closed: the block around it ends
        if name in VOID:
            if name == "br":
                held.append(" ")
            elif name == "hr":
                flush()
            continue
        if m["end"]:
            if name in BLOCKS or any(x[0] == name for x in stack):
                close((name,))
            continue
        label, dropped = element(name, m["attrs"])
        if name not in BLOCKS:  # inline: a part of its block, or left out of it
            if dropped and not m["attrs"].endswith("/"):
                skipped.append(name)
            continue
        if name in BLOCKS:
            if name in CLOSES and stack[-1][0] in CLOSES[name]:
                close(CLOSES[name])
            elif stack[-1][0] == "p":
                close(("p",))
        flush()
        _, around, level, out, inside = stack[-1]
        if level < DEPTH or (dropped and not out) or (name in MAIN and not inside):
            own: list = []
            around.append(["e", label, own])
            level += 1
        else:
            own = around
        if not m["attrs"].endswith("/") or name in BLOCKS:
            stack.append((name, own, level, out or dropped, inside or name in MAIN))
    flush()
    return items, texts


# wrappers: items are "t" (a slot), ["e", label, items], ["?", items] and ["+", items]


def alike(a: list, b: list) -> bool:
    """Whether two items can be one: both text, the same element, or groups of such."""
    if a[0] in "?+" and b[0] in "?+" and len(a[1]) != len(b[1]):
        return False
    if a[0] in "?+":
        return (len(a[1]) == 1 or b[0] in "?+") and alike(a[1][0], b)
    if b[0] in "?+":
        return len(b[1]) == 1 and alike(a, b[1][0])
    return a[0] == b[0] and (a[0] == "t" or a[1] == b[1])


def key_of(x: list) -> str | None:
    """Equal for items that are alike; a group of several items is like none."""
    while x[0] in "?+":
        if len(x[1]) > 1:
            return None
        x = x[1][0]
    return x[0] if x[0] == "t" else f"e {x[1]}"


def places(items: list) -> dict:
    """Where each key stands."""
    out: dict = {}
    for k, x in enumerate(items):
        out.setdefault(key_of(x), []).append(k)
    out.pop(None, None)
    return out


def after(found: dict, x: list, k: int) -> int | None:
    """The first place from ``k`` on of an item that is like ``x``."""
    own = found.get(key_of(x), ())
    at = bisect_left(own, k)
    return own[at] if at < len(own) else None


def merge(a: list, b: list) -> list:
    """The item that stands for two that are alike."""
    if a[0] in "?+" or b[0] in "?+":
        inner = align(a[1] if a[0] in "?+" else [a], b[1] if b[0] in "?+" else [b])
        kinds = {a[0], b[0]}
        while len(inner) == 1 and inner[0][0] in "?+":
            kinds.add(inner[0][0])
            inner = inner[0][1]
        out = ["+", inner] if "+" in kinds else None
        return (["?", [out]] if out else ["?", inner]) if "?" in kinds else out
    return ["t"] if a[0] == "t" else ["e", a[1], align(a[2], b[2])]


def optional(items: list) -> list:
    return items if len(items) == 1 and items[0][0] == "?" else [["?", items]]


def repeated(last: list, more: list) -> list:
    """``last`` as a repeated group that covers ``more`` too."""
    out = merge(last, more)
    if out[0] == "?":
        return ["?", [out[1][0] if out[1][0][0] == "+" else ["+", out[1]]]]
    return out if out[0] == "+" else ["+", [out]]


def align(a: list, b: list) -> list:
    """The smallest generalisation found of two item lists."""
    out: list = []
    i = j = 0
    in_a = in_b = None
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if alike(x, y):
            out.append(merge(x, y))
            i, j = i + 1, j + 1
            continue
        # a repeated group of several items meets one round of them
        if x[0] == "+" and len(x[1]) > 1 and _row(x[1], b[j : j + len(x[1])]):
            out.append(["+", align(x[1], b[j : j + len(x[1])])])
            i, j = i + 1, j + len(x[1])
            continue
        if y[0] == "+" and len(y[1]) > 1 and _row(y[1], a[i : i + len(y[1])]):
            out.append(["+", align(a[i : i + len(y[1])], y[1])])
            i, j = i + len(y[1]), j + 1
            continue
        # repetition: what comes next is what came just before
        if out and alike(out[-1], y):
            out[-1], j = repeated(out[-1], y), j + 1
            continue
        if out and alike(out[-1], x):
            out[-1], i = repeated(out[-1], x), i + 1
            continue
        # optional: the nearer of the two items that turns up further on
        if in_a is None:
            in_a, in_b = places(a), places(b)
        at, to = after(in_b, x, j + 1), after(in_a, y, i + 1)
        if at is not None and (to is None or at - j <= to - i):
            out += [o for k in range(j, at) for o in optional([b[k]])]
            j = at
        elif to is not None:
            out += [o for k in range(i, to) for o in optional([a[k]])]
            i = to
        else:
            out += optional([x]) + optional([y])
            i, j = i + 1, j + 1
    for x in [*a[i:], *b[j:]]:
        if out and alike(out[-1], x):
            out[-1] = repeated(out[-1], x)
        else:
            out += optional([x])
    return out


def _row(body: list, items: list) -> bool:
    return len(body) == len(items) and all(map(alike, body, items))


def fold(items: list, widest: int = 3) -> list:
    """The structure of a page: texts as slots, and rows of up to ``widest`` items that repeat as one group."""
    own = [["t"] if x[0] == "t" else ["e", x[1], fold(x[2], widest)] for x in items]
    for size in range(1, widest + 1):
        out: list = []
        for x in own:
            out.append(x)
            while len(out) >= size + 1:
                last = out[-size:]
                before = out[-size - 1]
                if size == 1 and alike(before, x):
                    out[-2:] = [repeated(before, x)]
                elif size > 1 and before[0] == "+" and len(before[1]) == size and _row(before[1], last):
                    out[-size - 1 :] = [["+", align(before[1], last)]]
                elif size > 1 and len(out) >= 2 * size and not any(k[0] in "?+" for k in out[-2 * size :]) and _row(out[-2 * size : -size], last):
                    out[-2 * size :] = [["+", align(out[-2 * size : -size], last)]]
                else:
                    break
        own = out
    return own


def infer(structures: Iterator[list]) -> list:
    """The wrapper of a series of structures or wrappers."""
    out = None
    for s in structures:
        out = s if out is None else align(out, s)
    return out or []


def labelled(items: list, inside: bool = False, dropped: bool = False, numbers: Iterator[int] | None = None) -> list:
    """``items`` with slots ["t", in an article or main element, in a dropped element, number]."""
    numbers = count() if numbers is None else numbers
    out = []
    for x in items:
        if x[0] == "t":
            out.append(["t", inside, dropped, next(numbers)])
        elif x[0] == "e":
            out.append(["e", x[1], labelled(x[2], inside or re.split(r"[.!]", x[1])[0] in MAIN, dropped or x[1].endswith("!"), numbers)])
        else:
            out.append([x[0], labelled(x[1], inside, dropped, numbers)])
    return out


def flat(items: list) -> list[tuple[list, int]]:
    """The list's slots and elements without groups; each with the place where its repeated group begins, or -1."""
    out: list[tuple[list, int]] = []
    for x in items:
        if x[0] in "?+":
            begin = len(out)
            out += [(y, begin if x[0] == "+" and r < 0 else r if r < 0 else r + begin) for y, r in flat(x[1])]
        else:
            out.append((x, -1))
    return out


def walk(wrapper: list, items: list, found: list[tuple[int, list]]) -> bool:
    """Take each text block's number and slot; False if the wrapper does not accept the items."""
    places = flat(wrapper)
    at = 0
    for y in items:
        fits = lambda k: places[k][0][0] == y[0] and (y[0] == "t" or places[k][0][1] == y[1])
        k = next((k for k in range(at, len(places)) if fits(k)), None)
        last = places[at - 1][1] if at else -1
        if last >= 0 and (again := next((k for k in range(last, at) if fits(k)), None)) is not None and (k is None or k > at):
            k = again  # another round of the repeated group
        if k is None:
            return False
        slot = places[k][0]
        if y[0] == "t":
            found.append((y[1], slot))
        elif not walk(slot[2], y[2], found):
            return False
        at = k + 1
    return True


def place(slot: list, text: str) -> str:
    """A string in a slot, as constants are named."""
    return f"{slot[3]}:{xxhash.xxh64_hexdigest(text)}"


def taken(marked: list, items: list, texts: list[str], constants: frozenset = frozenset()) -> list[int] | None:
    """The numbers of the page's blocks in article or main slots, or, if it has none there, of all its blocks that are neither
    dropped nor constants; None if the wrapper does not accept the page."""
    found: list[tuple[int, list]] = []
    if not walk(marked, items, found):
        return None
    kept = [(i, slot) for i, slot in found if not slot[2]]
    if main := [i for i, slot in kept if slot[1]]:
        return main
    return [i for i, slot in kept if not constants or place(slot, texts[i]) not in constants]


def main_text(page: str | None, wrapper: list | None) -> str:
    """The page's main text by its host's wrapper."""
    items, texts = tree(page or "")
    own = fold(items)
    for candidate in ([] if wrapper is None else [wrapper, align(wrapper, own)]) + [own]:
        found = taken(labelled(candidate), items, texts)
        if found is not None:
            return "\n".join(texts[i] for i in found)
    raise AssertionError("a page's own structure accepts it")


@lru_cache(maxsize=4096)
def _parsed(wrapper: str) -> tuple[list, list]:
    own = json.loads(wrapper)
    return own, labelled(own)


def host(url):
    """Lower-case host of a url column, '' if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def structures(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the distinct structures of each host's pages, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "html"):
                own = {(h, json.dumps(fold(tree(page or "")[0]), separators=(",", ":"))) for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)}
                yield pa.record_batch([pa.array([k[i] for k in own], pa.string()) for i in (0, 1)], names=["host", "wrapper"])

    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, wrapper string").distinct()


def wrappers(found: DataFrame, each: int = 16) -> DataFrame:
    """(host, wrapper): one wrapper per host. Up to ``each`` structures are aligned in a task, then what came of these, until one is left:
    a tree for each host, so no task has all structures of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            rows = []
            for h, s, w in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper")), strict=True):
                if (h, s) != key:
                    if key is not None:
                        rows.append((key[0], json.dumps(own, separators=(",", ":"))))
                    key, own = (h, s), json.loads(w)
                else:
                    own = align(own, json.loads(w))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["host", "wrapper"])
        if key is not None:
            yield pa.record_batch([pa.array([x], pa.string()) for x in (key[0], json.dumps(own, separators=(",", ":")))], names=["host", "wrapper"])

    found = written(found, "structures")
    while True:
        sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        salted = found.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / each)))
        rows = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", F.length("wrapper"), "wrapper").select("host", "salt", "wrapper")
        found = written(rows.mapInArrow(run, "host string, wrapper string"), "aligned")


def with_wrapper(pages: DataFrame, own: DataFrame, small: bool) -> DataFrame:
    """page_id, url and html of every page with its host and what ``own`` has of this."""
    return pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(F.broadcast(own) if small else own, "host", "left")


def constants(rows: DataFrame, least: int = 5) -> DataFrame:
    """(host, constants): the strings, by slot, that stand outside article and main elements on every page of a host that its
    wrapper accepts and that fills none of these, of hosts with ``least`` different pages. ``rows`` has host, html and wrapper; counts leave a task pre-aggregated."""
    schema = pa.schema([("host", pa.string()), ("place", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "html"):
                seen: Counter = Counter()
                for h, page, w in zip(*(part.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                    items, texts = tree(page or "")
                    found: list[tuple[int, list]] = []
                    if not walk(_parsed(w)[1], items, found):
                        continue
                    if any(slot[1] and not slot[2] for _, slot in found):
                        continue  # a page that fills an article or main element is told by these
                    seen[h, "page:" + xxhash.xxh64_hexdigest(page or "")] += 1
                    seen.update({(h, place(slot, texts[i])) for i, slot in found if not slot[2]})
                yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    counts = rows.where("wrapper IS NOT NULL").select("host", "html", "wrapper").mapInArrow(run, "host string, place string, n long").groupBy("host", "place").agg(F.sum("n").alias("n"))
    counts = written(counts, "strings")
    page = F.col("place").startswith("page:")
    totals = counts.where(page).groupBy("host").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("pages")).where(F.col("different") >= least)
    # what every page has is no more than one page's strings
    return counts.where(~page).join(totals, "host").where("n = pages").groupBy("host").agg(F.collect_list("place").alias("constants"))


def extract(pages: DataFrame, broadcast_bytes: int = 8 << 20, least: int = 5) -> DataFrame:
    """page_id, url and text (its main text) of every row of ``pages`` (page_id, url, html)."""
    own = written(wrappers(structures(pages)), "wrappers")
    small = (own.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= broadcast_bytes
    own = written(own.join(constants(with_wrapper(pages, own, small), least), "host", "left"), "wrappers-with-strings")
    strings = F.coalesce(F.aggregate("constants", F.lit(0), lambda n, x: n + F.length(x)), F.lit(0))
    small = (own.agg(F.sum(F.length("wrapper") + F.length("host") + strings)).first()[0] or 0) <= broadcast_bytes
    rows = with_wrapper(pages, own, small).select("page_id", "url", "html", "wrapper", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "html"):
                out = []
                for page, w, fixed in zip(*(part.column(c).to_pylist() for c in ("html", "wrapper", "constants")), strict=True):
                    if w is None:
                        out.append(main_text(page, None))
                        continue
                    plain, marked = _parsed(w)
                    items, texts = tree(page or "")
                    found = taken(marked, items, texts, frozenset(fixed or ()))
                    out.append(main_text(page, plain) if found is None else "\n".join(texts[i] for i in found))
                yield pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
