"""Main text of web pages by wrappers inferred for each host: union-free regular expressions over token streams.

A page's tokens are nested into elements; its skeleton is what is left without texts. Skeletons of one host are aligned step by
step: what only one side has becomes optional, what follows itself becomes a repeated group, texts become slots. Equal skeletons
count once, so a host of a third of all pages costs its different skeletons only; these are merged in rounds of bounded groups,
dealt by their hashes, so that the wrapper depends neither on partitions nor on any one task seeing a whole host.
Each page is then read by its host's wrapper, which tells the slot of every text; what a slot holds over all pages of the host,
and the names of the elements around it, tell whether it is part of the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import md5
from json import dumps, loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, text_of
from .textbytes import batches_by_bytes, give_back

DEEPEST = 64  # elements nested deeper count as their content
LONGEST = 48  # particles of an element's content, beyond which it is any mix of them
PERIOD = 4  # elements in a repeated group at most
FAN_IN = 64  # skeletons that are merged together
SAME = 5  # a slot with one text only in so many places, on a host with so many different pages, is part of the template
MOST = 0.75  # of a host's running text is in the element taken as the article where none is marked

#: Elements without content, without text to read, and within a line of text, as in the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NO_TEXT = set("head nav header footer aside form button select option menu dialog object audio video canvas".split())
#: The starts that end an open element, by its name; any other ends at its own end or its parent's.
ENDS = {"p": "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
        "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "tbody", "thead", "tfoot"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"], "head": ["body"]}
BARRIER = set("table ul ol dl div section article body td th blockquote".split())
#: Words that begin or end a class, id or role of what isn't main text, and those that make it something else.
OUTSIDE = set("""ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion comment comments discussion disqus respond reply replies sidebar aside
nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar colophon cookie cookies consent gdpr notice notices notification alert toast popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended widget search toolbar pagination pager copyright contentinfo complementary form skip""".split())
UNLESS = {"with", "has", "no", "without"}
NO_ARTICLE = {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "promo"}
MAIN_TAGS = {"article": "*", "main": "+"}
MAIN_NAMES = {"article": "*", "post": "*", "entry": "*", "story": "*", "articlebody": "*", "main": "+"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.I)
_NAME = re.compile(r"[A-Za-z]+(?:[-_:]+[A-Za-z]+)*(?=[-_:\d]*$)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    """An element: its label, its elements, and its own texts, each with the number of elements before it and how much of it is linked."""

    label: str
    content: list[Node] = field(default_factory=list)
    texts: list[tuple[int, str, int]] = field(default_factory=list)


def label_of(name: str, attributes: str) -> str:
    """name, '!' if named as other than main text, '*' if as an article, '+' if as main content, then the words of its class, id and role; numbers don't count."""
    words, kind = set(), "!" if name in NO_TEXT else MAIN_TAGS.get(name, "")
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _NONE.search(value):
            kind = "!"
        elif key not in ("style", "aria-hidden"):
            for token in value.split():
                found = _NAME.match(token)
                part = [w.lower() for w in _WORD.findall(found[0])] if found else []
                words |= set(part)
                ends = {*part[:1], *part[-1:]} & (NO_ARTICLE if name in MAIN_TAGS else OUTSIDE)
                if ends and not UNLESS & set(part) and not (part[0] in MAIN_NAMES and part[-1] == "header"):
                    kind = "!"
                elif not kind and part and part[0] in MAIN_NAMES and (len(part) == 1 or part[-1] in ("body", "content", "text")):
                    kind = MAIN_NAMES[part[0]]
    if name in ("html", "body"):
        kind = ""
    return ".".join([name + kind, *sorted(words)])


def parse(page: str) -> Node:
    """The page's elements with their texts: references decoded, white space as one space, trimmed; inline markup parts no words."""
    root = Node("")
    stack, names = [root], [""]  # open elements; names are those of the ones too deep to be told apart, too
    run: list[str] = []
    linked = inked = 0

    def close_text() -> None:
        nonlocal inked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1].texts.append((len(stack[-1].content), text, min(inked, len(text))))
        inked = 0

    def close(k: int) -> None:
        del names[k:]
        del stack[min(k, len(stack)) :]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            run.append(page[at:stop])
            inked += (stop - at) * bool(linked)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name == "wbr":  # comments and declarations stand for nothing
            continue
        if name == "a":
            linked = not m[1]
        if name == "br":
            run.append(" ")
            continue
        if name in INLINE and (name != names[-1] if m[1] else "!" not in label_of(name, m[3])):
            continue
        close_text()
        if m[1]:
            k = len(names) - 1
            while k and names[k] != name:
                k -= 1
            if k:
                close(k)
            continue
        if name in RAW:  # ends at its own end tag only
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if name in VOID:
            continue
        for k in range(len(names) - 1, 0, -1):
            if name in ENDS.get(names[k], ()):
                close(k)
                break
            if names[k] in BARRIER:
                break
        if m[3].endswith("/") and "-" in name:  # closed at once
            continue
        if len(names) <= DEEPEST:
            header = name == "header" and any("*" in x.label.split(".")[0] or "+" in x.label.split(".")[0] for x in stack)
            node = Node("header" if header else label_of(name, m[3]))
            stack[-1].content.append(node)
            stack.append(node)
        names.append(name)
    close_text()
    return root


# --- expressions: ["e", label, many, optional, content, text] for an element, ["g", many, optional, content] for a group


def _key(x: list) -> str:
    return x[1] if x[0] == "e" else "(" + " ".join(_key(y) for y in x[-1]) + ")"


def _flags(x: list) -> tuple[bool, bool]:
    return (x[2], x[3]) if x[0] == "e" else (x[1], x[2])


def _with(x: list, many: bool, optional: bool) -> list:
    return ["e", x[1], many, optional, x[4], x[5]] if x[0] == "e" else ["g", many, optional, x[3]]


def _join(a: list, b: list) -> list:
    """Two particles with the same key as one."""
    many, optional = _flags(a)[0] or _flags(b)[0], _flags(a)[1] or _flags(b)[1]
    if a[0] == "e":
        return ["e", a[1], many, optional, align(a[4], b[4]), a[5] or b[5]]
    return ["g", many, optional, [_join(x, y) for x, y in zip(a[3], b[3], strict=True)]]


def fold(items: list[list]) -> list[list]:
    """Resolve repeats: a particle or a run of up to PERIOD that follows itself becomes a repeated group; endless variety becomes any mix."""
    for period in range(1, PERIOD + 1):
        out: list[list] = []
        keys: list[str] = []
        for x in items:
            out.append(x)
            keys.append(_key(x))
            if period > 1 and len(out) > period and out[-period - 1][0] == "g" and [_key(y) for y in out[-period - 1][3]] == keys[-period:]:
                held = out[-period - 1]
                out[-period - 1 :] = [["g", True, held[2], [_join(p, q) for p, q in zip(held[3], out[-period:], strict=True)]]]
                keys[-period - 1 :] = [_key(out[-1])]
            while len(out) >= 2 * period and keys[-period:] == keys[-2 * period : -period]:
                old, new = out[-2 * period : -period], out[-period:]
                if period == 1:
                    made = _with(_join(old[0], new[0]), True, _flags(old[0])[1] and _flags(new[0])[1])
                else:
                    made = ["g", True, False, [_join(p, q) for p, q in zip(old, new, strict=True)]]
                out[-2 * period :] = [made]
                keys[-2 * period :] = [_key(made)]
        items = out
    if len(items) > LONGEST:
        flat: dict[str, list] = {}
        waiting = items[::-1]
        while waiting:
            x = waiting.pop()
            if x[0] == "g":
                waiting += x[3][::-1]
            else:
                x = _with(x, False, True)
                flat[x[1]] = _join(flat[x[1]], x) if x[1] in flat else x
        items = [["g", True, True, list(flat.values())]]
    return items


def align(a: list[list], b: list[list]) -> list[list]:
    """The least common expression of two contents: matches by the longest common run of keys, the rest optional in its place."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_join(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for i in range(len(ka) - 1, -1, -1):
        for j in range(len(kb) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(ka) or j < len(kb):
        if i < len(ka) and j < len(kb) and ka[i] == kb[j]:
            out.append(_join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(kb) or i < len(ka) and best[i + 1][j] >= best[i][j + 1]:
            out.append(_with(a[i], _flags(a[i])[0], True))
            i += 1
        else:
            out.append(_with(b[j], _flags(b[j])[0], True))
            j += 1
    return fold(out)


def skeleton(node: Node) -> list[list]:
    """A page's own expression: its elements with repeats resolved, texts as slots."""
    return fold([["e", x.label, False, False, skeleton(x), bool(x.texts)] for x in node.content])


# --- reading a page by a wrapper


class Wrapper:
    """An expression whose elements have numbers: which element each of a page's elements is, by the automaton of its content."""

    def __init__(self, content: list[list]) -> None:
        self.labels: list[str] = [""]
        self.inside: list[tuple[list[int], dict[int, list[int]]]] = [([], {})]
        self.inside[0] = self._compile(content)

    def _compile(self, content: list[list]) -> tuple[list[int], dict[int, list[int]]]:
        """The numbers of the elements that can come first in one element's content, and of those that can follow each."""
        follow: dict[int, list[int]] = {}

        def walk(items: list[list]) -> tuple[list[int], list[int], bool]:
            first, last, empty = [], [], True
            for x in items:
                if x[0] == "e":
                    n = len(self.labels)
                    self.labels.append(x[1])
                    self.inside.append(([], {}))
                    self.inside[n] = self._compile(x[4])
                    follow[n] = []
                    f, z, e = [n], [n], False
                else:
                    f, z, e = walk(x[3])
                many, optional = _flags(x)
                if many:
                    for p in z:
                        follow[p] += [q for q in f if q not in follow[p]]
                for p in last:
                    follow[p] += [q for q in f if q not in follow[p]]
                first += f if empty else []
                last = last + z if e or optional else z
                empty = empty and (e or optional)
            return first, last, empty

        first, _, _ = walk(content)
        return first, follow

    def slots(self, node: Node, number: int = 0, path: str = "") -> list[tuple[str, str, int]]:
        """(slot, text, linked) of all texts below in page order; a slot is the labels on the way to it and the element's number (-1: unknown to the wrapper)."""
        first, follow = self.inside[number] if number >= 0 else ([], {})
        steps: list[dict[int, int]] = []
        now: list[int] | None = None
        for x in node.content:  # for each element that can be reached, the least one before it
            found: dict[int, int] = {}
            for p, nexts in [(-1, first)] if now is None else [(p, follow[p]) for p in now]:
                for q in nexts:
                    if self.labels[q] == x.label:
                        found.setdefault(q, p)
            if not found:  # not of this wrapper: go on from any element of that label
                found = {q: -1 for q in follow if self.labels[q] == x.label}
            steps.append(found)
            now = sorted(found) or now
        chosen, at = [-1] * len(steps), -1
        for k in range(len(steps) - 1, -1, -1):
            if steps[k]:
                chosen[k] = at if at in steps[k] else min(steps[k])
                at = steps[k][chosen[k]]
        out, t = [], 0
        for k in range(len(node.content) + 1):
            while t < len(node.texts) and node.texts[t][0] == k:
                out.append((f"{path}#{number}", *node.texts[t][1:]))
                t += 1
            if k < len(node.content):
                out += self.slots(node.content[k], chosen[k], f"{path}/{node.content[k].label}")
        return out


def marked(node: Node) -> int:
    """2 where an element named as an article is there, outside of what is no main text, else 1 where one named as main content is, else 0."""
    most = 0
    for x in node.content:
        kind = x.label.split(".")[0]
        most = max(most, 0 if "!" in kind else 2 if "*" in kind else max(int("+" in kind), marked(x)))
    return most


def _skeletons(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_by_bytes(batch, "html"):
            found = {}
            for host, page in zip(part["host"].to_pylist(), part["html"].to_pylist(), strict=True):
                text = dumps(skeleton(parse(page)), separators=(",", ":"))
                found[host, md5(text.encode()).hexdigest()] = text
            yield pa.RecordBatch.from_pylist([{"host": h, "hash": k, "wrapper": t} for (h, k), t in sorted(found.items())], schema=pa.schema([("host", pa.string()), ("hash", pa.string()), ("wrapper", pa.string())]))
        give_back()


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """One expression for a group of at most FAN_IN of a host, aligned in order of their hashes."""
    held = None
    for _, text in sorted(zip(rows["hash"].to_pylist(), rows["wrapper"].to_pylist(), strict=True)):
        held = loads(text) if held is None else align(held, loads(text))
    text = dumps(held, separators=(",", ":"))
    return pa.table({"host": [key[0].as_py()], "hash": [md5(text.encode()).hexdigest()], "wrapper": [text]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper of pages (host, html): every host's skeletons merged in rounds, at most FAN_IN at a time."""
    left = pages.select("host", "html").mapInArrow(_skeletons, "host string, hash string, wrapper string").groupBy("host", "hash").agg(F.first("wrapper").alias("wrapper"))
    while True:
        left = stage(left, "skeletons")
        sizes = left.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return left.select("host", "wrapper")
        rank = F.row_number().over(Window.partitionBy("host", "part").orderBy("hash")) - 1
        parts = F.pmod(F.xxhash64("hash"), F.ceil(F.col("n") / (FAN_IN // 2)).cast("long"))  # so that no task orders a whole host
        dealt = left.join(sizes, "host").withColumn("part", parts).withColumn("group", F.floor(rank / FAN_IN))
        left = dealt.groupBy("host", "part", "group").applyInArrow(_merged, "host string, hash string, wrapper string")
        left = left.groupBy("host", "hash").agg(F.first("wrapper").alias("wrapper"))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        for part in batches_by_bytes(batch, "html"):
            kinds, blocks = [], []
            for host, page, text in zip(part["host"].to_pylist(), part["html"].to_pylist(), part["wrapper"].to_pylist(), strict=True):
                if host not in known:
                    known = dict(list(known.items())[-255:]) | {host: Wrapper(loads(text))}
                root = parse(page)
                kinds.append(marked(root))
                blocks.append([{"slot": s, "text": t, "linked": n} for s, t, n in known[host].slots(root)])
            kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string()), ("linked", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part["id"], part["url"], part["host"], pa.array(kinds, pa.int32()), pa.array(blocks, kind)], names=["id", "url", "host", "marked", "blocks"])
        give_back()


def read_blocks(pages: DataFrame) -> DataFrame:
    """id, url, host, marked, blocks(slot, text, linked) of pages (id, url, host, html), each read by its host's wrapper."""
    with_wrapper = pages.join(wrappers(pages), "host").select("id", "url", "host", "html", "wrapper")
    return with_wrapper.mapInArrow(_read, f"id {pages.schema['id'].dataType.simpleString()}, url string, host string, marked int, blocks array<struct<slot: string, text: string, linked: bigint>>")


def roles(pages: DataFrame) -> DataFrame:
    """host, article, main, rest: the slots that are main text on pages with a marked article, with marked main content, and on others, of pages with blocks."""
    blocks = pages.select("host", F.explode("blocks").alias("b")).select("host", "b.*")
    slots = blocks.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("linked").alias("linked"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    kinds = pages.groupBy("host").agg(F.approx_count_distinct(F.xxhash64("blocks.text")).alias("different"))
    path = F.substring_index("slot", "#", 1)
    outside = path.rlike(r"/[^/.]*!")
    fixed = (F.col("low") == F.col("high")) & (F.col("n") >= SAME) & (F.col("different") >= SAME)
    slots = stage(slots.join(kinds, "host").where(~outside & ~fixed).select("host", "slot", path.alias("path"), "chars", "linked"), "page-slots")
    running = slots.where(F.col("linked") * 2 < F.col("chars"))
    # what holds the elements with the texts, so that a heading beside paragraphs is in; texts that lie in body's own elements are held by these
    depths = "sequence(1, if(path = '' OR element_at(split(path, '/'), -2) RLIKE '^(html|body)?([.]|$)', size(split(path, '/')), size(split(path, '/')) - 1))"
    prefixes = F.expr(f"transform({depths}, k -> struct(k AS depth, array_join(slice(split(path, '/'), 1, k), '/') AS prefix))")
    inside = running.select("host", "chars", F.explode(prefixes).alias("p")).groupBy("host", "p.depth", "p.prefix").agg(F.sum("chars").alias("chars"))
    whole = running.groupBy("host").agg(F.sum("chars").alias("all"))
    holder = inside.join(whole, "host").where(F.col("chars") >= MOST * F.col("all")).groupBy("host").agg(F.max_by("prefix", "depth").alias("prefix"))
    in_holder = F.coalesce(F.startswith(F.concat("path", F.lit("/")), F.concat("prefix", F.lit("/"))), F.lit(False))
    return slots.join(holder, "host", "left").groupBy("host").agg(
        *[F.collect_list(F.when(x, F.col("slot"))).alias(n) for n, x in (("article", F.col("path").rlike(r"/[^/.]*\*")), ("main", F.col("path").rlike(r"/[^/.]*\+")), ("rest", in_holder))])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text: the article of each page, its blocks joined by one space.

    Where elements are named as an article (by tag, class, id or role), the text is what they hold, else what those named as main content hold; elsewhere it is what the innermost element holds that has MOST of the running text
    (mostly not linked) of its host's pages. Left out are elements named as menus, headers, footers, sidebars, notices, adverts, forms and comments, hidden ones, scripts and styles,
    and slots with the same text on all pages of a host with SAME different ones. Null or empty html gives '', as do pages without such text. Pages whose url is null or has no host
    count as one host's. Rows that repeat are read each for itself. Other columns are ignored; an empty table gives no rows."""
    known = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), text_of(html_col).alias("html"))
    read = stage(read_blocks(known), "page-blocks")
    kept = F.when(F.col("marked") == 2, F.col("article")).when(F.col("marked") == 1, F.col("main")).otherwise(F.col("rest"))
    joined = read.join(stage(roles(read), "page-roles"), "host", "left").withColumn("kept", F.coalesce(kept, F.array().cast("array<string>")))
    text = F.expr("array_join(transform(filter(blocks, b -> array_contains(kept, b.slot)), b -> b.text), ' ')")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


#: The pages given have one article element each and these references only; tests hold other pages against texts known by construction.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '<(/?(p|h1)|br)>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g') AS t FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'), '&quot;', '"'), '&lt;', '<'), chr(1), '&', 'g') AS t FROM t)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM d"""

QUERIES = {"op12_main_text": op12_main_text}
ORACLES = {"op12_main_text": ORACLE}
