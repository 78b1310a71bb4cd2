"""Main text of web pages, from their markup and from the difference to the page with the nearest URL.

A page is read into lines of text, each in a zone: boilerplate by its markup, inside an article, or
open. Pages of a host stand next to each other by path; the lines of a page and of its nearest
neighbour are aligned by a longest common subsequence, and lines that both have are furniture of the
site, unless both have them inside their articles.
"""

from __future__ import annotations

import html as entities
import os
import re
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundtally.llm.common import map_rows, written

FURNITURE, OPEN, ARTICLE = 0, 1, 2

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|select|button|title"
_DROPPED = frozenset("nav footer aside form menu dialog fieldset".split())
_CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|pop-?up|modal|newsletter|subscribe|signup|side-?bar|menu|nav|navbar|navigation"
    r"|breadcrumbs?|footer|masthead|comments?|comment-list|disqus|replies|respond|related|recommend\w*|share|sharing|social|widget|toolbar|pagination|pager|copyright|legal|search"
    r"|contentinfo|complementary|dialog)(?:$|[\s_-])", re.I)
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|top-?bar)(?:$|[\s_-])", re.I)


def read_lines(page: str | None) -> list[tuple[str, int]]:
    """(line, zone) of every block of text, references decoded and white space made single blanks.

    Open elements lie on a stack with their zone. An end tag closes what is open inside its element; without
    an open element it is passed over. Paragraphs, list items and cells end where the next begins.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    held: list[str] = []

    def close_line() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append((text, stack[-1][1]))

    for token in _TOKEN.finditer(page or ""):
        text, name = token["text"], token["name"]
        if text is not None:
            held.append(text)
        elif name is None:
            if token["raw"]:
                held.append(" ")
        else:
            name = name.lower()
            if name == "br":
                held.append(" ")
                continue
            if name not in _INLINE:
                close_line()
            if name in _VOID:
                continue
            if token["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        if name in _INLINE and stack[i][1] != stack[i - 1][1]:
                            close_line()
                        del stack[i:]
                        break
                continue
            if name not in _INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or stack[i][0] == name and name in _CLOSES_ITSELF:
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE and stack[i][0] not in _CLOSES_ITSELF:
                        break
            zone = stack[-1][1]
            if zone != FURNITURE:
                given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(token["attributes"])}
                labels = " ".join((given.get("class", ""), given.get("id", ""), given.get("role", "")))
                is_main = name in ("article", "main") or given.get("role", "").lower() == "main" or given.get("itemprop", "").lower() == "articlebody"
                if name in _DROPPED or name not in ("html", "body") and _FURNITURE_NAMES.search(labels):
                    zone = FURNITURE
                elif zone == OPEN and (name in ("header", "head") or name not in ("html", "body") and _HEADER_NAMES.search(labels)):
                    zone = FURNITURE
                elif is_main:
                    zone = ARTICLE
                if zone != stack[-1][1]:
                    close_line()
            stack.append((name, zone))
    close_line()
    return lines


def _lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, by words of bits."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
    out, total = [0], 0
    for bit in reversed(f"{row:0{len(b)}b}") if b else ():
        total += bit == "0"
        out.append(total)
    return out


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of one longest common subsequence, found by halving, in memory linear in the lines."""
    out: list[tuple[int, int]] = []

    def walk(a0: int, a1: int, b0: int, b1: int) -> None:
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        tail = 0
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, tail = a1 - 1, b1 - 1, tail + 1
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0)))
        elif a0 < a1 and b0 < b1:
            middle, part = (a0 + a1) // 2, b[b0:b1]
            ahead, back = _lengths(a[a0:middle], part), _lengths(a[middle:a1][::-1], part[::-1])
            cut = max(range(len(part) + 1), key=lambda j: ahead[j] + back[len(part) - j])
            walk(a0, middle, b0, b0 + cut)
            walk(middle, a1, b0 + cut, b1)
        out.extend((a1 + k, b1 + k) for k in range(tail))

    walk(0, len(a), 0, len(b))
    return out


def shared_lines(marks: list[int], zones: list[int], other_marks: list[int], other_zones: list[int]) -> list[int]:
    """Places of lines that the neighbour has too, given the marks (hashes) and zones of both pages' lines.

    A line that both have inside an article is not furniture. If the neighbour shares all of a page's open lines,
    and there is no article, it is a copy and tells nothing.
    """
    both = set(marks) & set(other_marks)
    mine, others = [i for i, m in enumerate(marks) if m in both], [j for j, m in enumerate(other_marks) if m in both]
    aligned = common_subsequence([marks[i] for i in mine], [other_marks[j] for j in others])
    wanted = ARTICLE if ARTICLE in zones else OPEN
    gone = [mine[i] for i, j in aligned if zones[mine[i]] == wanted and not (wanted == ARTICLE and other_zones[others[j]] == ARTICLE)]
    return [] if len(gone) == zones.count(wanted) else gone


def main_lines(lines: list[tuple[str, int]], gone: list[int]) -> list[str]:
    """With an article only its lines can stay, otherwise open lines; shared ones go."""
    wanted = ARTICLE if any(zone == ARTICLE for _, zone in lines) else OPEN
    dropped = set(gone)
    return [text for i, (text, zone) in enumerate(lines) if zone == wanted and i not in dropped]


def nearest_pages(keys: DataFrame) -> DataFrame:
    """(row, other): for each (row, host, path) the row of the same host with the nearest path, null if it is alone.

    Pages are range-partitioned by host, path and row, so a host of any size spreads. A page's candidates
    are the ones just before and after it, across the partitions' borders too; the longer common start of the paths
    decides, then the one before.
    """
    order = ["host", "path", "row"]
    placed = written(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    here = F.struct(*order)
    with_next = placed.withColumn("before", F.lag(here).over(inside)).withColumn("after", F.lead(here).over(inside))
    borders = placed.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    across = Window.orderBy("part")  # one row for each partition
    borders = borders.select("part", F.lag("last").over(across).alias("last_before"), F.lead("first").over(across).alias("first_after"))
    rows = (with_next.join(borders, "part").withColumn("before", F.coalesce("before", "last_before")).withColumn("after", F.coalesce("after", "first_after"))
            .select("row", "host", "path", "before", "after"))

    def make():
        def batch(rows: dict) -> dict:
            out = []
            for host, path, before, after in zip(rows["host"], rows["path"], rows["before"], rows["after"]):
                near = [(len(os.path.commonprefix([path, x["path"]])), x["row"]) for x in (before, after) if x and x["host"] == host]
                out.append(max(near, key=lambda x: x[0])[1] if near else None)
            return {"row": rows["row"], "other": out}

        return batch

    return map_rows(rows, "row long, other long", make)


def shared_places(rows: DataFrame) -> DataFrame:
    """(id, page, gone) of the pages that share lines with their neighbour; ``page`` is a digest of the row."""
    def read():
        def batch(rows: dict) -> dict:
            lines = [read_lines(h) for h in rows["html"]]
            marks = [[int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for t, _ in r] for r in lines]
            return {"id": rows["id"], "page": rows["page"], "url": rows["url"], "marks": marks, "zones": [bytes(z for _, z in r) for r in lines]}

        return batch

    found = written(map_rows(rows, "id long, page long, url string, marks array<long>, zones binary", read).withColumn("row", F.monotonically_increasing_id()))
    plain = F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", "")
    keys = found.select("row", F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)).alias("host"),
                        F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "").alias("path"))
    other = found.select(F.col("row").alias("other"), F.col("marks").alias("other_marks"), F.col("zones").alias("other_zones"))
    pairs = nearest_pages(keys).filter("other is not null").join(other, "other").join(found, "row").select("id", "page", "marks", "zones", "other_marks", "other_zones")

    def align():
        def batch(rows: dict) -> dict:
            gone = [shared_lines(m, list(z), om, list(oz)) for m, z, om, oz in zip(rows["marks"], rows["zones"], rows["other_marks"], rows["other_zones"])]
            return {"id": rows["id"], "page": rows["page"], "gone": gone}

        return batch

    return map_rows(pairs, "id long, page long, gone array<int>", align).filter(F.size("gone") > 0)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_lines) of every page: its main text, one line for each block, empty if there is none.

    Pages are compared by marks of their lines, so no text moves; those that lose lines are written, and Spark
    broadcasts them to the pages only if their size is under its threshold. Null markup is empty. A null
    or relative URL has an empty host, and such pages are compared with each other. Repeated rows are
    copies of each other and come out alike. An empty table gives no rows.
    """
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).withColumn("page", F.xxhash64("id", "url", "html"))
    losing = written(shared_places(rows).groupBy("id", "page").agg(F.min("gone").alias("gone")))
    lost = losing.select(F.col("id").alias("lost_id"), F.col("page").alias("lost_page"), "gone")
    both = rows.join(lost, (rows.page == lost.lost_page) & rows.id.eqNullSafe(lost.lost_id), "left").select("id", "url", "html", "gone")

    def decide():
        def batch(rows: dict) -> dict:
            out = [main_lines(read_lines(h), g or []) for h, g in zip(rows["html"], rows["gone"])]
            return {"id": rows["id"], "url": rows["url"], "text": ["\n".join(x) for x in out], "n_lines": [len(x) for x in out]}

        return batch

    return map_rows(both, "id long, url string, text string, n_lines long", decide)
