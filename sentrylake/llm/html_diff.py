"""HTML extraction by differencing pages with nearby URLs.

Pages are ordered by host and URL path, pages of a host with equal lines once: copies take the site lines of the
first of them. Each is compared with the neighbours of its host, so with the nearest different pages, first with
that whose path has the longer common beginning. Text lines are aligned by longest common subsequence; lines shared
with the page compared belong to the site and are deleted. A neighbour that shares nearly all text that may be main
text, as far as the other neighbour does not share it too, is a near copy and says nothing about the site; the other
is taken then. Lines shared with any neighbour that half of the different pages of the host share are the site's in any
case, so a page between near copies, or whose text is nearly all menu, loses its menu as well.

Markup has its say too: lines inside elements marked as navigation, advert, form and so on always go. Paragraphs,
headings and list items of an article go if all neighbours that are no near copies share them and they are common
on the host: passages that several articles quote are text. If a page has text in an article or main element, text
outside it goes, unless what is left outside is longer than what is left inside.

Lines are compared by 64-bit hashes. Hosts may be of any size: pages are dealt by ranges of (host, path), and a
task holds a batch of them. How many pages share a line is counted by host and line; what half of the pages share
is no longer than two of them.

Defined cases: null and empty html has an empty text; a page without host (null or odd URL) and a lone page
of a host is not compared; repeated rows are copies of each other; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import os.path

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import stage
from .html_lines import BOILERPLATE, OPEN, PROSE, lines
from .neighbours import with_neighbours

COPY = 0.9  # share of the text that may be main text from which a neighbour is a copy
COMMON, LEAST_PAGES = 0.5, 3  # share of a host's different pages that makes a shared line the site's; least pages


def common_lines(left: list, right: list) -> list[int]:
    """Places on the left of a longest common subsequence of lines.

    Bit-parallel (Hyyrö 2004): one whole number per line on the left, with a bit per line on the right; a
    zero bit says that the best length grows there. The numbers are kept and walked back.
    """
    places: dict = {}
    for at, line in enumerate(right):
        places[line] = places.get(line, 0) | 1 << at
    full = (1 << len(right)) - 1
    row, rows = full, []
    for line in left:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    shared, i, j = [], len(left), len(right)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # the same length without the right line
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # the same length without the left line
            i -= 1
        else:
            i, j = i - 1, j - 1
            shared.append(i)
    return shared[::-1]


def candidates(sizes: list[int], kinds: str) -> list[int]:
    """Lines that may be main text and tell copies: those of an article if it is the longer part, else all but boilerplate."""
    article = [i for i, kind in enumerate(kinds) if kind not in (OPEN, BOILERPLATE)]
    outside = sum(sizes[i] for i, kind in enumerate(kinds) if kind == OPEN)
    if sum(sizes[i] for i in article) > outside:
        return article
    return [i for i, kind in enumerate(kinds) if kind != BOILERPLATE]


def site_lines(own: list, sizes: list[int], kinds: str, neighbours: list[list]) -> list[tuple[int, bool | None]]:
    """Lines shared with any neighbour: True if they belong to the site, False if they do where common on the host, else None."""
    may_be = candidates(sizes, kinds)
    shared = [set(common_lines(own, other)) for other in neighbours]

    def nearly_all(found: set[int], of: list[int]) -> bool:
        return sum(sizes[i] for i in of if i in found) > COPY * sum(sizes[i] for i in of)

    alike = [nearly_all(found, may_be) for found in shared]
    different = []
    for at, found in enumerate(shared):
        others = set().union(*(o for i, o in enumerate(shared) if i != at and not alike[i]))
        if not nearly_all(found, [i for i in may_be if i not in others]):
            different.append(found)
    site = different[0] if different else set()
    in_all = set.intersection(*different) if different else set()
    return [
        (i, (False if i in in_all else None) if kinds[i] == PROSE else i in site) for i in sorted(set().union(*shared))
    ]


def main_text(own: list[str], kinds: str, site: list[int]) -> str:
    """The lines that stay, joined: of the article, and those outside it if they are longer."""
    gone = set(site)
    left = [i for i, kind in enumerate(kinds) if kind != BOILERPLATE and i not in gone]
    outside = sum(len(own[i]) for i in left if kinds[i] == OPEN)
    if outside <= sum(len(own[i]) for i in left if kinds[i] != OPEN):
        left = [i for i in left if kinds[i] != OPEN]
    return "\n".join(own[i] for i in left)


def host_and_path(url: Column) -> list[Column]:
    """Host and path with query; empty where there is none."""
    address = F.coalesce(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "//"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return [host.alias("host"), F.regexp_extract(address, r"^(?://[^/?#]*)?(.*)$", 1).alias("path")]


@F.arrow_udf(StructType([
    StructField("hashes", ArrayType(LongType())), StructField("sizes", ArrayType(IntegerType())), StructField("kinds", StringType()),
]))
def line_hashes(pages: pa.Array) -> pa.Array:
    """Hash, size and kind of each line."""
    hashes, sizes, kinds = [], [], []
    for page in pages:
        found, kind = lines(page.as_py() or "")
        hashes.append([xxhash.xxh64_intdigest(line) >> 1 for line in found])
        sizes.append([len(line) for line in found])
        kinds.append(kind)
    return pa.StructArray.from_arrays(
        [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(kinds, pa.string())],
        ["hashes", "sizes", "kinds"],
    )


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("n_lines", IntegerType())]))
def text_without(pages: pa.Array, site: pa.Array) -> pa.Array:
    """The main text of each page without the lines of its site, and the number of all lines."""
    texts, numbers = [], []
    for page, gone in zip(pages, site):
        found, kinds = lines(page.as_py() or "")
        texts.append(main_text(found, kinds, gone.as_py() or []))
        numbers.append(len(found))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(numbers, pa.int32())], ["text", "n_lines"])


SHARED = "array<struct<at:int,line:bigint,sure:boolean>>"
_SHARED = pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64()), ("sure", pa.bool_())]))


def _differenced(rows: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
    first, last = max(0, start - 1), min(rows.num_rows, stop + 1)
    near = rows.slice(first, last - first)
    hosts, paths, hashes, sizes, kinds = (near.column(c).to_pylist() for c in ("host", "path", "hashes", "sizes", "kinds"))
    found = []
    for at in range(start - first, stop - first):
        beside = [i for i in (at - 1, at + 1) if 0 <= i < len(hosts) and hosts[i] and hosts[i] == hosts[at]]
        beside.sort(key=lambda i: -len(os.path.commonprefix([paths[i], paths[at]])))
        shared = site_lines(hashes[at], sizes[at], kinds[at], [hashes[i] for i in beside])
        found.append([{"at": i, "line": hashes[at][i], "sure": sure} for i, sure in shared])
    own = rows.slice(start, stop - start)
    names = ["_content", "_check", "host"]
    return pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(found, _SHARED)], [*names, "shared"])


@F.arrow_udf(ArrayType(IntegerType()))
def settled(shared: pa.Array, common: pa.Array) -> pa.Array:
    """The shared lines that belong to the site: those of the page compared and those common on the host."""
    site = []
    for found, lines_of_host in zip(shared, common):
        often = set(lines_of_host.as_py() or ())
        site.append([s["at"] for s in found.as_py() or () if s["sure"] or (s["sure"] is False and s["line"] in often)])
    return pa.array(site, pa.list_(pa.int32()))


def common_of_hosts(shared: DataFrame) -> DataFrame:
    """host, common: the lines that enough of the host's different pages share with a neighbour."""
    held = shared.select("host", F.explode(F.array_distinct("shared.line")).alias("line"))
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    # both small tables are written so that the joins on host are plain ones, which AQE splits at a host of any size
    pages = stage(shared.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host-pages")
    often = counts.join(pages.hint("merge"), "host").where(F.col("n") >= F.col("pages") * COMMON)
    return stage(often.groupBy("host").agg(F.collect_list("line").alias("common")), "host-lines")


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Only hashes of lines go through the order, once for all pages of a host with equal lines; the pages
    themselves move once, to where their site lines are. Rows equal in id, URL and html are one page.
    """
    key = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    slim = pages.select(
        F.col("page_id").cast("bigint").alias("_page"), key.alias("_key"), *host_and_path(F.col("url")), line_hashes("html").alias("_l")
    )
    content = [F.col("host"), F.col("_l.hashes"), F.col("_l.kinds")]
    rows = stage(slim.select(
        "_page", "_key", F.xxhash64(*content).alias("_content"), F.hash(*content).alias("_check"), "host", "path", "_l.*"
    ), "page-lines")
    # the first page of those with equal lines
    parts = ["path", "_page", "_key", "hashes", "sizes", "kinds"]
    different = rows.groupBy("_content", "_check", "host").agg(F.min(F.struct(*parts)).alias("_f")).select(
        "_content", "_check", "host", "_f.*"
    )
    order = [F.col("host"), F.col("path"), F.col("_page"), F.col("_key")]
    shared = stage(
        with_neighbours(different, order, _differenced, f"_content bigint, _check int, host string, shared {SHARED}", name="pages"), "shared"
    )
    # shuffled joins at every size: hosts, copies and site lines grow with the pages
    site = shared.join(common_of_hosts(shared).hint("merge"), "host", "left").select(
        "_content", "_check", settled("shared", "common").alias("site")
    )
    of_rows = rows.select("_page", "_key", "_content", "_check").distinct()
    site = stage(of_rows.join(site.hint("merge"), ["_content", "_check"]).select("_page", "_key", "site"), "site")
    same = F.col("page_id").cast("bigint").eqNullSafe(F.col("_page")) & (key == F.col("_key"))
    joined = pages.select("page_id", "url", "html").join(site.hint("merge"), same, "left")
    text = joined.select("page_id", "url", text_without("html", "site").alias("_t"), F.size("site").alias("n_shared"))
    return text.select(
        "page_id", "url", F.col("_t.text").alias("text"), F.length("_t.text").cast("long").alias("n_chars"),
        F.col("_t.n_lines").cast("long").alias("n_lines"), F.col("n_shared").cast("long").alias("n_shared"),
    )
