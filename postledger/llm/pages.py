"""Main text of web pages: marked articles, and blocks that a host-wide suffix order does not show as boilerplate."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import cut_and_count
from .common import among, cut_lineage, map_rows, type_of, without

#: Repeated substrings of at least so many words count; shorter blocks count as a whole.
RUN = 5
#: A substring is boilerplate on so large a share of the host's distinct pages, on LEAST of them at least; MOST are always enough.
SHARE = 0.3
LEAST = 3
MOST = 50
#: Fingerprints that a task holds before it packs them, places that it holds before it returns them,
#: and bits of the filter over fingerprints found often; its size does not depend on the pages.
HELD = 3 << 20
GROUPED = 1 << 17
FILTER_BITS = 1 << 24
#: Classes of hosts for which the driver knows how many pages make a substring boilerplate.
CLASSES = 1 << 14

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot
th thead title tr ul""".split())
_MAIN = frozenset(("article", "main"))
_SIDE = frozenset("""aside audio button canvas datalist dialog fieldset footer form head header iframe menu nav noscript object script
search select style svg template textarea title video""".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold an article's own text; other text in it, as in a bare div, may be a notice.
_TEXT = _HEADING | frozenset("p li dt dd td th blockquote pre figcaption caption summary".split())
#: Words of class, id and role that name a part beside the article.
_SIDE_NAMES = frozenset("""ad ads adsense advert advertisement adverts alert author-box banner breadcrumb breadcrumbs byline-links comment
comments complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation
newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies respond search share sharing
sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split())
#: Words that make a name tell about a neighbour or a layout ("has-sidebar"), not about the part itself.
_ABOUT = frozenset("has have with without no not layout is wrap wrapper container".split())
#: Elements that an open one of the listed names ends before.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
         "option": ("option",), "body": ("head",)}
_WALLS = frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "nav", "aside", "footer", "header", "form", "td", "th"))
_ENDS_P = _BLOCK - {"br", "html", "head", "body", "title", "option", "caption", "legend", "summary", "tbody", "thead", "tfoot", "tr", "td", "th"}
_NAME = re.compile(r"[a-z0-9]+")
_UNFINISHED = re.compile(r"<[a-zA-Z/!][^<>]*\Z")  # a tag that the page's end cuts off


def _beside(tag: str, attrs) -> str:
    """The name under which an element is a part beside the article, or an empty text."""
    if tag in _SIDE:
        return tag
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for part in value.lower().split():
                words = _NAME.findall(part)
                if tag in _MAIN or tag in ("html", "body"):  # these hold the article; only their plain names count
                    hit = part if tag == "article" and part in _SIDE_NAMES else ""
                elif part in _SIDE_NAMES:
                    hit = part
                else:
                    hit = "" if _ABOUT.intersection(words) else next((w for w in (*words[:1], *words[-1:]) if w in _SIDE_NAMES), "")
                if hit:
                    return hit
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return "hidden"
    return ""


class _Reader(HTMLParser):
    """Blocks of a page in order, each with its zone: main, loose (in the article, but in none of its
    paragraphs and the like), side (menus, forms, notices, ...), link (outside articles, all words in links) or open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[tuple[str, bool, str]] = []  # element, starts a main part, name as a part beside it
        self.main = self.side = self.heading = self.links = 0
        self.parts: list[str] = []
        self.plain = False  # whether the block has words outside links

    def zone(self) -> str:
        if self.side:
            # a heading in the header of an article belongs to the article
            inner = {beside for _, _, beside in self.stack if beside}
            return "main" if self.main and self.heading and inner == {"header"} else "side"
        if not self.main:
            return "open"
        names = [name for name, _, _ in self.stack]
        return "loose" if not _TEXT.intersection(names) and not names[-1:] == ["article"] and self.stack and not self.stack[-1][1] else "main"

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            zone = self.zone()
            if zone == "open" and not self.plain and not _TEXT.difference({"li", "dd", "dt", "td", "th"}).intersection(n for n, _, _ in self.stack):
                zone = "link"
            self.parts, self.plain = [], False
            if text:
                self.blocks.append((text, zone))

    def _pop(self) -> None:
        name, main, side = self.stack.pop()
        self.main -= main
        self.side -= bool(side)
        self.heading -= name in _HEADING
        self.links -= name == "a"

    def _close(self, name: str, walls: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of that name, unless an element of ``walls`` is in between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                if any(s[0] in _BLOCK for s in self.stack[k:]):
                    self.flush()
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in walls:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        if tag in _VOID:
            return
        for other in _ENDS.get(tag, ()):
            self._close(other, _WALLS - {other})
        if tag in _ENDS_P:
            self._close("p", _WALLS)
        main = tag in _MAIN or any(k == "role" and v in ("main", "article") for k, v in attrs)
        side = _beside(tag, attrs)
        self.stack.append((tag, main, side))
        self.main += main
        self.side += bool(side)
        self.heading += tag in _HEADING
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _VOID:
            if tag == "br":
                self.flush()
            return
        self._close(tag)

    def handle_data(self, data):
        if data:
            if self.stack and self.stack[-1][0] in ("script", "style"):
                return
            self.parts.append(data)
            self.plain |= not self.links and not data.isspace()

    def read(self, html: str) -> list[tuple[str, str]]:
        self.feed(_UNFINISHED.sub("", html))
        self.close()
        self.flush()
        return self.blocks


def blocks(html: str) -> list[tuple[str, str]]:
    """(text, zone) of each block of the page, in order."""
    return _Reader().read(html)


def host_of(url: str | None) -> str:
    match = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return match[1].lower() if match else ""


def stream_of(found: list[str], sizes: list[int], run: int) -> tuple[list[str], list[str]]:
    """The words of the page's stream, which is that of all its blocks in order, and its blocks of fewer than ``run`` words."""
    return " ".join(found).split(), [text for text, n in zip(found, sizes) if n < run]


def read_pages(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` as all its blocks, with their zones and numbers of words; ``page`` is a hash of the texts."""
    def rows_of(batches):
        import xxhash

        for numbers, ids, urls, bodies in batches:
            out = {k: [] for k in ("row", "page_id", "url", "host", "page", "blocks", "zones", "sizes")}
            for number, page, url, html in zip(numbers, ids, urls, bodies):
                found = blocks(html or "")
                texts = [t for t, _ in found]
                values = (number, page, url, host_of(url), int(np.uint64(xxhash.xxh64_intdigest("\x00".join(texts))).view(np.int64)),
                          texts, [z for _, z in found], [len(t.split()) for t in texts])
                for column, value in zip(out.values(), values):
                    column.append(value)
            yield out

    return map_rows(
        pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html"),
        [("row", "long"), ("page_id", type_of(pages, "page_id")), ("url", "string"), ("host", "string"), ("page", "long"),
         ("blocks", "array<string>"), ("zones", "array<string>"), ("sizes", "array<int>")], rows_of)


def suffixes(run: int) -> Column:
    """The suffixes of the page's stream, cut at ``run`` words, by their starts; then its shorter blocks, each as a whole.

    White space is in no word, so a line break sets whole blocks apart.
    """
    starts = F.when(F.size("words") >= run, F.sequence(F.lit(1), F.size("words") - run + 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("words", i, run), " "))
    return F.concat(cut, F.transform("short", lambda x: F.concat(F.lit("\n"), x)))


def suffix_order(read: DataFrame, run: int = RUN) -> DataFrame:
    """``(host, suffix, row)``: the suffixes of all streams of ``read``, or those it lists as ``suffix``, host by host in the order of their words.

    Range partitions hold the order, one after the other. The row is part of it, so that a suffix
    of very many pages lies in several partitions.
    """
    listed = F.col("suffix") if "suffix" in read.columns else F.explode(F.array_distinct(suffixes(run))).alias("suffix")
    return read.select("host", listed, "row").repartitionByRange("host", "suffix", "row").sortWithinPartitions("host", "suffix", "row")


def repeats(order: DataFrame) -> DataFrame:
    """``(host, suffix, n)``: beginnings that neighbours in the suffix order have in common, and on how many pages."""
    schema = pa.schema([("host", pa.string()), ("suffix", pa.string()), ("n", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, str, int] | None = None  # the open stretch of neighbours
        first = True  # whether it may have begun in the partition before
        for batch in batches:
            if not batch.num_rows:
                continue
            host, suffix = (batch.column(k).cast(pa.string()) for k in (0, 1))
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = ~pc.and_(pc.equal(host[1:], host[:-1]), pc.equal(suffix[1:], suffix[:-1])).to_numpy(zero_copy_only=False)
            if last is not None and (host[0].as_py(), suffix[0].as_py()) == last[:2]:
                new[0] = False
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(new)))
            ahead = int(starts[0]) if len(starts) else len(new)  # rows that continue the open stretch
            if last is not None:
                last = (*last[:2], last[2] + ahead)
            if not len(starts):
                continue
            if last is not None and (first or last[2] > 1):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], schema=schema)
            first = last is None and len(starts) == 1
            whole = sizes[:-1] > 1
            if last is None and len(starts) > 1:
                whole[0] = True
            at = pa.array(starts[:-1][whole])
            yield pa.RecordBatch.from_arrays([host.take(at), suffix.take(at), pa.array(sizes[:-1][whole])], schema=schema)
            end = int(starts[-1])
            last = (host[end].as_py(), suffix[end].as_py(), int(sizes[-1]))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], schema=schema)

    # a stretch at the end of a partition may go on in the next one
    return order.select("host", "suffix").mapInArrow(apply, "host string, suffix string, n long").groupBy("host", "suffix").agg(F.sum("n").alias("n")).filter("n > 1")


class _Codes(dict):
    """64-bit codes of texts, kept while they are few."""

    def __missing__(self, text: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[text] = xxhash.xxh64_intdigest(text)
        return h

    def of(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), dtype=np.uint64, count=len(texts))


def suffix_prints(host: str, words: list[str], short: list[str], run: int, codes: _Codes) -> np.ndarray:
    """64-bit fingerprints of a page's :func:`suffixes` on its host, in their order."""
    own, n = codes.of(words), max(len(words) - run + 1, 0)
    start, out = codes.of([host]), []
    for columns in ([own[k:k + n] for k in range(run)], [codes.of(["\n" + x for x in short])]):
        h = np.repeat(start, len(columns[0]))
        for c in columns:
            h ^= c
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out)


def _pack(held: dict[int, list[np.ndarray]], bits: int, parts: int) -> dict[str, list]:
    """Fingerprints of ``bits`` bits by need and range of values (of 2 ** ``parts``): sorted, each with its pages, as compressed differences."""
    out: dict[str, list] = {"need": [], "part": [], "n": [], "packed": []}
    begin = np.arange(1 << parts, dtype=np.uint64) << np.uint64(bits - parts)
    for need, arrays in held.items():
        keys, pages = np.unique(np.concatenate(arrays), return_counts=True)
        edges = [*np.searchsorted(keys, begin).tolist(), len(keys)]
        for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo < hi:
                steps = np.diff(keys[lo:hi], prepend=begin[part])
                planes = [x.view(np.uint8).reshape(hi - lo, -1).T.tobytes() for x in (steps, np.minimum(pages[lo:hi], need).astype(np.uint32))]
                for column, value in zip(out.values(), (need, part, hi - lo, pa.compress(b"".join(planes), codec="zstd", asbytes=True))):
                    column.append(value)
    return out


def often(read: DataFrame, least: dict[int, int], bits: int, run: int = RUN) -> DataFrame:
    """``print``: the fingerprints, cut to ``bits`` bits, of suffixes of ``read`` on as many pages as make boilerplate on their host.

    ``least`` has that number for a class of hosts, or a smaller one. Equal suffixes have equal fingerprints, so
    none that is boilerplate is missing. Fingerprints are sorted, counted and packed where pages are read and only then
    dealt by ranges of values, so few bytes each are moved, and a suffix of very many pages only once from each task.
    """
    parts = max(4, (2 * int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length() - 1)
    # halves and quarters of the largest number and so on, so that a task packs few different ones
    floor = {c: LEAST << int(np.log2(max(n / LEAST, 1))) for c, n in least.items()}

    def rows_of(batches):
        codes = _Codes()
        held: dict[int, list[np.ndarray]] = {}
        n = 0
        for batch in batches:
            for host, kind, texts, sizes in zip(*batch):
                own = np.unique(suffix_prints(host, *stream_of(texts, sizes, run), run, codes) >> np.uint64(64 - bits))
                held.setdefault(floor[kind], []).append(own)
                n += len(own)
                if n >= HELD:
                    yield _pack(held, bits, parts)
                    held, n = {}, 0
        yield _pack(held, bits, parts)

    def counted(group: pa.Table) -> pa.Table:
        keys, pages = [], []
        for part, n, packed in zip(*(group.column(k).to_pylist() for k in ("part", "n", "packed"))):
            raw = np.frombuffer(pa.decompress(packed, 12 * n, codec="zstd", asbytes=True), dtype=np.uint8)
            steps, own = (np.ascontiguousarray(x.reshape(-1, n).T).view(t).ravel() for x, t in ((raw[:8 * n], np.uint64), (raw[8 * n:], np.uint32)))
            keys.append(np.cumsum(steps) + np.uint64(part << (bits - parts)))
            pages.append(own.astype(np.int64))
        keys, pages = np.concatenate(keys), np.concatenate(pages)
        order = np.argsort(keys, kind="stable")
        keys, pages = keys[order], pages[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        enough = np.add.reduceat(pages, starts) >= group.column("need")[0].as_py()
        return pa.table({"print": pa.array(keys[starts[enough]].astype(np.int64))})

    packed = map_rows(read.select("host", _class().alias("class"), "blocks", "sizes"), [("need", "int"), ("part", "int"), ("n", "int"), ("packed", "binary")], rows_of)
    return packed.groupBy("need", "part").applyInArrow(counted, "print long")


def _class() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(CLASSES)).cast("int")


def _filter(prints: DataFrame) -> np.ndarray:
    """A bit per fingerprint; gathered as at most ``FILTER_BITS / 64`` numbers."""
    bit = prints.select(F.col("print").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b"))
    rows = bit.groupBy(F.shiftright("b", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("set")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint64)


def common_suffixes(read: DataFrame, prints: DataFrame, bits: int, run: int = RUN) -> DataFrame:
    """The suffixes of ``read`` whose fingerprints are among ``prints``, and a few more: ``(host, suffix, rows, at, outside)``.

    ``rows`` and ``at`` are where they begin, of many pages in a row of the result; all places of a page are in one.
    ``outside`` counts those of its pages on which a place is not wholly in a marked article.
    """
    table = read.sparkSession.sparkContext.broadcast(_filter(prints))

    def grouped(places: dict[tuple[str, str], list]) -> dict[str, list]:
        return {"host": [h for h, _ in places], "suffix": [x for _, x in places], "rows": [v[0] for v in places.values()],
                "at": [v[1] for v in places.values()], "outside": [v[2] for v in places.values()]}

    def rows_of(batches):
        codes = _Codes()
        places: dict[tuple[str, str], list] = {}  # rows, places, pages outside articles and the last of them
        n = 0
        for batch in batches:
            for row, host, texts, zones, sizes in zip(*batch):
                words, short = stream_of(texts, sizes, run)
                own = suffix_prints(host, words, short, run, codes) >> np.uint64(64 - bits) & np.uint64(FILTER_BITS - 1)
                marked = table.value[(own >> np.uint64(6)).astype(np.int64)] >> (own & np.uint64(63)) & np.uint64(1)
                hits = np.flatnonzero(marked).tolist()
                if not hits:
                    continue
                grams = max(len(words) - run + 1, 0)
                article = [z == "main" for z in zones]
                inner = np.append(0, np.cumsum(np.repeat(article, sizes)))
                inside = np.append(inner[run:] - inner[:-run] == run if grams else [], [x for x, size in zip(article, sizes) if size < run]).astype(bool)
                for i in hits:
                    own = places.setdefault((host, " ".join(words[i:i + run]) if i < grams else "\n" + short[i - grams]), [[], [], 0, None])
                    own[0].append(row)
                    own[1].append(i)
                    if not inside[i] and own[3] != row:
                        own[2:] = own[2] + 1, row
                    n += 1
                if n >= GROUPED:
                    yield grouped(places)
                    places, n = {}, 0
        yield grouped(places)

    return map_rows(read.select("row", "host", "blocks", "zones", "sizes"),
                    [("host", "string"), ("suffix", "string"), ("rows", "array<long>"), ("at", "array<int>"), ("outside", "long")], rows_of)


def covered_blocks(sizes: list[int], zones: list[str], starts: list[int], run: int = RUN) -> list[int]:
    """Blocks which repeated substrings cover whole, on a page with repeated :func:`suffixes` at ``starts``.

    Blocks of a marked article stay whatever covers them, those beside it are never text, so neither is listed.
    """
    total = sum(sizes)
    grams = max(total - run + 1, 0)
    edge = np.zeros(total + 1, dtype=np.int64)
    inner = np.array(starts, dtype=np.int64)
    inner = np.unique(inner[inner < grams])
    edge[inner] += 1
    edge[inner + run] -= 1
    bare = np.append(0, np.cumsum(np.cumsum(edge[:total]) == 0))  # words that none covers, before each place
    short = [k for k, n in enumerate(sizes) if n < run]
    repeated = {short[s - grams] for s in starts if s >= grams}
    at, out = 0, []
    for k, n in enumerate(sizes):
        if zones[k] not in ("main", "side") and (k in repeated or bare[at] == bare[at + n]):
            out.append(k)
        at += n
    return out


def unique_text(found: list[str], zones: list[str], gone: list[int]) -> str:
    """Text of a page without the blocks ``gone``; all others stay whole: no word is cut out of a block.

    With a marked article its blocks stay, and those loose in it
    that are left; without one the open blocks that are left, or else those of links.
    """
    left = sorted({*range(len(found))}.difference(gone))
    for wanted in (("main", "loose"), ("open",), ("link",)):
        lines = [found[k] for k in left if zones[k] in wanted]
        if lines or wanted[0] in zones or "loose" in zones:
            break
    return "\n".join(lines)


def main_text(pages: DataFrame, run: int = RUN, share: float = SHARE) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html).

    Blocks in the paragraphs, headings, lists and tables of a page's article
    (article or main) are its text, unless an inner menu, form, notice, comment
    list or the like encloses them. On all else repetition decides: the suffixes of the word
    streams of a host's pages, articles included, are sorted, and neighbours with a common
    beginning of ``run`` words show a repeated substring. They are cut there, as
    a longer repeat consists of the beginnings of its suffixes: the
    longest repeats are the stretches that these cover without a gap. A beginning counts as boilerplate if it is on ``share`` of
    the host's distinct pages (LEAST at least; MOST are enough on any host), and not on half of them or more only in marked
    articles, as it belongs to the texts then. Blocks
    that boilerplate covers whole go; of a block that it covers in part nothing is cut. Pages of equal
    texts count as one page, so copies of a page do not erase it, and
    texts that stand on a few pages of a host stay on them. No host and no suffix is gathered in one task.

    Before the sort all suffixes are counted by fingerprints, and those on too few pages to be
    boilerplate are left out of it; the order of the others compares their words.

    Null html is empty and gives the empty text, a url without a host belongs
    to the host of that name (empty), repeated rows are read each, other
    columns are ignored, an empty table gives no rows.
    """
    read, counts = cut_and_count(read_pages(pages), "zstd", words=F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, n: x + n)))
    distinct = cut_lineage(read.groupBy("host", "page").agg(F.min("row").alias("first")))
    needed = distinct.groupBy("host").agg(F.least(F.greatest(F.ceil(F.count("*") * share), F.lit(LEAST)), F.lit(MOST)).cast("int").alias("need"))
    least = {r["class"]: r["need"] for r in needed.groupBy(_class().alias("class")).agg(F.min("need").alias("need")).collect()}
    copies = cut_lineage(read.select("row", "host", "page").join(distinct, ["host", "page"]).filter("row > first").select("row", "first"))
    once = without(read, copies, "row")
    # a few bits more than tell all suffixes apart
    bits = min(max(counts["words"].bit_length() + 4, 24), 62)
    found = cut_lineage(common_suffixes(once, often(once, least, bits, run), bits, run), "zstd")
    common = repeats(suffix_order(found.select("host", "suffix", F.explode(F.array_distinct("rows")).alias("row")), run)).filter(F.col("n") >= LEAST)
    repeated = salted_join(common, needed, ["host"], "inner", F.xxhash64("suffix")).filter("n >= need")
    outside = found.groupBy("host", "suffix").agg(F.sum("outside").alias("outside"))
    repeated = repeated.join(outside, ["host", "suffix"]).filter("2 * outside > n").select("host", "suffix")
    places = found.join(repeated, ["host", "suffix"]).select(F.explode(F.arrays_zip("rows", "at")).alias("x"))
    covered = cut_lineage(places.groupBy(F.col("x.rows").alias("first")).agg(F.collect_list("x.at").alias("at")), "zstd")
    starts = covered.withColumnRenamed("first", "row").unionByName(copies.join(covered, "first").select("row", "at"))

    def decide(batches):
        for rows, sizes, zones, starts in batches:
            yield {"row": rows, "gone": [covered_blocks(n, z, s, run) for n, z, s in zip(sizes, zones, starts)]}

    def keep(batches):
        for ids, urls, found, zones, gone in batches:
            yield {"page_id": ids, "url": urls, "text": [unique_text(f, z, g) for f, z, g in zip(found, zones, gone)]}

    layouts = read.select("row", "sizes", "zones").join(starts, "row")
    gone = cut_lineage(map_rows(layouts.select("row", "sizes", "zones", "at"), [("row", "long"), ("gone", "array<int>")], decide).filter("size(gone) > 0"))
    whole = without(read, gone, "row").withColumn("gone", F.array().cast("array<int>"))
    decided = whole.unionByName(among(read, gone, "row").join(gone, "row"))
    return map_rows(decided.select("page_id", "url", "blocks", "zones", "gone"),
                    [("page_id", type_of(pages, "page_id")), ("url", "string"), ("text", "string")], keep)


#: The same for pages whose article holds only h1, p, b and br, as all pages of the given tables do.
SIMPLE_PAGES_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?b>', '', 'g') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1|br)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""
