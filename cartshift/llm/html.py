"""Main text of web pages: what a host repeats goes, what is a page's own stays.

A page is read into blocks of text. The blocks outside article and main elements form the page's token stream,
a line of menus, headers, notices, adverts, footers and, on pages without such elements, the text itself. The
streams of a host's distinct pages are laid end to end, with the page's end as a token that equals nothing, and
their suffixes are sorted by host and first ``depth`` tokens: a suffix array cut at that depth, dealt over the
cluster by ranges. Neighbours in it with an equal beginning are a substring that repeats; where they come from
enough distinct pages, every token that it covers is boilerplate, and repeats at neighbouring places of a page
join to the full repeat. A block shorter than ``depth`` is sorted as a whole, up to its end, among the suffixes.
Tokens that stay uncovered are the page's own.

Markup is an exact check on top, for what no repetition shows: an article or main element's own blocks are kept
even where copies of a page repeat them, and elements that name themselves menus, forms, adverts, comments and so
on are dropped even where they stand once. The blocks in between, unmarked and outside of articles, are the ones
that the suffix array decides on, whatever the number of a host's pages: what does not repeat is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from itertools import groupby

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

# Elements of HTML by what they mean for text.
UNSEEN = frozenset("script style template noscript title textarea iframe object svg math canvas audio video select datalist".split())
FURNITURE = frozenset("head nav aside footer form menu dialog button".split())
BREAKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table"
    " caption tbody thead tfoot tr ul option dialog".split()
)
GAPS = frozenset("br td th wbr img input".split())
HOLDERS = BREAKS - frozenset("p li dd dt hr h1 h2 h3 h4 h5 h6 tr option html body".split())
# Words by which elements name themselves in class, id or role.
LAYOUT = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer sidebar side rail"
    " toolbar pagination pager search login copyright legal banner contentinfo complementary widget widgets".split()
)
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social form".split()
)
# Whole names (class or id) of lists of reader comments or of other pages, and of what is one of them.
COMMENTS = frozenset(
    "comment comments commentlist comment-list comment_list comments-list commentslist comment-body comments-area"
    " comment-area comments-section comment-section comments-container comment-thread comments-wrapper reply replies"
    " reply-list respond comment-respond comment-form commentform disqus disqus_thread"
    " related related-posts related-articles related-content related-links related-stories related-pages"
    " recommended recommended-posts recommended-articles recommendations".split()
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[A-Za-z][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")
# Words that say nothing of what an element is, beside those of LAYOUT and ASIDES in a name.
PLAIN = frozenset(
    "area bar block blocks body bottom box button buttons bottom col column container content group holder icon icons"
    " inner item items left link links list main module outer page panel post primary right row secondary section site"
    " slot stack sticky strip sub super text top unit with wrap wrapper global article entry no has is js fixed mobile"
    " desktop".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("br wbr img input hr meta link col area base embed source track param".split())
# Open elements that a new one ends, and the elements around these that it does not look beyond.
CELLS, ROWS = frozenset({"td", "th"}), frozenset({"tr", "td", "th"})
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (CELLS, frozenset({"tr", "table"})),
    "th": (CELLS, frozenset({"tr", "table"})),
    "tr": (ROWS, frozenset({"table", "thead", "tbody", "tfoot"})),
    **{name: (ROWS | {"thead", "tbody", "tfoot"}, frozenset({"table"})) for name in ("thead", "tbody", "tfoot")},
}
PARAGRAPH = frozenset({"p"})


@dataclass(frozen=True)
class Boilerplate:
    """A run is boilerplate if it has ``depth`` tokens or more, or is a whole block, and repeats on ``pages`` pages of
    its host, or on both pages of a host with two. Pages that are equal but for marked furniture are copies and
    count as one."""

    depth: int = 8
    pages: int = 3


def attributes(rest: str) -> dict[str, str]:
    """An element's attributes by name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(values))
    return found


def name_words(given: dict[str, str]) -> tuple[set[str], set[str], bool]:
    """What the names of an element (class, id, role) say that it is, as words of LAYOUT and ASIDES; its whole
    names; whether it says that it is the main text. A name counts if all its words are such or PLAIN ones."""
    words, names = set(), set()
    main = any(given.get(k, "").lower() in ("articlebody", "main", "article") for k in ("itemprop", "role"))
    for kind in ("class", "id", "role"):
        for name in given.get(kind, "").split():
            names.add(name.lower())
            parts = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
            known = parts & (LAYOUT | ASIDES)
            if all(p in known or p in PLAIN or len(p) == 1 for p in parts):
                words |= known
    return words, names, main


def hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(UNSHOWN.search(given.get("style", "")))


class Opened:
    """The open elements: name, region (2 in an article, 1 in a main element, 0), reason to skip ("" if none)."""

    def __init__(self):
        self.stack: list[tuple[str, int, str]] = [("", 0, "")]
        self.count: dict[str, int] = {}

    @property
    def top(self) -> tuple[str, int, str]:
        return self.stack[-1]

    def push(self, name: str, region: int, skip: str) -> None:
        self.stack.append((name, region, skip))
        self.count[name] = self.count.get(name, 0) + 1

    def cut(self, at: int) -> None:
        for name, _, _ in self.stack[at:]:
            self.count[name] -= 1
        del self.stack[at:]

    def find(self, names: frozenset[str], barrier: frozenset[str]) -> int:
        """The place of the innermost open element of ``names``, 0 if ``barrier`` comes first."""
        if not any(self.count.get(n) for n in names):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name in names:
                return i
            if name in barrier:
                return 0
        return 0

    def after(self, name: str) -> int:
        """From where elements end when ``name`` begins: a paragraph before a block, an item before the next; 0 for none."""
        places = [self.find(PARAGRAPH, HOLDERS)] if name in BREAKS else []
        if name in IMPLIED:
            places.append(self.find(*IMPLIED[name]))
        return min((p for p in places if p), default=0)

    def end(self, name: str) -> int:
        """The place of the element that an end tag closes, 0 if there is none in reach."""
        return self.find(frozenset({name}), IMPLIED[name][1] if name in IMPLIED else frozenset())


def blocks_of(html: str) -> list[tuple[str, int, bool]]:
    """A page's blocks in order: text, whether it stands in an article (2) or main element (1), whether in marked
    furniture. The page's first article or main element is no reader comment, whatever its names are.

    Character references are decoded and white space inside a block is one space. End tags that may be left out are
    implied, as by the next paragraph, item or cell; other unclosed elements end where an element around them ends; a
    page cut off anywhere is read as far as it goes.
    """
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    opened = Opened()
    at = 0
    begun = False  # whether an article or main element has been opened

    def close_block():
        found = " ".join(unescape("".join(text)).split())
        if found:
            out.append((found, opened.top[1], bool(opened.top[2])))
        text.clear()

    def cut(place: int):
        """End the elements from a place on; a block ends with them if what follows is another kind of text."""
        if opened.stack[place - 1][1:] != opened.top[1:]:
            close_block()
        opened.cut(place)

    while True:
        tag = TAG.search(html, at)
        text.append(html[at : tag.start()] if tag else html[at:])
        if tag is None:
            break
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            if name in BREAKS:
                close_block()
            elif name in GAPS:
                text.append(" ")
            place = opened.end(name)
            if place and (name in BREAKS or name in GAPS or not any(x[0] in BREAKS for x in opened.stack[place + 1 :])):
                cut(place)
            continue
        rest = tag["rest"] or ""
        if name in UNSEEN:
            if not rest.endswith("/") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                text.append(" ")
            continue
        if name in BREAKS:
            close_block()
        elif name in GAPS:
            text.append(" ")
        if name in ("html", "body") or name in VOID:
            continue
        place = opened.after(name)
        if place:
            cut(place)
        _, inside, skip = opened.top
        given = attributes(rest) if rest else {}
        words, names, main = name_words(given) if given and name not in HEADINGS else (set(), set(), False)
        region = 2 if name == "article" or main else 1 if name == "main" else 0
        if names & COMMENTS and not main and (begun or not region):
            reason = "comment"
        elif name in FURNITURE or (words & ASIDES and region < 1):
            reason = "aside"
        elif hidden(given):
            reason = "aside"
        elif not inside and not region and (name == "header" or words & LAYOUT):
            reason = "layout"
        elif inside and not region and words & LAYOUT - {"header", "banner", "side", "legal", "search"}:
            reason = "layout"
        else:
            reason = ""
        begun |= region > 0 and skip != "comment"
        if region and skip in ("layout", "aside"):
            skip = ""  # a main text is not part of the layout around it
        skip = skip or reason
        if name not in BREAKS and name not in GAPS and skip != opened.top[2]:
            close_block()
        if not rest.endswith("/"):
            opened.push(name, max(inside, region), skip)
    close_block()
    return out


END = "\x1e"  # stands before a short block that is sorted as a whole
FREE, MARKED, KEPT = 0, 1, 2  # kinds of blocks: the suffix array decides; furniture; an article's own


def suffixes(blocks: list[str], depth: int) -> list[tuple[str, int, int]]:
    """The beginnings of a stream's suffixes with the places from and to which they reach: ``depth`` tokens from
    every place that has so many, and each block of fewer tokens as a whole."""
    tokens, short = [], []
    for block in blocks:
        words = block.split()
        if len(words) < depth:
            short.append((END + " ".join(words), len(tokens), len(tokens) + len(words)))
        tokens += words
    return [(" ".join(tokens[i : i + depth]), i, i + depth) for i in range(len(tokens) - depth + 1)] + short


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def page_parts(html: str | None) -> tuple[list[tuple[str, int]], str, int]:
    """A page's blocks with their kinds, its token stream (a line per block) and a digest that is equal for copies."""
    found = [(text, MARKED if skip else KEPT if level else FREE) for text, level, skip in blocks_of(html or "")]
    line = "\n".join(text for text, kind in found if kind != KEPT)
    unmarked = "\n".join(text for text, kind in found if kind != MARKED)
    return found, line, digest(unmarked or line)


def packed(found: list[tuple[str, int]]) -> bytes:
    """Blocks with their kinds; no block holds a line break."""
    return zstandard.compress("\n".join(f"{kind}{text}" for text, kind in found).encode("utf-8", "surrogatepass"), 1)


def unpacked(page: bytes) -> tuple[list[str], list[int]]:
    found = [b for b in zstandard.decompress(page).decode("utf-8", "surrogatepass").split("\n") if b]
    return [b[1:] for b in found], [int(b[0]) for b in found]


def parsed(pages: DataFrame, kinds: dict[str, str], columns) -> DataFrame:
    """Columns ``kinds`` (names and types) of all pages; ``columns`` makes them of a piece of ``page_id``, ``url``, host
    and the parts of its pages."""
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^/]*//(?:[^/@]*@)?([^/?#:]*)", 1)), F.lit(""))
    given = pages.select(
        F.col("page_id").alias("page_id"), F.col("url").alias("url"), host.alias("host"), F.col("html").alias("_html")
    )

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parts = [page_parts(html) for html in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(columns(batch, parts), list(kinds))

    return given.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def stream_of(batch: pa.RecordBatch, parts: list) -> pa.Array:
    return pa.array([digest(f"{host} {p[1]}") for host, p in zip(batch.column(2).to_pylist(), parts)], pa.int64())


def read_streams(pages: DataFrame) -> DataFrame:
    """Every page's token stream, ``line``: ``stream`` is equal for equal streams of a host, ``same`` for copies."""

    def columns(batch, parts):
        return [
            batch.column(2),
            pa.array([p[2] for p in parts], pa.int64()),
            stream_of(batch, parts),
            pa.array([p[1] for p in parts], pa.string()),
        ]

    return parsed(pages, {"host": "string", "same": "long", "stream": "long", "line": "string"}, columns)


def read_pages(pages: DataFrame) -> DataFrame:
    """Every page with its stream and all its blocks with their kinds (``page``)."""
    given = dict(pages.dtypes)

    def columns(batch, parts):
        page = pa.array([packed(p[0]) for p in parts], pa.binary())
        return [batch.column(0), batch.column(1), stream_of(batch, parts), page]

    kinds = {"page_id": given["page_id"], "url": given["url"], "stream": "long", "page": "binary"}
    return parsed(pages, kinds, columns)


def dealt(streams: DataFrame, rules: Boilerplate) -> DataFrame:
    """A row per distinct beginning of a suffix of each stream."""
    columns = ["host", "need", "same", "stream", "start"]

    def work(batches):
        for batch in batches:
            for host, need, same, stream, line in zip(*(batch.column(i).to_pylist() for i in range(5))):
                starts = list({start for start, _, _ in suffixes(line.split("\n"), rules.depth)} if line else ())
                if starts:
                    given = zip((host, need, same, stream), (pa.string(), pa.int64(), pa.int64(), pa.int64()))
                    alike = [pa.repeat(pa.scalar(v, kind), len(starts)) for v, kind in given]
                    yield pa.RecordBatch.from_arrays([*alike, pa.array(starts, pa.string())], columns)

    return streams.mapInArrow(work, "host string, need long, same long, stream long, start string")


def neighbours(batches):
    """Walks a range of the suffix array. Rows of ``stream`` and ``start`` (a digest) that repeat on ``need`` distinct
    pages, and with ``open_start`` the rows of the range's first and last run that other ranges may go on with.

    A run of equal beginnings is held until ``need`` pages are seen, then passed on row by row; of such a run
    at an edge of the range, one row per page up to ``need`` speaks for it."""
    names = ["host", "need", "same", "stream", "start", "open_start"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out: list[tuple] = []
    now, first, held, seen, last = None, True, [], [], None  # seen: one row per page, `need` at most

    def put(row, start_open):
        host, start, need, same, stream = row
        out.append((host, need, same, stream, digest(start), start if start_open else None))

    def finish(at_edge):
        for row in (held or seen) if at_edge else ():
            put(row, True)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in (0, 4, 1, 2, 3))):
            if row[:2] != now:
                if now is not None:
                    finish(first)
                    first = False
                now, held, seen, last = row[:2], [], [], None
            if row[3] != last and len(seen) < row[2]:
                seen.append(row)
            last = row[3]
            if len(seen) < row[2]:
                held.append(row)
                continue
            for r in held:
                put(r, False)
            held = []
            put(row, False)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
    if now is not None:
        finish(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def repeats(streams: DataFrame, rules: Boilerplate) -> DataFrame:
    """Per stream with repeats: ``covered``, the digests of the beginnings that repeat."""
    order = ["host", "start", "same", "stream"]
    array = dealt(streams, rules).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(
        array.mapInArrow(neighbours, "host string, need long, same long, stream long, start long, open_start string")
    )
    open_ = found.where("open_start is not null")
    # two runs per range at most
    across = (
        open_.select("host", "need", "open_start", "same")
        .distinct()
        .groupBy("host", "need", "open_start")
        .agg(F.count("*").alias("n"))
        .where("n >= need")
        .select("host", "open_start")
    )
    over = open_.join(F.broadcast(across), ["host", "open_start"])
    rows = found.where("open_start is null").select("stream", "start").unionByName(over.select("stream", "start"))
    return stored(rows.groupBy("stream").agg(F.collect_set("start").alias("covered")))


def own_text(blocks: list[str], kinds: list[int], covered: list[int] | None, rules: Boilerplate) -> str:
    """A page's text: blocks of articles whole, of the other unmarked ones the tokens that no repeat covers.

    A repeat that runs on into a block by fewer than ``depth`` tokens, but not to its end, leaves these: pages whose
    own texts begin with the same word after the same menu keep that word."""
    line = [block for block, kind in zip(blocks, kinds) if kind != KEPT]
    hidden = [False] * sum(len(block.split()) for block in line)
    if covered:
        known = set(covered)
        for start, i, j in suffixes(line, rules.depth):
            if digest(start) in known:
                hidden[i:j] = [True] * (j - i)
    at, out = 0, []
    for block, kind in zip(blocks, kinds):
        if kind == KEPT:
            out.append(block)
            continue
        words = block.split()
        if kind == FREE:
            runs = [(gone, list(run)) for gone, run in groupby(range(len(words)), lambda i: hidden[at + i])]
            stays = [i for gone, run in runs if not gone or len(run) < min(rules.depth, len(words)) for i in run]
            out.append(" ".join(words[i] for i in stays))
        at += len(words)
    return "\n".join(text for text in out if text)


def main_text(pages: DataFrame, rules: Boilerplate = Boilerplate()) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url`` and ``text``, the main text (empty if there is none).

    A null or empty ``html`` has no text; pages without a URL or host share one host. Repeated rows each get a
    row and count as one page; other columns are ignored; an empty table gives an empty result.

    The streams of all pages go through the suffix array, and every text is made of what it says; markup is held against
    that page by page. Equal streams of a host meet before suffixes are made of them, as one row for each of their
    first ``rules.pages`` distinct pages, which is all that a repeat asks for. The ranges of the suffix array are cut by
    page within equal beginnings, so neither a host with very many pages nor a very common passage gathers in a
    task. A host's only page has nothing to repeat. Pages are read twice, for their streams and for their texts: that
    moves and stores the texts once instead of twice.
    """
    read = stored(read_streams(pages).distinct())
    hosts = read.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("n"))
    hosts = stored(hosts.where("n >= 2").select("host", F.least("n", F.lit(rules.pages)).cast("long").alias("need")))
    first = F.row_number().over(Window.partitionBy("stream").orderBy("same"))
    few = read.withColumn("_n", first).where(F.col("_n") <= rules.pages)  # the limit holds before the shuffle too
    streams = few.join(hosts, "host").select("host", "need", "same", "stream", "line")
    covered = repeats(streams, rules)
    told = read_pages(pages).join(covered, "stream", "left").select("page_id", "url", "page", "covered")

    def work(batches):
        for batch in batches:
            texts = []
            for page, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                texts.append(own_text(*unpacked(page), hashes, rules))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    kinds = dict(told.dtypes)
    return told.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
