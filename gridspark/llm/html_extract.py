"""HTML extraction by equivalence-class template deduction.

A page is read once, into the blocks of text that stand outside menus, headers, footers, sidebars,
notices, adverts, forms, comments and the like; whether text is wanted is decided where it stands. An
explicit article or main element, where the page has one, bounds the slots: its blocks are the text.

Other pages are held against their host's template. Tokens are tag paths, and words with the path they
stand on. Over the host's different pages, tokens with the same occurrence vector (how often in
which page) form an equivalence class; the vectors are compared by two sums of hashes over (page,
count), so a host with a third of all pages sends no more than its vocabulary. A class is valid
when it has two tokens or more, in most of the pages, and nests: all of it lies in one slot of the
classes placed before it, the widest first. Classes whose tokens occur once a page make up the template's
sequence; those that occur several times belong to the slot they repeat in. A page's words are aligned
with the sequence (longest increasing run), and a block is a slot's text unless most of its words are template.

Defined results: a null or empty html gives empty text and 0 characters; a null url is a host of
its own; hosts with fewer than ``LEAST_PAGES`` different pages without explicit content have no template; equal
pages of a host count once in it; a page all of whose blocks are template is empty; repeated rows and
page_ids are pages of their own and give a row each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html as _html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import release, stash, text_blocks

#: A token is template when it occurs in this share of the host's pages, and in this many at least.
SUPPORT, LEAST_PAGES = 0.6, 3
#: The last form takes a tag whose quotes never close, up to its next bracket.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?", re.S)  # fmt: skip
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "xmp", "noembed", "noframes", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "label", "input", "option", *_RAW}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
#: Words that a class or id begins or ends with where it names a region that isn't the article.
_REGIONS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar widget nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice notices disclaimer alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond discussion pagination pager toolbar search banner".split()
)
_WHOLE = {"hidden", "skip", "skip-link", "aside", "side"}
_P_ENDS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ITEMS = {"li", "tr", "td", "th", "dd", "dt"}
_SPACE = re.compile(r"\s+")


def _named(value: str) -> bool:
    """Whether a class or id names an unwanted region."""
    for name in value.lower().split():
        parts = re.split(r"[-_]+|(?<=[a-z])(?=\d)", name.strip("-_"))
        if name in _WHOLE or parts[0] in _REGIONS or parts[-1] in _REGIONS or parts[-1].isdigit() and len(parts) > 1 and parts[-2] in _REGIONS:
            return True
    return False


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in _DROP:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and _named(value):
            return True
        if name == "role" and value.lower() in _DROP_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str, bool]]:
    """(path, text, inside an article or main element) of a page's wanted blocks in order."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool, bool, str]] = []  # tag, wanted so far, inside article or main, path
    parts: list[str] = []
    state = [False, ""]  # of the open block: inside, path

    def add(text: str) -> None:
        _, wanted, inside, path = stack[-1] if stack else ("", True, False, "")
        if wanted:
            if not parts:
                state[:] = inside, path
            parts.append(text)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((state[1], text, state[0]))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m.group(1) is not None:
            add(m.group(1).replace("&", "&amp;"))
        closing, name, attrs = (m.group(2), m.group(3), m.group(4)) if m.group(3) else (m.group(5), m.group(6), m.group(7))
        if name is None:
            continue
        tag = name.lower()
        if tag in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(x[0] in _BLOCK for x in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                # a stray end tag of an inline or paragraph element doesn't close what holds it
                if tag not in _BLOCK and stack[k][0] in _BLOCK or tag == "p" and stack[k][0] != "p" and stack[k][0] in _P_ENDS:
                    break
            continue
        if tag in _P_ENDS or tag in _ITEMS:
            # an open paragraph (or item) ends here; inline elements left open inside it end with it
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" and tag in _P_ENDS or t == tag and tag in _ITEMS:
                    del stack[k:]
                    break
                if t in _BLOCK:
                    break
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID or (attrs or "").endswith("/"):
            continue
        _, wanted, inside, path = stack[-1] if stack else ("", True, False, "")
        stack.append((tag, wanted and not _unwanted(tag, attrs or ""), inside or tag in ("article", "main"), f"{path}/{tag}" if tag in _BLOCK else path))
    flush()
    return out


def explicit(found: list[tuple[str, str, bool]]) -> str | None:
    """The text of a page with an article or main element; None if there is none with text."""
    inside = [text for _, text, own in found if own]
    return " ".join(inside) if inside else None


def token_hash(path: str, word: str | None = None) -> int:
    token = path if word is None else f"{path}\x00{word}"
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens(found: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(token, block) of a page in order: each block's path, then its words on that path."""
    return [x for k, (path, text) in enumerate(found) for x in ((token_hash(path), k), *((token_hash(path, w), k) for w in text.split()))]


class Template:
    """A host's nested classes: ``order`` of tokens that occur once, and the slot of those that repeat."""

    def __init__(self, order: dict[int, int], repeated: dict[int, int]):
        self.order, self.repeated = order, repeated

    @classmethod
    def of(cls, rows: list[tuple[int, int, int, float, int]]) -> Template:
        """From (token, class, support, mean place, most in a page) of tokens with enough support."""
        classes = defaultdict(list)
        for token, kind, support, place, most in rows:
            classes[kind].append((place, token, support, most))
        valid = sorted((c for c in classes.values() if len(c) > 1), key=lambda c: (-c[0][2], -len(c), min(c)))
        sequence: list[tuple[float, int]] = []
        for members in (c for c in valid if max(x[3] for x in c) == 1):
            places = sorted((x[0], x[1]) for x in members)
            # between two classes placed before: all in one slot of theirs, or around all of it
            gaps = {bisect.bisect(sequence, p) for p in places}
            if len(gaps) == 1 or gaps == {0, len(sequence)}:
                sequence = sorted(sequence + places)
        order = {token: k for k, (_, token) in enumerate(sequence)}
        repeated = {}
        for members in (c for c in valid if max(x[3] for x in c) > 1):
            slots = {bisect.bisect(sequence, (place, token)) for place, token, _, _ in members}
            if len(slots) == 1:
                repeated |= {token: min(slots) for _, token, _, _ in members}
        return cls(order, repeated)

    def slots(self, found: list[tuple[str, str]]) -> list[str]:
        """The texts of a page's blocks that are slots: at most half of their words are template."""
        seen = tokens(found)
        places = [(self.order[t], k) for k, (t, _) in enumerate(seen) if t in self.order]
        # the longest run of template tokens in template order; ends[n] ends the lowest run of n + 1
        ends: list[int] = []
        tops: list[int] = []
        before: list[int] = []
        for j, (place, _) in enumerate(places):
            n = bisect.bisect_left(tops, place)
            before.append(ends[n - 1] if n else -1)
            tops[n : n + 1] = [place]
            ends[n : n + 1] = [j]
        matched = set()
        j = ends[-1] if ends else -1
        while j >= 0:
            matched.add(places[j][1])
            j = before[j]
        hits, total, slot = Counter(), Counter(), 0
        heads = {}
        for k, (token, block) in enumerate(seen):
            if k in matched:
                slot = self.order[token] + 1
            hit = k in matched or self.repeated.get(token) == slot
            if block in heads:  # a block's first token is its path
                total[block] += 1
                hits[block] += hit
            heads[block] = True
        return [text for k, (_, text) in enumerate(found) if 2 * hits[k] <= total[k]]


def main_text(page: str, template: Template | None = None) -> str:
    """The explicit content of a page, or the slots of its template, or all wanted blocks."""
    found = blocks(page)
    text = explicit(found)
    if text is None:
        bare = [(path, t) for path, t, _ in found]
        text = " ".join(template.slots(bare) if template else [t for _, t in bare])
    return text


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


_READ = "page_id long, url string, host string, text string, blocks array<struct<path: string, text: string>>, same long"


def _read(pages: DataFrame) -> DataFrame:
    """Every page read once: its explicit text, or its blocks and their hash."""

    def run(batches):
        kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
        for b in text_blocks(batches, "html"):
            texts, rest, same = [], [], []
            for source in b.column("html").to_pylist():
                found = blocks(source or "")
                texts.append(explicit(found) if found else "")
                bare = None if texts[-1] is not None else [{"path": p, "text": t} for p, t, _ in found]
                rest.append(bare)
                same.append(None if bare is None else token_hash("\x01".join(f"{x['path']}\x00{x['text']}" for x in bare)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(texts, pa.string()), pa.array(rest, kind), pa.array(same, pa.int64())], names=["page_id", "url", "host", "text", "blocks", "same"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", _host(F.col("url")).alias("host"))
    return rows.mapInArrow(run, _READ)


def templates(read: DataFrame, support: float = SUPPORT, least: int = LEAST_PAGES) -> DataFrame:
    """(host, tokens, places, repeated): the template of every host with enough different pages.

    ``places`` are the tokens' places in the sequence, for those marked ``repeated`` their slot.
    """
    different = read.where("blocks IS NOT NULL").select("host", "blocks", "same").dropDuplicates(["host", "same"])
    hosts = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("host", "token", "page", "count", "place")}
            for host, found, page in zip(*(b.column(c).to_pylist() for c in ("host", "blocks", "same")), strict=True):
                seen = [t for t, _ in tokens([(x["path"], x["text"]) for x in found])]
                first: dict[int, int] = {}
                for k, t in enumerate(seen):
                    first.setdefault(t, k)
                for t, n in Counter(seen).items():
                    for c, x in zip(out, (host, t, page, n, first[t] / len(seen)), strict=True):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("host", pa.string()), ("token", pa.int64()), ("page", pa.int64()), ("count", pa.int32()), ("place", pa.float64())]))

    seen = different.select("host", "blocks", "same").mapInArrow(run, "host string, token long, page long, count int, place double")
    vector = seen.groupBy("host", "token").agg(
        F.count("*").alias("support"),
        F.sum(F.shiftright(F.xxhash64("page", "count"), 12)).alias("v1"),
        F.sum(F.shiftright(F.xxhash64("count", "page", F.lit(1)), 12)).alias("v2"),
        F.avg("place").alias("place"),
        F.max("count").alias("most"),
    )
    # in most pages: no more such tokens than a page has, over ``support``
    often = vector.join(hosts, "host").where((F.col("support") >= least) & (F.col("support") >= F.col("pages") * support))

    def nest(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("token", "v1", "v2", "support", "place", "most")]
        made = Template.of([(t, (a, b), s, p, m) for t, a, b, s, p, m in zip(*columns, strict=True)])
        both = [*((t, k, False) for t, k in made.order.items()), *((t, k, True) for t, k in made.repeated.items())]
        row = {"host": [table.column("host")[0].as_py()]} | {c: [[x[k] for x in both]] for k, c in enumerate(("tokens", "places", "repeated"))}
        return pa.table(row, schema=pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("repeated", pa.list_(pa.bool_()))]))

    kept = often.select("host", "token", "v1", "v2", "support", "place", "most")
    return kept.groupBy("host").applyInArrow(nest, "host string, tokens array<long>, places array<int>, repeated array<boolean>").where(F.size("tokens") > 0)


def extract(pages: DataFrame, support: float = SUPPORT, least: int = LEAST_PAGES) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    read = stash(_read(pages), "pages-read")
    known = stash(templates(read, support, least), "templates")
    release(pages.sparkSession)
    held = read.where("blocks IS NOT NULL").select("page_id", "url", "host", "blocks").join(known, "host", "left")

    def run(batches):
        for b in batches:
            texts, made = [], {}
            for host, found, *template in zip(*(b.column(c).to_pylist() for c in ("host", "blocks", "tokens", "places", "repeated")), strict=True):
                bare = [(x["path"], x["text"]) for x in found]
                if template[0] is not None and host not in made:
                    rows = list(zip(*template, strict=True))
                    made = {host: Template({t: k for t, k, r in rows if not r}, {t: k for t, k, r in rows if r})}  # hosts come in runs
                texts.append(" ".join(made[host].slots(bare) if template[0] is not None else [t for _, t in bare]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    slots = held.select("page_id", "url", "host", "blocks", "tokens", "places", "repeated").mapInArrow(run, "page_id long, url string, text string")
    whole = read.where("blocks IS NULL").select("page_id", "url", "text").unionByName(slots)
    return whole.withColumn("n_chars", F.char_length("text").cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
