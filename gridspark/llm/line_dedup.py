"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line per group.

A line is normalised to its lower-cased words, one space between them. Equal normalised lines are
one node, by 128 bits of hash. Two nodes are similar when 1 - edit distance / longer length of the
normalised lines is at least ``SIMILARITY``, in code points. Candidates share a key:

* 64-bit SimHashes (over the line's ``GRAM``-byte grams) that differ in at most ``DISTANCE`` bits agree
  on at least two of five blocks, so every pair of blocks is a key.
* At an edit similarity of 0.9 most SimHashes are further apart than pigeonhole blocks reach, so
  ``SKETCHES`` min-hash keys over the same grams are keys too.
* Lines of at most ``SHORT`` characters also have ``SHORT_SKETCHES`` keys over shorter grams, and those
  where one edit is all that the similarity allows have their halves from either end: one edit leaves
  one half untouched, so no such pair is missed.

Candidates within ``REACH`` bits of SimHash (short lines: any) are verified. Of each connected group
only the first occurrence stays, by (doc_id, text hash, line number).

Defined results: lines without words always stay; a null text stays null; rows equal in doc_id and
text count as one document and keep the same lines; a null doc_id is a document like any other;
columns other than ``text`` are untouched.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import SECOND_BASE, RangeHash, bucket_links, fitting, mix64, release, shared_keys, stash, text_blocks, utf8
from gridspark.llm.decontamination import words
from gridspark.llm.near_dedup import _NORMAL, edit_distance

DISTANCE = 3
SIMILARITY = 0.9
#: Bytes of a gram; min-hash keys of a line, each of the least gram in every one of ``BINS`` bins.
GRAM, SKETCHES, BINS = 6, 12, 4
#: Lines of at most so many characters have further keys of shorter grams in fewer bins.
SHORT, SHORT_GRAM, SHORT_SKETCHES, SHORT_BINS = 54, 4, 8, 3
#: SimHash bits that candidates may differ in: lines of edit similarity 0.9 differ in 13 on average at worst.
REACH = 20
#: Tables of pigeonhole blocks that are searched in one turn; a turn's shuffle is on disk at once.
TURN = 5
#: Parts of the documents that lines are looked up in, one after the other, for the same reason.
PARTS = 2
#: Bytes of text whose lines are looked at together: arrays of eight bytes a character that fit a core's cache, and a worker keeps little of.
LINE_BYTES = 1 << 18
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of a block of texts (n + 1), and each text's first line (texts + 1)."""
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    # a break at a text's very end starts an empty line there, before the next text's first line
    first = np.arange(len(offsets) - 1) + np.searchsorted(breaks, offsets[:-1], side="right")
    return np.append(starts, len(raw)), np.append(first, len(starts))


def normalised(line: str) -> str:
    return b" ".join(words(line.encode("utf-8", "surrogatepass"))).decode("utf-8", "surrogatepass")


def normal_lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes of all lines in a row, and where each line's begin and end in them."""
    z = _NORMAL[raw]
    word = z != 32
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first separator after a word
    inside = at[:-1][at[:-1] < len(raw)]
    keep[inside] = word[inside]
    count = np.concatenate([[0], np.cumsum(keep)])
    z = z[keep]
    start, end = count[at[:-1]], count[at[1:]].copy()
    full = end > start
    end[full] -= z[end[full] - 1] == 32
    return z, start, end


def gram_hashes(z: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-byte grams (8 at most) of a byte array."""
    n = max(0, len(z) - size + 1)
    padded = np.concatenate([z, np.zeros(8, np.uint8)])
    h = np.ndarray((n,), "<u8", padded, strides=(1,)) & np.uint64((1 << (8 * size)) - 1)
    h = h * np.uint64(0x9E3779B97F4A7C15)  # integer arrays wrap around
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def line_grams(z: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of every line, and where each line's begin (n + 1 numbers)."""
    n = np.maximum(0, end - start - size + 1)
    at = np.concatenate([[0], np.cumsum(n)])
    return gram_hashes(z, size)[np.arange(at[-1]) + np.repeat(start - at[:-1], n)], at


def min_keys(grams: np.ndarray, at: np.ndarray, sketches: int = SKETCHES, bins: int = BINS) -> np.ndarray:
    """The min-hash keys of every line (lines x ``sketches``, 32 bits each)."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    mixed = np.zeros((sketches, len(at) - 1), np.uint64)
    dealt = (grams >> np.uint64(20)) % np.uint64(bins)
    odd = mix64(np.arange(1, sketches + 1, dtype=np.uint64) + np.uint64(1000 * bins)) | np.uint64(1)
    for c in range(bins):
        mine = np.flatnonzero(dealt == np.uint64(c))
        own, values = owner[mine], grams[mine]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for k in range(sketches if len(mine) else 0):
            mixed[k, own[first]] += mix64(np.minimum.reduceat(values * odd[k], first) + np.uint64(c))
    return (mix64(mixed) >> np.uint64(32)).astype(np.uint32).T


def half_keys(z: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: RangeHash) -> np.ndarray:
    """Keys (lines x 4) that lines share with any other one edit away: the halves from either end.

    Of two strings one edit apart, the shorter of m characters, the common start or the common end
    has m // 2 characters at least; a line can be either, so its m is its length or one less.
    """
    lead = np.flatnonzero((z & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, start), np.searchsorted(lead, end)
    place = np.append(lead, len(z))
    out = np.zeros((len(start), 4), np.uint32)
    for k, shorter in enumerate((0, 1)):
        m = np.maximum(last - first - shorter, 0)
        for side, (a, b) in enumerate(((start, place[first + m // 2]), (place[last - m // 2], end))):
            with np.errstate(over="ignore"):
                # of a line's last half the end is its last character's, not the separator's
                out[:, 2 * side + k] = mix64(hashed(a, np.maximum(a, b)) + m.astype(np.uint64)) >> np.uint64(32)
    return out


def pair_parities(z: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of every line: of its pairs of neighbour characters in each of 64 hashed bins, whether their number is odd.

    An edit takes two pairs and makes two at most, so lines ``d`` edits apart differ in 4 * ``d`` bits at most.
    """
    out = np.zeros(len(start), np.uint64)
    lead = np.flatnonzero((z & 0xC0) != 0x80)
    wide = np.diff(lead, append=len(z))
    at = np.concatenate([z, np.zeros(4, np.uint8)])
    code = np.ndarray((len(z),), "<u4", at, strides=(1,))[lead]
    if len(lead) < len(z):
        code = code & (np.uint32(0xFFFFFFFF) >> (32 - 8 * np.minimum(wide, 4)).astype(np.uint32))
    else:
        code = code & np.uint32(255)
    value = (code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(26)
    bit = np.append(np.uint64(1) << value.astype(np.uint64), np.uint64(0))
    first, last = np.searchsorted(lead, start), np.searchsorted(lead, end) - 1  # pairs first .. last - 1
    busy = np.flatnonzero(last > first)
    if len(busy):
        # what lies between two lines is reduced too, and left out
        edges = np.stack([first[busy], last[busy]], 1).ravel()
        out[busy] = np.bitwise_xor.reduceat(bit, edges)[::2]
    return out


_LANES = np.uint64(0x0001000100010001)


def simhash(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Majority bits over the grams of every line.

    A 64-bit sum holds four 16-bit counters, so sixteen shifted sums count all bits; lines of more
    grams than a counter holds are counted bit by bit.
    """
    n = np.diff(at)
    sim = np.zeros(len(n), np.uint64)
    busy = np.flatnonzero(n > 0)
    if not len(busy):
        return sim
    starts, total = at[:-1][busy], n[busy]
    votes = np.zeros((len(busy), 64), np.int64)
    for bit in range(16):
        sums = np.add.reduceat((grams >> np.uint64(bit)) & _LANES, starts)
        votes[:, bit::16] = sums.view(np.uint16).reshape(-1, 4)
    for k in np.flatnonzero(total > 60_000).tolist():
        own = grams[starts[k] : starts[k] + total[k]]
        votes[k] = [int(((own >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    ones = (2 * votes > total[:, None]).astype(np.uint8)
    sim[busy] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return sim


#: Characters of lines whose similarity allows one edit, and no more, with a line one shorter.
_ONE_EDIT = (9, 19)
#: The table that a line's key at each place belongs to, after those of pigeonhole blocks.
_PLACES = [*range(SKETCHES + SHORT_SKETCHES), *[SKETCHES + SHORT_SKETCHES] * 2, *[SKETCHES + SHORT_SKETCHES + 1] * 2]


def line_keys(raw: np.ndarray, at: np.ndarray) -> dict:
    """Of all lines with words: index, 128-bit node, characters, SimHash, parities of pairs, and keys with their offsets."""
    z, start, end = normal_lines(raw, at)
    index = np.flatnonzero(end > start)
    start, end = start[index], end[index]
    chars = np.concatenate([[0], np.cumsum((z & 0xC0) != 0x80)])
    n = chars[end] - chars[start]
    hashed = RangeHash(z)
    node = np.stack([hashed(start, end), RangeHash(z, SECOND_BASE)(start, end)], 1) if len(index) else np.zeros((0, 2), np.uint64)
    grams = line_grams(z, start, end, GRAM)
    short = np.flatnonzero((n >= _ONE_EDIT[0]) & (n <= SHORT))
    tiny = np.flatnonzero((n >= _ONE_EDIT[0]) & (n <= _ONE_EDIT[1]))
    width = np.where(n >= _ONE_EDIT[0], SKETCHES, 0)
    width[short] += SHORT_SKETCHES
    width[tiny] += 4
    offsets = np.concatenate([[0], np.cumsum(width)])
    keys = np.zeros(offsets[-1], np.uint32)
    put = lambda lines, first, values: keys.__setitem__(offsets[lines][:, None] + first + np.arange(values.shape[1]), values)
    fuzzy = np.flatnonzero(n >= _ONE_EDIT[0])
    put(fuzzy, 0, min_keys(*grams)[fuzzy])
    put(short, SKETCHES, min_keys(*line_grams(z, start[short], end[short], SHORT_GRAM), SHORT_SKETCHES, SHORT_BINS))
    put(tiny, SKETCHES + SHORT_SKETCHES, half_keys(z, start[tiny], end[tiny], hashed))
    return {"index": index, "node": node, "n": n, "sim": simhash(*grams), "par": pair_parities(z, start, end), "keys": keys, "offsets": offsets}


def line_rows(batches, limit: int = LINE_BYTES):
    """The rows of ``_lines`` for batches of (doc_id, row, text)."""
    for b in text_blocks(batches, "text", limit):
        raw, offsets = utf8(b.column("text"))
        at, first = lines_of(raw, offsets)
        k = line_keys(raw, at)
        owner = np.searchsorted(first, k["index"], side="right") - 1
        take, count = pa.array(owner), len(owner)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id").take(take),
                b.column("row").take(take),
                pa.array((k["index"] - first[owner]).astype(np.int32)),
                pa.array(k["n"].astype(np.int32)),
                pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer((np.arange(count + 1) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(k["node"]))]),
                pa.array(k["node"][:, 0].view(np.int64).copy()),
                pa.array(k["sim"].view(np.int64)),
                pa.array(k["par"].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(k["offsets"].astype(np.int32)), pa.array(k["keys"].view(np.int32))),
            ],
            names=["doc_id", "row", "line", "n_chars", "node", "h", "sim", "par", "keys"],
        )


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, n_chars, node, h, sim, par, keys) of every line with words; no keys where it is compared for equality only."""
    return _keyed(docs).mapInArrow(line_rows, "doc_id long, row long, line int, n_chars int, node binary, h long, sim long, par long, keys array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def _tables(distance: int) -> list:
    return list(combinations(_BLOCKS, len(_BLOCKS) - distance))


def block_keys(distance: int = DISTANCE, tables: slice = slice(None)):
    """The columns of pigeonhole blocks, or of some tables of them, for ``shared_keys``."""

    def columns(b: pa.RecordBatch):
        sim = np.asarray(b.column("sim")).view(np.uint64)
        for t, chosen in list(enumerate(_tables(distance)))[tables]:
            key = np.zeros(len(sim), np.uint64)
            for low, wide in chosen:
                key = (key << np.uint64(wide)) | ((sim >> np.uint64(low)) & np.uint64((1 << wide) - 1))
            yield t, np.arange(len(sim)), key

    return columns


def own_keys(b: pa.RecordBatch):
    """The columns of the lines' own keys for ``shared_keys``."""
    lists = b.column("keys")
    begin, size = np.asarray(lists.offsets)[:-1], np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.values).view(np.uint32)
    for place, t in enumerate(_PLACES):
        mine = np.flatnonzero(size > place)
        if len(mine):
            yield 100 + t, mine, flat[begin[mine] + place]


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes`` (node, first): the normalised line, from the document that has it first."""
    places = nodes.groupBy(F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__row")).agg(F.collect_list(F.struct("node", "first.line")).alias("wanted"))
    found = _keyed(docs).join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).select("text", "wanted")

    def pick(batches):
        for b in text_blocks(batches, "text", LINE_BYTES):
            raw, offsets = utf8(b.column("text"))
            at, first = lines_of(raw, offsets)
            z, start, end = normal_lines(raw, at)
            wanted = b.column("wanted")
            count = np.diff(np.asarray(wanted.offsets))
            items = wanted.flatten()
            line = np.asarray(items.field("line")) + np.repeat(first[:-1], count)
            size = end[line] - start[line]
            ends = np.concatenate([[0], np.cumsum(size)])
            data = z[np.arange(ends[-1]) + np.repeat(start[line] - ends[:-1], size)]
            text = pa.LargeStringArray.from_buffers(len(line), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            yield pa.RecordBatch.from_arrays([items.field("node"), text.cast(pa.string())], names=["node", "text"])

    # repeated rows give a node several times
    return found.mapInArrow(pick, "node binary, text string").dropDuplicates(["node"])


def similar_lines(x: str, y: str, similarity: float = SIMILARITY) -> bool:
    most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    return edit_distance(x, y, most) <= most


class Letters:
    """Texts as ranks of their characters, eight bytes of them from any place on as one word."""

    def __init__(self, *columns: pa.Array):
        texts = pa.chunked_array([c.cast(pa.large_string()) for c in columns]).combine_chunks()
        self.size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
        seen[codes] = 1
        rank = np.cumsum(seen, dtype=np.uint32)  # of many characters a place holds fewer
        self.bits = 8 if rank[-1] < 1 << 8 else 16 if rank[-1] < 1 << 16 else 32
        ranks = np.concatenate([rank[codes], np.zeros(8, np.uint32)]).astype(f"<u{self.bits // 8}")
        self.word = np.ndarray((len(codes) + 1,), "<u8", ranks, strides=(self.bits // 8,)).copy()

    def agree(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many characters from places ``x`` and ``y`` on are the same, ``room`` at most."""
        per = 64 // self.bits
        differ = self.word[x] ^ self.word[y]
        same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // np.uint8(self.bits)
        out = np.minimum(same, room)
        live, done = np.flatnonzero((same == per) & (room > per)), per
        while len(live):
            differ = self.word[x[live] + done] ^ self.word[y[live] + done]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // np.uint8(self.bits)
            out[live] = np.minimum(done + same.astype(np.int64), room[live])
            done += per
            live = live[(same == per) & (room[live] > done)]
        return out


#: Edits from which on a pair is decided alone, and cells of furthest places that are computed together.
MANY_EDITS, CELLS = 400, 1 << 17


def within(letters: Letters, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether ``most`` edits lead from text ``i`` to text ``j``, of many pairs at once.

    The furthest place that every diagonal reaches with so many edits (Ukkonen 1985), on the diagonals
    from which the last one can still be reached.
    """
    out = np.zeros(len(i), bool)
    swap = letters.size[i] > letters.size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.flatnonzero(letters.size[j] - letters.size[i] <= most)
    order = order[np.argsort(most[order], kind="stable")]
    while len(order):
        least = int(most[order[0]])
        n = min(max(1, CELLS // (2 * least + 3)), int(np.searchsorted(most[order], 2 * least + 2, side="right")))
        mine, order = order[:n], order[n:]
        out[mine] = _within(letters, i[mine], j[mine], most[mine])
    return out


def _within(letters: Letters, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    out, row, none = np.zeros(len(i), bool), np.arange(len(i)), np.int32(-(1 << 29))
    x, y = letters.start[i], letters.start[j]
    m, n, most = (v.astype(np.int32) for v in (letters.size[i], letters.size[j], most))
    # beside the first and the last diagonal, 0 and n - m, half of what is left of the edits
    half = (most - (n - m)) // 2
    goal = n - m + half
    d = np.arange(int((goal + half).max()) + 1, dtype=np.int32) - half[:, None]
    detour, top = np.abs(d - (n - m)[:, None]), np.minimum(m[:, None], n[:, None] - d)
    far = np.full((len(i), d.shape[1] + 2), none)
    far[np.arange(len(row)), half + 1] = -1
    for edits in range(int(most.max()) + 1):
        # the diagonals that so many edits reach, and that the others lead on from
        low = int(np.maximum(np.maximum(half - edits, goal - most + edits), 0).min())
        high = int(np.minimum(half + edits, goal + most - edits).max()) + 1
        part = (slice(None), slice(low, high))
        # a changed character, one that only the longer has, one that only the shorter has
        new = np.maximum(far[:, low + 1 : high + 1], far[:, low + 2 : high + 2])
        new += 1
        np.maximum(new, far[:, low:high], out=new)
        np.minimum(new, top[part], out=new)
        r, c = np.nonzero((new >= 0) & (new + d[part] >= 0) & (detour[part] <= (most - edits)[:, None]))
        at, k, limit = new[r, c], d[r, c + low], top[r, c + low]
        reached = at + letters.agree(x[r] + at, y[r] + at + k, limit - at).astype(np.int32)
        new.fill(none)
        new[r, c] = reached
        far[:, low + 1 : high + 1] = new
        done = far[np.arange(len(row)), goal + 1] >= m
        out[row[done]] = True
        stay = ~done & (most > edits)
        if not stay.any():
            break
        if not stay.all():
            row, m, x, y, most, half, d, detour, goal, top, far = (v[stay] for v in (row, m, x, y, most, half, d, detour, goal, top, far))
    return out


def similar_pairs(letters: Letters, i: np.ndarray, j: np.ndarray, text, similarity: float = SIMILARITY) -> np.ndarray:
    """``similar_lines`` of many pairs; ``text(k)`` is the text of number k."""
    most = np.floor((1 - similarity) * np.maximum(letters.size[i], letters.size[j]) + 1e-9).astype(np.int64)
    out, few = np.zeros(len(i), bool), most < MANY_EDITS
    out[few] = within(letters, i[few], j[few], most[few])
    for k in np.flatnonzero(~few).tolist():
        out[k] = similar_lines(text(i[k]), text(j[k]), similarity)
    return out


#: Counts of hashed character pairs that a line is described by.
PAIR_BINS = 128


def gram_counts(texts: pa.Array) -> np.ndarray:
    """How many pairs of neighbour characters of every text fall into each bin (texts x ``PAIR_BINS``, 255 at most)."""
    out = np.zeros((len(texts), PAIR_BINS), np.uint8)
    for s in range(0, len(texts), 2048):
        part = texts.slice(s, 2048)
        size = np.asarray(pc.utf8_length(part)).astype(np.int64)
        codes = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(part)), size)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        value = (codes[pair] * np.uint32(0x9E3779B1) + codes[pair + 1] * np.uint32(0x85EBCA6B)) >> np.uint32(25)
        counts = np.bincount(owner[pair] * PAIR_BINS + value, minlength=len(part) * PAIR_BINS)
        out[s : s + len(part)] = np.minimum(counts, 255).reshape(-1, PAIR_BINS)
    return out


def allowed(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether ``most`` edits can lead from row ``i`` of counts ``a`` to row ``j`` of ``b``: an edit takes and makes two pairs at most."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 13):
        part = slice(s, s + (1 << 13))
        x, y = a[i[part]], b[j[part]]
        more = np.maximum(x, y)
        out[part] = np.maximum((more - y).sum(1, dtype=np.int32), (more - x).sum(1, dtype=np.int32)) <= 2 * most[part]
    return out


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose normalised lines (node, text) are similar."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def compare(batches):
        for b in text_blocks(batches, "a"):
            a, z = b.column("a"), b.column("b")
            longer = np.maximum(np.asarray(pc.utf8_length(a)), np.asarray(pc.utf8_length(z)))
            every = np.arange(b.num_rows)
            keep = allowed(gram_counts(a), every, gram_counts(z), every, np.floor((1 - similarity) * longer + 1e-9))
            left = np.flatnonzero(keep)
            if len(left):
                some = [c.take(pa.array(left)) for c in (a, z)]
                n = len(left)
                keep[left] = similar_pairs(Letters(*some), np.arange(n), np.arange(n) + n, lambda k: some[k // n][k % n].as_py(), similarity)  # noqa: B023
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(compare, "u binary, v binary")


def kept_lines(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, lines): the line numbers that stay, of all lines with words."""
    spark = docs.sparkSession
    place = F.struct("doc_id", "row", "line")
    nodes = stash(_lines(docs).groupBy("node").agg(F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("n_chars", "h", "sim", "par", "keys")]), "lines")

    def fits(a, b):
        longer = F.greatest(a["size"], b["size"])
        apart = lambda c: F.bit_count(a[c].bitwiseXOR(b[c]))
        return ((longer <= SHORT) | (apart("sim") <= REACH)) & (F.least(a["size"], b["size"]) >= similarity * longer - 1e-9) & (apart("par") <= 4 * F.floor((1 - similarity) * longer + 1e-9))

    def close(data, i, j):
        size, sim, par = data["size"].astype(np.int64), data["sim"].view(np.uint64), data["par"].view(np.uint64)
        longer = np.maximum(size[j], size[i])
        ok = ((longer <= SHORT) | (np.bitwise_count(sim[j] ^ sim[i]) <= REACH)) & (np.minimum(size[j], size[i]) >= similarity * longer - 1e-9)
        ok &= np.bitwise_count(par[j] ^ par[i]) <= 4 * np.floor((1 - similarity) * longer + 1e-9)
        if "text" not in data:
            return ok
        if "grams" not in data:
            data["grams"] = gram_counts(data["text"])
        left = np.flatnonzero(ok)
        ok[left] = allowed(data["grams"], i[left], data["grams"], j[left], np.floor((1 - similarity) * longer[left] + 1e-9))
        return ok

    def decide(data, i, j):
        if "letters" not in data:
            data["letters"] = Letters(data["text"])
        return similar_pairs(data["letters"], i, j, lambda k: data["text"][k].as_py(), similarity)

    fuzzy = nodes.where(F.size("keys") > 0).withColumnRenamed("n_chars", "size")
    near = []
    for low in range(0, len(_tables(distance)), TURN):
        release(spark)
        near.append(shared_keys(fuzzy, block_keys(distance, slice(low, low + TURN)), ["sim"], False, "line-candidates", close, {"size": "<i4", "sim": "<i8", "par": "<i8"}))
    release(spark)
    near.append(shared_keys(fuzzy, own_keys, ["keys"], False, "line-candidates"))
    release(spark)
    both = reduce(DataFrame.unionByName, near)
    at = both.join(nodes.select("h", "node", "n_chars", "sim", "par"), "h").select("bucket", "node", F.col("n_chars").alias("size"), "sim", "par")
    at = stash(fitting(at, both, close), "lines-near")
    release(spark, *near)
    # the keys are not read any more
    slim = stash(nodes.select("node", "first"), "lines-first")
    release(spark, nodes)
    wanted = stash(slim.join(at.select("node").distinct(), "node", "left_semi"), "line-wanted")
    found = []
    for part in range(PARTS):
        release(spark)
        found.append(stash(_texts(docs.where(F.pmod(F.xxhash64("text"), F.lit(PARTS)) == part), wanted), "line-texts"))
    texts = reduce(DataFrame.unionByName, found)
    release(spark, wanted)
    label = bucket_links(at, fits, lambda pairs: verified(pairs, texts, similarity), close, decide, "lines", texts, many=True)
    # of a group the node with the first occurrence stays
    named = label.join(slim, "node")
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    gone = stash(named.join(best, "component").where("first != best").select("node"), "lines-gone")
    kept = stash(slim.join(gone, "node", "left_anti").groupBy("first.doc_id", "first.row").agg(F.collect_list("first.line").alias("lines")), "lines-kept")
    release(spark, slim, at, *found, gone, label)
    return kept


def _cut(docs: DataFrame, kept: DataFrame, drop_emptied: bool) -> DataFrame:
    """``docs`` with the lines that don't stay taken out of ``text``, and __n_lines, __n_kept (lines with words)."""
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("lines").alias("__lines"))
    joined = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left").drop("__id", "__row")
    names = docs.columns

    def run(batches):
        for b in text_blocks(batches, "text", LINE_BYTES):
            text = b.column("text")
            raw, offsets = utf8(text)
            at, first = lines_of(raw, offsets)
            letters = np.concatenate([[0], np.cumsum(_NORMAL[raw] != 32)])
            busy = np.diff(letters[at]) > 0
            n = len(busy)
            keep = ~busy
            lists = b.column("__lines")
            count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            keep[np.asarray(lists.flatten()) + np.repeat(first[:-1], count)] = True
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[first])
            n_lines, n_kept = total(busy), total(busy & keep)
            stay = np.repeat(keep, np.diff(at))
            # the last line that stays of a text whose very last line goes loses its line break
            last = np.maximum.accumulate(np.where(keep, np.arange(n), -1))[first[1:] - 1]
            cut = (last >= first[:-1]) & (last < first[1:] - 1)
            stay[at[last[cut] + 1] - 1] = False
            ends = np.concatenate([[0], np.cumsum(stay)])[offsets].astype(np.int64)
            valid = np.packbits(np.asarray(text.is_valid()), bitorder="little")
            texts = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[stay])), pa.py_buffer(valid)).cast(text.type)
            out = pa.RecordBatch.from_arrays([*(texts if c == "text" else b.column(c) for c in names), pa.array(n_lines, pa.int64()), pa.array(n_kept, pa.int64())], names=[*names, "__n_lines", "__n_kept"])
            yield out.filter(pa.array((n_kept > 0) | (n_lines == 0))) if drop_emptied else out

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_kept", T.LongType())]))


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines removed; documents that lost every line with words go."""
    return _cut(docs, kept_lines(docs, distance, similarity), True).drop("__n_lines", "__n_kept")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _cut(docs, kept_lines(docs), False).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_kept").alias("n_kept"), "text")
