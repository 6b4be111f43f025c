"""Held-out passages inside a corpus (problem 6).

Method: spaced-seed hashing.  Both sides become streams of word hashes; fixed masks pick some of a
window's positions and ignore the others, so a changed word at an ignored position does not break a
hit.  The hashes of the held-out items are broadcast in blocks of a fixed size (more items mean more
blocks, each against all documents), joined with the hashes of every document, and the surroundings of
the hits are verified by an alignment that tolerates substitutions and inserted words.  Map-only: no
text and no document fingerprint is ever shuffled or collected.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import table
from .visual import Former, former, published, tables

# Fixed masks: 1 takes the word, 0 ignores it.
MASKS = ("110111", "111011", "1110111", "1101011")
WINDOW = 6
# For items with a floor below the usual: any passage of two points or more has two equal words in a row, one of one point has a word.
SHORT = ("11", "1")
CHANGED = 2
#: A seed of more items of a block than this is looked up only for pairs that other seeds have found, where that is enough.
HOT = 64
ACCENTS = "\"'`^~=."
MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """cp -> lower-cased base letter, 0 for anything but letters, 1 for combining marks; bounded by the code space."""
    out = np.zeros(0x30000, np.uint32)
    for cp in range(0x30000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            low = unicodedata.normalize("NFD", ch.lower())[0]
            out[cp] = ord(low)
        elif cat == "Mn":
            out[cp] = 1
    return out


# Blocks of scripts that are written without blanks (Thai, Lao, Burmese, Khmer, kana, Han); each letter there is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))


class Words:
    """Texts in typesetting markup -> hashes of their words, whatever commands, braces, accents or comments surround them."""

    def __init__(self, form: Former, fold: np.ndarray):
        self.form, self.fold = form, fold

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes of all texts, number of words of each text).

        Words are runs of letters, compared without case and accents; in scripts without blanks each letter is one.  Command names, formulas in
        dollars and digits are not words; braces, accent commands and hyphenated line ends do not
        break a word.  Comments count as text: a passage in a commented-out draft is still there.
        """
        texts = [_joined(t) for t in self.form.form(texts)]
        whole = "\n\n" + "\n\n".join(texts) + "\n\n"
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        letter = self.fold[np.minimum(cp, 0x2FFFF)]
        kind = (letter > 1).astype(np.uint8)  # 0 breaks a word, 1 letter, 2 is dropped without a break
        kind[letter == 1] = 2
        kind[(cp == ord("{")) | (cp == ord("}"))] = 2
        slash = np.flatnonzero(cp == ord("\\"))
        slash = slash[slash < len(cp) - 2]
        after = cp[slash + 1]
        accent = slash[np.isin(after, np.frombuffer(ACCENTS.encode("utf-32-le"), np.uint32)) & ((letter[slash + 2] > 1) | np.isin(cp[slash + 2], (ord("{"), ord("\\"))))]
        kind[accent] = kind[accent + 1] = 2
        dash = slash[after == ord("-")]
        kind[dash] = kind[dash + 1] = 2
        is_l = kind == 1
        edge = np.flatnonzero(np.diff(is_l.astype(np.int8), prepend=0, append=0))
        lo, hi = edge[::2], edge[1::2]
        named = cp[lo - 1] == ord("\\")
        dotless = named & (hi - lo == 1) & np.isin(cp[lo], (ord("i"), ord("j")))
        kind[lo[dotless] - 1] = 2
        lo, hi = lo[named & ~dotless], hi[named & ~dotless]
        delta = np.zeros(len(cp) + 1, np.int8)
        delta[lo] = 1
        delta[hi] -= 1
        kind[np.cumsum(delta[:-1], dtype=np.int8) > 0] = 0
        opening = np.flatnonzero(cp == ord("{"))
        kind[opening[(kind[opening - 1] == 0) | (cp[opening - 1] == ord("}"))]] = 0
        money = np.flatnonzero((cp == ord("$")))
        money = money[cp[money - 1] != ord("\\")]
        if len(money):
            line = cp == ord("\n")
            stop = np.flatnonzero(line[1:] & line[:-1])
            para = np.searchsorted(stop, money)
            first = np.concatenate([[True], np.diff(para) > 0])
            nth = np.arange(len(money)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            pairs = np.flatnonzero((nth % 2 == 0) & np.append(np.diff(para) == 0, False))
            delta = np.zeros(len(cp) + 1, np.int8)
            delta[money[pairs]] = 1
            delta[money[pairs + 1]] -= 1
            kind[np.cumsum(delta[:-1], dtype=np.int8) > 0] = 0
            kind[money] = 0
        keep = np.flatnonzero(kind != 2)
        is_l = kind[keep] == 1
        begin = is_l & ~np.append(False, is_l[:-1])
        alone = cp[keep]
        if int(alone.max()) >= UNSPACED[0][0]:
            alone = np.logical_or.reduce([(alone >= a) & (alone <= b) for a, b in UNSPACED]) & is_l
            begin |= is_l & (alone | np.append(False, alone[:-1]))
        lo = np.flatnonzero(begin)
        at, let = keep[lo], letter[keep][is_l].astype(np.uint64)
        size = np.diff(np.flatnonzero(begin[is_l]), append=len(let))
        end = np.cumsum(size)
        with np.errstate(over="ignore"):
            up = np.power(BASE, np.arange(16, dtype=np.uint64))
            place = (np.arange(len(let)) - np.repeat(end - size, size))
            total = np.zeros(len(let) + 1, np.uint64)
            np.cumsum((let + np.uint64(7)) * up[place % 16] * (MULT + (place // 16).astype(np.uint64) * np.uint64(2)), out=total[1:])
            h = (total[end] - total[end - size]) * MULT
            h ^= h >> np.uint64(29)
        bound = np.cumsum(lens) + 1
        doc = np.searchsorted(bound, at, side="right")
        return h, np.bincount(doc, minlength=len(texts))[: len(texts)] if len(texts) else np.zeros(0, np.int64)


_BREAK = re.compile(r"-[ \t]*\n[ \t]*")


def _joined(t: str) -> str:
    return _BREAK.sub("", t) if "-\n" in t or "- \n" in t or "-\t\n" in t else t


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of every window under the mask; one for each start that the window fits after."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (salt + 1) * int(MULT) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                out = (out + h[j : j + n]) * BASE
                out ^= out >> np.uint64(31)
    return out


def floor(size: int, share: float, least: int) -> int:
    """The points from which a passage of an item of this many words counts: ``least``, or the share of the item where that is less."""
    return min(least, max(1, int(np.ceil(share * size - 1e-9))))


def _grouped(value: np.ndarray, at: np.ndarray):
    """(value, the places of ``at`` that have it), by value."""
    at = at[np.argsort(value[at], kind="stable")]
    edge = np.flatnonzero(np.diff(value[at], prepend=-1))
    return zip(value[at[edge]].tolist(), np.split(at, edge[1:]) if len(edge) else [])


@dataclass
class Items:
    """A block of held-out items: their words and the sorted seed hashes with item and position."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    filter: np.ndarray
    short: bool  # some items are found by the masks in SHORT
    shared: np.ndarray  # the seeds that are put off, sorted
    later: dict[int, tuple[np.ndarray, np.ndarray]]  # item -> (numbers of its put-off seeds, their positions)

    @staticmethod
    def build(ids: list, texts: list[str], words: Words, bits: int = 24, share: float = 0.5, least: int = 6, seed_share: float = 0.2) -> Items:
        """Seeds that more than HOT items have are put off for every item of which they cover less than ``seed_share``.

        Such an item is never a candidate by them alone, so nothing is lost: they are added to the pairs that its other seeds find.
        """
        h, n = words.split(texts)
        each = np.split(h, np.cumsum(n)[:-1]) if len(n) else []
        seed, item, pos = [], [], []
        floors = [floor(len(w), share, least) for w in each]
        for i, w in enumerate(each):
            for m, mask in enumerate(MASKS + SHORT):
                if m not in ((4,) if 1 < floors[i] < least else (5,) if floors[i] < least else range(len(MASKS))):
                    continue
                s = seeds(w, mask, m)
                seed.append(s)
                item.append(np.full(len(s), i, np.int32))
                pos.append(np.arange(len(s), dtype=np.int32))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        s, i, p = cat(seed, np.uint64), cat(item, np.int32), cat(pos, np.int32)
        by = np.argsort(s, kind="stable")
        s, i, p = s[by], i[by], p[by]
        first = np.flatnonzero(np.diff(s, prepend=~s[:1], append=~s[-1:]) != 0)
        often = np.repeat(np.diff(first) > HOT, np.diff(first))
        later, off = {}, np.zeros(len(s), bool)
        for k, at in _grouped(i, np.flatnonzero(often)):
            reach = np.minimum(np.diff(np.sort(p[at]), append=np.iinfo(np.int32).max), WINDOW).sum()
            if floors[k] >= least and reach < seed_share * len(each[k]):
                off[at] = True
        shared = np.unique(s[off])
        number = np.searchsorted(shared, s[off])
        at_off = np.flatnonzero(off)
        for k, own in _grouped(i[off], np.arange(len(at_off))):
            later[k] = (number[own], p[at_off[own]])
        seen = np.zeros(1 << bits, bool)
        seen[(s >> np.uint64(64 - bits)).astype(np.int64)] = True
        return Items(ids, each, s[~off], i[~off], p[~off], seen, any(f < least and len(w) > 0 for f, w in zip(floors, each)), shared, later)


def passages(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int, int, int, np.ndarray]]:
    """Local alignments (equal words, item from, item to, doc from, doc to, path) of at least ``least`` points, best first.

    One point for an equal word, minus one for an inserted word, minus CHANGED for a changed or lost word
    of the item: a sentence that shares its pattern but not its content words with the item earns nothing.
    A stretch of the item is found at every place that holds it: only the words of the item against the words
    of the document that were taken together are out afterwards.  The path has, for each equal word, its place
    in the item and in the document and the points so far.  A whole item ends the search.
    """
    n = len(item)
    eq = item[:, None] == doc[None, :]
    H = np.zeros((n + 1, len(doc) + 1), np.int32)
    step = np.arange(len(doc) + 1, dtype=np.int32)
    found, a, b = [], 0, len(doc)
    top = np.zeros(len(doc) + 1, np.int32)
    while True:
        for i in range(1, n + 1):
            row = np.zeros(b - a + 1, np.int32)
            row[0] = H[i, a]
            row[1:] = np.where(eq[i - 1, a:b], H[i - 1, a:b] + 1, H[i - 1, a:b] - CHANGED)
            np.maximum(row[1:], H[i - 1, a + 1 : b + 1] - CHANGED, out=row[1:])
            np.maximum(row, 0, out=row)
            H[i, a : b + 1] = np.maximum.accumulate(row + step[: b - a + 1]) - step[: b - a + 1]
        top[a : b + 1] = H[:, a : b + 1].max(axis=0)
        score = int(top.max())
        if score < least:
            return found
        at = np.flatnonzero(top == score)
        i, j = np.unravel_index(int(H[:, at].argmax()), (n + 1, len(at)))
        i, j = int(i), int(at[j])
        i1, j1, path = i, j, []
        while H[i, j] > 0:
            hit = eq[i - 1, j - 1]
            if H[i, j] == H[i - 1, j - 1] + (1 if hit else -CHANGED):
                if hit:
                    path.append((i - 1, j - 1, int(H[i, j])))
                i, j = i - 1, j - 1
            elif H[i, j] == H[i - 1, j] - CHANGED:
                i -= 1
            else:
                j -= 1
        found.append((len(path), i, i1, j, j1, np.array(path[::-1], np.int64)))
        if len(path) == n:
            return found
        eq[i:i1, j:j1] = False
        # a passage spans less than twice the item, so nothing changes beyond
        a, b = j, min(len(doc), j1 + 2 * n)


def dense_stretches(doc: np.ndarray, item: np.ndarray, slice_: int = 16_384) -> tuple[int, np.ndarray]:
    """(words of the item, places in the document) inside some stretch of five on one diagonal of which four words are equal.

    Passages hold no more words than that, but for passages with more changes.  The document is gone
    through in slices, so a text of any length takes the same memory.
    """
    if min(len(doc), len(item)) < 5:
        return len(item), np.arange(len(doc))
    n, seen, places = len(item) - 4, np.zeros(len(item) - 4, bool), []
    for a in range(0, len(doc) - 4, slice_):
        part = doc[a : a + slice_ + 4]
        m = len(part) - 4
        eq = (item[:, None] == part[None, :]).view(np.uint8)
        near = eq[:n, :m] + eq[1 : n + 1, 1 : m + 1]
        for k in (2, 3, 4):
            near += eq[k : n + k, k : m + k]
        hit = near >= 4
        seen |= hit.any(axis=1)
        places.append(a + np.flatnonzero(hit.any(axis=0)))
    rows = np.flatnonzero(seen)
    return int(np.minimum(np.diff(rows, append=rows[-1] + 5), 5).sum()) if len(rows) else 0, np.concatenate(places)


def around(doc: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """The document without what is farther than ``reach`` from the places; each gap becomes a run that no passage can cross."""
    keep = np.zeros(len(doc) + 1, np.int64)
    np.add.at(keep, np.maximum(places - reach, 0), 1)
    np.add.at(keep, np.minimum(places + reach, len(doc)), -1)
    inside = np.cumsum(keep[:-1]) > 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    wall = np.zeros(reach, doc.dtype)
    return np.concatenate([x for a, b in zip(edge[::2], edge[1::2]) for x in (doc[a:b], wall)]) if len(edge) else doc[:0]


def all_passages(doc: np.ndarray, item: np.ndarray, least: int, slice_: int = 50_000) -> list[tuple[int, int, int, int, int, np.ndarray]]:
    """passages() of a document of any length: in slices that overlap by twice what a passage can span.

    A passage in an overlap is found twice; as both cover the same words of the item, a chain takes one.
    """
    if len(doc) <= slice_:
        return passages(doc, item, least)
    out = []
    for a in range(0, len(doc), slice_):
        out += [(s, i, j, a + x, a + y, path + (0, a, 0)) for s, i, j, x, y, path in passages(doc[a : a + slice_ + 4 * len(item)], item, least)]
    return out


def in_order(parts: list[tuple]) -> int:
    """Most equal words in a chain of whole passages that follow each other in the item and in the document."""
    parts = sorted(parts, key=lambda p: p[3])
    best = []
    for k, p in enumerate(parts):
        best.append(p[0] + max((best[m] for m in range(k) if parts[m][2] <= p[1] and parts[m][4] <= p[3]), default=0))
    return max(best, default=0)


def chained(parts: list[tuple], size: int, least: int) -> int:
    """Most equal words in a chain as in in_order(), in which passages may be cut at either end to pieces of at least ``least`` points.

    Passages that overlap in the item are needed in part only: those of words 0 to 35 and 25 to 60 hold all 60.
    """
    if not parts:
        return 0
    most = len(np.unique(np.concatenate([p[5][:, 0] for p in parts])))
    if max(p[0] for p in parts) == most or len(parts) < 64 and in_order(parts) == most:
        return most
    of = np.repeat(np.arange(len(parts)), [len(p[5]) for p in parts])
    nth = np.concatenate([np.arange(len(p[5])) for p in parts])
    item, doc = (np.concatenate([p[5][:, c] for p in parts]) for c in (0, 1))
    before = [np.zeros(len(p[5]), np.int64) for p in parts]  # the best chain before a piece that begins with this word
    ended, late = np.zeros(size + 1, np.int64), []  # the best chain that has ended before this word of the item
    order, now = np.argsort(doc, kind="stable").tolist(), -1
    for x in order:
        if doc[x] > now:
            for i, v in late:
                np.maximum(ended[i + 1 :], v, out=ended[i + 1 :])
            late, now = [], doc[x]
        k, z = of[x], nth[x]
        before[k][z] = ended[item[x]]
        points = parts[k][5][: z + 1, 2]
        begin = np.flatnonzero(points[z] - points + 1 >= least)
        if len(begin):
            late.append((item[x], int((before[k][begin] + z - begin).max()) + 1))
    return max([int(ended[-1]), *(v for _, v in late)])


class Finder:
    def __init__(self, items: Items, words: Words, share: float, least: int, seed_share: float):
        self.items, self.words, self.share, self.least, self.seed_share = items, words, share, least, seed_share
        self.bits = np.uint64(64 - int(np.log2(len(items.filter))))
        self.need = np.array([len(w) for w in items.words], np.int64)

    def find(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text number, item number, share of the item's words found) of every leak in the texts."""
        return self.find_in(*self.words.split(texts))

    def find_in(self, h: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float]]:
        """find() in texts that are words already: the hashes of all words and how many each text has."""
        start = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)
        doc, item, at, few, held = [], [], [], [], []
        t = self.items
        for m, mask in enumerate(MASKS + SHORT if t.short else MASKS):
            s = seeds(h, mask, m)
            p = np.flatnonzero(t.filter[(s >> self.bits).astype(np.int64)])
            p = p[of[p] == of[p + len(mask) - 1]]
            if len(t.shared):
                number = np.minimum(np.searchsorted(t.shared, s[p]), len(t.shared) - 1)
                has = t.shared[number] == s[p]
                held.append(np.unique(of[p[has]].astype(np.int64) * len(t.shared) + number[has]))
            lo, hi = np.searchsorted(t.seed, s[p], "left"), np.searchsorted(t.seed, s[p], "right")
            k = hi - lo
            p, lo, k = p[k > 0], lo[k > 0], k[k > 0]
            if len(p):
                q = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                if m >= len(MASKS):
                    few.append((np.repeat(of[p], k).astype(np.int64) * len(t.ids) + t.item[q], np.repeat(p, k)))
                    continue
                doc.append(np.repeat(of[p], k))
                item.append(t.item[q])
                at.append(t.pos[q])
        out = self._short(h, start, n, few) if few else []
        if not doc:
            return out
        doc, item, at = (np.concatenate(x) for x in (doc, item, at))
        key = doc.astype(np.int64) * len(t.ids) + item
        wide = int(self.need.max()) + 1
        if t.later and held:
            held = np.unique(np.concatenate(held))
            for k in np.unique(key).tolist():
                d, i = divmod(k, len(t.ids))
                if i in t.later:
                    number, p = t.later[i]
                    got = p[np.isin(d * len(t.shared) + number, held)]
                    key, at = np.append(key, np.full(len(got), k)), np.append(at, got)
        key, at = np.divmod(np.unique(key * wide + at), wide)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        # length of the union of the windows of a pair
        reach = np.diff(at, append=0)
        reach[np.append(first[1:] - 1, len(key) - 1)] = WINDOW
        covered = np.add.reduceat(np.minimum(reach, WINDOW), first)
        for k in key[first][covered >= self.seed_share * self.need[key[first] % len(t.ids)]].tolist():
            d, i = divmod(k, len(t.ids))
            size, w = int(self.need[i]), h[start[d] : start[d] + n[d]]
            dense, places = dense_stretches(w, t.words[i])
            if dense < self.share * size:
                continue
            got = chained(all_passages(around(w, places, 2 * size), t.words[i], self.least), size, self.least)
            if got >= self.share * size:
                out.append((d, i, got / size))
        return out


    def _short(self, h: np.ndarray, start: np.ndarray, n: np.ndarray, few: list) -> list[tuple[int, int, float]]:
        """find() of items with a floor of their own: every pair with a hit is aligned around its hits."""
        key, at = (np.concatenate(x) for x in zip(*few))
        by = np.argsort(key, kind="stable")
        key, at, out = key[by], at[by], []
        for k, places in zip(key[(edge := np.flatnonzero(np.diff(key, prepend=-1)))].tolist(), np.split(at, edge[1:])):
            d, i = divmod(k, len(self.items.ids))
            size, w = int(self.need[i]), h[start[d] : start[d] + n[d]]
            least = floor(size, self.share, self.least)
            got = chained(all_passages(around(w, np.unique(places - start[d]), 2 * size), self.items.words[i], least), size, least)
            if got >= self.share * size:
                out.append((d, i, got / size))
        return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", share: float = 0.5, least: int = 6, seed_share: float = 0.2, block_items: int = 20_000, chars: int = 1_000_000) -> DataFrame:
    """(doc_key, item_key, share_found): documents that hold at least ``share`` of an item's words as passages in its order.

    A passage scores at least ``least`` (equal words less inserted ones and twice the changed or lost ones), so shared
    phrases and scattered words add nothing.  Pairs are looked at when seed hits cover ``seed_share`` of the item.
    Of items too short for that (``share`` of their words is below ``least``) passages count from that share on, and every
    document with two of their words in a row, or one where one is enough, is looked at; no length is excluded.
    Items are taken in blocks of ``block_items`` (a block with its seeds is about 100 MB at most for
    items of 100 words), each block against all documents; with more than one block the documents are
    split into words once and their hashes are kept as a table.  Null or empty texts and items without a
    word give no row; repeated documents give their row each time; repeated items count as one each.
    """
    spark = docs.sparkSession
    q = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull()).distinct()
    blocks = max(1, -(-q.count() // block_items))
    src = docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    kinds = [src.schema["k"].dataType.simpleString(), q.schema["i"].dataType.simpleString()]
    forms = tables(published(spark))
    maps, fold = spark.sparkContext.broadcast(forms), spark.sparkContext.broadcast(fold_table())
    if blocks > 1:
        src = table(src.mapInArrow(_hashed(maps, fold, chars), f"k {kinds[0]}, t binary"))
    words, result = Words(former(forms), fold_table()), None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        block = spark.sparkContext.broadcast(Items.build([r[0] for r in rows], [r[1] for r in rows], words, share=share, least=least, seed_share=seed_share))
        part = src.mapInArrow(_search(block, maps, fold, share, least, seed_share, chars, to_arrow_schema(q.select("i").schema).field(0).type), f"k {kinds[0]}, i {kinds[1]}, share_found double")
        result = part if result is None else result.unionByName(part)
    return result.select(F.col("k").alias(doc_key), F.col("i").alias(item_key), "share_found")


def _search(block, maps, fold, share, least, seed_share, chars, item_type):
    def run(batches):
        finder = Finder(block.value, Words(former(maps.value), fold.value), share, least, seed_share)
        ids = finder.items.ids
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            rows, item, got = [], [], []
            for at, part in _pieces(texts, chars):
                if isinstance(part[0], bytes):
                    found = finder.find_in(np.frombuffer(b"".join(part), np.uint64), np.array([len(x) // 8 for x in part]))
                else:
                    found = finder.find(part)
                for d, i, s in found:
                    rows.append(at + d)
                    item.append(ids[i])
                    got.append(s)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(item, item_type), pa.array(got, pa.float64())], names=["k", "i", "share_found"])

    return run


def _pieces(texts: pa.Array, chars: int):
    """(number of the first text, texts) in pieces of about ``chars``, so that memory does not follow the batch."""
    at, size, part = 0, 0, []
    for n in range(len(texts)):
        part.append(texts[n].as_py())
        size += len(part[-1])
        if size >= chars or n == len(texts) - 1:
            yield at, part
            at, size, part = n + 1, 0, []


def _hashed(maps, fold, chars):
    def run(batches):
        words = Words(former(maps.value), fold.value)
        for b in batches:
            out = []
            for _, part in _pieces(b.column(1), chars):
                h, n = words.split(part)
                end = np.cumsum(n)
                out += [h[a - k : a].tobytes() for a, k in zip(end.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["k", "t"])

    return run
