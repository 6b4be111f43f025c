"""One stored form for text that looks the same (problem 8).

Method: a batch of texts is exploded to positioned code points (one flat array of code points with
the offset of every text), joined with the broadcast decomposition and look-alike table, combining
marks are ordered by their class, starters and marks are recomposed, and the strings are rebuilt.
The explode happens inside an Arrow batch: as rows, 3 000 code points a document would have to be
shuffled back together, several times the input; here no text is ever shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.skew import salted_join
from ..session import cut

# Letters of another script that are drawn like a Latin letter.
LOOK_ALIKE = {
    # Cyrillic small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Cyrillic capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    # Greek capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small
    "ο": "o", "ν": "v",
    # hyphens of one length
    "‐": "-", "‑": "-",
}
# Further such letters, apart from the table above because the comparison SQL is built from that one.
# No two letters of a script become the same but palochka and the Cyrillic I, which are drawn alike; so texts in a script stay apart.
RARE_ALIKE = {
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "յ": "j", "Օ": "O", "Ս": "U",
    # Cyrillic palochka, straight u, izhitsa, sje
    "Ӏ": "I", "ӏ": "l", "Ү": "Y", "Ѵ": "V", "ѵ": "v", "Ԍ": "G",
    # Greek lunate sigma, yot
    "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Compatibility characters that are drawn exactly as their parts; of the Roman numerals those of one letter.
DRAWN_AS_PARTS = "µﬀﬁﬂﬃﬄ․…ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
# Decomposition tags whose mapping does not change the look beyond the cell width or line breaking.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>")
JAMO = re.compile("[\u1100-\u11ff]")


@lru_cache(maxsize=4)
def published(spark) -> tuple[tuple[str, str], ...]:
    """(letter, ASCII letter drawn like it) from the Unicode confusables data that comes with Spark's own Unicode library.

    Letters of other scripts than Latin without a decomposition whose skeleton is that of an ASCII letter; where I and l share
    one, lower-case letters become l and others I.  The tables above come first, and of the letters of one script only the
    first is drawn like a given ASCII letter: confusables that only resemble it (sigma and o) keep texts of a script apart.
    """
    checker = getattr(spark._jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
    skeletons = lambda chars: checker.getSkeleton("\n".join(chars)).split("\n")
    plain: dict[str, list[str]] = {}
    letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    for ch, k in zip(letters, skeletons(letters)):
        plain.setdefault(k, []).append(ch)
    script = lambda ch: unicodedata.name(ch, "?").split()[0]
    known = LOOK_ALIKE | RARE_ALIKE
    taken = {(script(k), v) for k, v in known.items()}
    others = [chr(c) for c in range(0x80, 0x20000) if not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xDFFF)]
    others = [ch for ch in others if unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lo") and ch not in known and not unicodedata.decomposition(ch) and script(ch) != "LATIN"]
    out = []
    for ch, k in zip(others, skeletons(others)):
        like = plain.get(k)
        if like:
            to = like[0] if len(like) == 1 else "l" if ch.islower() else "I"
            if (script(ch), to) not in taken:
                taken.add((script(ch), to))
                out.append((ch, to))
    return tuple(out)


def _parts(ch: str, more: dict[str, str]) -> str:
    """Full decomposition of one character under the same-look rules, look-alikes resolved."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or ord(ch) == 0x034F:
        return ""
    if cat == "Zs":
        return " "
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    if ch in RARE_ALIKE:
        return RARE_ALIKE[ch]
    if ch in more:
        return more[ch]
    fields = unicodedata.decomposition(ch).split()
    if fields and (fields[0][0] != "<" or fields[0] in SAME_LOOK_TAGS or ch in DRAWN_AS_PARTS):
        codes = fields[1:] if fields[0][0] == "<" else fields
        return "".join(_parts(chr(int(c, 16)), more) for c in codes)
    return ch


@lru_cache(maxsize=4)
def tables(alike: tuple[tuple[str, str], ...] = ()) -> dict[str, np.ndarray]:
    """The mapping as flat arrays; their size is bounded by the code space (sparse part about 30 KB).

    ``alike`` are look-alikes beside the tables above, as published() gives them.
    ``size[cp]`` is how many code points cp becomes, ``at[cp]`` where they start in ``flat``;
    ``mark[cp]`` is the combining class; ``pair`` and ``made`` are the primary compositions.
    """
    src, flat, at, pair, made, marks = [], [], [], [], [], []
    more = dict(alike)
    for cp in range(0x80, 0x30000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF:
            continue
        ch = chr(cp)
        k = unicodedata.combining(ch)
        if k:
            marks.append((cp, k))
        p = _parts(ch, more)
        if p != ch:
            src.append((cp, len(p)))
            at.append(len(flat))
            flat.extend(map(ord, p))
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch)) == ch:
            a, b = (int(x, 16) for x in d.split())
            pair.append((a << 21) | b)
            made.append(cp)
    for cp in range(0xE0000, 0xE01F0):
        if _parts(chr(cp), more) == "":
            src.append((cp, 0))
            at.append(len(flat))
    src_a = np.array(src, np.uint32)
    order = np.argsort(np.array(pair, np.uint64), kind="stable")
    return {
        "src": src_a[:, 0],
        "len": src_a[:, 1].astype(np.uint8),
        "at": np.array(at, np.int32),
        "flat": np.array(flat, np.uint32),
        "mark_cp": np.array([m[0] for m in marks], np.uint32),
        "mark_class": np.array([m[1] for m in marks], np.uint8),
        "pair": np.array(pair, np.uint64)[order],
        "made": np.array(made, np.uint32)[order],
    }


class Former:
    """Brings batches of text to the one form, from a broadcast mapping."""

    def __init__(self, t: dict[str, np.ndarray]):
        self.size = np.ones(0x110000, np.uint8)
        self.size[t["src"]] = t["len"]
        self.where = np.full(0x110000, -1, np.int32)
        self.where[t["src"]] = t["at"]
        self.mark = np.zeros(0x110000, np.uint8)
        self.mark[t["mark_cp"]] = t["mark_class"]
        self.flat, self.pair, self.made = t["flat"], t["pair"], t["made"]

    def form(self, texts: list[str]) -> list[str]:
        """Texts of any length, in the one form; the work is on the flat array of all their code points."""
        changed = [k for k, s in enumerate(texts) if not s.isascii()]
        if not changed:
            return texts
        todo = [unicodedata.normalize("NFC", texts[k]) if JAMO.search(texts[k]) else texts[k] for k in changed]
        lens = np.fromiter(map(len, todo), np.int64, len(todo))
        cp = np.frombuffer("".join(todo).encode("utf-32-le", "surrogatepass"), np.uint32)
        cp, lens = self._decompose(cp, lens)
        cp, lens = self._recompose(*self._order(cp, lens))
        whole = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        out, end = list(texts), np.cumsum(lens)
        for k, a, b in zip(changed, (end - lens).tolist(), end.tolist()):
            out[k] = whole[a:b]
        return out

    def form_list(self, texts: list[str], chars: int = 2_000_000) -> list[str]:
        """form() in pieces of about ``chars`` code points, so that memory does not follow the batch."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= chars:
                out += self.form(part)
                part, size = [], 0
        return out + self.form(part) if part else out

    def form_column(self, col: pa.Array) -> pa.Array:
        texts = col.to_pylist()
        done = iter(self.form_list([t for t in texts if t is not None]))
        return pa.array([None if t is None else next(done) for t in texts], pa.string())

    def _decompose(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.flatnonzero(cp > 127)
        pos = pos[self.where[cp[pos]] >= 0]
        if not len(pos):
            return cp, lens
        hit = cp[pos]
        n = self.size[hit].astype(np.int64)
        grow = np.cumsum(n - 1)
        out = np.empty(len(cp) + int(grow[-1]), np.uint32)
        keep = np.ones(len(cp), bool)
        keep[pos] = False
        shift = np.zeros(len(cp) + 1, np.int32)
        shift[pos + 1] = n - 1
        shift = np.cumsum(shift, dtype=np.int64)[:-1]
        kept = np.flatnonzero(keep)
        out[kept + shift[kept]] = cp[kept]
        start = pos + shift[pos]
        for j in range(int(n.max(initial=0))):
            m = n > j
            out[start[m] + j] = self.flat[self.where[hit[m]] + j]
        doc = np.searchsorted(np.cumsum(lens), pos, side="right")
        return out, lens + np.bincount(doc, weights=n - 1, minlength=len(lens)).astype(np.int64)

    def _order(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.flatnonzero(cp > 127)
        pos = pos[self.mark[cp[pos]] > 0]
        if len(pos) < 2:
            return cp, lens
        k = self.mark[cp[pos]]
        together = np.diff(pos) == 1
        starts = np.cumsum(lens) - lens
        together &= ~np.isin(pos[1:], starts)
        if not (together & (k[1:] < k[:-1])).any():
            return cp, lens
        run = np.concatenate([[0], np.cumsum(~together)])
        by = np.lexsort((k, run))
        cp = cp.copy()
        cp[pos] = cp[pos[by]]
        return cp, lens

    def _recompose(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.flatnonzero(cp > 127)
        pos = pos[self.mark[cp[pos]] > 0]
        end = np.cumsum(lens)
        begins = end - lens
        inside = ~np.isin(pos, begins[lens > 0])
        first = np.ones(len(pos), bool)
        first[1:] = (np.diff(pos) != 1) | ~inside[1:]
        run = np.cumsum(first) - 1
        if not len(pos):
            return cp, lens
        head = pos[first]
        open_ = inside[first]  # a mark at the start of a text has no base
        base_at = head - 1
        nth = np.arange(len(pos)) - np.flatnonzero(first)[run]
        cp = cp.copy()
        gone = np.zeros(len(cp), bool)
        last = np.zeros(len(head), np.uint8)  # class of the last mark kept after the base
        for j in range(int(nth.max()) + 1):
            at = np.flatnonzero(nth == j)
            r = run[at]
            ok = open_[r]
            at, r = at[ok], r[ok]
            p = pos[at]
            k = self.mark[cp[p]]
            key = (cp[base_at[r]].astype(np.uint64) << np.uint64(21)) | cp[p].astype(np.uint64)
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            free = (last[r] == 0) | (last[r] < k)
            made = (self.pair[i] == key) & free
            cp[base_at[r[made]]] = self.made[i[made]]
            gone[p[made]] = True
            stay = ~made
            last[r[stay]] = np.maximum(last[r[stay]], k[stay])
        if not gone.any():
            return cp, lens
        lost = np.searchsorted(end, np.flatnonzero(gone), side="right")
        return cp[~gone], lens - np.bincount(lost, minlength=len(lens))


_FORMERS: dict[int, Former] = {}


def former(t: dict[str, np.ndarray] | None = None) -> Former:
    """One Former per Python worker and mapping; without a mapping the tables above alone."""
    t = tables() if t is None else t
    size = len(t["src"])
    if size not in _FORMERS:
        _FORMERS[size] = Former(t)
    return _FORMERS[size]


def form_text(text: str | None) -> str | None:
    """The one form of a single text; None stays None."""
    return None if text is None else former().form([text])[0]


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _forms(spark):
    """The mapping, broadcast once; about 60 KB whatever the data."""
    return spark.sparkContext.broadcast(tables(published(spark)))


def one_form(df: DataFrame, text: str = "text", out: str = "text_form") -> DataFrame:
    """Adds ``out``: the text in its one form.  Map-only, every column of df is kept.

    Nulls stay null, empty texts stay empty, texts may be of any length.  ``out`` replaces a column
    of the same name (also the text itself).  An empty table gives an empty table.
    """
    maps, pos = _forms(df.sparkSession), df.columns.index(text)
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches):
        f = former(maps.value)
        for b in batches:
            formed = f.form_column(b.column(pos))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in keep), formed], names=[*keep, out])

    return df.mapInArrow(run, schema)


def look_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _look, _stored): 128-bit fingerprints of the one form and of the text as stored.

    Rows with a null text are left out: nothing is drawn, so nothing looks the same.
    """
    maps = _forms(df.sparkSession)
    small = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    kind = small.schema["_k"].dataType.simpleString()

    def run(batches):
        f = former(maps.value)
        for b in batches:
            raw = b.column(1).to_pylist()
            looks, stored = [], []
            for s, formed in zip(raw, f.form_list(raw)):
                h = _digest(s)
                stored.append(h)
                looks.append(h if formed is s else _digest(formed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(looks, pa.binary()), pa.array(stored, pa.binary())], names=["_k", "_look", "_stored"])

    return small.mapInArrow(run, f"_k {kind}, _look binary, _stored binary").withColumnRenamed("_k", key)


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, look_class, n_same_look, n_stored_forms).

    look_class is the smallest key of the documents that look the same.  Repeated rows of a key count
    as often as they come; null texts are left out.  Partial aggregation comes before the shuffle, and
    the rows meet their class through a join salted for hot classes.
    """
    ids = cut(look_ids(df, key, text))
    per = ids.groupBy("_look", "_stored").agg(F.min(key).alias("_lo"), F.count(F.lit(1)).alias("_m"))
    classes = per.groupBy("_look").agg(F.min("_lo").alias("look_class"), F.sum("_m").alias("n_same_look"), F.count(F.lit(1)).alias("n_stored_forms"))
    return salted_join(ids, classes, ["_look"], spread=key).select(key, "look_class", "n_same_look", "n_stored_forms")


def look_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (key_a < key_b) of documents that look the same but are stored differently.

    Only distinct stored forms of a look are compared with each other; exact copies are never compared,
    they are attached to each differing form afterwards, so the work is bounded by the result.
    """
    ids = cut(look_ids(df, key, text))
    forms = ids.groupBy("_look", "_stored").agg(F.count(F.lit(1)).alias("_m"))
    varied = forms.groupBy("_look").agg(F.count(F.lit(1)).alias("_n_forms")).where("_n_forms > 1").select("_look")
    forms = cut(forms.join(varied, "_look", "left_semi").select("_look", "_stored", "_m"))
    members = cut(ids.join(forms.select("_stored"), "_stored", "left_semi").select("_stored", F.col(key).alias("_k")))
    b = forms.select("_look", F.col("_stored").alias("_other"), F.col("_m").alias("_n"))
    # the form with more copies comes first: its rows are the ones that get salted
    pairs = salted_join(forms, b, ["_look"], spread="_stored").where((F.col("_m") > F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("_stored") < F.col("_other")))).select("_stored", "_other")
    left = salted_join(members, pairs, ["_stored"], spread="_k").select(F.col("_other").alias("_stored"), F.col("_k").alias("_k1"))
    both = salted_join(left, members.withColumnRenamed("_k", "_k2"), ["_stored"], spread="_k1")
    return both.where("_k1 <> _k2").select(F.least("_k1", "_k2").alias(f"{key}_a"), F.greatest("_k1", "_k2").alias(f"{key}_b")).distinct()
