"""Passages of evaluation items inside a corpus of subtitle files.

Items and documents become sequences of folded words, in which the usual recognition errors
vanish. Both are written as templates: numbers, and names and units, become typed
placeholders, all other words of the items stay. Windows of the items' words and places whose
spacing differs are hashed; those of each document are joined with them by hash where the
document lies, a damaged word as every word it may stand for, and followed in both directions
as long as the words agree (a verbatim passage). Windows of the templates are joined likewise;
one whose slots hold other values is followed as long as
each slot value of the item stands for one value of the document and the other way round
(the item asked again with other parameters).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.subtitles import cues, fold
from brindle.session import spread

#: A number, of digits and the letters taken for them.
NUMBER = re.compile(r"(?=.*\d)[0-9oOlI|sS]+$")
DIGIT = re.compile(r"[0-9]")
DIGITS = str.maketrans("oOlI|sS", "0011155")
EDGES = ".,;:!?\u00a1\u00bf\u2026\u2013\u2014\"'\u00ab\u00bb\u201c\u201d\u201e()[]-"
#: Words of a window, of the template or of the item itself.
WINDOW = 4
#: How many words of the item and of the document a spacing error may put in place of each other.
SPACED = ((1, 2), (2, 1), (2, 2), (1, 3), (3, 1))
#: Distinct words of documents whose readings an executor keeps.
KEPT = 500_000
#: Words of a window that are no placeholders; with fewer it says nothing.
FRAMES = 2
#: Share of the items in which a template word must stand.
FEW = 0.02
#: Items whose index is sent to the executors at a time.
BLOCK = 20_000
LEAKS = "item_id bigint, doc_id bigint, kind string, words int, at int"


def plain(text: str) -> bytes:
    """fold() after accents are taken off instead of accented letters left out."""
    return fold("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))


def split_h(word: str) -> bytes:
    """fold() of a word in which h may have been taken for li."""
    return fold(word.replace("li", "h"))


def split_d(word: str) -> bytes:
    """fold() of a word in which cl is el with a misread sign, and no d."""
    return fold(word.replace("cl", "el").replace("CL", "EL"))


def tokens(words: list[str]) -> tuple[list[bytes], list[int]]:
    """Folded words that are not empty, numbers as # and their digits; and the position of each among the words."""
    out, at = [], []
    if not words:
        return out, at
    for i, (w, f) in enumerate(zip(words, fold(" ".join(words)).split(b" "), strict=True)):
        if not w.isalpha() and DIGIT.search(w):
            n = w.strip(EDGES)
            if NUMBER.match(n):
                f = b"#" + n.translate(DIGITS).encode()
        if f:
            out.append(f)
            at.append(i)
    return out, at


@dataclass
class Index:
    """Items and the windows of their templates."""

    ids: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    toks: list[list[bytes]] = field(default_factory=list)
    at: list[list[int]] = field(default_factory=list)
    frames: frozenset[bytes] = frozenset()
    known: frozenset[bytes] = frozenset()
    windows: dict[tuple[bytes, ...], list[tuple[int, int]]] = field(default_factory=dict)
    grams: dict[tuple[bytes, ...], list[tuple[int, int]]] = field(default_factory=dict)
    gram: int = WINDOW
    joins: dict[int, dict[bytes, list[tuple[int, int, int]]]] = field(default_factory=dict)
    pairs: dict[bytes, dict[bytes, list[tuple[int, int]]]] = field(default_factory=dict)
    plains: dict[bytes, set[bytes]] = field(default_factory=dict)
    splits: dict[bytes, set[tuple[bytes, bool]]] = field(default_factory=dict)
    letters: dict[bytes, set[tuple[bytes, bool]]] = field(default_factory=dict)
    edits: dict[bytes, set[tuple[bytes, bool]]] = field(default_factory=dict)
    read: dict[str, tuple[bytes, ...]] = field(default_factory=dict)
    folded: dict[str, bytes] = field(default_factory=dict)

    def readings(self, word: str, b: bytes) -> tuple[bytes, ...]:
        """The items' words that a document's word, b when folded, may stand for: those that Passage.same accepts."""
        got = self.read.get(word)
        if got is None:
            out = {b} if b in self.known else set()
            if b[:1] != b"#":
                out |= self.plains.get(plain(word), set())
                out |= {a for a, li in self.splits.get(split_h(word), ()) if li or "li" in word}
                out |= {a for a, cl in self.letters.get(split_d(word), ()) if cl or "cl" in word.lower()}
                odd = _odd(word)
                out |= {a for key in _shorter(b) for a, marked in self.edits.get(key, ()) if (odd or marked) and _edits(a, b)}
            if len(self.read) >= KEPT:
                self.read.clear()
            got = self.read[word] = tuple(out)
        return got

    def kinds(self, toks: list[bytes]) -> list[bytes]:
        """The template: n for a number, u for a unit or other value after a number, x for a name or other value, and the words
        of the template as they are."""
        frames = self.frames
        return [b"#n" if t[:1] == b"#" else t if t in frames else b"#u" if before[:1] == b"#" else b"#x" for before, t in zip([b"", *toks], toks, strict=False)]


def token_counts(rows: list[tuple[int, str]]) -> dict[bytes, list[int]]:
    """Of each folded word: its places, those where it looks like a name or unit, and the items that hold it.

    A name is a word with a capital inside a sentence, a unit a word that follows a number.
    """
    out: dict[bytes, list[int]] = {}
    for _, text in rows:
        words = text.split()
        toks, at = tokens(words)
        for k, (t, i) in enumerate(zip(toks, at, strict=True)):
            c = out.setdefault(t, [0, 0, 0])
            c[0] += 1
            inside = i > 0 and words[i - 1][-1] not in ".?!:"
            c[1] += t[:1] != b"#" and (inside and words[i].strip(EDGES)[:1].isupper() or k > 0 and toks[k - 1][:1] == b"#")
        for t in set(toks):
            out[t][2] += 1
    return out


def is_frame(word: bytes, places: int, slots: int, items_with: int, items: int) -> bool:
    """Whether a word belongs to the templates: no number, no name or unit for half of its places, and in FEW of the items or more."""
    return word[:1] != b"#" and 2 * slots < places and items_with > FEW * items


def frame_words(items: DataFrame) -> frozenset[bytes]:
    """The words of the templates of all items (i, t). Each stands in FEW of the items at least, so there are no more than
    the words of an item by 1 / FEW."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = token_counts(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            n = [b.num_rows] + [0] * len(c)  # the items themselves under the empty word
            yield pa.RecordBatch.from_arrays([pa.array([b"", *c], pa.binary()), *[pa.array([0, *[v[j] for v in c.values()]], pa.int64()) for j in range(3)], pa.array(n, pa.int64())], names=["w", "p", "s", "i", "n"])

    sums = items.mapInArrow(work, "w binary, p bigint, s bigint, i bigint, n bigint").groupBy("w").agg(*[F.sum(c).alias(c) for c in "psin"])
    total = (sums.filter(F.col("w") == b"").first() or {"n": 0})["n"]
    often = sums.filter((F.col("i") > FEW * total) & (2 * F.col("s") < F.col("p"))).collect()
    return frozenset(bytes(r["w"]) for r in often if is_frame(bytes(r["w"]), r["p"], r["s"], r["i"], total))


def build_index(rows: list[tuple[int, str]], least: int = WINDOW, frames: frozenset[bytes] | None = None) -> Index:
    """Index of items, whose runs of ``least`` words or more are sought. frames: the words of the templates, if they come from more items than these."""
    ix = Index()
    for ident, text in rows:
        words = text.split()
        toks, at = tokens(words)
        if toks:
            ix.ids.append(ident)
            ix.words.append(words)
            ix.toks.append(toks)
            ix.at.append(at)
    counts = token_counts(rows)
    ix.known = frozenset(counts)
    ix.frames = frozenset(t for t, c in counts.items() if is_frame(t, *c, len(ix.toks))) if frames is None else frames
    windows: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
    for n, toks in enumerate(ix.toks):
        kinds = ix.kinds(toks)
        for p in range(len(kinds) - WINDOW + 1):
            if sum(k[:1] != b"#" for k in kinds[p : p + WINDOW]) >= FRAMES:
                windows[tuple(kinds[p : p + WINDOW])].append((n, p))
    ix.windows = dict(windows)
    _add_seeds(ix, least)
    return ix


def _add_seeds(ix: Index, least: int) -> None:
    """What a run of ``least`` words holds at least one of: ``gram`` words one by one, or words in other spacing."""
    ix.gram = max(1, min(WINDOW, least))
    grams, plains, splits, letters, edits = defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    joins: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {k: defaultdict(list) for k in (1, 2, 3)}
    pairs: dict[bytes, dict[bytes, list[tuple[int, int]]]] = {}
    for n, (words, toks, at) in enumerate(zip(ix.words, ix.toks, ix.at, strict=True)):
        for p in range(len(toks)):
            if p + ix.gram <= len(toks):
                grams[tuple(toks[p : p + ix.gram])].append((n, p))
            for k, b in SPACED:
                if p + k <= len(toks):
                    u = "".join(words[at[p] : at[p + k - 1] + 1])
                    for key in {fold(u), split_h(u)}:
                        if len(key) > 2 and k == b:
                            pairs.setdefault(key, {}).setdefault(toks[p], []).append((n, p))
                        elif len(key) > 2:
                            joins[b][key].append((n, p, k))
            a, u = toks[p], words[at[p]]
            if a[:1] == b"#":
                continue
            if not u.isascii():
                plains[plain(u)].add(a)
            splits[split_h(u)].add((a, "li" in u))
            letters[split_d(u)].add((a, "cl" in u.lower()))
            if len(a) > 3:
                for key in _shorter(a):
                    edits[key].add((a, _odd(u)))
    ix.pairs, ix.letters = pairs, dict(letters)
    ix.grams, ix.joins, ix.plains, ix.splits, ix.edits = dict(grams), {k: dict(v) for k, v in joins.items()}, dict(plains), dict(splits), dict(edits)


def _shorter(a: bytes) -> set[bytes]:
    """A word and it with one sign left out; words one edit apart share one of these."""
    return {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))}


def _edits(a: bytes, b: bytes) -> bool:
    """Whether at most one insertion, deletion or change leads from a to b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _odd(word: str) -> bool:
    """Whether a word bears the marks of damage or of an accent: signs beyond ASCII, a digit or a mark between letters."""
    w = word.strip(EDGES)
    return not w.isascii() or (not w.isalpha() and any(c in "0123456789|?" for c in w))


class Passage:
    """A document's words beside an item's."""

    def __init__(self, ix: Index, n: int, words: list[str], toks: list[bytes], at: list[int]):
        self.iw, self.it, self.ia, self.folded = ix.words[n], ix.toks[n], ix.at[n], ix.folded
        self.dw, self.dt, self.da = words, toks, at

    def same(self, i: int, j: int) -> bool:
        a, b = self.it[i], self.dt[j]
        if a == b:
            return True
        if a[:1] == b"#" or b[:1] == b"#":
            return False
        u, v = self.iw[self.ia[i]], self.dw[self.da[j]]
        if not u.isascii() and plain(u) == plain(v):
            return True
        if ("li" in u or "li" in v) and split_h(u) == split_h(v):
            return True
        if ("cl" in u or "cl" in v or "CL" in u or "CL" in v) and split_d(u) == split_d(v):
            return True
        return (_odd(u) or _odd(v)) and len(a) > 3 and _edits(a, b)

    def step(self, i: int, j: int, way: int) -> tuple[int, int]:
        """How many words of the item and of the document agree next, (0, 0) if none: one each, or several whose spacing differs."""
        if not (0 <= i < len(self.it) and 0 <= j < len(self.dt)):
            return 0, 0
        if self.same(i, j):
            return 1, 1
        for a, b in SPACED:
            x, y = (i, j) if way > 0 else (i - a + 1, j - b + 1)
            if self.spaced(x, y, a, b):
                return a, b
        return 0, 0

    def spaced(self, x: int, y: int, a: int, b: int) -> bool:
        """Whether a words of the item from x on and b of the document from y on differ in spacing only."""
        if x < 0 or y < 0 or x + a > len(self.it) or y + b > len(self.dt):
            return False
        s, t = self.it[x], self.dt[y]
        # what follows a word of two signs or more doesn't change its first sign
        if s[0] != t[0] and s[0] != 35 and t[0] != 35 and len(s) > 1 and len(t) > 1 and "li" not in self.iw[self.ia[x]] and "li" not in self.dw[self.da[y]]:
            return False
        u = "".join(self.iw[self.ia[x] : self.ia[x + a - 1] + 1])
        v = "".join(self.dw[self.da[y] : self.da[y + b - 1] + 1])
        p = self.folded.get(u)
        if p is None:
            p = self.folded[u] = fold(u)
        return (len(p) > 2 or u == v) and (p == fold(v) or ("li" in u or "li" in v) and split_h(u) == split_h(v)) and DIGIT.findall(u) == DIGIT.findall(v)

    def run(self, i: int, j: int, a: int = 1, b: int = 1) -> tuple[int, int, int, int]:
        """Bounds (item from, to, document from, to) of the agreeing words around a words from i on and b from j on, which agree."""
        lo, lj = i, j
        while (s := self.step(lo - 1, lj - 1, -1)) != (0, 0):
            lo, lj = lo - s[0], lj - s[1]
        hi, hj = i + a, j + b
        while (s := self.step(hi, hj, 1)) != (0, 0):
            hi, hj = hi + s[0], hj + s[1]
        return lo, hi, lj, hj

    def template_run(self, i: int, j: int, ik: list[bytes], dk: list[bytes]) -> tuple[int, int]:
        """(words, slots that differ) of the longest template match through i and j with consistent slots."""
        there: dict[bytes, bytes] = {}
        back: dict[bytes, bytes] = {}

        def fits(a: int, b: int) -> bool:
            if not (0 <= a < len(ik) and 0 <= b < len(dk)) or ik[a] != dk[b]:
                return False
            if ik[a][:1] != b"#":
                return True
            return there.setdefault(self.it[a], self.dt[b]) == self.dt[b] and back.setdefault(self.dt[b], self.it[a]) == self.it[a]

        lo = 0
        while fits(i + lo, j + lo):
            lo += 1
        up = -1
        while fits(i + up, j + up):
            up -= 1
        return lo - up - 1, sum(a != b for a, b in there.items())


def _seeds(ix: Index, words: list[str], toks: list[bytes], at: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(item number, its word, the document's word, and how many of either) where a run may begin to be followed.

    A run of agreeing words has a place where spacing differs, or all its words agree one by one and every window of
    them is found, so no run is missed.
    """
    read, size, grams = ix.read, ix.gram, ix.grams
    forms = [read[words[i]] if words[i] in read else ix.readings(words[i], t) for i, t in zip(at, toks, strict=True)]
    one = [f[0] if f else b"" for f in forms]
    for j, window in enumerate(zip(*(one[k:] for k in range(size)), strict=False)):
        if window in grams:
            for n, p in grams[window]:
                yield n, p, j, 1, 1
    for j in sorted({k for i, f in enumerate(forms) if len(f) > 1 for k in range(max(0, i - size + 1), min(i, len(forms) - size) + 1)}):
        for window in product(*forms[j : j + size]):
            for n, p in grams.get(window, ()):
                yield n, p, j, 1, 1
    ends = [words[i] for i in at]
    # a word and those after it that fold to nothing
    heads = ends if len(at) == len(words) else ["".join(words[i:k]) for i, k in zip(at, [*at[1:], len(words)], strict=True)]
    spans = ends
    for b in (1, 2, 3):
        if b > 1:
            spans = [x + y for x, y in zip(heads, spans[1:], strict=False)]
        if not spans:
            return
        folded = fold(" ".join(spans)).split(b" ") if b > 1 else [fold(v) if t[0] == 35 else t for t, v in zip(toks, spans, strict=True)]
        joins, pairs, places = ix.joins[b], ix.pairs if b == 2 else {}, range(len(spans))
        li = [j for j, v in enumerate(spans) if "li" in v]
        for at_j, keys in ((places, folded), (li, split_h(" ".join([spans[j] for j in li])).split(b" ") if li else [])):
            if not joins.keys().isdisjoint(keys):
                for j, key in zip(at_j, keys, strict=True):
                    if key in joins:
                        for n, p, a in joins[key]:
                            yield n, p, j, a, b
            if not pairs or pairs.keys().isdisjoint(keys):
                continue
            for j, key in zip(at_j, keys, strict=True):
                if key in pairs:
                    for first, where in pairs[key].items():
                        # two words that are the item's two are no other spacing
                        if first != toks[j]:
                            for n, p in where:
                                yield n, p, j, 2, 2


def _edge(words: list[str], start: int, end: int) -> int:
    """Words among those from start to end that fold to nothing and yet have letters."""
    return sum(any(c.isalpha() for c in w) for w in words[max(0, start) : end])


def _length(ix: Index, n: int, words: list[str], at: list[int], run: tuple[int, int, int, int]) -> int:
    """Words of the item in a run, with those beside it that fold to nothing and stand beside it in the document, too."""
    lo, hi, lj, hj = run
    ia, iw = ix.at[n], ix.words[n]
    length = ia[hi - 1] - ia[lo] + 1
    for i, j, item_end, doc_end in ((lo - 1, lj - 1, ia[lo], at[lj]), (hi, hj, None, None)):
        if item_end is not None:
            a, b = _edge(iw, ia[i] + 1 if i >= 0 else 0, item_end), _edge(words, at[j] + 1 if j >= 0 else 0, doc_end)
        else:
            a, b = _edge(iw, ia[hi - 1] + 1, ia[i] if i < len(ia) else len(iw)), _edge(words, at[hj - 1] + 1, at[j] if j < len(at) else len(words))
        length += min(a, b)
    return length


def find(ix: Index, text: str, least: int, asked_again: int) -> list[tuple[int, str, int, int]]:
    """(item number, kind, words, position in the document) of each item that a document speaks."""
    spoken: list[list[str]] = []
    plain_words: list[str] = []
    doubt = False
    for cue in cues(text):
        for line in cue:
            said = line.split()
            spoken.append(said)
            # a label in a line of capitals looks like its words
            while said and said[0][-1] == ":" and len(said[0]) > 3 and said[0].isupper():
                doubt = doubt or fold(said[0]) in ix.known
                said = said[1:]
            plain_words += said
    found = _find(ix, plain_words, least, asked_again)
    if not doubt:
        return found
    # it may be a word of an item, so both readings are followed
    best: dict[tuple[int, str], tuple[int, str, int, int]] = {}
    for f in [*found, *_find(ix, list(chain.from_iterable(spoken)), least, asked_again)]:
        if f[2] > best.get(f[:2], (0, "", 0, 0))[2]:
            best[f[:2]] = f
    return [f for f in best.values() if f[1] == "verbatim" or (f[0], "verbatim") not in best]


def _find(ix: Index, words: list[str], least: int, asked_again: int) -> list[tuple[int, str, int, int]]:
    if not words:
        return []
    toks, at = tokens(words)
    kinds = ix.kinds(toks)
    best: dict[int, tuple[int, int]] = {}
    again: dict[int, tuple[int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    # the item's own words, followed in both directions
    for n, p, j, a, b in _seeds(ix, words, toks, at):
        if done.get((n, p - j), -1) > j:
            continue
        passage = Passage(ix, n, words, toks, at)
        if (a, b) == (2, 2) and passage.same(p, j) and passage.same(p + 1, j + 1) or (a, b) != (1, 1) and not passage.spaced(p, j, a, b):
            continue
        lo, hi, lj, hj = passage.run(p, j, a, b)
        if (a, b) == (1, 1):
            done[n, p - j] = hj
        length = _length(ix, n, words, at, (lo, hi, lj, hj)) if hi - lo >= least - 8 else hi - lo
        if length > best.get(n, (0, 0))[0]:
            best[n] = (length, at[lj])
    diagonals: dict[tuple[int, int], list[int]] = defaultdict(list)
    for j, window in enumerate(zip(*(kinds[k:] for k in range(WINDOW)), strict=False)):
        if window in ix.windows:
            for n, p in ix.windows[window]:
                diagonals[n, p - j].append(j)
    for (n, offset), js in diagonals.items():
        # a template run of that many words holds a third as many windows with words enough, on one diagonal
        if 3 * len(js) < asked_again or best.get(n, (0, 0))[0] >= least:
            continue
        end, ik = -1, ix.kinds(ix.toks[n])
        for j in js:
            if j >= end:
                length, other = Passage(ix, n, words, toks, at).template_run(j + offset, j, ik, kinds)
                end = j + max(1, length)
                if other and length > again.get(n, (0, 0))[0]:
                    again[n] = (length, at[j])
    out = [(n, "verbatim", w, a) for n, (w, a) in best.items() if w >= least]
    taken = {n for n, *_ in out}
    return out + [(n, "asked again", w, a) for n, (w, a) in again.items() if w >= asked_again and n not in taken]


def leaks(
    documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 12, asked_again: int = 24
) -> DataFrame:
    """(item_id, doc_id, kind, words, at): items whose passages documents speak.

    kind is ``verbatim`` for at least ``least`` consecutive words of the item, spoken in order
    (words counts the longest run), or ``asked again`` for at least ``asked_again`` words of the
    item's template with other values in its slots, consistently. at is the position of the
    passage among the document's spoken words. One row an item, document and kind at most.

    Items are a stated query set: their index is sent to the executors in blocks of BLOCK
    items, and each document is searched whole where it is read, so nothing is shuffled and
    copies of a document cost no more than other documents. Null or empty texts, and items
    without words, match nothing; items with a null id are left out; documents with a null id
    are reported with it. Repeated items under one id are one item each and may repeat a row.
    """
    texts = spread(documents.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    wanted = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")).na.drop()
    out, feed = None, wanted.toLocalIterator()
    rows = list(islice(feed, BLOCK))
    ahead = list(islice(feed, BLOCK))
    frames = frame_words(wanted) if ahead else None

    def search(rows: list[tuple[int, str]]) -> DataFrame:
        ix = build_index(rows, least, frames)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text = text.as_py()
                    if text:
                        got += [(ix.ids[n], doc, kind, w, a) for n, kind, w, a in find(ix, text, least, asked_again)]
                cols = list(zip(*got, strict=True)) if got else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "doc_id", "kind", "words", "at"])

        return texts.mapInArrow(work, LEAKS)

    while rows or out is None:
        part = search([(r["i"], r["t"]) for r in rows])
        out, rows, ahead = part if out is None else out.unionByName(part), ahead, list(islice(feed, BLOCK))
    return out
