"""Repairing text read off scanned pages (problem 5).

Counts of words over the whole corpus and skip-gram vectors learned on the scanned pages tell what a
page should say. A rare word is linked to a frequent neighbour that a plausible glyph edit away, or a
lost or added space, makes of it; where several fit, or the rare word is not so rare, the vectors of
the words around decide. Furniture (running heads, folios, stamps) is told by place, by what other
pages and documents repeat, and by the document's title; words cut at a line or page end are joined
if the corpus has them whole, and stay hyphenated if it has them so.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, spread

HYPHENS = "-‐‑¬­"
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_WORD = re.compile(r"[^\W_]+(?:['’\-‐][^\W_]+)*")
#: What is read for what is printed (fixed values: glyphs that look alike).
GLYPHS = {
    "rn": "m", "m": "rn", "vv": "w", "w": "vv", "ii": "u", "iii": "m", "cl": "d", "d": "cl", "li": "h", "h": "b li", "b": "h 6", "1": "l i", "l": "1 i t",
    "0": "o", "o": "0 a c e", "5": "s", "s": "5", "8": "b s", "6": "b", "9": "g", "q": "g", "g": "q 9", "f": "t", "t": "f l", "e": "c é o", "c": "e o",
    "a": "o á ä", "í": "i", "i": "í l j 1", "n": "u ri", "u": "n ii", "j": "i", "v": "y", "y": "v", "ri": "n", "ni": "m", "in": "m", "nn": "m", "2": "z", "z": "2", "é": "e",
    "ü": "ii u", "ö": "o", "ä": "a", "ó": "o", "á": "a", "ú": "u", "ñ": "n", "ß": "b", "iu": "m", "ui": "m", "]": "l", "|": "l", "!": "l", "'": "", "ı": "i",
}
_RULES = [(a, b) for a, bs in GLYPHS.items() for b in (bs.split() or [""])]
#: Counts (to CORPUS words) from which a word is broadcast and has a vector; shares bound both. The counts
#: of rarer words reach the pages that ask for them by a join. Contexts that vectors are learned on.
KNOWN, PLACED, CONTEXTS, DIM, WINDOW = 2, 8, 300, 32, 3
#: Pages of a document that are read together.
BLOCK = 256
#: Words of text to which all thresholds on counts refer: in a larger corpus counts are taken down to it,
#: so that a threshold is a share; in a smaller one it stays the least number that is evidence.
CORPUS = 2_600_000
#: A word this frequent is taken as read rightly; a neighbour must be so many times as frequent.
SURE, TIMES = 400, 12


def lower(w: str) -> str:
    return unicodedata.normalize("NFC", w).lower()


def _line_words(line: str, first: bool, last: bool) -> list[str]:
    """Words of a line without what a break may have cut."""
    found = _WORD.findall(line)
    if found and last and line.rstrip()[-1:] in HYPHENS:
        found = found[:-1]
    return found[1:] if first else found


def _with_parts(found: list[str]) -> list[str]:
    return found + [x for w in found if "-" in w for x in w.split("-")]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: lower-case words (compounds also whole) over the texts of all documents; cut words left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text.lower()
                if kind != "scan":
                    n.update(_with_parts(_WORD.findall(text)))
                    continue
                cut_before = False
                for line in re.split(r"[\n\f]", text):
                    n.update(_with_parts(_line_words(line, cut_before, True)))
                    cut_before = line.rstrip()[-1:] in HYPHENS if line.strip() else cut_before
            if len(n) > 500_000:
                yield _counted(n)
                n.clear()
        yield _counted(n)

    return spread(docs.where("text is not null").select("kind", "text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(n: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def skipgrams(pages: DataFrame, index: dict[str, int]) -> DataFrame:
    """w, c, n: how often context word c stands within WINDOW words of word w on the pages (column lines)."""
    held = pages.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held.value
        total = np.zeros(len(ids) * CONTEXTS, np.int64)
        for b in batches:
            for lines in b.column(0).to_pylist():
                x = np.array([ids.get(w, -1) for w in _WORD.findall(" ".join(l or "" for l in lines or []).lower())], np.int64)
                for gap in range(1, WINDOW + 1):
                    for w, c in ((x[:-gap], x[gap:]), (x[gap:], x[:-gap])):
                        ok = (w >= 0) & (c >= 0) & (c < CONTEXTS)
                        np.add.at(total, w[ok] * CONTEXTS + c[ok], 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array((at // CONTEXTS).astype(np.int32)), pa.array((at % CONTEXTS).astype(np.int32)), pa.array(total[at])], names=["w", "c", "n"])

    return pages.select("lines").mapInArrow(run, "w int, c int, n bigint").groupBy("w", "c").agg(F.sum("n").alias("n"))


def learn_vectors(n: np.ndarray, negative: float = 5.0, rounds: int = 60, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram with negative sampling on counts of (word, context): the expected objective, by Adam."""
    rng = np.random.default_rng(seed)
    w, c = rng.normal(0, 0.1, (n.shape[0], DIM)), rng.normal(0, 0.1, (n.shape[1], DIM))
    total = max(1.0, n.sum())
    noise = negative * n.sum(1, keepdims=True) * (n.sum(0, keepdims=True) / total)
    weight = n + noise
    scale = 1 / np.maximum(1.0, weight.sum(1, keepdims=True))
    back = 1 / np.maximum(1.0, weight.sum(0, keepdims=True))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)]
    for step in range(1, rounds + 1):
        g = n - weight / (1 + np.exp(-np.clip(w @ c.T, -30, 30)))
        grads = ((g * scale) @ c - 1e-3 * w, (g * back).T @ w - 1e-3 * c)
        for p, d, m, v in ((w, grads[0], state[0], state[1]), (c, grads[1], state[2], state[3])):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.astype(np.float32), c.astype(np.float32)


@dataclass
class Model:
    count: dict[str, float]  # to CORPUS words
    index: dict[str, int]
    word: np.ndarray
    context: np.ndarray
    edges: set[str]
    slips: set[str] = field(default_factory=set)
    one: float = 1.0  # what one word of the text counts

    def edge(self, t: str) -> bool:
        """Is the template one that stands at page edges, a slip or a lost space apart?"""
        k = re.sub(r"[# ]", "", t)
        return t in self.edges or len(k) > 7 and (k in self.slips or any(k[:i] + k[i + 1 :] in self.slips for i in range(len(k))))

    def fit_in(self, word: str, around: list[str]) -> float:
        """How well the skip-gram vectors let word stand among the words around; 0 where they can't tell."""
        i = self.index.get(word)
        c = [j for a in around if (j := self.index.get(a)) is not None and j < len(self.context)]
        if i is None or not c:
            return 0.0
        return float((self.context[c] @ self.word[i]).mean())


@dataclass
class Page:
    key: tuple
    lines: list[str]
    kinds: list[set[str]] = field(default_factory=list)
    fixes: list[dict[int, str]] = field(default_factory=list)


def template(line: str) -> str:
    t = re.sub(r"\d+", "#", lower(line))
    return " ".join(re.findall(r"[^\W\d_]+|#", t))


_ROMAN = re.compile(r"c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_FOLIO = re.compile(r"[\W_]*(?:(?:page|seite|página|p|s|pag|folio)\.?\s*)?[\dOolISzZB|]{1,4}(?:\s*(?:/|of|von|de|sur)\s*[\dOolISzZB|]{1,4})?[\W_]*", re.I)
_VOLUME = re.compile(r".{4,70},\s*(?:vol|bd|band|tome|t|vo1|voi|v0l)\.?\s*[\dOlIS]+\s*\(?.{0,6}\)?", re.I)


def is_folio(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > 24:
        return False
    if not any(c.isdigit() for c in s) and not s.lower().startswith(("page", "seite", "página")):
        bare = "".join(c for c in unicodedata.normalize("NFKD", s.strip(" .-–—[]()").lower()) if not unicodedata.combining(c))
        return bool(bare and _ROMAN.fullmatch(bare))
    bare = ""
    return bool(_FOLIO.fullmatch(s)) or bool(bare and _ROMAN.fullmatch(bare))


def _like(a: str, b: str) -> bool:
    """Equal texts but for a tenth or so of their letters."""
    return bool(a and b) and abs(len(a) - len(b)) <= 4 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.84


def mark_furniture(pages: list[Page], title: str | None, model: Model) -> None:
    """Furniture at the upper and lower edge of each page, from outside in."""
    heading = " ".join(re.findall(r"[^\W_]+", lower(title or "")))
    spots = []
    for p in pages:
        full = [i for i, l in enumerate(p.lines) if l.strip()]
        spots.append((full[:2], full[::-1][:2], len(full)))
    seen: Counter[str] = Counter()
    for p, (top, bottom, _) in zip(pages, spots):
        seen.update({template(p.lines[i]) for i in {*top[:1], *bottom[:1]}})
    repeated = [t for t, n in seen.items() if n >= 2 and t.strip("# ")]
    widths = sorted(len(l.strip()) for p in pages for l in p.lines if l.strip())
    wide = widths[len(widths) * 3 // 4] if widths else 0
    for p, (top, bottom, full) in zip(pages, spots):
        for side in (top, bottom):
            for i in side:
                if full < 2 or i in (top[-1:] if side is bottom and full < 3 else ()):
                    break
                line = p.lines[i].strip()
                t = template(line)
                words = t.replace("#", " ").split()
                plain = " ".join(words)
                named = re.findall(r"[^\W_]+", lower(re.sub(r"^\W*\d{1,4}\s{2,}|\s{2,}\d{1,4}\W*$", "", line)))
                text = " ".join(named)
                hit = is_folio(line) or bool(_VOLUME.fullmatch(line)) or model.edge(t)
                if not hit and heading and len(named) >= 2 and side is top:
                    hit = heading.startswith(text) or _like(text, heading[: len(text)])
                if not hit and side is top and re.fullmatch(r"\S.{1,40}\s(et\s*a[l1]|u\.\s*a|y\s+co[l1]s?|et\s+coll?)\.?(\s+\d{1,4})?", line):
                    hit = True
                if not hit and plain and len(line) < max(60, wide):
                    hit = any(t == r or _like(t, r) for r in repeated) and not line.endswith((",", ".", ";"))
                if not hit:
                    break
                p.kinds[i].add("furniture")


class Reader:
    """Finds what is wrong in the words of one document."""

    def __init__(self, model: Model, pages: list[Page]) -> None:
        self.m = model
        self.own: Counter[str] = Counter()
        for p in pages:
            for l in p.lines:
                self.own.update(_line_words(l.lower(), False, True))

    def count(self, w: str) -> float:
        n = self.m.count.get(w, 0)
        return n if n else min(2, self.own.get(w, 0))

    def neighbours(self, w: str) -> list[str]:
        out = []
        for a, b in _RULES:
            at = w.find(a)
            while at >= 0:
                out.append(w[:at] + b + w[at + len(a) :])
                at = w.find(a, at + 1)
        return out

    def better(self, w: str, around: list[str]) -> str | None:
        """The frequent word that w most probably is a misreading of."""
        n = self.m.count.get(w, 0)
        own = self.own.get(w, 0)
        if n >= SURE:
            return None
        best, score = None, -1e9
        if "�" in w:
            pattern = re.compile(re.escape(w).replace("�", ".{1,2}"))
            found = [x for x in self.own if abs(len(x) - len(w)) < 2 and pattern.fullmatch(x)]
        else:
            found = self.neighbours(w)
            if n < KNOWN and len(w) > 6:  # two misread glyphs in a long word that nobody knows
                known = self.m.count
                found += [y for x in found for y in self.neighbours(x) if known.get(y, 0) >= 30] if not any(known.get(x, 0) >= TIMES for x in found) else []
        for x in found:
            k = self.m.count.get(x, 0)
            here = self.own.get(x, 0)
            strong = k >= TIMES * max(1, n) or (n <= 2 and here >= 2 and here >= 2 * own and k > n and len(x) > 5)
            if not strong or len(x) < 2:
                continue
            fit = self.m.fit_in(x, around)
            if n >= PLACED and k < 60 * n and fit <= self.m.fit_in(w, around):
                continue  # w is a word of its own, and x fits no better here
            s = np.log(k + 3 * here + 1) + fit
            if s > score:
                best, score = x, s
        return best

    def parted(self, w: str) -> str | None:
        """Two frequent words that stand in w without their space."""
        n = self.m.count.get(w, 0)
        if n >= 30 or len(w) < 3 or not w.isalpha():
            return None
        if len(w) < 5:  # two little words: both must be far more frequent
            for i in range(1, len(w)):
                if min(self.m.count.get(w[:i], 0), self.m.count.get(w[i:], 0)) >= 300 * max(1, n):
                    return f"{w[:i]} {w[i:]}"
            return None
        best, score = None, 0.0
        for i in range(1, len(w)):
            a, b = w[:i], w[i:]
            ka, kb = self.m.count.get(a, 0), self.m.count.get(b, 0)
            if min(len(a), len(b)) < 2 and a not in _SINGLE:
                continue
            if len(b) < 2:
                continue
            if ka < 200 and kb < 200:
                continue
            if min(ka, kb) < (8 if min(len(a), len(b)) > 3 else 200) and not (max(ka, kb) >= 200 and self.own.get(a if ka < kb else b, 0) >= 2 and len(a if ka < kb else b) > 5):
                continue
            s = np.log(ka + 2) + np.log(kb + 2)
            if s > score:
                best, score = f"{a} {b}", s
        return best if best and (n < KNOWN or n * 50 < np.exp(score / 2)) else None


_SINGLE = {"a", "e", "i", "o", "y", "à"}
#: Specks of dirt read as marks within a word.
_SPECK = re.compile(r"(?<=[^\W\d_])[.|~,·`^*:;_•\\](?=[^\W\d_])")
_GENE = re.compile(r"[A-Z]{3,}\d{1,3}")


def mark_words(pages: list[Page], model: Model) -> None:
    """Kinds hyphen and misread of the lines, and the corrections of their words."""
    reader = Reader(model, pages)
    flat = [(p, i) for p in pages for i, l in enumerate(p.lines) if l.strip() and "furniture" not in p.kinds[i]]
    after = {(id(p), i): flat[k + 1] for k, (p, i) in enumerate(flat[:-1])}
    joined: dict[tuple[int, int], bool] = {}
    for p in pages:
        for i, line in enumerate(p.lines):
            if not line.strip():
                continue
            raw = line.split()
            cores = [m.group() if (m := _CORE.search(x)) else "" for x in raw]
            low = [lower(c) for c in cores]
            end = line.rstrip()[-1:]
            nxt = after.get((id(p), i))
            hangs = -1
            if end in HYPHENS and len(raw[-1]) > 1 and any(x.isalpha() for x in raw[-1]) and (raw[-1][-2].isalnum() or raw[-1][-2] in "'�"):
                hangs = len(raw) - 1
            elif raw[-1] == end and end in HYPHENS and len(raw) > 1 and cores[-2].isalpha() and nxt is not None:
                tail = _CORE.search(nxt[0].lines[nxt[1]].split()[0])  # a space before the hyphen: only if the whole word is known
                if tail and model.count.get(low[-2] + lower(tail.group()), 0) >= 3:
                    hangs = len(raw) - 2
                    p.kinds[i].add("misread")
            for k, w in enumerate(low):
                if not w:
                    if "�" in raw[k] or (k and raw[k] in (".", ",", ")")):  # a lost glyph, or a space before a mark
                        p.kinds[i].add("misread")
                    continue
                around = [x for x in low[max(0, k - WINDOW) : k + WINDOW + 1] if x != w]
                if k == 0 and joined.get((id(p), i)):
                    continue
                if k == hangs and nxt is not None:
                    _joint(p, i, k, cores[k], end, nxt, reader, around, joined)
                    continue
                fix = _word(reader, cores, low, k, around, raw[k])
                if fix is None:
                    continue
                p.kinds[i].add("misread")
                p.fixes[i][k] = fix


def _word(reader: Reader, cores: list[str], low: list[str], k: int, around: list[str], raw: str) -> str | None:
    """What the k-th word of a line should be; None if it is right."""
    w, core, count = low[k], cores[k], reader.m.count
    if k + 1 < len(low) and low[k + 1] and raw[-1:] not in ".,;:)]":
        whole = w + low[k + 1]
        n = max(count.get(whole, 0), 3 if reader.own.get(whole, 0) >= 2 and len(whole) > 4 else 0)
        least = min(count.get(w, 0), count.get(low[k + 1], 0))
        if (n >= 3 * max(least, reader.m.one) if least < KNOWN else n > 6 * least) and whole.isalnum() and not whole.isdigit() and len(whole) > 3:
            return whole  # the next word goes with it; reflow() drops the space
    if k and low[k - 1] and count.get(low[k - 1] + w, 0) > 6 * max(3, count.get(w, 0)) and (low[k - 1] + w).isalpha() and min(count.get(w, 0), count.get(low[k - 1], 0)) * 6 < count.get(low[k - 1] + w, 0) and len(w) < 4:
        return None  # already told at the word before
    if count.get(w, 0) >= SURE and "�" not in raw:
        return None
    bare = _SPECK.sub("", w)
    if bare != w and count.get(w, 0) * TIMES <= count.get(bare, 0) and (count.get(bare, 0) >= 5 or reader.own.get(bare, 0) >= 2):
        return bare
    if "-" in w and "�" not in w:
        parts = w.split("-")
        fixed = [reader.better(x, around) if len(x) > 2 and not x.isdigit() else None for x in parts]
        return "-".join(f or x for f, x in zip(fixed, parts)) if any(fixed) else None
    if w.isdigit():
        return None
    digits = sum(c.isdigit() for c in w)
    if digits and digits < len(w):
        if _GENE.fullmatch(core) and reader.own.get(w, 0) >= 2:
            return None
        if re.fullmatch(r"[\dOoSsIlBZz]{2,5}", core) and digits * 2 >= len(w) and not re.fullmatch(r"\d+s", w):
            return core.translate(str.maketrans("OoSsIlBZz", "005511822"))
    if len(w) < 3 and not digits and "�" not in w:
        return reader.better(w, around) if len(w) == 2 and count.get(w, 0) < 20 else None
    fix = reader.better(w, around)
    if fix is None and digits == 0:
        fix = reader.parted(w)
    if fix is None and "�" in raw:
        fix = core
    return fix


def _joint(p: Page, i: int, k: int, a: str, mark: str, nxt: tuple[Page, int], reader: Reader, around: list[str], joined: dict) -> None:
    """A line that ends in a hyphen: is the word cut there or does the hyphen belong to it?"""
    q, j = nxt
    first = q.lines[j].split()[0]
    m = _CORE.search(first)
    b = m.group() if m else ""
    head, tail = lower(re.split(r"[-‐]", a)[-1]), lower(re.split(r"[-‐]", b)[0])
    whole, compound = head + tail, f"{lower(a)}-{lower(b)}"
    count = reader.m.count
    n, h = reader.count(whole), count.get(compound, 0) or count.get(f"{head}-{tail}", 0)
    ka, kb = count.get(head, 0), count.get(tail, 0)
    fix = None
    if mark in "¬­":
        is_cut = True
    elif n or h:
        is_cut = n >= h if n and h else bool(n)
    else:
        fix = reader.better(whole, around)
        apart = tail[:1].isdigit() or b[:1].isupper() or (kb >= 30 and len(tail) > 3 and (ka >= 30 or reader.own.get(head, 0) >= 2 or a[:1].isupper()))
        is_cut = bool(fix) or not apart
    joined[(id(q), j)] = True
    if is_cut:
        p.kinds[i].add("hyphen")
        fix = fix or reader.better(whole, around)
        p.fixes[i][k] = (fix or whole) + "\x00"
        if fix:  # the misread glyph is where the words part
            same = next((x for x, (c, d) in enumerate(zip(whole, fix)) if c != d), min(len(whole), len(fix)))
            (p if same < len(head) else q).kinds[i if same < len(head) else j].add("misread")
    else:
        for w, r, x in ((head, p, i), (tail, q, j)):
            if len(w) > 3 and reader.better(w, around):
                r.kinds[x].add("misread")


def reflow(pages: list[Page]) -> list[str]:
    """Each page's text as paragraphs of running words: furniture gone, cut words whole, misread words corrected."""
    out, carried = [], False
    for p in pages:
        paragraphs, now = [], []
        body = [i for i, l in enumerate(p.lines) if l.strip() and "furniture" not in p.kinds[i]]
        wide = max((len(p.lines[i].rstrip()) for i in body), default=0)
        for i in body:
            words = p.lines[i].split()
            skip = carried
            carried = False
            for k, raw in enumerate(words):
                if skip:
                    skip = False
                    rest = raw[(m.end() if (m := _CORE.search(raw)) else 0) :]
                    if now:
                        now[-1] += rest
                    continue
                fix = p.fixes[i].get(k)
                if fix is None:
                    now.append(raw)
                    continue
                m = _CORE.search(raw)
                core, before, rest = (m.group(), raw[: m.start()], raw[m.end() :]) if m else (raw, "", "")
                if fix.endswith("\x00"):
                    fix, rest, carried = fix[:-1], "", True
                if core[:1].isupper():
                    fix = fix.upper() if core.isupper() and len(core) > 1 else fix[:1].upper() + fix[1:]
                if k + 1 < len(words) and lower(core + (m2.group() if (m2 := _CORE.search(words[k + 1])) else "")) == lower(fix):
                    skip, rest = True, ""
                now.append(before + fix + rest)
            if now and now[-1][-1:] in ".!?:" and len(p.lines[i].rstrip()) < 0.75 * wide:
                paragraphs.append(" ".join(now))
                now = []
        if now:
            paragraphs.append(" ".join(now))
        out.append("\n\n".join(paragraphs))
    return out


def read_document(pages: list[tuple[tuple, list[str]]], title: str | None, model: Model) -> tuple[list[Page], list[str]]:
    """Marked pages (in order) of one reading of a document, and their repaired text."""
    made = [Page(key, lines, [set() for _ in lines], [{} for _ in lines]) for key, lines in pages]
    mark_furniture(made, title, model)
    mark_words(made, model)
    return made, reflow(made)


def rare_words(lines: list[str], known: dict[str, float]) -> list[str]:
    """The words beyond the known ones whose counts may be asked for: those of the lines, two that adjoin, and cut ones made whole."""
    out: set[str] = set()
    lines = [l for l in lines if l.strip()]
    low = [[lower(m.group()) if (m := _CORE.search(x)) else "" for x in l.split()] for l in lines]
    for i, (line, words) in enumerate(zip(lines, low)):
        out.update(_with_parts(_WORD.findall(line.lower())), words, (x for w in words if "-" in w for x in w.split("-")))
        out.update(a + b for a, b in zip(words, words[1:]) if a not in known or b not in known)
        if line.rstrip()[-1:] in HYPHENS:
            for a in words[-2:]:
                head = re.split(r"[-‐]", a)[-1]
                for b in (x[0] for x in low[i + 1 : i + 6]):  # furniture may stand between
                    tail = re.split(r"[-‐]", b)[0]
                    out.update((head + tail, f"{head}-{tail}", f"{a}-{b}"))
    return sorted(w for w in out if w and w not in known)


def scanned_pages(chunks: DataFrame, ocr: DataFrame, docs: DataFrame) -> DataFrame:
    """tbl, doc_id, page, at (order), lines of the pages of documents of kind scan; repeated deliveries once."""
    scans = docs.where("kind = 'scan' and doc_id is not null").select("doc_id").distinct()
    a = chunks.join(scans, "doc_id", "left_semi").where("text is not null").select(F.lit("chunks").alias("tbl"), "doc_id", "page", F.coalesce("page", "idx").alias("at"), F.split("text", "\n").alias("lines")).distinct()
    b = ocr.join(scans, "doc_id", "left_semi").where("size(lines) > 0").select(F.lit("ocr_results").alias("tbl"), "doc_id", "page", F.col("page").alias("at"), F.transform("lines", lambda l: F.coalesce(l["text"], F.lit(""))).alias("lines")).distinct()
    return a.unionByName(b)


def learn(pages: DataFrame, docs: DataFrame) -> tuple[Model, DataFrame]:
    """Counts of all documents' frequent words, vectors of the scanned pages, line templates that stand at page edges; word, n of the rare words."""
    counts = cut(word_counts(docs), "words")
    rate = min(1.0, CORPUS / max(1, counts.agg(F.sum("n")).first()[0] or 0))
    counts = counts.withColumn("n", F.col("n") * rate)
    words = counts.where(F.col("n") >= KNOWN).orderBy(F.desc("n"), "word").collect()
    count = {r.word: r.n for r in words}
    index = {r.word: i for i, r in enumerate(words) if r.n >= PLACED}
    grams = np.zeros((len(index), CONTEXTS))
    found = skipgrams(pages, index).toArrow()  # at most index x CONTEXTS
    grams[found["w"].to_numpy(), found["c"].to_numpy()] = found["n"].to_numpy()
    word, context = learn_vectors(grams)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for lines in b.column(0).to_pylist():
                full = [template(l or "") for l in lines or [] if (l or "").strip()]
                for i, t in enumerate(full):
                    if 0 < len(t) < 60:
                        n[(t, int(i < 1 or i >= len(full) - 1))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["t", "edge", "n"])

    s = pages.select("lines").mapInArrow(shapes, "t string, edge int, n bigint").groupBy("t").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("edge")).alias("e"))
    fixed = s.where((F.col("e") * rate >= 6) & (F.col("e") >= 0.95 * F.col("n")) & F.col("t").contains("#") & F.col("t").rlike(r"[^# ]")).select("t")
    edges = [r.t for r in fixed.collect()]
    bare = {re.sub(r"[# ]", "", t) for t in edges}
    return Model(count, index, word, context, set(edges), {x for k in bare if len(k) > 7 for x in (k, *(k[:i] + k[i + 1 :] for i in range(len(k))))}, rate), counts.where(F.col("n") < KNOWN)


def read_pages(chunks: DataFrame, ocr: DataFrame, docs: DataFrame) -> DataFrame:
    """tbl, doc_id, page, text (repaired), marks: array of (line_no, kind).

    Only documents of kind scan. Null texts, null and empty lines arrays give nothing; a null line is
    empty. A page delivered twice is read once. Lines of chunks and of ocr_results are read apart, as
    two readings of the document. Documents with null doc_id and pages of unknown documents are left
    out; a null title just tells nothing. Pages of a document are read in one task, in order.
    """
    pages = cut(scanned_pages(chunks, ocr, docs), "pages")
    learned, rare = learn(pages, docs.select("kind", "text"))
    held = docs.sparkSession.sparkContext.broadcast(learned)
    titles = docs.where("kind = 'scan'").select("doc_id", "title").dropDuplicates(["doc_id"])
    at = F.coalesce(F.col("at"), F.lit(0))
    block = F.floor(at / BLOCK)
    both = F.when((at % BLOCK == 0) & (at > 0), F.array(block, block - 1)).otherwise(F.array(block))
    placed = pages.withColumn("own", block).withColumn("block", F.explode(both))
    page = F.struct("tbl", "at", "page", "lines", (F.col("own") == F.col("block")).alias("out"))
    whole = placed.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    whole = cut(whole, "blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value.count
        for b in batches:
            words = [rare_words([l or "" for p in ps for l in p["lines"]], known) for ps in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "block", "words"])

    asked = whole.mapInArrow(ask, "doc_id bigint, block bigint, words array<string>").select("doc_id", "block", F.explode("words").alias("word"))
    told = asked.join(rare, "word").groupBy("doc_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("rare"))
    whole = whole.join(told, ["doc_id", "block"], "left").join(titles, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            tbl, doc, page, text, marks = [], [], [], [], []
            for d, ps, title, rarer in zip(*(b.column(i).to_pylist() for i in range(4))):
                here = replace(model, count={**model.count, **dict(rarer or ())})
                done: dict[tuple, tuple] = {}
                for t in ("chunks", "ocr_results"):
                    mine = [((t, x["page"], x["out"]), x["lines"]) for x in ps if x["tbl"] == t]
                    if not mine:
                        continue
                    same = tuple(tuple(l) for _, l in mine)
                    if same not in done:
                        done[same] = read_document(mine, title, here)
                    read, texts = done[same]
                    for (key, _), p, s in zip(mine, read, texts):
                        if not key[2]:
                            continue
                        tbl.append(t)
                        doc.append(d)
                        page.append(key[1])
                        text.append(s)
                        marks.append([{"line_no": i, "kind": k} for i, ks in enumerate(p.kinds) for k in sorted(ks)])
            mark_type = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(tbl, pa.string()), pa.array(doc, pa.int64()), pa.array(page, pa.int32()), pa.array(text, pa.string()), pa.array(marks, mark_type)], names=["tbl", "doc_id", "page", "text", "marks"])

    return whole.select("doc_id", "pages", "title", "rare").mapInArrow(run, "tbl string, doc_id bigint, page int, text string, marks array<struct<line_no:int,kind:string>>")
