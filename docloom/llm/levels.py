"""Reading level of documents by regularised ordinal regression (problem 9).

Features of a document's prose: lexical diversity, word rarity (frequencies over the whole corpus),
connectives, a proxy of clause depth (commas, brackets and subordinators of a sentence), lengths of
words and sentences. They are standardised within each language over all documents. A proportional-
odds model with a quadratic penalty is fitted to raters' marks, each mark an observation of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, spread

LANGS = ("en", "de", "fr", "es")
#: Function words, by which prose and its language are told (fixed values).
FUNCTION = {
    "en": "the of and to a in is it that for was on are as with they be at this have from or by not but what all were we when your can there an which their if will about how up out them then she many some so these would her like him into has more two see no could people than been who its now did get down may you our us do after before only also every still",
    "de": "der die das und in zu den ist von mit sich des ein eine einen einem einer im dem nicht auf für als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wurden sei wir unter gegen vom kann schon wenn ihre ihr ihnen uns waren deren welche sowie zwischen beim nun ohne",
    "fr": "le la les de des du un une et à en est que qui dans pour sur au aux par ce se ne pas plus avec il elle ils nous vous on sont été a ont cette ces son sa ses leur leurs ou mais comme dont si tout être fait après avant entre sans sous chez lors très peu aussi y l d n s qu c j m t était ont",
    "es": "el la los las de del un una y a en es que se por con para no al lo su sus como más o este esta estos fue ha son entre ser sin sobre también desde hasta donde cuando muy si ya porque le les nos han cada otro otra todo pero antes tras uno dos hay están usted me te tan según cuyo cuya",
}
#: Connectives and subordinating words (fixed values).
CONNECTIVE = {
    "en": "however moreover furthermore therefore accordingly hence thus consequently nevertheless whereas although albeit despite irrespective inasmuch conversely additionally because since while unless whether though notwithstanding by extension given",
    "de": "jedoch zudem ferner demnach folglich daher somit dennoch während obwohl wenngleich trotz ungeachtet unbeschadet insofern weil da falls sofern sodass indem wobei hingegen außerdem mithin infolgedessen",
    "fr": "cependant toutefois en outre ainsi donc néanmoins tandis alors bien quoique malgré nonobstant puisque parce car lorsque afin notamment partant dès conséquent dont où",
    "es": "sin embargo además asimismo por tanto así pues no obstante mientras aunque pese pesar puesto porque cuando siempre salvo máxime siquiera consiguiente cuyo cuya donde luego",
}
#: A word is rare, and as rare as any, below this share of all words; so at most its inverse are
#: broadcast, however large the corpus is.
RARE_SHARE = 5e-6
#: Most marks that the model is fitted to (by hash of doc_id and rater); a bound of the fit only.
MARKS = 50_000
FEWEST_WORDS = 40

_WORD = re.compile(r"[^\W\d_]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n|\f")
_SENTENCE = re.compile(r"[.!?…]+(?=[\s\"'”»)\]]|$)")
_CLAUSE = re.compile(r"[,;:(–—]")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬­][ \t]*\n[ \t]*(?=[^\W\d_A-Z])")
_HEADING = re.compile(r"(?mi)^\s*(?:\[\d+\].*|\d+\.\s.*\b(?:19|20)\d\d.*|#+ .*|references|literatur|références|referencias|bibliograph\w*)\s*$")
_sets = {g: frozenset(FUNCTION[g].split()) for g in LANGS}


class _Default(dict):
    """A dict whose lookup of a missing key gives `other`; mapping it over words runs in C."""

    def __init__(self, known: dict, other: float) -> None:
        super().__init__(known)
        self.other = other

    def __missing__(self, key: object) -> float:
        return self.other


#: The languages of which a word is a function word, as bits.
_BITS = _Default({w: sum(1 << i for i, g in enumerate(LANGS) if w in _sets[g]) for g in LANGS for w in _sets[g]}, 0)
FEATURES = (
    "word_length", "long_words", "very_long_words", "sentence_length", "clause_depth", "diversity", "rarity", "rare_words", "connectives", "clause_marks", "function_words", "short_words",
    # Of the sentences, which tell more than means where easy and hard ones mix:
    "median_sentence", "sentences_14", "sentences_24", "median_longest_word", "sentences_word_13", "sentences_word_9", "median_word_length", "sentences_mean_55", "sentences_mean_65", "sentences_mean_43",
)


def prose(text: str) -> tuple[list[str], list[int], int, str] | None:
    """Words in lower case, words of each sentence, clause marks and language of a text's prose; None if it has none.

    A paragraph is prose if at least a tenth of its words are function words of the text's language
    and most of its characters are letters or spaces, so tables, letter strings and lists of
    references drop out. Chinese text has no words of these languages and drops out too.
    """
    text = _HEADING.sub("", text)
    if "\n" in text:
        text = _BREAK.sub("", text)
    parts = []
    votes = dict.fromkeys(LANGS, 0)
    for p in _PARAGRAPH.split(text):
        each = [_WORD.findall(x) for x in _SENTENCE.split(p.lower())]
        w = [x for e in each for x in e]
        if len(w) < 4:
            continue
        bits = Counter(map(_BITS.__getitem__, w))
        hits = {g: sum(n for b, n in bits.items() if b >> i & 1) for i, g in enumerate(LANGS)}
        parts.append((p, w, hits, [len(e) for e in each if e]))
        for g in LANGS:
            votes[g] += hits[g]
    if not parts:
        return None
    lang = max(LANGS, key=votes.get)
    words, sentences, clauses = [], [], 0
    for p, w, hits, lengths in parts:
        if hits[lang] * 10 < len(w) or sum(map(len, w)) < 0.6 * len(p.replace(" ", "")):
            continue
        words += w
        sentences += lengths
        clauses += len(_CLAUSE.findall(p))
    return (words, sentences, clauses, lang) if words else None


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts of the corpus, counted within each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(_WORD.findall(t.lower()))
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return spread(docs.where("text is not null").select("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _of_sentences(size: np.ndarray, length: np.ndarray) -> tuple[float, ...]:
    """Lengths, longest words and mean word lengths of sentences of three words and more."""
    start = np.cumsum(length) - length
    longest, mean = np.maximum.reduceat(size, start), np.add.reduceat(size, start) / length
    full = length >= 3
    if full.any():
        length, longest, mean = length[full], longest[full], mean[full]
    return (
        float(np.median(length)), (length >= 14).mean(), (length >= 24).mean(), float(np.median(longest)), (longest >= 13).mean(), (longest >= 9).mean(),
        float(np.median(mean)), (mean >= 5.5).mean(), (mean >= 6.5).mean(), (mean < 4.3).mean(),
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, words, lang and FEATURES of documents with at least FEWEST_WORDS words of prose."""
    words = cut(word_counts(docs.select("text")), "words")
    total = words.agg(F.sum("n")).first()[0] or 1
    counts = words.where(F.col("n") >= RARE_SHARE * total).collect()  # at most 1 / RARE_SHARE
    held = docs.sparkSession.sparkContext.broadcast({r.word: float(np.log(total / r.n)) for r in counts})
    unseen = float(-np.log(RARE_SHARE)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = _Default(held.value, unseen).__getitem__
        link = {g: set(CONNECTIVE[g].split()) for g in LANGS}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keep, n, langs, rows = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    got = prose(t)
                    if got is None or len(got[0]) < FEWEST_WORDS:
                        continue
                    w, sentences, clauses, lang = got
                    k = len(w)
                    size = np.fromiter(map(len, w), np.int32, k)
                    r = np.fromiter(map(rare, w), np.float64, k)
                    c = Counter(w)
                    n_s = len(sentences)
                    rows.append((
                        size.mean(), (size >= 7).mean(), (size >= 12).mean(), np.log(k / n_s), clauses / n_s, np.log(len(c)) / np.log(k),
                        r.mean(), (r > 9).mean(), sum(c[x] for x in c.keys() & link[lang]) / k, clauses / k, sum(c[x] for x in c.keys() & _sets[lang]) / k, (size <= 4).mean(), *_of_sentences(size, np.array(sentences)),
                    ))
                    keep.append(i)
                    n.append(k)
                    langs.append(lang)
                x = np.array(rows, np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int32()), pa.array(langs, pa.string()), *(pa.array(x[:, j].copy()) for j in range(x.shape[1]))], names=["doc_id", "words", "lang", *FEATURES])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, words int, lang string, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Ordinal:
    """P(level <= k) = sigmoid(bound[k] - weight·x)."""

    weight: np.ndarray
    bound: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        c = 1 / (1 + np.exp(-np.clip(self.bound[None, :] - (x @ self.weight)[:, None], -40, 40)))
        c = np.concatenate([np.zeros((len(x), 1)), c, np.ones((len(x), 1))], 1)
        return np.diff(c, axis=1)


def fit(x: np.ndarray, level: np.ndarray, levels: int = 4, penalty: float = 1.0, rounds: int = 400) -> Ordinal:
    """Proportional odds by gradient steps (Adam) on the penalised likelihood; level counts from 1."""
    d, n = x.shape[1], max(1, len(x))
    w, start, gaps = np.zeros(d), -1.0, np.zeros(levels - 2)
    theta = np.concatenate([w, [start], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def bounds(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([[t[d]], np.exp(t[d + 1 :])]))

    k = level - 1
    for step in range(1, rounds + 1):
        b = bounds(theta)
        z = x @ theta[:d]
        hi = np.where(k < levels - 1, b[np.minimum(k, levels - 2)] - z, 40.0)
        lo = np.where(k > 0, b[np.maximum(k - 1, 0)] - z, -40.0)
        sh, sl = 1 / (1 + np.exp(-np.clip(hi, -40, 40))), 1 / (1 + np.exp(-np.clip(lo, -40, 40)))
        p = np.maximum(sh - sl, 1e-9)
        gh, gl = sh * (1 - sh) / p, -sl * (1 - sl) / p
        gz = -(gh + gl)
        gb = np.zeros(levels - 1)
        np.add.at(gb, np.minimum(k, levels - 2), np.where(k < levels - 1, gh, 0))
        np.add.at(gb, np.maximum(k - 1, 0), np.where(k > 0, gl, 0))
        g = np.zeros_like(theta)
        g[:d] = gz @ x / n - penalty / n * theta[:d]
        g[d] = gb.sum() / n
        for j in range(levels - 2):
            g[d + 1 + j] = gb[j + 1 :].sum() * np.exp(theta[d + 1 + j]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Ordinal(theta[:d], bounds(theta))


def grade(docs: DataFrame, marks: DataFrame, levels: int = 4, penalty: float = 1.0) -> DataFrame:
    """doc_id, lang (as found), level, demand (latent scale), confidence, of documents with enough prose.

    docs: doc_id, text. marks: doc_id, rater, level. Documents with null doc_id or text, or with less
    than FEWEST_WORDS words of prose, are left out; very long texts count whole. Rows that repeat a
    doc_id with the same prose come once. Marks with null, out of range or for other documents are
    ignored; without any mark every document gets level 2 by the model's start. Ties between levels go
    to the lower one.
    """
    rows = cut(features(docs).dropDuplicates(["doc_id"]), "features")
    stats = rows.groupBy("lang").agg(*(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).collect()  # a row for each language
    mean = {r.lang: np.array([r[f"m_{f}"] for f in FEATURES]) for r in stats}
    sd = {r.lang: np.array([max(r[f"s_{f}"], 1e-6) for f in FEATURES]) for r in stats}
    good = marks.where(F.col("level").between(1, levels)).select("doc_id", "rater", "level")
    seen = rows.join(good, "doc_id").orderBy(F.xxhash64("doc_id", "rater")).limit(MARKS).select("doc_id", "rater", "lang", "level", *FEATURES).toPandas().sort_values(["doc_id", "rater", "level"])

    def scaled(x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        mu = np.stack([mean[g] for g in lang]) if len(lang) else np.zeros((0, len(FEATURES)))
        s = np.stack([sd[g] for g in lang]) if len(lang) else np.ones((0, len(FEATURES)))
        return np.clip((x - mu) / s, -4, 4)

    model = fit(scaled(seen[list(FEATURES)].to_numpy(float), seen["lang"].to_numpy()), seen["level"].to_numpy(int), levels, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(2 + j).to_numpy() for j in range(len(FEATURES))], 1)
            z = scaled(x, np.array(b.column(1).to_pylist(), object))
            p = model.probabilities(z)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((p.argmax(1) + 1).astype(np.int32)), pa.array(z @ model.weight), pa.array(p.max(1))], names=["doc_id", "lang", "level", "demand", "confidence"])

    return rows.select("doc_id", "lang", *FEATURES).mapInArrow(run, "doc_id bigint, lang string, level int, demand double, confidence double")
