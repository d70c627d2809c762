"""Language identification by hierarchical discrimination.

A text is first given a language family, then a language within it. Both steps are duels: one linear support vector
machine for each pair of families, and for each pair of languages of one family; the class that wins most duels is taken.
Features are the frequencies of hashed character n-grams of the whole text. The machines are fitted on the driver, on a
bounded sample of labelled rows: of each of the MOST_LANGUAGES most frequent languages PER_LANGUAGE rows, those of texts up
to SAMPLE_CHARS code points first, then the shortest others, of which as many code points are taken; among equals those
whose ids hash lowest. Their weights, whose size depends on the number of languages alone, go to the workers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import sized_parts

#: The sample to learn from: rows for each language at most, code points of each, and languages (the most frequent ones).
PER_LANGUAGE, SAMPLE_CHARS, MOST_LANGUAGES = 400, 20_000, 100
BUCKETS = 1 << 13
NGRAMS = 3
PART_BYTES = 2_000_000
UNDETERMINED = "und"
#: Languages of each family. Fixed values. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "sd", "si", "ur"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("ceb", "id", "jv", "mg", "ms", "su", "tl"),
    "sino-tibetan": ("bo", "my", "zh"),
}


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"={language}")


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter (general category L)."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one row for each n, each column the n-grams that begin at one place; the bounds of
    the texts, which all have a mark before and after; and their letters' counts. Other characters count as one mark."""
    lead = "\0" * (NGRAMS - 1)  # so no n-gram of a text reaches into the next
    whole = lead + ("\0" + lead).join(texts).lower() + "\0" * NGRAMS
    sizes = [len(t) if t.isascii() else len(t.lower()) for t in texts]
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + NGRAMS)])
    n = int(begins[-1])
    rows, mix = [], np.zeros(n, np.uint32)
    for k in range(NGRAMS):
        mix = (mix + codes[k : k + n] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        mix ^= mix >> np.uint32(15)
        rows.append(mix >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.stack(rows), begins, np.add.reduceat(letter[:n].astype(np.int64), begins[:-1]) if texts else np.zeros(0, np.int64)


def frequencies(texts: list[str]) -> np.ndarray:
    """Each text's share of every hashed n-gram."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        rows = grams([text])[0]
        out[i] = np.bincount(rows.ravel(), minlength=BUCKETS) / rows.size
    return out


def separating(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Model:
    """languages, and for each duel two classes and a column of weights. A class is a family or a language."""

    languages: tuple[str, ...]
    duels: tuple[tuple[str, str], ...]
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> Model:
        known = tuple(sorted(set(languages)))
        families = sorted({family(lang) for lang in known})
        if not known:
            return cls((), (), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
        label, kin = np.array(languages), np.array([family(lang) for lang in languages])
        duels = [(a, b, kin) for a, b in combinations(families, 2)]
        for f in families:
            duels += [(a, b, label) for a, b in combinations([lang for lang in known if family(lang) == f], 2)]
        x = frequencies(texts)
        scale = 1 / (np.sqrt(x.mean(axis=0)) + 1e-3)
        x = np.hstack([x * scale, np.ones((len(x), 1), np.float32)])
        columns = [separating(x[(of == a) | (of == b)], np.where(of[(of == a) | (of == b)] == a, 1.0, -1.0)) for a, b, of in duels]
        w = np.array(columns).reshape(len(duels), BUCKETS + 1).T
        return cls(known, tuple((a, b) for a, b, _ in duels), np.ascontiguousarray(w[:-1] * scale[:, None], np.float32), w[-1].astype(np.float32))

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's margin in every duel, and its number of letters."""
        rows, begins, n_letters = grams(texts)
        total = np.diff(begins) * NGRAMS
        out = np.empty((len(texts), len(self.duels)))
        for d in range(len(self.duels)):
            column = np.ascontiguousarray(self.weights[:, d])
            each = column[rows[0]]
            for k in range(1, NGRAMS):
                each += column[rows[k]]
            out[:, d] = np.add.reduceat(each, begins[:-1], dtype=np.float64) / total + self.offset[d]
        return out, n_letters

    def winners(self, classes: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class that wins most duels (then by its mean certainty, then by name), and that mean, for every text."""
        wins, sure = np.zeros((len(margins), len(classes))), np.zeros((len(margins), len(classes)))
        for d, (a, b) in enumerate(self.duels):
            if a in classes and b in classes:
                chance = 1 / (1 + np.exp(-np.clip(3 * margins[:, d], -30, 30)))
                for c, p in ((a, chance), (b, 1 - chance)):
                    wins[:, classes.index(c)] += p > 0.5
                    sure[:, classes.index(c)] += p
        sure = sure / (len(classes) - 1) if len(classes) > 1 else np.ones_like(sure)
        best = np.argmax(wins + sure / 2, axis=1)
        return best, sure[np.arange(len(margins)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        margins, n_letters = self.margins(texts)
        families = sorted({family(lang) for lang in self.languages})
        at, score = self.winners(families, margins)
        names = np.full(len(texts), UNDETERMINED, object)
        for i, f in enumerate(families):
            members = [lang for lang in self.languages if family(lang) == f]
            here = np.flatnonzero(at == i)
            best, sure = self.winners(members, margins[here])
            names[here] = np.array(members, object)[best]
            score[here] *= sure
        names[n_letters == 0], score[n_letters == 0] = UNDETERMINED, 0.0
        return names.tolist(), score


def held_out(key: str) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4 (a null id: empty)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, chars: int = SAMPLE_CHARS, most: int = MOST_LANGUAGES) -> Model:
    """A model from the rows that are not held out and have a language and a text.

    The driver gets a count for each of the languages, a rank's bounds for each, and then the sample. Rows are ranked
    within their language, each task keeping the first ones only, so neither frequent languages nor rows that share an id
    crowd others out.
    """
    size = F.length(text)
    place = F.struct(F.when(size > chars, size).otherwise(0).alias("over"), F.xxhash64(key).alias("hash"))
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(key)).select(F.col(lang).alias("lang"), place.alias("place"), F.left(text, F.lit(chars)).alias("text"))
    names = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most).collect()]
    if not names:
        return Model.fit([], [])
    first = lambda some, *by: some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= per_language)
    ranked = first(rows.where(F.col("lang").isin(names)).select("lang", "place"), "place")
    within = F.lit(False)
    for r in ranked.groupBy("lang").agg(F.max("place").alias("last")).collect():
        last = F.struct(F.lit(r["last"]["over"]).alias("over"), F.lit(r["last"]["hash"]).cast("long").alias("hash"))
        within = within | ((F.col("lang") == r["lang"]) & (F.col("place") <= last))
    taken = first(rows.where(within), "place", "text").select("lang", "text").collect()
    pairs = sorted((r["lang"], r["text"]) for r in taken)
    return Model.fit([t for _, t in pairs], [name for name, _ in pairs])


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of every row, with lang_pred and score, from whole texts.

    A null text, and a text with no letter, is und with score 0; so is every text if nothing could be learned. Classes
    that win as many duels rank by their mean certainty, then by name. Repeated rows each keep their row, and equal texts
    have equal results; an empty table gives an empty result. Columns that are not kept are not read; a kept column may
    have any name but those of the result.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    kept = [f"kept_{i}" for i in range(len(keep))]
    source = docs.select(F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    schema = ", ".join([*[f"{k} {kinds[c].simpleString()}" for c, k in zip(keep, kept, strict=True)], "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in sized_parts(batch.column(0), PART_BYTES):
                part = batch.slice(first, last - first)
                names, score = model.predict([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "lang_pred", "score")
