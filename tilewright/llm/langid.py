"""Language identification by hierarchical discrimination.

A document's language family is predicted first; then linear support vector machines, one
for each pair, separate the related languages within it. Both levels see the same features:
square roots of the relative frequencies of hashed letter pairs and triples of the whole
text, in UTF-8 and lower case, everything but letters as a space.

The models are fitted on the driver on a bounded sample: SAMPLE documents of each language,
those with the smallest hash of their id and text (documents equal in both count once), for
at most LANGUAGES languages, those with the most documents. Executors send their feature
vectors, not their texts. The model (one weight vector for each pair of classes) is as large
as the number of languages allows, whatever the corpus. Predicting is one pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, trimmed

#: Language families by ISO 639-1 code. Codes that are missing here are families of their own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}

#: Documents of a language, and languages, that are learned from.
SAMPLE, LANGUAGES = 800, 64
#: Least score of a document whose language counts as found.
FLOOR = 0.4
FEATURES = 4096
_BITS = 12
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, bytes of other letters as they are, the rest a space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def features(text: str) -> np.ndarray:
    """One row of FEATURES numbers with a norm of 1 (0 for an empty text)."""
    b = np.frombuffer(b" " + text.lower().encode(errors="replace").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]  # one space between words
    pairs = b[:-1] << np.uint32(8) | b[1:]
    triples = pairs[:-1] << np.uint32(8) | b[2:]
    shift = np.uint32(32 - _BITS)
    counts = np.bincount(pairs * np.uint32(2654435761) >> shift, minlength=FEATURES)
    counts = counts + np.bincount((triples * np.uint32(2246822519) + np.uint32(374761393)) >> shift, minlength=FEATURES)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 200) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss; y: -1 or 1.

    Classes weigh the same however many rows they have. Accelerated gradient steps from zero.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (1 + 4 * cost)
    for t in range(steps):
        push = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        step = v - rate * (v - 2 * cost * np.append(push @ x, push.sum()).astype(np.float32))
        v, w = step + t / (t + 3) * (step - w), step
    return w


class Hierarchy:
    """Families, then languages: machines for each pair of classes at either level."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.asarray(langs, object)
        families = np.asarray([family(s) for s in langs], object)
        self.families = sorted(set(families))
        self.members = {f: sorted(set(langs[families == f])) for f in self.families}
        self.top = self._pairs(x, families, self.families)
        self.low = {f: self._pairs(x[families == f], langs[families == f], m) for f, m in self.members.items()}

    @staticmethod
    def _pairs(x, names, classes):
        out = {}
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                rows = (names == a) | (names == b)
                some = x if rows.all() else x[rows]
                out[a, b] = fit_svm(some, np.where(names[rows] == a, 1.0, -1.0).astype(np.float32))
        return out

    @staticmethod
    def _vote(x, classes, machines):
        """Index of the class with most votes (then the largest sum of margins), and its mean confidence."""
        votes = np.zeros((len(x), len(classes)))
        sure = np.zeros_like(votes)
        place = {c: i for i, c in enumerate(classes)}
        for (a, b), w in machines.items():
            m = x @ w[:-1] + w[-1]
            p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
            votes[:, place[a]] += (m >= 0) + 1e-3 * p
            votes[:, place[b]] += (m < 0) + 1e-3 * (1 - p)
            sure[:, place[a]] += p
            sure[:, place[b]] += 1 - p
        won = votes.argmax(1)
        return won, sure[np.arange(len(x)), won] / max(1, len(classes) - 1) if machines else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores from 0 to 1."""
        out, score = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        if not self.families or not len(x):
            return out, score
        won, sure = self._vote(x, self.families, self.top)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(won == i)
            if rows.size:
                lang, more = self._vote(x[rows], self.members[f], self.low[f])
                out[rows] = np.asarray(self.members[f], object)[lang]
                score[rows] = sure[rows] * more
        return out, score


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, text) -> (lang, order, x)."""
    for batch in batches:
        x = [features(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], ["lang", "order", "x"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Hierarchy:
    """Fit on sample documents of each non-null language of labelled, or all if there are fewer.

    Documents count if they have a letter, and once if id and text are the same. Of more
    than LANGUAGES values of lang, those with the most documents are learned.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(5)), F.lit(1 << 40))
    known = labelled.filter(lang.isNotNull() & F.regexp_like(text, F.lit(r"\p{L}")))
    rows = known.select(text.alias("text"), lang.alias("lang"), order.alias("order"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("order", 0.02).alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()}
    # the share of hashes that holds about a quarter more than the sample; cut to size below
    share = F.lit(False)
    for name, n in sorted(counts.items()):
        share = share | ((F.col("lang") == name) & (F.col("order") < int(min(1.0, (1.25 * sample + 50) / max(1, n)) * (1 << 40))))
    drawn = rows.filter(share).groupBy("lang", "order").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    drawn = drawn.withColumn("place", place).filter(F.col("place") <= sample).select("lang", "order", "text")
    got = drawn.mapInArrow(trimmed(_sent), "lang string, order long, x binary").toArrow()
    order = pc.sort_indices(got.select(["lang", "order"]), [("lang", "ascending"), ("order", "ascending")])
    langs = got["lang"].take(order).to_pylist()
    x = np.empty((len(langs), FEATURES), np.float32)
    for k, i in enumerate(order.to_pylist()):
        x[k] = np.frombuffer(got["x"][i].as_buffer(), np.float16)
    del got
    model = Hierarchy(x, langs)
    del x
    give_back()
    return model


def _answers(model: Hierarchy, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text; a few hundred at a time are held as strings and features."""
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    for at in range(0, len(texts), 500):
        part = texts.slice(at, 500).to_pylist()
        known = [i for i, t in enumerate(part) if has_letter(t)]
        if known:
            rows = [at + i for i in known]
            lang[rows], score[rows] = model.predict(np.stack([features(part[i]) for i in known]))
    return lang, score


def _predicted(model: Hierarchy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _answers(model, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def _known_only(model: Hierarchy, text_col: str, languages: frozenset[str] | None, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            if model.families:
                lang, score = _answers(model, texts)
                known = (lang != UNKNOWN) & (score >= floor)
                if languages is not None:
                    known &= np.array([s in languages for s in lang], bool)
            else:
                known = [has_letter(t.as_py()) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return run


def predict(docs: DataFrame, model: Hierarchy, keep: list[Column], text_col: str = "text") -> DataFrame:
    """keep, lang_pred, score for every row, from the text alone.

    A text that is null or has no letter is "und" with score 0, as is any text if the
    model has learned no language. Repeated rows are answered once each.
    """
    # the text comes first, under whatever name, so that no name of keep can clash with it
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *keep)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(trimmed(_predicted(model)), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by id, that is never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rest, predicted for all."""
    model = fit(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    return predict(docs, model, [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")], text_col)


def keep_known(
    docs: DataFrame, languages: list[str] | None = None, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """docs whose predicted language is one of languages (None: any) with a score of floor or more, all columns unchanged.

    Rows whose text is null, empty or without a letter have no language and go. Where no
    language could be learned, the rows with a letter are kept.
    """
    model = fit(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
    return docs.mapInArrow(trimmed(_known_only(model, text_col, languages and frozenset(languages), floor)), docs.schema)
