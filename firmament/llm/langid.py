"""Language identification: family first, then one-versus-one SVMs within it.

Every text becomes hashed counts of its letters' one- to three-grams (square
roots, unit length).  A one-versus-rest linear SVM per family picks the
family; within it a linear SVM for every pair of languages votes, ties going
to the larger margin.  The score also says how much the text looks like the
learned ones at all: its evidence is the best family's margin plus its cosine
with the winner's mean vector, held against ``FLOOR`` times the median of the
winner's learned texts (less for texts under ``SHORT`` characters, which have
fewer n-grams to show).  At that bound the score is ``MIN_SCORE``, below it
less, so that texts in no learned language can be told.  Models are fitted on at most ``per_language`` labelled
documents of each language, chosen by the hash of their id; prediction reads
every whole text.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything when no labelled text exists; languages beyond the
``languages`` most frequent are not learned; repeated rows get equal
rows; null ids are carried and count as not held out; texts of any length are
read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmament.llm.store import id_bucket, saved

SIZES = (512, 1024, 2048)  # hashed one-, two- and three-grams
DIMS = sum(SIZES)
PIECE = 1 << 18  # characters of a text that are counted at once
UND = "und"
MIN_SCORE = 0.2  # the score of a text whose evidence is just enough
FLOOR = 0.55  # of the median evidence of learned texts: between theirs and that of languages left out
SHORT = 256  # letters and spaces
STEEP = 6.0

# Languages by family (ISO 639-1); others are a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "finnic": "fi et",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr ne pa gu",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _counts(text: str) -> tuple[list[np.ndarray], bool]:
    """Hashed counts of one-, two- and three-grams of a whole text, and whether
    it has a letter.  Runs of other characters are one space, as are both ends.
    Works on a piece of the text at a time, so memory doesn't grow with it."""
    counts = [np.zeros(size, np.int64) for size in SIZES]
    counts[0][32] += 1
    last = np.array([32])  # up to two characters before the piece
    any_letter = False
    for i in range(0, len(text) + 1, PIECE):
        c = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = _letters()[c]
        any_letter |= bool(letter.any())
        c = np.where(letter, c, 32)
        if i + PIECE > len(text):
            c = np.append(c, 32)
        c = c[(c != 32) | (np.append(last[-1], c[:-1]) != 32)]
        both = np.concatenate([last, c])
        old = len(last)
        two = both[:-1] * 40503 + both[1:] * 2654435761  # ends at its second character
        three = two[:-1] + both[2:] * 97531
        for count, h, size in zip(counts, (c, two[old - 1 :], three[max(0, old - 2) :]), SIZES):
            count += np.bincount((h & (size - 1)) if count is counts[0] else ((h >> 7) & (size - 1)), minlength=size)
        last = both[-2:]
    return counts, any_letter


def _unit(counts: list[np.ndarray]) -> np.ndarray:
    x = np.sqrt(np.concatenate([n / max(1, n.sum()) for n in counts]))
    return x / np.linalg.norm(x)


def features(text: str | None) -> np.ndarray | None:
    """Unit-length feature vector of a whole text; None without a letter."""
    counts, any_letter = _counts(text or "")
    return _unit(counts) if any_letter else None


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Weights (last: bias) of a linear SVM with squared hinge loss, classes
    of equal weight; ``y`` is +1 or -1.  Accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (penalty + 2 * (share @ (x * x).sum(1)))
    w = z = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (penalty * z - 2 * (share * y * slack) @ x)
        z = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """families: weights per family; pairs: weights for +first, -second language;
    centres: unit mean vector per language; usual: median evidence of its learned texts."""

    families: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]
    languages: dict[str, list[str]]
    centres: dict[str, np.ndarray] = field(default_factory=dict)
    usual: dict[str, float] = field(default_factory=dict)

    def evidence(self, x: np.ndarray, margin: float, lang: str) -> float:
        """``margin``: the best family's; a lone family, which has none to be told from, counts by the cosine."""
        cosine = float(self.centres[lang] @ x)
        return cosine + (margin if len(self.families) > 1 else 1.5 * cosine - 0.5)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, any_letter = _counts(text or "")
        if not any_letter or not self.families:
            return UND, 0.0
        x = np.append(_unit(counts), 1.0)
        margins = sorted(((float(w @ x), name) for name, w in self.families.items()), reverse=True)
        gap = margins[0][0] - (margins[1][0] if len(margins) > 1 else -margins[0][0])
        score = 1 / (1 + np.exp(-2 * gap)) if len(margins) > 1 else 1.0
        names = self.languages[margins[0][1]]
        votes = {name: [0, 0.0] for name in names}
        for a, b in combinations(names, 2):
            m = float(self.pairs[a, b] @ x)
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(names, key=lambda n: (*votes[n], n))
        for other in names:
            if other != best:
                m = float(self.pairs[min(best, other), max(best, other)] @ x) * (1 if best < other else -1)
                score = min(score, 1 / (1 + np.exp(-4 * m)))
        enough = FLOOR * self.usual[best] * min(1.0, np.log(counts[0].sum()) / np.log(SHORT))
        over = self.evidence(x[:-1], margins[0][0], best) / enough - 1
        score = min(score, 1 / (1 + (1 / MIN_SCORE - 1) * np.exp(-STEEP * over)))
        return best, float(score)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    langs_at = np.array(langs, dtype=object)
    names = sorted(set(langs))
    of = {name: family(name) for name in names}
    kinds = sorted(set(of.values()))
    in_family = np.array([of[n] for n in langs], dtype=object)
    families = {k: fit_svm(x, np.where(in_family == k, 1.0, -1.0)) for k in kinds}
    languages = {k: [n for n in names if of[n] == k] for k in kinds}
    pairs = {}
    for k in kinds:
        for a, b in combinations(languages[k], 2):
            own = (langs_at == a) | (langs_at == b)
            pairs[a, b] = fit_svm(x[own], np.where(langs_at[own] == a, 1.0, -1.0))
    model = Model(families, pairs, languages)
    for name in names:
        own = x[langs_at == name]
        centre = own.mean(0)
        model.centres[name] = centre / np.linalg.norm(centre)
        margins = own @ families[of[name]][:-1] + families[of[name]][-1]
        model.usual[name] = max(1e-3, float(np.median([model.evidence(v, m, name) for v, m in zip(own, margins)])))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, languages: int = 200) -> Model:
    """A model from at most ``per_language`` documents of each of the
    ``languages`` most frequent languages of ``docs``; their feature vectors
    (7 KB each) are what the driver gets.

    Documents are drawn by a hash of id and text (copies count once); about
    three times as many as are wanted are ranked by it within their language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = saved(counts, "languages")
    drawn = F.pmod(F.xxhash64(F.lit(3), "id", "text"), F.lit(1 << 40))
    rows = rows.withColumn("drawn", drawn).join(F.broadcast(counts), "lang").filter(F.col("drawn") < F.lit(3.0 * per_language * (1 << 40)) / F.col("n"))
    rows = saved(rows.groupBy("lang", "drawn").agg(F.first("text").alias("text")), "sample")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("drawn"))
    rows = rows.withColumn("first", first).filter(F.col("first") <= per_language)

    def of(text):
        x = features(text)
        return None if x is None else x.astype("<f2").tobytes()

    # no filter on x: it would be pushed below the join, to all rows
    got = rows.select("lang", F.udf(of, "binary")("text").alias("x")).collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got if r["x"] is not None)
    if not got:
        return Model({}, {}, {})
    return fit(np.stack([np.frombuffer(b, "<f2").astype(float) for _, b in got]), [lang for lang, _ in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    guess = F.udf(lambda text: shared.value.predict(text), "struct<lang_pred:string,score:double>")
    held = id_bucket(F.col(id_col), held_out[0]) == held_out[1]
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), guess(F.col(text_col)).alias("p")).select("doc_id", "held_out", "p.*")


def learned(docs: DataFrame, id_col: str = "doc_id", held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """The documents a model may learn from."""
    return docs.filter(id_bucket(F.col(id_col), held_out[0]) != held_out[1])


def accepted(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a language the model knows, with their own columns;
    rejected are ``und`` and those scored under ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ok(text):
        lang, score = shared.value.predict(text)
        return lang != UND and score >= min_score

    return docs.filter(F.udf(ok, "boolean")(F.col(text_col)))
