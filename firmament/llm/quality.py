"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones in windows.  Every
passage is encoded (character-class bigrams, word repetition, length, repeats
of an earlier passage of the text, through a learned layer), gated attention
weighs the passages with weights learned from the document labels alone, and
the weighted passage is scored: with h = relu(We x + be),
a = softmax(w . (tanh(V h) * sigmoid(U h))), score = sigmoid(c . sum(a h) + b).

Fitted on at most ``per_label`` labelled documents of each label, weighted
back to the labels' shares, and of a long one on at most ``per_bag`` passages
spread over it; scoring reads every passage of every text.

Defined results: null, empty and blank texts score 0; repeated rows get equal
rows; null ids are carried, count as the empty id text and so as held out
where that remainder says so; several labels of a document are averaged;
without labels every text scores 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmament.llm.store import id_bucket, saved

WINDOW = 600  # bytes of a passage at most
AT_ONCE = 4096  # passages encoded at a time
EXTRA = 8
HIDDEN, GATE = 32, 16

# Byte classes of the encoder; other bytes are class 15.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\r\n", b".", b",", b"!", b"?;:",
    b"'\"`", b"|", b"()[]{}<>", b"#$%&*@+=~^_", b"-/\\", bytes(range(128, 256)),
)
CLASS_OF = np.full(256, 15, np.int64)
for _i, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _i
DIMS = 256 + EXTRA


def passages(text: str | None) -> list[bytes]:
    """Non-blank lines, cut into windows; all of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [line[i : i + WINDOW] for line in raw.splitlines() for i in range(0, len(line), WINDOW) if line[i : i + WINDOW].strip()]


def encoded(text: str | None) -> Iterator[np.ndarray]:
    """One row of DIMS numbers per passage, AT_ONCE passages at a time."""
    parts, seen, before = passages(text), set(), b""
    for at in range(0, len(parts), AT_ONCE):
        some = parts[at : at + AT_ONCE]
        sizes = np.array([len(p) for p in some])
        code = CLASS_OF[np.frombuffer(b"".join(some), np.uint8)]
        owner = np.repeat(np.arange(len(some)), sizes)
        within = owner[1:] == owner[:-1]
        pair = (owner[1:] * 256 + code[:-1] * 16 + code[1:])[within]
        counts = np.bincount(pair, minlength=256 * len(some)).reshape(-1, 256)
        x = np.zeros((len(some), DIMS), np.float32)
        x[:, :256] = np.sqrt(counts / np.maximum(1, sizes - 1)[:, None])
        for i, part in enumerate(some):
            words = part.split()
            n, d = len(words), len(set(words))
            same = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
            twos = len(set(zip(words, words[1:]))) if n > 1 else 1
            x[i, 256:] = (d / n, same / n, twos / max(1, n - 1), min(1.0, sizes[i] / n / 20), np.log1p(n) / 5, part in seen, part == before, 1.0)
            seen.add(part)
            before = part
        yield x


def bag(text: str | None, most: int) -> np.ndarray:
    """The passages a model learns from: all, or ``most`` at even distances over the whole text."""
    n = len(passages(text))
    chosen = np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
    rows = [np.zeros((0, DIMS), np.float32)]
    for k, x in enumerate(encoded(text)):
        own = chosen[(chosen >= k * AT_ONCE) & (chosen < (k + 1) * AT_ONCE)]
        rows.append(x[own - k * AT_ONCE])
    return np.concatenate(rows)


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class Model:
    """The weights; none: every text scores 0.5."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hidden passages, the two gates and the attention logits."""
        p = self.p
        h = np.maximum(0, x @ p["We"] + p["be"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def decide(self, z: np.ndarray) -> float:
        return float(_sigmoid(z @ self.p["c"] + self.p["b"][0]))

    def forward(self, x: np.ndarray) -> tuple[float, dict]:
        h, t, s, e = self.attend(x)
        a = np.exp(e - e.max())
        a /= a.sum()
        z = a @ h
        return self.decide(z), {"h": h, "t": t, "s": s, "a": a, "z": z}

    def score(self, text: str | None) -> float:
        """All passages of a text, with a running softmax, so memory doesn't grow with their number."""
        top, weight, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in encoded(text):
            if not self.p:
                return 0.5
            h, _, _, e = self.attend(x)
            now = max(top, e.max())
            a, old = np.exp(e - now), np.exp(top - now)
            z, weight, top = z * old + a @ h, weight * old + a.sum(), now
        return self.decide(z / weight) if weight else 0.0

    def gradient(self, x: np.ndarray, slope: float, kept: dict, g: dict[str, np.ndarray]) -> None:
        """Adds the loss gradient of one bag; ``slope``: d loss / d logit."""
        p, h, t, s, a, z = self.p, kept["h"], kept["t"], kept["s"], kept["a"], kept["z"]
        g["c"] += slope * z
        g["b"] += slope
        dz = slope * p["c"]
        dh = np.outer(a, dz)
        da = h @ dz
        de = a * (da - a @ da)
        g["w"] += de @ (t * s)
        dts = np.outer(de, p["w"])
        dv, du = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["V"] += h.T @ dv
        g["U"] += h.T @ du
        dh += dv @ p["V"].T + du @ p["U"].T
        dh *= h > 0
        g["We"] += x.T @ dh
        g["be"] += dh.sum(0)


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = 30, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> Model:
    """Adam on the weighted log loss of the bags."""
    rng = np.random.default_rng(seed)
    shapes = {"We": (DIMS, HIDDEN), "be": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("be", "b") else np.zeros(s) for k, s in shapes.items()}
    model, m, v, step = Model(p), {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            g = {k: np.zeros(s) for k, s in shapes.items()}
            for j in order[i : i + batch]:
                score, kept = model.forward(bags[j])
                model.gradient(bags[j], weights[j] * (score - labels[j]) / batch, kept, g)
            step += 1
            for k in shapes:
                d = g[k] + 1e-4 * p[k]
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 600, per_bag: int = 256) -> Model:
    """A model from at most ``per_label`` documents of each label, and at most
    ``per_bag`` passages of each; their features are what the driver gets.

    Labelled ids are drawn by their hash; of the texts that have one of them
    (copies count once) the ``per_label`` first by hash are taken."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(per_label / n)).otherwise(share)
    picked = known.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # 2 * per_label ids
    texts = texts.groupBy("y", F.xxhash64(F.lit(7), "id", "text").alias("drawn")).agg(F.first("id").alias("id"), F.first("text").alias("text"))
    texts = saved(texts, "sample")
    # two steps, so that an id with very many rows is never ranked in one task
    for by in (["y", F.pmod("drawn", F.lit(256))], ["y"]):
        texts = texts.withColumn("first", F.row_number().over(Window.partitionBy(*by).orderBy("drawn"))).filter(F.col("first") <= per_label).drop("first")

    def of(text):
        x = bag(text, per_bag)
        return x.astype("<f2").tobytes() if len(x) else None

    # no filter on x: it would be pushed below the join, to all rows
    got = texts.select("id", "y", F.udf(of, "binary")("text").alias("x")).collect()
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in got if r["x"] is not None)
    if not got:
        return Model()
    y = np.array([r[1] for r in got], float)
    total = sum(counts.values())
    taken = {k: max(1, int((y == k).sum())) for k in counts}
    weights = np.array([counts[int(k)] / total * len(y) / taken[int(k)] for k in y])
    return fit([np.frombuffer(r[2], "<f2").astype(float).reshape(-1, DIMS) for r in got], y, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    of = F.udf(lambda text: shared.value.score(text), "double")
    held = id_bucket(F.col(id_col), held_out[0]) == held_out[1]
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), of(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
