"""Quality of documents from labels of their lines: a linear-chain conditional random field.

Every line with a word is good or bad. Its features are shares of character classes, repetition and
lengths, of itself and of the lines before and after it; neighbouring labels are tied by transition
weights. Only documents are labelled, so the field is fitted in rounds: first every line has its
document's label, then the lines of bad documents that look good are given back (the worst stays bad).
Forward-backward marginals, weighted by the lines' lengths, make a document's quality, which a
logistic fit turns into a score.

Whole texts are scored. Texts without a word (null ones among them) have no lines and get the share of
good rows among such rows of the sample, or 0. If the sample has only one class or no row, every score
is its share of good rows. Rows without an id and repeated rows are scored each; labels without an id are
left out, of a repeated label the larger counts. Of lines that look equally bad the first is the worst. An
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsift.llm.frames import keyed_texts, map_rows
from mailsift.llm.labelled import logistic, probability, sample

# Labelled documents per class the field is fitted on; of these, ones with more lines are left out of the fit,
# and so are those behind the first that hold so many lines of their class: 37 numbers a line go to the driver.
SAMPLE = 2000
FIT_LINES = 1000
CLASS_LINES = 200_000
ROUNDS, STEPS, RATE = 2, 120, 0.1
RIDGE = 1e-3

SYMBOLS = b"#*$%&|<>@^~=+_{}[]\\/"
MARKS = b"!?"
STOPS = b".,;:'\"()-"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
OWN = 12


def line_features(lines: list[str]) -> np.ndarray:
    """One row per line: own features, those of the line before, of the line after, and 1."""
    own = np.empty((len(lines), OWN))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        data = line.encode()
        n = len(data)
        words = line.split()
        k = max(len(words), 1)
        share = [(n - len(data.translate(None, kind))) / n for kind in (SYMBOLS, MARKS, STOPS, DIGITS, UPPER)]
        own[i] = (
            *(min(x * 10, 3.0) for x in share),
            1.0 - len(set(words)) / k,
            sum(map(eq, words, words[1:])) / k,
            min(n / k / 10, 3.0),
            np.log1p(k) / 5,
            1.0 if k < 4 else 0.0,
            1.0 if line in seen else 0.0,
            share[0] > 0.03,
        )
        seen.add(line)
    out = np.zeros((len(lines), 3 * OWN + 1))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[:, -1] = 1.0
    return out


def text_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()]


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of 'good' and expected counts of transitions (bad/good x bad/good).

    ``scores``: of good against bad, one per line. ``moves``: 2 x 2 weights of neighbouring labels.
    """
    n = len(scores)
    good = 1.0 / (1.0 + np.exp(-np.clip(scores, -30, 30)))
    (a, b), (c, d) = np.exp(moves).tolist()
    g = good.tolist()
    f = [0.0] * n  # scaled forward weight of good; bad has the rest
    p = g[0]
    f[0] = p
    for t in range(1, n):
        bad, ok = ((1 - p) * a + p * c) * (1 - g[t]), ((1 - p) * b + p * d) * g[t]
        p = ok / (bad + ok)
        f[t] = p
    marginal = [0.0] * n
    expected = np.zeros((2, 2))
    back_bad = back_ok = 1.0
    marginal[-1] = f[-1]
    e00 = e01 = e10 = e11 = 0.0
    for t in range(n - 1, 0, -1):
        ok, bad = g[t] * back_ok, (1 - g[t]) * back_bad
        p = f[t - 1]
        w00, w01, w10, w11 = (1 - p) * a * bad, (1 - p) * b * ok, p * c * bad, p * d * ok
        total = w00 + w01 + w10 + w11
        e00, e01, e10, e11 = e00 + w00 / total, e01 + w01 / total, e10 + w10 / total, e11 + w11 / total
        marginal[t - 1] = (w10 + w11) / total
        back_bad, back_ok = a * bad + b * ok, c * bad + d * ok
        scale = back_bad + back_ok
        back_bad, back_ok = back_bad / scale, back_ok / scale
    expected[:] = ((e00, e01), (e10, e11))
    return np.array(marginal), expected


@dataclass
class LineField:
    """Weights of the field and of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * OWN + 1))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray | None = None
    base: float = 0.0
    wordless: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        return forward_backward(x @ self.weights, self.moves)[0]

    def features(self, text: str) -> list[float] | None:
        """Length-weighted quality of the lines, the worst line, the share of bad text; None without lines."""
        lines = text_lines(text)
        if not lines:
            return None
        return self.summary(line_features(lines), np.array([len(x) for x in lines], dtype=float))

    def summary(self, x: np.ndarray, lengths: np.ndarray) -> list[float]:
        good = self.marginals(x)
        share = lengths / lengths.sum()
        quality = float(good @ share)
        q = min(max(quality, 1e-4), 1 - 1e-4)
        return [quality, float(np.log(q / (1 - q))) / 4, float(good.min()), float(share[good < 0.5].sum()), float(np.log1p(lengths.sum())) / 8]

    def score(self, text: str) -> float:
        found = self.features(text)
        if self.document is None:
            return self.base
        return self.wordless if found is None else probability(self.document, found)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        """Fit to documents of line features; rounds give good-looking lines of bad documents back."""
        goal = [np.full(len(x), float(y)) for x, y in zip(docs, labels, strict=True)]
        stacked = np.vstack(docs)
        ends = np.cumsum([len(x) for x in docs])
        starts = ends - [len(x) for x in docs]
        # A document's lines weigh as one document does.
        per_line = np.repeat(weight / (ends - starts) ** 0.5, ends - starts)
        for number in range(ROUNDS):
            if number:
                for i, x in enumerate(docs):
                    if not labels[i]:
                        good = self.marginals(x)
                        goal[i] = (good > 0.5).astype(float)
                        goal[i][int(good.argmin())] = 0.0
            target = np.concatenate(goal)
            seen = np.zeros((2, 2))
            for i, y in enumerate(goal):
                for a, b in zip(y[:-1], y[1:], strict=True):
                    seen[int(a), int(b)] += weight[i] / len(y) ** 0.5
            self._ascend(stacked, starts, ends, per_line, weight, target, seen)

    def _ascend(self, stacked, starts, ends, per_line, weight, target, seen) -> None:
        """Adam steps on the penalised log-likelihood of the labels."""
        size = len(self.weights)
        theta = np.concatenate([self.weights, self.moves.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        norm = per_line.sum()
        for step in range(1, STEPS + 1):
            scores = stacked @ theta[:size]
            moves = theta[size:].reshape(2, 2)
            good = np.empty(len(scores))
            expected = np.zeros((2, 2))
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                good[a:b], e = forward_backward(scores[a:b], moves)
                expected += e * weight[i] / (b - a) ** 0.5
            slope = np.concatenate([stacked.T @ (per_line * (target - good)), (seen - expected).ravel()]) / norm
            slope -= RIDGE * theta
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights, self.moves = theta[:size], theta[size:].reshape(2, 2)


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = SAMPLE) -> LineField:
    """A field from ``labels`` (doc_id, quality) of the rows where ``learn`` holds."""
    learn = F.lit(True) if learn is None else learn
    taken, weight = sample(documents, labels, "quality", learn, per_class)
    # Of at most ``per_class`` rows each; in the sample's own order.
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id")
    lines_before = F.sum(F.least(F.size(F.split("text", "\n")), F.lit(FIT_LINES))).over(order)
    taken = taken.withColumn("_lines", lines_before).filter(F.col("_lines") <= CLASS_LINES)

    def rows(slices):
        for part in slices:
            out = []
            for text, y in zip(part["text"], part["y"], strict=True):
                lines = text_lines(text)
                if len(lines) <= FIT_LINES:
                    x = line_features(lines) if lines else np.zeros((0, 3 * OWN + 1))
                    out.append((y, x.tobytes(), [float(len(line)) for line in lines]))
            yield out

    found = map_rows(taken.select("text", "y"), rows, "y int, x binary, lengths array<double>").collect()
    model = LineField()
    model.base = float(sum(r["y"] for r in found)) / max(len(found), 1)
    blank = [r["y"] for r in found if not r["lengths"]]
    model.wordless = float(sum(blank)) / len(blank) if blank else 0.0
    found = sorted((r for r in found if r["lengths"]), key=lambda r: (r["y"], r["lengths"], r["x"]))
    if len({r["y"] for r in found}) < 2:
        return model
    docs = [np.frombuffer(r["x"]).reshape(len(r["lengths"]), -1) for r in found]
    y = np.array([r["y"] for r in found])
    # The field learns from both classes alike, the score from their true shares.
    model.fit(docs, y, np.ones(len(y)))
    x = np.array([model.summary(d, np.array(r["lengths"])) for d, r in zip(docs, found, strict=True)])
    model.document = logistic(x, y, np.array([weight[k] for k in y.tolist()]) / max(weight.values()))
    return model


def score_texts(documents: DataFrame, model: LineField, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def rows(slices):
        for part in slices:
            yield [(d, float(model.score(t))) for d, t in zip(part["doc_id"], part["text"], strict=True)]

    return map_rows(keyed_texts(documents, key, text), rows, "doc_id long, score double")
