"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Each line of a text is a position of a chain, described by indicator features. Viterbi decoding
marks each line as content or boilerplate; the share of words in content lines decides whether a
document that passes the base rules is kept. The field is fitted here, by gradient ascent on the
conditional likelihood, to lines of labelled documents. Their labels are of whole documents: quality 1
says that most words are content, quality 0 that most are not. So lines are labelled within them: at
first each like its document; then, from weights fitted to single lines, a line that clearly looks like
the other kind takes the other label, the clearest first, as long as the document's own kind keeps more
than half of the words; and so again from the new labels. The field is fitted to these labels, which
change inside a text, so its moves learn where boilerplate begins and ends.
The labelled sample is bounded (``SAMPLE`` documents, taken in the order of a hash of their id, and the
first ``SAMPLE_LINES`` lines of each); all else covers every row and whole texts.

Rules and labels are a map over rows without any shuffle: hot keys do not matter, and a lost executor
costs its running tasks alone. Texts pass in small batches, so a very long text is held alone, with
some 200 bytes for each of its lines.

Edge cases: null text counts as having no words and fails the base rules; a text of blank lines
likewise; without labelled rows of both kinds every document that passes the base rules is kept; an
empty table gives no rows; lines that either label fits as well count as content; a document of just
the content share that is asked for stays; repeated rows and null ids give a row each; of contradicting
labels of one id the lower quality counts, and of its texts the one with the smallest hash is fitted
to; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, map_rows

#: Labelled documents that the field is fitted to, and lines of each, at most.
SAMPLE, SAMPLE_LINES = 1500, 512
#: Rounds of labelling lines, and by what odds (as a logarithm) a line must look like the other kind.
ROUNDS, CLEARLY = 2, 1.0
#: A document stays if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_END = re.compile(r"[.!?:;\"'»)]\Z")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    text = text or ""
    words = text.encode().split()  # bytes: just the white space of ASCII
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that are found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    w = np.fromiter([numbers.setdefault(x, len(numbers)) for x in words], dtype=np.uint64, count=len(words))
    if len(numbers) == len(words):
        return 0
    # a window found twice is made of pairs found twice; the few that are left are compared as they are
    pair = w[:-1] * np.uint64(len(words) + 1) + w[1:]
    _, number, count = np.unique(pair, return_inverse=True, return_counts=True)
    common = count[number] > 1
    maybe = common[:n].copy()
    for j in range(1, width - 1):
        maybe &= common[j : j + n]
    at = np.flatnonzero(maybe)
    rows = w[at[:, None] + np.arange(width)]
    found: dict[bytes, int] = {}
    keys = [r.tobytes() for r in rows]
    for k in keys:
        found[k] = found.get(k, 0) + 1
    at = at[[found[k] > 1 for k in keys]] if keys else at
    if not len(at):
        return 0
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


#: What each indicator of a line says.
FEATURES = (
    "always", "first line", "last line", "1 to 3 words", "4 to 9 words", "30 words or more", "ends like a sentence", "a symbol in 20 characters",
    "a symbol in 100 characters", "two bars or more", "half of the letters upper case", "a digit in 5 characters", "half of the words seen before in the line",
    "equal to an earlier line", "no lower-case letter", "two exclamation marks", "mean word of 15 characters or more", "mean word of 2 characters or less",
)


def _kinds() -> np.ndarray:
    """Kind of each character: 0 other, 1 symbol, 2 bar, 3 digit, 4 upper-case, 5 lower-case letter,
    6 white space; characters from U+3000 on count as other."""
    out = np.zeros(0x3001, dtype=np.int64)
    for c in range(0x3000):
        ch = chr(c)
        out[c] = 2 if ch == "|" else 1 if ch in SYMBOLS else 3 if ch in "0123456789" else 6 if ch in _SPACES else 4 if ch.isupper() else 5 if ch.islower() else 0
    return out


_KINDS = _kinds()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indicators of each line with a word, its number of words)."""
    every = text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line_of = np.cumsum(points == 10) * 7
    table = np.bincount(line_of + _KINDS[np.minimum(points, 0x3000)], minlength=7 * len(every)).reshape(-1, 7)
    table[:-1, 6] -= 1  # the line feed itself
    split = [x.encode().split() for x in every]
    at = [k for k, words in enumerate(split) if words]
    lines, words, table = [every[k] for k in at], [split[k] for k in at], table[at]
    n = np.array([len(x) for x in words], dtype=np.int64)
    if not len(n):
        return np.zeros((0, len(FEATURES)), dtype=np.int8), n
    chars = table.sum(axis=1)
    symbols, bars, digits, upper, lower = table[:, 1] + table[:, 2], table[:, 2], table[:, 3], table[:, 4], table[:, 5]
    in_words, index = chars - table[:, 6], np.arange(len(n))
    seen: set[str] = set()
    again = [x in seen or seen.add(x) is not None for x in lines]
    out = np.stack([
        index >= 0, index == 0, index == len(n) - 1, n <= 3, (n >= 4) & (n <= 9), n >= 30,
        np.array([_END.search(x.rstrip(_SPACES)) is not None for x in lines]), 20 * symbols >= chars, 100 * symbols >= chars, bars >= 2, upper > lower,
        5 * digits >= chars, (2 * np.array([len(set(x)) for x in words]) <= n) & (n > 1), np.array(again), lower == 0,
        np.array([x.count("!!") >= 2 for x in lines]), in_words >= 15 * n, in_words <= 2 * n,
    ], axis=1).astype(np.int8)
    return out, n


class LineField:
    """A linear-chain conditional random field over two labels, 0 content and 1 boilerplate."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = np.round(weights, 6), np.round(moves, 6)  # (2, features), (2, 2)

    @classmethod
    def fit(cls, chains: list[np.ndarray], labels: list, rounds: int = 150, rate: float = 0.1, shrink: float = 1e-3) -> LineField:
        """Gradient ascent with adaptive steps. ``labels`` has the labels of each chain's lines, or one for all of them."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        chains, marks = [chains[i].astype(float) for i in order], [np.broadcast_to(labels[i], len(chains[i])) for i in order]
        longest, n_feat = len(chains[0]), chains[0].shape[1]
        lengths = np.array([len(c) for c in chains])
        live = [int((lengths > t).sum()) for t in range(longest)]
        x = [np.stack([chains[i][t] for i in range(live[t])]) for t in range(longest)]
        y = [np.array([marks[i][t] for i in range(live[t])]) for t in range(longest)]
        theta = np.zeros(2 * n_feat + 4)
        m, v, total = np.zeros_like(theta), np.zeros_like(theta), lengths.sum()
        for step in range(1, rounds + 1):
            w, trans = theta[: 2 * n_feat].reshape(2, n_feat), theta[2 * n_feat :].reshape(2, 2)
            score = [xt @ w.T for xt in x]
            alpha, beta = [score[0]], [np.zeros((k, 2)) for k in live]
            for t in range(1, longest):
                alpha.append(score[t] + np.logaddexp(alpha[-1][: live[t], :1] + trans[0], alpha[-1][: live[t], 1:] + trans[1]))
            for t in range(longest - 2, -1, -1):
                k = live[t + 1]
                ahead = score[t + 1] + beta[t + 1]
                beta[t][:k] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
            z = np.logaddexp(*(alpha[0] + beta[0]).T)
            g_w, g_t = np.zeros_like(w), np.zeros((2, 2))
            for t in range(longest):
                k = live[t]
                p = np.exp(alpha[t] + beta[t] - z[:k, None])
                truth = np.stack([y[t] == 0, y[t] == 1], axis=1)
                g_w += (truth - p).T @ x[t]
                if t:
                    pair = np.exp(alpha[t - 1][:k, :, None] + trans + (score[t] + beta[t])[:, None, :] - z[:k, None, None])
                    g_t -= pair.sum(axis=0)
                    np.add.at(g_t, (y[t - 1][:k], y[t]), 1)
            grad = np.concatenate([g_w.ravel(), g_t.ravel()]) / total - shrink * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(theta[: 2 * n_feat].reshape(2, n_feat), theta[2 * n_feat :].reshape(2, 2))

    def decode(self, features: np.ndarray) -> list[int]:
        """The likeliest labels (Viterbi); ties go to content."""
        if not len(features):
            return []
        score = (features @ self.weights.T).tolist()
        (t00, t01), (t10, t11) = self.moves.tolist()
        a, b = score[0]
        back = []
        for s0, s1 in score[1:]:
            from0, from1 = b + t10 > a + t00, b + t11 > a + t01
            a, b = s0 + (b + t10 if from0 else a + t00), s1 + (b + t11 if from1 else a + t01)
            back.append((from0, from1))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def labelled_lines(chains: list[np.ndarray], words: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, clearly: float = CLEARLY) -> list[np.ndarray]:
    """Labels of the lines of documents, from one label for each document."""
    marks = [np.full(len(c), y) for c, y in zip(chains, labels, strict=True)]
    for _ in range(rounds):
        lines, y = np.concatenate(chains), np.concatenate(marks)
        seen, at, count = np.unique(np.column_stack([lines, y]), axis=0, return_inverse=True, return_counts=True)
        w = _single_lines(seen[:, :-1].astype(float), seen[:, -1], count)
        odds = lines @ w  # of boilerplate
        ends = np.cumsum([len(c) for c in chains])[:-1]
        for k, (odd, n, label) in enumerate(zip(np.split(odds, ends), words, labels, strict=True)):
            other = -odd if label else odd
            marks[k] = np.full(len(n), label)
            order = np.lexsort((np.arange(len(n)), -other))
            taken = np.cumsum(n[order])
            marks[k][order[(other[order] > clearly) & (2 * taken < n.sum())]] = 1 - label
    return marks


def _single_lines(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 50, shrink: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps over distinct lines with their counts."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w)), x.T @ (count * (y - p)) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(w, 6)


def content_share(field: LineField | None, text: str) -> float:
    """Share of the words that are in content lines; 1 without a field."""
    features, counts = line_features(text)
    if field is None or not len(counts):
        return 1.0
    return float(counts[np.array(field.decode(features)) == 0].sum() / counts.sum())


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> LineField | None:
    """A field fitted to at most ``sample`` labelled documents; None unless both kinds are there."""
    known = labels.select(F.col("doc_id").alias("id"), "quality").filter("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # bounded by ``sample``
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")

    def run(ids, texts, hashes, quality):
        found = [line_features(t or "") for t in texts]
        return {"id": ids, "h": hashes, "quality": quality, "x": [x[:SAMPLE_LINES].tobytes() for x, _ in found], "n": [n[:SAMPLE_LINES].tobytes() for _, n in found]}

    lines = map_rows(texts.select("id", "text", F.xxhash64("text"), "quality"), "id long, h long, quality int, x binary, n binary", run)
    rows = lines.groupBy("id").agg(F.min(F.struct("h", "quality", "x", "n")).alias("m")).select("id", "m.quality", "m.x", "m.n").orderBy("id").limit(sample).collect()
    rows = [r for r in rows if r.x]
    chains, words, labels = [np.frombuffer(r.x, dtype=np.int8).reshape(-1, len(FEATURES)) for r in rows], [np.frombuffer(r.n, dtype=np.int64) for r in rows], [1 - r.quality for r in rows]
    if len(set(labels)) < 2:
        return None
    return LineField.fit(chains, labelled_lines(chains, words, labels))


def judge(docs: DataFrame, field: LineField | None, share: float = CONTENT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and
    ``content_share`` of every row."""

    def run(ids, texts):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        counts = [base_counts(t) for t in texts]
        failed = [base_failed(c[0], c[4]) for c in counts]
        shares = [content_share(field, t or "") for t in texts]
        out = {"doc_id": ids, "base_failed": failed, "content_share": shares, "kept": [not f and s >= share for f, s in zip(failed, shares, strict=True)]}
        return out | {n: [c[k] for c in counts] for k, n in enumerate(names)}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), schema, run)


def keep_good(docs: DataFrame, field: LineField | None, share: float = CONTENT_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that ``judge`` keeps; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, kept = whole.slice(at, ROWS), []
                for t in batch.column(text_col):
                    text = t.as_py() or ""
                    words = text.encode().split()
                    kept.append(not base_failed(len(words), repeated_words(words)) and content_share(field, text) >= share)
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_lines(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, labels array<int>``: the label of each line with a word, 0 content, 1 boilerplate."""

    def run(ids, texts):
        found = [line_features(t or "")[0] for t in texts]
        return {"doc_id": ids, "labels": [field.decode(x) if field else [0] * len(x) for x in found]}

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), "doc_id long, labels array<int>", run)


def op8_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit_field(docs, labels))
