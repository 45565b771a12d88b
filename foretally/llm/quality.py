"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential is linear in the features of the line and
of its two neighbours, a transition potential ties neighbouring labels, and forward-backward
gives each line's marginal. A document's quality is a calibrated function of its marginals,
weighted by line length.

Only documents carry labels. A line-wise classifier fitted on the documents' labels first says which
lines of low-quality documents look good; the field is then trained on these line labels by
gradient steps on its conditional likelihood.

Nulls and odd input: a null text counts as empty, an empty text is one empty line; a row with a
null id is scored like any other; repeated rows get equal scores; without labels of both
kinds every score is the same; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_pieces
from foretally.llm.fitting import calibrated, fit_logistic, held_out, labelled_sample, sigmoid
from foretally.workspace import settle

ACCEPT = 0.5
_STEPS = 150
_KINDS = 10


def _byte_kinds() -> np.ndarray:
    """For each byte: space, lower case, upper case, digit, sentence mark, exclamation, bar, other symbol, beyond ASCII, line break."""
    kind = np.full(256, 7, np.int64)
    kind[[9, 11, 12, 13, 32]] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[ord(c) for c in ".,;:?'\"()-"]] = 4
    kind[ord("!")] = 5
    kind[ord("|")] = 6
    kind[128:] = 8
    kind[10] = 9
    return kind


@dataclass
class QualityModel:
    """Weights of the line features, transition potentials (from, to; 1 is bad), scaling, and the calibration."""

    node: np.ndarray = field(default_factory=lambda: np.zeros(0))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(3))


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, where each text's lines start, line lengths in bytes)."""
    split = pc.split_pattern(texts, "\n")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    lines = split.flatten()
    n = len(lines)
    lengths = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lines), "")[0].as_buffer() if n else b""
    kinds = _byte_kinds()[np.frombuffer(joined, np.uint8)]
    kinds += np.repeat(np.arange(n) * _KINDS, lengths)
    counts = np.bincount(kinds, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    shares = counts[:, :9] / np.maximum(lengths, 1)[:, None]
    word_lists = pc.ascii_split_whitespace(lines)
    starts = word_lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    words = word_lists.flatten()
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = pc.equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
    same[starts[:-1][starts[:-1] < len(words)]] = False  # a line's first word repeats none
    running = np.concatenate([[0], np.cumsum(same)])
    repeats = (running[starts[1:]] - running[starts[:-1]]) / np.maximum(np.diff(starts), 1)
    codes = pc.dictionary_encode(lines)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pair = text_of * max(len(codes.dictionary), 1) + codes.indices.to_numpy(zero_copy_only=False)
    copied = np.ones(n)
    copied[np.unique(pair, return_index=True)[1]] = 0.0
    own = np.column_stack([shares, repeats, copied, np.log1p(lengths), np.log1p(np.diff(starts))])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[offsets[:-1]], last[offsets[1:] - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0.0, 0.0
    return np.column_stack([np.ones(n), own, before, first, after, last]), offsets, lengths


def marginals(bad: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability that each line is bad, summed transition marginals, log partition), over all chains at once.

    ``bad`` is each line's log-potential of being bad, good being zero. Chains advance together, longest first.
    """
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    starts, counts = offsets[:-1][order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    live = np.searchsorted(-counts, -np.arange(longest), side="left")  # chains longer than t
    top = np.maximum(bad, 0)
    node = np.column_stack([np.exp(-top), np.exp(bad - top)])
    move = np.exp(moves - moves.max())
    alpha, norm = np.zeros((len(bad), 2)), np.ones(len(bad))
    for t in range(longest):
        at = starts[: live[t]] + t
        a = node[at] if t == 0 else node[at] * (alpha[at - 1] @ move)
        norm[at] = a.sum(axis=1)
        alpha[at] = a / norm[at][:, None]
    beta, pairs = np.ones((len(bad), 2)), np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        after = node[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        beta[at] = after @ move.T
        pairs += (alpha[at].T @ after) * move
    p = alpha * beta
    log_z = float(np.log(norm).sum() + top.sum() + moves.max() * (len(bad) - len(counts)))
    return p[:, 1] / p.sum(axis=1), pairs, log_z


def train_field(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray, steps: int = _STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that raise the labels' conditional likelihood, by adaptive gradient steps."""
    n = len(features)
    inner = np.ones(n, bool)
    inner[offsets[:-1]] = False
    now, past = labels[inner].astype(int), labels[np.flatnonzero(inner) - 1].astype(int)
    seen = np.bincount(past * 2 + now, minlength=4).reshape(2, 2).astype(float)
    theta = np.zeros(features.shape[1] + 4)
    speed, inertia = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, pairs, _ = marginals(features @ theta[:-4], theta[-4:].reshape(2, 2), offsets)
        slope = np.concatenate([features.T @ (labels - p), (seen - pairs).ravel()]) / n - 1e-3 * theta
        inertia = 0.9 * inertia + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope**2
        theta += 0.1 * (inertia / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _scaled(features: np.ndarray, model: QualityModel) -> np.ndarray:
    return (features - model.mean) / model.spread


def _document_features(p: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted share of bad lines, and the same as log-odds."""
    weight = lengths + 1.0
    share = np.add.reduceat(weight * p, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.column_stack([share, np.log(share / (1 - share))])


def score_texts(texts: pa.Array, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality of each text, probability of each line to be bad, where each text's lines start)."""
    features, offsets, lengths = line_features(texts)
    if not len(model.node):
        return np.full(len(texts), sigmoid(model.calibration[0])), np.zeros(len(lengths)), offsets
    p, _, _ = marginals(_scaled(features, model) @ model.node, model.moves, offsets)
    x = _document_features(p, lengths, offsets)
    return calibrated(x, model.calibration), p, offsets


def fit(docs: DataFrame, labels: DataFrame, rows: int | None = None, **columns) -> QualityModel:
    """The model, from a bounded sample of labelled rows outside the held-out fold."""
    limit = {} if rows is None else {"rows": rows}
    sample = settle(labelled_sample(docs, labels, "quality", **limit, **columns), "quality-sample")

    def lines(piece: pa.RecordBatch) -> pa.RecordBatch:
        features, offsets, lengths = line_features(piece.column("text"))
        kind = pa.list_(pa.float32())
        cells = [[f.astype(np.float32).ravel() for f in np.split(m, offsets[1:-1])] for m in (features, lengths[:, None])]
        return pa.RecordBatch.from_arrays(
            [piece.column("label").cast(pa.int32()), *(pa.array(c, kind) for c in cells)], ["label", "features", "lengths"]
        )

    # numbers of the bounded sample's lines, not texts
    table = map_pieces(sample.select("label", "text"), lines, "label int, features array<float>, lengths array<float>", "text").toArrow()
    model = QualityModel()
    good = table.column("label").to_numpy().astype(float)
    if not len(good) or good.min() == good.max():
        model.calibration[0] = 0.0 if not len(good) else (4.0 if good[0] else -4.0)
        return model
    lengths = pc.list_flatten(table.column("lengths")).to_numpy().astype(float)
    features = pc.list_flatten(table.column("features")).to_numpy().astype(float).reshape(len(lengths), -1)
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column("lengths")).to_numpy())]).astype(np.int64)
    model.mean, model.spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    model.mean[0], model.spread[0] = 0.0, 1.0
    x = _scaled(features, model)
    bad_text = np.repeat(1 - good, np.diff(offsets))
    share = (lengths + 1) / np.repeat(np.add.reduceat(lengths + 1, offsets[:-1]), np.diff(offsets))
    alone = fit_logistic(x[:, 1:], bad_text, weights=share)
    labels_ = bad_text * (sigmoid(alone[0] + x[:, 1:] @ alone[1:]) > 0.5)
    model.node, model.moves = train_field(x, offsets, labels_)
    p, _, _ = marginals(x @ model.node, model.moves, offsets)
    model.calibration = fit_logistic(_document_features(p, lengths, offsets), good)
    return model


def score_documents(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, line_marginals): the quality of each text, and for each line the probability that it is bad."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def score(piece: pa.RecordBatch) -> pa.RecordBatch:
        q, p, offsets = score_texts(filled(piece.column(1)), model)
        cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(p, pa.float64()))
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(q), cells], ["doc_id", "score", "line_marginals"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_pieces(rows, score, f"doc_id {kind}, score double, line_marginals array<double>", "text")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_bad_lines) of every document."""
    found = score_documents(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
        F.size(F.filter("line_marginals", lambda p: p >= 0.5)).alias("n_bad_lines"),
    )
