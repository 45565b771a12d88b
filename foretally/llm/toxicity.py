"""Toxicity by maximum-scoring segment search.

A term's score is a lower bound of its log-odds in toxic against other documents, under Dirichlet
priors drawn from the term's overall frequency. A term is a word, or the beginning of words too
rare to have a score of their own. All other words cost ``DRIFT``. A linear scan over a
document's scores finds every maximal segment; the extreme-value law of such segments in clean
text turns a segment's score and the document's length into an E-value, and the significant
segments' evidence is aggregated and calibrated to a probability.

Counts are of distinct contexts (a word with its neighbours at its first place in a document), so
neither repetition in a document nor copies of one count again.

Nulls and odd input: a null or empty text has no segment and gets the base score; a row with a
null id is scored like any other and isn't held out; repeated rows get equal scores; without any
label of both kinds the model is empty and every score is the base rate; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_arrow, map_pieces, pieces, words_of
from foretally.llm.fitting import calibrated, fit_logistic, held_out, labelled_sample
from foretally.workspace import settle

DRIFT = 0.03
PRIOR_WEIGHT = 4.0
PRIOR_FLOOR = 0.5
BOUND_Z = 2.5
MIN_SUPPORT = 8
PREFIXES = (7, 6, 5, 4, 3)
SIGNIFICANT = 0.01
#: Clean documents of the sample that the law's scale needs, and the scales that it may take.
LAW_SUPPORT = 20
LAW_SCALES = (0.01, 50.0)
REJECT = 0.7
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_~`"


@dataclass
class ToxicModel:
    """Scores of whole words, scores of word beginnings by length, the law of clean segments, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[int, dict[str, float]] = field(default_factory=dict)
    log_k: float = 0.0
    scale: float = 1.0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))


def normal_form(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.ascii_trim(words, characters=_EDGE))


def token_scores(words: pa.Array, model: ToxicModel) -> np.ndarray:
    """Each word's score: its own, else that of its longest known beginning, else the drift."""
    coded = pc.dictionary_encode(words)
    forms = normal_form(coded.dictionary)
    scores = np.full(len(forms), -DRIFT)
    if len(forms):
        lengths = pc.utf8_length(forms).to_numpy(zero_copy_only=False)
        open_ = np.ones(len(forms), bool)
        for size in (None, *PREFIXES):
            table = model.words if size is None else model.prefixes.get(size, {})
            if not table:
                continue
            keys = forms if size is None else pc.utf8_slice_codeunits(forms, 0, size)
            at = pc.fill_null(pc.index_in(keys, value_set=pa.array(list(table), pa.string())), -1).to_numpy(zero_copy_only=False)
            hit = open_ & (at >= 0) & (True if size is None else lengths > size)
            scores[hit] = np.array(list(table.values()))[at[hit]]
            open_ &= ~hit
    return scores[coded.indices.to_numpy(zero_copy_only=False)]


def maximal_segments(places: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that is ``values`` at ``places``, else ``-drift``.

    One pass from left to right. A segment knows the nearest one before it that begins at a lower sum;
    following these links, a new positive word joins the segments that it makes better, each merged once.
    """
    total, last = 0.0, -1
    firsts: list[int] = []
    lasts: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    lower: list[int] = []
    for place, value in zip(places, values):
        low = total - drift * (place - last - 1)
        total, last, first = low + value, place, place
        at = len(firsts) - 1
        while True:
            while at >= 0 and lows[at] >= low:
                at = lower[at]
            if at < 0 or highs[at] >= total:
                break
            first, low, before = firsts[at], lows[at], lower[at]
            for held in (firsts, lasts, lows, highs, lower):
                del held[at:]
            at = before
        for held, item in ((firsts, first), (lasts, place), (lows, low), (highs, total), (lower, at)):
            held.append(item)
    return [(a, b, high - low) for a, b, low, high in zip(firsts, lasts, lows, highs)]


def evidence(score: float, n_words: int, model: ToxicModel) -> float:
    """Minus the logarithm of the E-value: how many segments as good clean text of this length would hold."""
    return model.scale * score - model.log_k - math.log(max(n_words, 1))


def fit_law(n_words: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(log K, scale) of the extreme-value law of documents' best segments, by maximum likelihood.

    The law: a document of n words has no segment above x with probability exp(-K n exp(-scale x)). Documents whose
    best score isn't above the smallest positive one (most have no segment at all) count by that alone. For a given
    scale the best K has a closed form, and the slope of the likelihood in the scale falls, so halving finds
    its zero. Fewer than ``LAW_SUPPORT`` documents above that score leave the scale of pure log-odds, 1.
    """
    n_words, best = n_words[n_words > 0].astype(float), best[n_words > 0].astype(float)
    positive = best[best > 0]
    if not len(positive):
        return math.log(0.5 / max(n_words.sum(), 1.0)), 1.0
    least = positive.min()
    above, x = best > least, np.maximum(best, least) - least
    m = int(above.sum())
    total = x[above].sum()
    if m < LAW_SUPPORT or total <= 0:
        return math.log(len(positive) / n_words.sum()) + least, 1.0

    def weighted(scale: float) -> np.ndarray:
        return n_words * np.exp(-scale * x)

    def slope(scale: float) -> float:
        w = weighted(scale)
        return m / scale - total + m * float((w * x).sum() / w.sum())

    low, high = LAW_SCALES
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    scale = math.sqrt(low * high)
    return math.log(m / weighted(scale).sum()) + scale * least, scale


def document_segments(texts: pa.Array, model: ToxicModel) -> Iterator[tuple[int, int, list[tuple[int, int, float, float]]]]:
    """For each text with a positive word: its row, its word count, and its segments with their evidence."""
    words, offsets = words_of(texts)
    scores = token_scores(words, model)
    positive = np.flatnonzero(scores > 0)
    rows = np.searchsorted(offsets, positive, side="right") - 1
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    for begin, end in zip(heads, np.append(heads[1:], len(rows))):
        row = int(rows[begin])
        places = (positive[begin:end] - offsets[row]).tolist()
        n = int(offsets[row + 1] - offsets[row])
        found = maximal_segments(places, scores[positive[begin:end]].tolist(), DRIFT)
        yield row, n, [(a, b, s, evidence(s, n, model)) for a, b, s in found]


def _features(segments: list[tuple[int, int, float, float]], n_words: int) -> tuple[float, float, float]:
    good = [e for *_, e in segments if e > -math.log(SIGNIFICANT)]
    best = max((e for *_, e in segments), default=0.0)
    return min(max(best, 0.0), 300.0), math.log1p(len(good)), math.log1p(sum(good))


def _piece_features(texts: pa.Array, model: ToxicModel) -> tuple[np.ndarray, list[list]]:
    features, passages = np.zeros((len(texts), 3)), [[] for _ in range(len(texts))]
    for row, n, segments in document_segments(texts, model):
        features[row] = _features(segments, n)
        passages[row] = [s for s in segments if s[3] > -math.log(SIGNIFICANT)]
    return features, passages


def _support(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many distinct contexts of either kind a word first appears."""

    def places(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, offsets = words_of(piece.column("text"))
        coded = pc.dictionary_encode(words)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
        _, first = np.unique(row * max(len(coded.dictionary), 1) + codes, return_index=True)
        left, right = np.maximum(first - 1, offsets[row[first]]), np.minimum(first + 1, offsets[row[first] + 1] - 1)
        forms = normal_form(coded.dictionary)
        taken = [forms.take(pa.array(codes[i])) for i in (left, first, right)]
        context = pc.binary_join_element_wise(*taken, " ")
        labels = piece.column("label").to_numpy(zero_copy_only=False)[row[first]]
        return pa.RecordBatch.from_arrays([taken[1], context, pa.array(labels.astype(np.int32))], ["word", "context", "label"])

    rows = map_pieces(sample.select("text", "label"), places, "word string, context string, label int", "text")
    seen = rows.where("word <> ''").select("word", "label", F.xxhash64("context").alias("context")).distinct()
    return seen.groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("clean")
    )


def term_scores(table: list[tuple[str, int, int]]) -> ToxicModel:
    """Scores of words with support, and of the beginnings of words that a word without support falls back to.

    The Dirichlet prior of a term follows the shares of its longest known beginning, and that of a beginning
    those of a shorter one, down to the shares of all words.
    """
    model = ToxicModel()
    n_toxic, n_clean = (float(sum(r[i] for r in table)) for i in (1, 2))
    if not n_toxic or not n_clean:
        return model
    base = n_toxic / (n_toxic + n_clean)
    shares: dict[str, float] = {}  # of toxic places among a term's, with its prior
    scores: dict[str, float] = {}

    def parent(term: str) -> float:
        return next((shares[term[:n]] for n in PREFIXES if n < len(term) and term[:n] in shares), base)

    def add(term: str, toxic: int, clean: int) -> None:
        prior = parent(term)
        a = toxic + PRIOR_WEIGHT * prior + PRIOR_FLOOR * base
        b = clean + PRIOR_WEIGHT * (1 - prior) + PRIOR_FLOOR * (1 - base)
        shares[term] = a / (a + b)
        bound = math.log(a / b) - math.log(n_toxic / n_clean) - BOUND_Z * math.sqrt(1 / a + 1 / b)
        scores[term] = max(bound, -DRIFT)

    held = {word for word, t, c in table if t + c >= MIN_SUPPORT}
    for size in sorted(PREFIXES):
        counts: dict[str, list[int]] = {}
        for word, t, c in table:
            if len(word) > size and word not in held:
                pair = counts.setdefault(word[:size], [0, 0])
                pair[0], pair[1] = pair[0] + t, pair[1] + c
        for head, (t, c) in counts.items():
            if t + c >= MIN_SUPPORT:
                add(head, t, c)
    heads = {size: {h: scores[h] for h in scores if len(h) == size} for size in PREFIXES}
    for word, t, c in table:
        if word in held:
            shares.pop(word, None)
            add(word, t, c)
    toxic_heads = {h for own in heads.values() for h, s in own.items() if s > 0}
    # a neutral term needs an entry only where it keeps a toxic beginning from counting
    model.words = {w: scores[w] for w in held if scores[w] > 0 or any(w[:n] in toxic_heads for n in PREFIXES if n < len(w))}
    model.prefixes = {
        size: {h: s for h, s in own.items() if s > 0 or any(h[:n] in toxic_heads for n in PREFIXES if n < size)} for size, own in heads.items()
    }
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int | None = None, **columns) -> ToxicModel:
    """The model, from a bounded sample of labelled rows outside the held-out fold."""
    limit = {} if rows is None else {"rows": rows}
    sample = settle(labelled_sample(docs, labels, "toxic", **limit, **columns), "toxic-sample")
    # bounded by the sample: words below the support matter only through their beginnings
    model = term_scores(list(zip(*[c.to_pylist() for c in _support(sample).toArrow().columns])))

    def probe(piece: pa.RecordBatch) -> pa.RecordBatch:
        n, best, count = (np.zeros(piece.num_rows) for _ in range(3))
        _, offsets = words_of(piece.column("text"))
        n[:] = np.diff(offsets)
        for row, _, segments in document_segments(piece.column("text"), model):
            best[row], count[row] = max(s[2] for s in segments), len(segments)
        label = piece.column("label").cast(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(best), pa.array(count), label], ["n", "best", "count", "label"])

    rows_ = map_pieces(sample.select("text", "label"), probe, "n double, best double, count double, label double", "text")
    # three numbers a document of the bounded sample
    clean = rows_.where("label = 0").select("n", "best", "count").toPandas().sort_values(["n", "best", "count"])
    model.log_k, model.scale = fit_law(clean["n"].to_numpy(), clean["best"].to_numpy())

    def features(piece: pa.RecordBatch) -> pa.RecordBatch:
        x, _ = _piece_features(piece.column("text"), model)
        label = piece.column("label").cast(pa.float64())
        return pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), label], ["a", "b", "c", "label"])

    table = map_pieces(sample.select("text", "label"), features, "a double, b double, c double, label double", "text").toPandas()
    if len(table):
        model.calibration = fit_logistic(table[["a", "b", "c"]].to_numpy(), table["label"].to_numpy())
    return model


def score_documents(docs: DataFrame, model: ToxicModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, passages): passages are the significant segments, in words, with score and log of the E-value."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("log_e", pa.float64())]))

    def score(piece: pa.RecordBatch) -> pa.RecordBatch:
        x, passages = _piece_features(filled(piece.column(1)), model)
        p = calibrated(x, model.calibration)
        spans = pa.array([[{"first": a, "last": b, "score": s, "log_e": -e} for a, b, s, e in row] for row in passages], kind)
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(p), spans], ["doc_id", "score", "passages"])

    spark_kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {spark_kind}, score double, passages array<struct<first:int,last:int,score:double,log_e:double>>"
    return map_pieces(rows, score, schema, "text")


def without_toxic(docs: DataFrame, model: ToxicModel, text_column: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``reject``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_column):
                x, _ = _piece_features(filled(piece.column(text_column)), model)
                yield piece.filter(pa.array(calibrated(x, model.calibration) < reject))

    return map_arrow(docs, keep, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) of every document."""
    found = score_documents(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
