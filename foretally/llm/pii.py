"""Personal data by a semi-Markov conditional random field.

Around every sign of personal data (a digit, an at sign, a bracketed "at") a window of the text is cut
into tokens. Segments of bounded length that have the rough shape of an email address, an IP
address, a card or a phone number are candidates, each with features of the whole span and of its
surroundings; tokens outside stay single. Dynamic programming over segments chooses boundaries and
types jointly. The weights maximise the conditional likelihood of segmentations in a bounded sample of
texts. Their true spans are those of the exact base patterns, in the texts as they are and in copies where the spans
are written in other ways (spelled or bracketed signs, national and 00 numbers, other separators), with true boundaries,
or replaced by digits that are no personal data. No feature says what a base pattern says.

The base patterns are exact: their spans hold by definition, so the chosen segmentation must contain
them, and the model adds the spans around them that the patterns don't reach.

Nulls and odd input: a null or empty text has no span; rows with a null id are scanned like any other;
repeated rows get equal spans; other columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import filled, map_arrow, map_pieces, pieces
from foretally.llm.fitting import bounded_sample

KINDS = ("email", "ip", "card", "phone")
#: Texts that the weights are fitted on at most: those with the smallest hashes of their id and text, of at most FIT_BYTES.
FIT_TEXTS = 3000
FIT_BYTES = 16 << 10
#: Tokens of a segment at most, by kind.
MOST_TOKENS = {"email": 24, "ip": 13, "card": 11, "phone": 15}
#: Tokens after which a training window may be cut, between spans and at white space.
PART_TOKENS = 300
REACH = 48

# The base patterns, and what counts as a sign of personal data.
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9]|@|[\[({] ?at ?[\])}]", re.I)
ANY_SIGN = r"[0-9@]|[\[({] ?[aA][tT] ?[\])}]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_AT = r"[\[({] ?at ?[\])}]"
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+ ?(?:@|{_AT}) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({{] ?dot ?[\])}}] ?| dot )[A-Za-z0-9-]+)+", re.I)
_CUES = {
    "email": re.compile(r"(?:e-?mail|mail|contact|write|reach)\W{1,3}(?:\w+\W{1,2})?$", re.I),
    "ip": re.compile(r"(?:\bip|address|host|server)\W{1,3}(?:\w+\W{1,2})?$", re.I),
    "card": re.compile(r"(?:card|visa|credit|payment|account)\W{1,3}(?:\w+\W{1,2})?$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|fax|mobile|cell|dial)\W{1,3}(?:\w+\W{1,2})?$", re.I),
}
Span = tuple[int, int, int]  # kind, start, end


def passes_luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind, then start."""
    found: list[Span] = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        at += 1
        if host:
            found.append((0, start, host.end()))
            at = done = host.end()
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            found.append((1, match.start(), match.end()))
    for match in CARD.finditer(text):
        digits = _digits(match[0])
        if 13 <= len(digits) <= 19 and passes_luhn(digits):
            found.append((2, match.start(), match.end()))
    for match in PHONE.finditer(text):
        if 9 <= len(_digits(match[0])) <= 15:
            found.append((3, match.start(), match.end()))
    return found


def windows(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of a text near a sign, joined where they meet."""
    start = end = -1
    for sign in SIGN.finditer(text):
        low, high = max(0, sign.start() - REACH), min(len(text), sign.end() + REACH)
        if start >= 0 and low <= end:
            end = high
            continue
        if start >= 0:
            yield start, end
        start, end = low, high
    if start >= 0:
        yield start, end


def _tokens(text: str, start: int, end: int) -> list[int]:
    """Borders of the tokens of a window."""
    return [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]


def _shape(text: str, kind: int) -> bool:
    """Whether a string may be of a kind at all."""
    if kind == 0:
        return _ADDRESS.fullmatch(text) is not None
    n = sum("0" <= c <= "9" for c in text)
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(?:\[?[.]\]?[0-9]{1,3}){3}", text) is not None
    if kind == 2:
        return 12 <= n <= 19 and re.fullmatch(r"[0-9](?:[ .-]?[0-9])*", text) is not None
    return 7 <= n <= 15 and re.fullmatch(r"[+(]?[0-9][\s().0-9/-]*[0-9]", text) is not None


def span_features(text: str, start: int, end: int, kind: int) -> list[str]:
    """Names of the features of text[start:end] as a segment of ``kind``."""
    span = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]

    def side(c: str) -> str:
        return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else "mark"

    names = ["bias", f"before {side(before)}", f"after {side(after)}"]
    if _CUES[KINDS[kind]].search(text, max(0, start - 24), start):
        names.append("cue")
    if kind == 0:
        at = re.search(r"@|[\[({] ?at ?[\])}]", span, re.I)
        host = span[at.end() :].strip() if at else ""
        tail = re.split(r"[. ]", host)[-1]
        names += ["sign" if at and at[0] == "@" else "spelled sign", f"parts {min(host.count('.'), 3)}", f"tail {min(len(tail), 5)} {tail.isalpha()}"]
        if re.search(r"\s", span.replace(" dot ", ".") if not at or at[0] != "@" else span):
            names.append("space inside")
        if not re.search(r"[A-Za-z0-9]", span[: at.start()] if at else ""):
            names.append("no name")
        return [f"{kind} {n}" for n in names]
    groups = "-".join(str(len(g)) for g in re.findall(r"[0-9]+", span))
    n = len(_digits(span))
    names += [f"groups {groups if len(groups) < 12 else 'many'}", f"digits {n}"]
    if kind == 1:
        names.append("large part" if any(int(g) > 255 for g in re.findall(r"[0-9]+", span)) else "small parts")
        names.append("bracketed dots" if "[" in span else "plain dots")
    elif kind == 2:
        names.append("checked" if passes_luhn(_digits(span)) else "unchecked")
    else:
        names += ["plus" if span[0] == "+" else "no plus", "brackets" if "(" in span else "no brackets"]
        marks = re.sub(r"[0-9]", "", span)
        names += ["bare" if not marks else "marked", "two zeros" if span.startswith("00") else "no zeros", f"marks {''.join(sorted(set(marks)))}"]
    return [f"{kind} {n}" for n in names]


def candidates(text: str, borders: list[int]) -> list[tuple[int, int, int]]:
    """(first border, last border, kind) of every segment of bounded length with a kind's rough shape."""
    found = []
    n = len(borders) - 1
    heads = [text[b] for b in borders[:-1]]
    near = [c.isdigit() or c in "+(" for c in heads]
    ats = [i for i, c in enumerate(heads) if c == "@" or (c in "aA" and text[borders[i] : borders[i + 1]].lower() == "at")]
    for i in range(n):
        if near[i]:
            for kind in (1, 2, 3):
                if heads[i] in "+(" and kind != 3:
                    continue
                for j in range(i + 1, min(n, i + MOST_TOKENS[KINDS[kind]]) + 1):
                    head = heads[j - 1]
                    if not (head.isdigit() or head in " .-()/+[] "):
                        break
                    if head.isdigit() and _shape(text[borders[i] : borders[j]], kind):
                        found.append((i, j, kind))
    for at in ats:
        for i in range(max(0, at - 9), at):
            if not (heads[i].isalnum() and heads[i].isascii()) or (i and heads[i - 1] in _LOCAL and heads[i - 1] not in "._%+-"):
                continue
            for j in range(at + 3, min(n, i + MOST_TOKENS["email"]) + 1):
                if heads[j - 1].isalnum() and _shape(text[borders[i] : borders[j]], 0):
                    found.append((i, j, 0))
    return found


class Segmenter:
    """Weights of the span features, and dynamic programming over the segments of a window."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(n, 0.0) for n in names)

    def best(self, n: int, segments: list[tuple[int, int, float, Span]]) -> list[Span]:
        """The spans of the best segmentation of ``n`` tokens."""
        ending: dict[int, list[tuple[int, float, Span]]] = {}
        for i, j, score, span in segments:
            ending.setdefault(j, []).append((i, score, span))
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, score, span in ending.get(j, ()):
                if value[i] + score > value[j]:
                    value[j], back[j] = value[i] + score, (i, span)
        spans, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                j, span = back[j][0], back[j][1]
                spans.append(span)
        return spans[::-1]


#: What the weights start from, for a sign that samples lack.
PRIOR = {"1 large part": -6.0}
#: Added to a base span's score, so that no segmentation without it can win.
_CERTAIN = 1e4


def find_spans(text: str, segmenter: Segmenter) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and start."""
    if not text or not SIGN.search(text):
        return [], []
    base = base_spans(text)
    held, chosen = set(base), set()
    taken = _Covered(base)
    for start, end in windows(text):
        inside = [b for b in base if start < b[2] and b[1] < end]
        start, end = min([start, *(b[1] for b in inside)]), max([end, *(b[2] for b in inside)])
        borders = sorted({*_tokens(text, start, end), *(p for b in inside for p in b[1:])})
        place = {p: i for i, p in enumerate(borders)}
        segments = [(place[s], place[e], _CERTAIN + e - s, (k, s, e)) for k, s, e in inside]
        for i, j, kind in candidates(text, borders):
            span = (kind, borders[i], borders[j])
            if not taken.meets(*span[1:]):
                segments.append((i, j, segmenter.score(span_features(text, span[1], span[2], kind)), span))
        chosen.update(segmenter.best(len(borders) - 1, segments))
    return base, sorted(chosen | held)  # base spans may overlap each other; all of them stay


class _Covered:
    """The parts of a text that spans cover."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(span[1:] for span in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start


def _gold(base: list[Span]) -> list[Span]:
    """Base spans that don't overlap, the longer first."""
    kept: list[Span] = []
    for span in sorted(base, key=lambda b: (b[1] - b[2], b[0])):
        if all(span[2] <= k[1] or k[2] <= span[1] for k in kept):
            kept.append(span)
    return kept


def rewritten(text: str, gold: list[Span], turn: int) -> tuple[str, list[Span]]:
    """The text with its spans written in other ways, and where they are then; every fifth becomes digits of no person."""
    out, spans, at, length = [], [], 0, 0
    for number, (kind, start, end) in enumerate(sorted(gold, key=lambda g: g[1])):
        own = crc32(text[start:end].encode("utf-8", "replace")) // 8 + turn + number
        is_plain = own % 5 == 4
        new = _plain_digits(_digits(text[start:end]), own // 5) if is_plain else _other_form(text[start:end], kind, own // 5)
        out += [text[at:start], new]
        length += start - at
        if not is_plain:
            spans.append((kind, length, length + len(new)))
        length, at = length + len(new), end
    return "".join([*out, text[at:]]), spans


def _other_form(span: str, kind: int, choice: int) -> str:
    """Another way to write a span."""
    if kind == 0:
        name, host = span.split("@", 1)
        sign = (" [at] ", " (at) ", "[at]", "(at)", " {at} ", " @ ")[choice % 6]
        return name + sign + host.replace(".", (".", " [dot] ", "(dot)", " dot ", ".")[choice % 5])
    digits = _digits(span)
    if kind == 1:
        return span.replace(".", "[.]")
    if kind == 2:
        return (".", " ", "-")[choice % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, office, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    international = f"00{digits[:2]} {digits[2:4]} {digits[4:8]} {digits[8:]}".rstrip()
    if len(digits) < 10:
        return international
    return (f"({area}) {office}-{line}", f"{area}-{office}-{line}", international, f"{area}.{office}.{line}", f"({area}) {office} {line}")[choice % 5]


def _plain_digits(digits: str, choice: int) -> str:
    """A date, a time, a version, a range of years, an amount or a number of things."""
    d = (digits + "20171130")[:8]
    return (
        f"20{d[:2]}-0{int(d[2]) % 9 + 1}-1{d[3]}",
        f"1{d[0]}:3{d[1]}:2{d[2]}",
        f"{d[0]}.{d[1]}.{d[2:4]}",
        f"19{d[:2]}-20{d[2:4]}",
        f"{d[:3]},{d[3:6]}.{d[6:8]}",
        d,
        f"20{d[:2]}/{d[2:6]}",
        f"{d[:3]} of {d[3:6]}",
    )[choice % 8]


def _parts(text: str, borders: list[int], gold: list[Span]) -> Iterator[list[int]]:
    """The borders of a window in parts of some ``PART_TOKENS`` tokens; no part cuts a span or a word."""
    held, first = _Covered(gold), 0
    for at in range(len(borders) - 1):
        if at - first >= PART_TOKENS and text[borders[at] - 1].isspace() and not held.meets(borders[at] - 1, borders[at] + 1):
            yield borders[first : at + 1]
            first = at
    yield borders[first:]


def train(texts: list[str], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Segmenter:
    """Weights that maximise the likelihood of the true segmentations among all, by gradient steps over windows.

    Every text with spans is seen as it is and in two rewritten copies.
    """
    examples, known = [], []
    for text in texts:
        gold = _gold(base_spans(text))
        known.append((text, gold))
        known += [rewritten(text, gold, turn) for turn in (0, 1)] if gold else []
    for text, gold in known:
        for start, end in windows(text):
            inside = [g for g in gold if start < g[2] and g[1] < end]
            start, end = min([start, *(g[1] for g in inside)]), max([end, *(g[2] for g in inside)])
            borders = sorted({*_tokens(text, start, end), *(p for g in inside for p in g[1:])})
            for part in _parts(text, borders, inside):
                place = {p: i for i, p in enumerate(part)}
                right = {(place[s], place[e], k) for k, s, e in inside if s in place and e in place}
                found = sorted({*candidates(text, part), *right})
                if found:
                    segments = [(i, j, k, span_features(text, part[i], part[j], k)) for i, j, k in found]
                    examples.append((len(part) - 1, segments, [f in right for f in found]))
    weights = dict(PRIOR)
    squares: dict[str, float] = {}
    for _ in range(rounds):
        for n, segments, right in examples:
            scores = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
            expected = _expected(n, segments, scores)
            slope: dict[str, float] = {}
            for (_, _, _, names), p, is_right in zip(segments, expected, right):
                delta = is_right - p
                if abs(delta) > 1e-6:
                    for name in names:
                        slope[name] = slope.get(name, 0.0) + delta
            for name, g in slope.items():
                g -= decay * weights.get(name, 0.0)
                squares[name] = squares.get(name, 1e-2) + g * g
                weights[name] = weights.get(name, 0.0) + rate * g / math.sqrt(squares[name])
    return Segmenter(weights)


def _expected(n: int, segments: list, scores: list[float]) -> list[float]:
    """Each segment's probability to be in the segmentation, by the forward and backward sums of the lattice."""
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for at, (i, j, *_) in enumerate(segments):
        ending.setdefault(j, []).append(at)
        starting.setdefault(i, []).append(at)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum([ahead[j - 1], *(ahead[segments[a][0]] + scores[a] for a in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = _log_sum([behind[i + 1], *(behind[segments[a][1]] + scores[a] for a in starting.get(i, ()))])
    total = ahead[n]
    return [math.exp(min(0.0, ahead[s[0]] + score + behind[s[1]] - total)) for s, score in zip(segments, scores)]


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Segmenter:
    """The model, from a bounded sample of texts with a sign of personal data."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    keep = (F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike(ANY_SIGN)
    return train([r.text for r in bounded_sample(rows, FIT_TEXTS, "doc_id", "text", keep=keep).collect()])


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _marked(texts: pa.Array) -> list[int]:
    """Rows whose text has a sign of personal data."""
    return np.flatnonzero(pc.match_substring_regex(texts, ANY_SIGN).to_numpy(zero_copy_only=False)).tolist()


def detect(docs: DataFrame, segmenter: Segmenter, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = filled(piece.column(1))
        counts = np.zeros((len(KINDS), piece.num_rows), np.int64)
        digests, spans = [nothing] * piece.num_rows, [""] * piece.num_rows
        for row in _marked(texts):
            base, every = find_spans(texts[row].as_py(), segmenter)
            for kind, _, _ in base:
                counts[kind, row] += 1
            digests[row] = hashlib.sha256(span_text(base).encode()).hexdigest()
            spans[row] = span_text(every)
        columns = [piece.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return map_pieces(rows, run, f"doc_id {kind}, {counted}, base_sha256 string, spans string", "text")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, segmenter: Segmenter, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with personal data replaced and the length column kept true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_column):
                texts = piece.column(text_column)
                changed = {}
                for row in _marked(filled(texts)):
                    text = texts[row].as_py()
                    if spans := find_spans(text, segmenter)[1]:
                        changed[row] = redacted(text, spans)
                if changed:
                    mask = np.zeros(len(texts), bool)
                    mask[list(changed)] = True
                    new = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(changed.values()), texts.type))
                    piece = piece.set_column(piece.schema.get_field_index(text_column), text_column, new)
                    if length_column in piece.schema.names:
                        own = piece.schema.get_field_index(length_column)
                        lengths = pc.utf8_length(new).cast(piece.schema.field(own).type)
                        old = piece.column(own)
                        piece = piece.set_column(own, length_column, pc.if_else(pa.array(mask), lengths, old))
                yield piece

    return map_arrow(docs, run, docs.schema)
