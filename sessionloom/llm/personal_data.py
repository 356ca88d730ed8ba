"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans. The network, trained in numpy on labelled spans, adds spans in
spellings that the patterns do not cover, such as telephone numbers without a plus or cards with
dots. It is trained on a bounded sample: windows around base spans and around other digits of the
corpus, and windows into which spans from a fixed-seed generator are written. Every text is cut into
overlapping windows, each is decoded by Viterbi, and the spans of all windows of a text are
reconciled globally: pieces of one kind that overlap are one span, base spans win, and of the
others those with the greatest total score that do not overlap are kept.

An added span must have the shape of its kind (``plausible``), which needs a digit or an ``@``.
Windows without either cannot add anything and are not decoded; that changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.text import documents_table, steps

# The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
# Bounds of the training sample: documents looked at, and windows taken from each and in all.
SAMPLE_DOCUMENTS = 4_000
WINDOWS_PER_DOCUMENT = 4
SAMPLE_WINDOWS = 800
GENERATED_WINDOWS = 1_200
TRAIN_CHARS = 96
UNITS = 16
STEPS = 300
BATCH = 64
STEP_SIZE = 0.02
SEED = 11
# Characters per window when texts are read, and characters that neighbouring windows share.
WINDOW = 192
OVERLAP = 64
DECODE_WINDOWS = 256

# --- base patterns -------------------------------------------------------------------------

# The leftmost match can only begin where a run of its first characters begins, or where the last
# match ended; looking only there keeps long runs linear.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT, _EMAIL_NEXT = re.compile(_EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    plain = part.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := (_EMAIL_AT.match(text, at) if at else None) or _EMAIL_NEXT.search(text, at):
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base matches, by kind and start, in characters."""
    spans = [(0, *span) for span in _emails(text)] if "@" in text else []
    for found in _IP.finditer(text):
        if all(_small(part) for part in found.group().split(".")):
            spans.append((1, *found.span()))
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 16:
            digits = _NOT_DIGIT.sub("", found.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", found.group())) <= 15:
                spans.append((3, *found.span()))
    return spans


# --- labelled windows ----------------------------------------------------------------------

# Symbols: 0 beyond the text, 1 white space and controls, 2 other than ASCII, then printable ASCII.
SYMBOLS = 3 + 94
_SYMBOL = np.full(129, 2, dtype=np.uint8)
_SYMBOL[:128] = 1
_SYMBOL[33:127] = np.arange(3, SYMBOLS)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _SYMBOL[np.minimum(points, 128)]


def labelled_window(text: str, spans: list[tuple[int, int, int]], start: int) -> tuple[bytes, bytes]:
    """Symbols and tags (0, or kind number + 1) of the characters from ``start`` on."""
    signs, tags = np.zeros(TRAIN_CHARS, dtype=np.uint8), np.zeros(TRAIN_CHARS, dtype=np.uint8)
    low, high = max(0, start), min(len(text), start + TRAIN_CHARS)
    if high > low:
        signs[low - start : high - start] = symbols(text[low:high])
    for kind, first, last in spans:
        tags[max(0, first - start) : max(0, min(TRAIN_CHARS, last - start))] = kind + 1
    return signs.tobytes(), tags.tobytes()


_TRIGGER = re.compile(r"[0-9@]+")


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs, tags = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            draw = np.random.default_rng([SEED, len(text)])
            others = [m.start() for m in _TRIGGER.finditer(text) if not any(a <= m.start() < b for _, a, b in spans)]
            places = [first for _, first, _ in spans[: WINDOWS_PER_DOCUMENT - 1]] + others[:1]
            for place in places:
                window = labelled_window(text, spans, place - int(draw.integers(0, TRAIN_CHARS // 2)))
                signs.append(window[0])
                tags.append(window[1])
        yield pa.RecordBatch.from_arrays([pa.array(signs, pa.binary()), pa.array(tags, pa.binary())], ["signs", "tags"])


def corpus_windows(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows of the corpus: around base spans and around other digits.

    At most 800 windows of at most 4,000 documents with a digit or an ``@``, those with the smallest
    hashes of their text; only these windows reach the driver.
    """
    texts = documents.select(F.col(f"`{text}`").alias("text"))
    share = min(1.0, 4 * SAMPLE_DOCUMENTS / max(1, texts.count()))
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    chosen = texts.where((rank < int(share * (1 << 40))) & F.col("text").rlike("[0-9@]"))
    cut = chosen.orderBy(rank).limit(SAMPLE_DOCUMENTS).mapInArrow(_sample_batches, "signs binary, tags binary")
    rows = cut.orderBy(F.xxhash64("signs"), "signs").limit(SAMPLE_WINDOWS).collect()
    read = lambda name: np.frombuffer(b"".join(row[name] for row in rows), dtype=np.uint8).reshape(-1, TRAIN_CHARS)
    return read("signs"), read("tags")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"


class SpanWriter:
    """Draws example spans of every kind, and texts that look like one but are none."""

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)

    def pick(self, *choices: str) -> str:
        return choices[int(self.draw.integers(len(choices)))]

    def some(self, alphabet: str, low: int, high: int) -> str:
        count = int(self.draw.integers(low, high + 1))
        return "".join(alphabet[at] for at in self.draw.integers(0, len(alphabet), count))

    def digits(self, count: int) -> str:
        return self.some(_HEX[:10], count, count)

    def number(self, high: int) -> str:
        return str(int(self.draw.integers(0, high)))

    def word(self) -> str:
        return self.pick(self.some(_LETTERS, 2, 9), self.some(_LETTERS, 2, 9), self.some(_LETTERS, 1, 5).capitalize())

    def email(self) -> str:
        user = self.word() + self.pick("", "." + self.word(), "." + self.digits(2), "_" + self.digits(1), "+" + self.word())
        host = self.word() + self.pick("", self.digits(1), "-" + self.word())
        tail = self.pick(".com", ".org", ".example.com", ".co.uk", "." + self.some(_LETTERS, 2, 4), "")
        return user + self.pick("@", "@", "@", " @ ", "@ ") + host + tail

    def ip(self) -> str:
        return ".".join(self.number(256) for _ in range(4))

    def card(self) -> str:
        sizes = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3))[int(self.draw.integers(3))]
        return self.pick("", "", " ", "-", ".", "/").join(self.digits(size) for size in sizes)

    def phone(self) -> str:
        area, first, last = self.digits(3), self.digits(3), self.digits(4)
        country = self.pick("", "", "+" + self.pick("1", "44", "49", "351") + self.pick(" ", "-", "."), "00" + self.digits(2) + " ")
        gap = self.pick(" ", "-", ".")
        return country + self.pick(f"({area}) {first}-{last}", f"{area}{gap}{first}{gap}{last}", f"({area}){first}{gap}{last}")

    def other(self) -> str:
        return self.pick(
            self.some(_HEX, 24, 48),
            self.digits(int(self.draw.integers(1, 8))),
            f"{self.number(3000)}-{self.number(13)}-{self.number(32)}",
            f"{self.number(24)}:{self.digits(2)}:{self.digits(2)}",
            f"{self.number(10)}.{self.number(20)}.{self.number(9)}",
            f"{self.number(1000)}.{self.digits(2)}",
            f"{self.number(99)},{self.digits(3)},{self.digits(3)}",
            "@" + self.word(),
            f"#{self.digits(5)}",
            f"{self.word()}{self.digits(2)}",
            f"{self.number(400)} {self.number(90)} {self.number(90)}",
        )

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        """Words, spans and look-alikes in random order, with the labels of the spans."""
        parts, spans, length = [], [], 0
        for _ in range(int(self.draw.integers(6, 16))):
            turn = int(self.draw.integers(10))
            kind = turn if turn < len(KINDS) else None
            part = getattr(self, KINDS[kind])() if kind is not None else self.other() if turn == 5 else self.word()
            before = self.pick("", "", "", "(", '"', ": ", "= ") if turn < 6 else ""
            if kind is not None:
                spans.append((kind, length + len(before), length + len(before) + len(part)))
            part = before + part + self.pick("", "", "", ",", ".", ";", '"', "###", "!!", ")") + self.pick(" ", " ", "\n", "  ")
            parts.append(part)
            length += len(part)
        return "".join(parts), spans


def generated_windows(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    writer = SpanWriter(seed)
    rows = []
    for _ in range(count):
        text, spans = writer.text()
        rows.append(labelled_window(text, spans, int(writer.draw.integers(-8, max(1, len(text) - TRAIN_CHARS // 2)))))
    read = lambda at: np.frombuffer(b"".join(row[at] for row in rows), dtype=np.uint8).reshape(-1, TRAIN_CHARS)
    return read(0), read(1)


# --- network -------------------------------------------------------------------------------

TAGS = 1 + len(KINDS)


@dataclass
class Model:
    """Input tables and recurrent weights of both directions, output layer, CRF transitions."""

    ahead_in: np.ndarray
    ahead: np.ndarray
    back_in: np.ndarray
    back: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, field.name) for field in fields(self)]


def new_model(units: int = UNITS, seed: int = SEED) -> Model:
    draw = np.random.default_rng(seed)
    small = lambda *shape: draw.normal(0, 0.2, shape).astype(np.float32)
    tables = [small(SYMBOLS, 4 * units) for _ in range(2)]
    for table in tables:
        table[:, units : 2 * units] += 1.0  # remember by default
    zeros = lambda *shape: np.zeros(shape, dtype=np.float32)
    return Model(
        tables[0], small(units, 4 * units), tables[1], small(units, 4 * units),
        small(2 * units, TAGS), zeros(TAGS), zeros(TAGS, TAGS), zeros(TAGS), zeros(TAGS),
    )


def _lstm(signs: np.ndarray, table: np.ndarray, weights: np.ndarray, keep: bool = False):
    """Hidden states (time, window, unit) along the first axis of ``signs``; gates are in, forget, out, new."""
    units = weights.shape[0]
    long, count = signs.shape
    hidden = np.zeros((long + 1, count, units), dtype=np.float32)
    cell = np.zeros((count, units), dtype=np.float32)
    kept = []
    half = np.full(4 * units, 0.5, dtype=np.float32)
    half[3 * units :] = 1.0
    for at in range(long):
        gates = np.tanh((table[signs[at]] + hidden[at] @ weights) * half)
        gates[:, : 3 * units] *= 0.5
        gates[:, : 3 * units] += 0.5
        i, f, o, g = (gates[:, part * units : (part + 1) * units] for part in range(4))
        before = cell
        cell = f * cell + i * g
        squashed = np.tanh(cell)
        hidden[at + 1] = o * squashed
        if keep:
            kept.append((gates, before, squashed))
    return hidden, kept


def _lstm_slopes(signs, hidden, kept, weights, slope):
    """Gradients of the input table and the recurrent weights from those of the hidden states."""
    units = weights.shape[0]
    by_time = np.zeros((*signs.shape, 4 * units), dtype=np.float32)
    from_next = np.zeros_like(hidden[0])
    cell_slope = np.zeros_like(hidden[0])
    for at in range(len(signs) - 1, -1, -1):
        gates, before, squashed = kept[at]
        i, f, o, g = (gates[:, part * units : (part + 1) * units] for part in range(4))
        own = slope[at] + from_next
        cell_slope = cell_slope + own * o * (1 - squashed * squashed)
        row = by_time[at]
        row[:, :units] = cell_slope * g * i * (1 - i)
        row[:, units : 2 * units] = cell_slope * before * f * (1 - f)
        row[:, 2 * units : 3 * units] = own * squashed * o * (1 - o)
        row[:, 3 * units :] = cell_slope * i * (1 - g * g)
        from_next = row @ weights.T
        cell_slope = cell_slope * f
    flat = by_time.reshape(-1, 4 * units)
    recurrent = hidden[:-1].reshape(-1, units).T @ flat
    chosen = np.zeros((len(flat), SYMBOLS), dtype=np.float32)
    chosen[np.arange(len(flat)), signs.ravel()] = 1.0
    return chosen.T @ flat, recurrent


def emissions(model: Model, signs: np.ndarray) -> np.ndarray:
    """Scores (time, window, tag) of symbols (window, time)."""
    ahead, _ = _lstm(signs.T, model.ahead_in, model.ahead)
    back, _ = _lstm(signs.T[::-1], model.back_in, model.back)
    return np.concatenate([ahead[1:], back[:0:-1]], axis=2) @ model.out + model.bias


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def crf_slopes(scores: np.ndarray, tags: np.ndarray, model: Model):
    """Mean negative log-likelihood of the tags (time, window) and its gradients.

    Gradients are those of the scores, the transitions, and the scores of first and last tag.
    """
    long, count, _ = scores.shape
    ahead, back = np.empty_like(scores), np.empty_like(scores)
    ahead[0] = model.first + scores[0]
    for at in range(1, long):
        ahead[at] = _logsum(ahead[at - 1][:, :, None] + model.moves, 1) + scores[at]
    back[-1] = model.last
    for at in range(long - 2, -1, -1):
        back[at] = _logsum(model.moves + (scores[at + 1] + back[at + 1])[:, None, :], 2)
    total = _logsum(ahead[-1] + model.last, 1)
    shares = np.exp(ahead + back - total[None, :, None])
    pairs = np.exp(
        ahead[:-1, :, :, None] + model.moves + (scores[1:] + back[1:])[:, :, None, :] - total[None, :, None, None]
    ).sum(axis=(0, 1))
    right = np.eye(TAGS, dtype=np.float32)[tags]
    observed = np.zeros((TAGS, TAGS))
    np.add.at(observed, (tags[:-1].ravel(), tags[1:].ravel()), 1.0)
    path = (scores * right).sum(axis=(0, 2)) + model.first[tags[0]] + model.last[tags[-1]] + model.moves[tags[:-1], tags[1:]].sum(axis=0)
    slopes = (shares - right, pairs - observed, (shares[0] - right[0]).sum(axis=0), (shares[-1] - right[-1]).sum(axis=0))
    return float((total - path).mean()), tuple(slope / count for slope in slopes)


def slopes_of(model: Model, signs: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss of a batch (window, time) and the gradients of all arrays of the model."""
    along = signs.T
    ahead, kept_ahead = _lstm(along, model.ahead_in, model.ahead, True)
    back, kept_back = _lstm(along[::-1], model.back_in, model.back, True)
    both = np.concatenate([ahead[1:], back[:0:-1]], axis=2)
    scores = both @ model.out + model.bias
    loss, (score_slope, moves, first, last) = crf_slopes(scores, tags.T.astype(np.int64), model)
    flat = score_slope.reshape(-1, TAGS).astype(np.float32)
    units = model.ahead.shape[0]
    into = (flat @ model.out.T).reshape(both.shape)
    ahead_in, ahead_own = _lstm_slopes(along, ahead, kept_ahead, model.ahead, into[:, :, :units])
    back_in, back_own = _lstm_slopes(along[::-1], back, kept_back, model.back, into[::-1, :, units:])
    out = both.reshape(-1, 2 * units).T @ flat
    return loss, [ahead_in, ahead_own, back_in, back_own, out, flat.sum(axis=0), moves, first, last]


def fit(signs: np.ndarray, tags: np.ndarray, turns: int = STEPS, seed: int = SEED) -> Model:
    """Adam steps over batches in a fixed random order, the step size falling to a tenth."""
    model, draw = new_model(), np.random.default_rng(seed)
    arrays = model.arrays()
    means, squares = ([np.zeros_like(a) for a in arrays] for _ in range(2))
    order = np.zeros(0, dtype=np.int64)
    for turn in range(1, turns + 1):
        while len(order) < BATCH:
            order = np.concatenate([order, draw.permutation(len(signs))])
        chosen, order = order[:BATCH], order[BATCH:]
        _, slopes = slopes_of(model, signs[chosen], tags[chosen])
        rate = STEP_SIZE * 0.1 ** (turn / turns)
        for array, slope, mean, square in zip(arrays, slopes, means, squares):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            array -= (rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
    return model


def train(documents: DataFrame, text: str = "text") -> Model:
    """A model fitted on at most 800 windows of the corpus and 1,200 generated ones."""
    own, made = corpus_windows(documents, text), generated_windows(GENERATED_WINDOWS)
    return fit(np.concatenate([own[0], made[0]]), np.concatenate([own[1], made[1]]))


# --- reading texts -------------------------------------------------------------------------


def best_tags(model: Model, scores: np.ndarray) -> np.ndarray:
    """The best tag sequence (time, window) of every window."""
    long, count, _ = scores.shape
    came = np.empty((long, count, TAGS), dtype=np.int8)
    best = model.first + scores[0]
    for at in range(1, long):
        options = best[:, :, None] + model.moves
        came[at] = options.argmax(axis=1)
        best = options.max(axis=1) + scores[at]
    tags = np.empty((long, count), dtype=np.int8)
    tags[-1] = (best + model.last).argmax(axis=1)
    every = np.arange(count)
    for at in range(long - 1, 0, -1):
        tags[at - 1] = came[at][every, tags[at]]
    return tags


def window_starts(length: int) -> range:
    """First characters of the windows that cover a text, neighbours sharing ``OVERLAP`` characters."""
    return range(0, max(1, length - OVERLAP), WINDOW - OVERLAP)


def _decoded(model: Model, signs: list[np.ndarray], keys: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, kind, start, end, score) of the spans in a list of windows, keyed by (text, first character)."""
    for low in range(0, len(keys), DECODE_WINDOWS):
        block = np.zeros((len(keys[low : low + DECODE_WINDOWS]), WINDOW), dtype=np.uint8)
        for row, sign in zip(block, signs[low : low + DECODE_WINDOWS]):
            row[: len(sign)] = sign
        scores = emissions(model, block)
        tags = best_tags(model, scores).T
        edges = np.flatnonzero(np.diff(tags, axis=1, prepend=0, append=0).ravel())
        width = WINDOW + 1
        for first, last in zip(edges, edges[1:]):
            window, start = divmod(int(first), width)
            kind = int(tags[window, start]) if start < WINDOW else 0
            if kind and window == last // width:
                end = int(last) % width
                gain = scores[start:end, window, kind] - scores[start:end, window, 0]
                text, place = keys[low + window]
                yield text, kind - 1, place + start, place + end, float(gain.sum())


_EMAIL_SHAPE = re.compile(r"[^\s@]+ ?@ ?[^\s@]+\Z")
_IP_SHAPE = re.compile(r"[0-9]+(?: ?\. ?[0-9]+){3}\Z")
_CARD_SHAPE = re.compile(r"[0-9](?:[ ./-]?[0-9])+\Z")
_PHONE_SHAPE = re.compile(r"(?:\+|\(|[0-9])[ ().0-9/-]+[0-9]\Z")
_EDGE = re.compile(r"[A-Za-z0-9]")


def plausible(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a span that the network found has the shape of its kind and is no part of a longer word."""
    body = text[start:end]
    if _EDGE.match(text[end : end + 1]) or (start and _EDGE.match(text[start - 1])):
        return False
    digits = _NOT_DIGIT.sub("", body)
    if kind == 0:
        return len(body) <= 254 and bool(_EMAIL_SHAPE.match(body))
    if kind == 1:
        return bool(_IP_SHAPE.match(body)) and all(_small(part.strip()) for part in body.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(_CARD_SHAPE.match(body))
    return 8 <= len(digits) <= 15 and len(digits) < len(body) and bool(_PHONE_SHAPE.match(body))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends; an opening bracket stays if it is closed inside.

    The last window of a text may reach beyond its end, and so may a span.
    """
    end = min(end, len(text))
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if text[start:end].startswith("(") and ")" not in text[start:end]:
        start += 1
    return start, end


def reconciled(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Added spans (kind, start, end): pieces (kind, start, end, score) of all windows of one text, reconciled."""
    merged: list[list] = []
    for kind, start, end, score in sorted(found):
        if merged and merged[-1][0] == kind and start <= merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
            merged[-1][3] = max(score, merged[-1][3])
        else:
            merged.append([kind, start, end, score])
    taken = np.zeros((2, 0), dtype=np.int64)
    if base:
        starts, ends = zip(*sorted((start, end) for _, start, end in base))
        taken = np.array([starts, np.maximum.accumulate(ends)])
    offers = []
    for kind, start, end, score in merged:
        start, end = _trimmed(text, start, end)
        if end > start and score > 0 and plausible(text, kind, start, end):
            before = np.searchsorted(taken[0], end, side="left")
            if not before or taken[1][before - 1] <= start:
                offers.append((end, start, kind, score))
    # Greatest total score of spans that do not overlap, over spans by their ends.
    offers.sort()
    ends = [offer[0] for offer in offers]
    best, back = [0.0], []
    for end, start, _, score in offers:
        before = int(np.searchsorted(ends[: len(back)], start, side="right"))
        take = best[before] + score
        back.append((take > best[-1], before))
        best.append(max(best[-1], take))
    chosen, at = [], len(offers)
    while at:
        use, before = back[at - 1]
        if use:
            end, start, kind, _ = offers[at - 1]
            chosen.append((kind, start, end))
        at = before if use else at - 1
    return sorted(chosen)


def personal_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, added) of every text, by kind and start."""
    keys, signs, bases = [], [], []
    found: list[list] = [[] for _ in texts]
    for number, text in enumerate(texts):
        bases.append([])
        if not _TRIGGER.search(text):
            continue
        bases[number] = base_spans(text)
        for start in window_starts(len(text)):
            piece = text[start : start + WINDOW]
            if _TRIGGER.search(piece):
                keys.append((number, start))
                signs.append(symbols(piece))
    for number, kind, start, end, score in _decoded(model, signs, keys):
        found[number].append((kind, start, end, score))
    result = []
    for text, base, pieces in zip(texts, bases, found):
        added = reconciled(text, base, pieces) if pieces else []
        result.append(sorted([(*span, False) for span in base] + [(*span, True) for span in added]))
    return result


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def find_personal_data(frame: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, id, text, spans), one per input row; ``row`` holds the other columns of the input.

    ``spans`` lists kind, start, end (characters, end exclusive) and whether the network added the
    span, by kind and start. Base spans of different kinds may overlap; an added span overlaps
    nothing. A null text counts as empty and has no spans. Ids may be null or repeated; each row is
    judged alone. A text of any length is read whole, window by window.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                spans = [
                    [{"kind": KINDS[kind], "start": start, "end": end, "added": added} for kind, start, end, added in found]
                    for found in personal_spans(part.column("text").to_pylist(), shared.value)
                ]
                columns = [part.column(name) for name in part.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, SPAN_TYPE)], [*part.schema.names, "spans"])

    others = [f"`{name}`" for name in frame.columns if name not in (doc_id, text)]
    rows = frame.select(
        F.struct(*others).alias("row") if others else F.lit(None).cast("string").alias("row"),
        F.col(f"`{doc_id}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    kinds = "array<struct<kind: string, start: bigint, end: bigint, added: boolean>>"
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, spans {kinds}")


def masked_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform(spans, lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.when(span["start"] < state["at"], state).otherwise(
            F.struct(F.concat(state["done"], between, F.lit("["), F.upper(span["kind"]), F.lit("]")).alias("done"), span["end"].alias("at"))
        )

    rest = lambda state: F.concat(state["done"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(ordered, start, step, rest)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))), ","
    )


def op11_bilstm_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: counts and digest of base spans, and all spans."""
    documents = documents_table(spark, sf_dir).select("doc_id", "text")
    found = find_personal_data(documents, train(documents))
    base = F.filter("spans", lambda span: ~span["added"])
    counts = [F.size(F.filter(base, lambda span: span["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda span: span["added"])).cast("bigint").alias("n_added"),
    )
