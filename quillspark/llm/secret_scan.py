"""Secrets in texts: fixed rules, and a character convolutional network that judges every other candidate.

The rules (RULES) give the base spans. A candidate is a maximal run of 8 or more signs of SECRET_SIGNS
that has a digit and a letter, or that a base span touches. The network sees a window around it: BEFORE
signs ahead, VALUE signs of the candidate and AFTER signs behind; a longer candidate has several windows
and the highest of their scores, so all of it is read. Each sign is embedded, a flag tells whether it
lies in the candidate, one convolution of width 5 slides over the window, maxima are taken inside the
candidate and around it, and two dense layers give a logit. All of it is NumPy, forward and backward.

Labelled findings come from the documents outside one fifth of the texts (by hash of the window): what
the rules find is a secret; a candidate that no base span touches is none, unless it looks like one
(UNSURE: a telling word ahead, or 20 or more signs a fifth of which are digits), in which case it is
not learnt from but judged. Equal windows are one finding. At most SAMPLE findings of each label, those
with the smallest hashes, are learnt from by one task. A fourth of them is kept back: on these the logits
are calibrated (Platt) and for each shape of value (SHAPES) a threshold is chosen: of all that keep
RECALL of the secrets the ones of highest precision, of these the middle of the widest margin. A shape
with fewer than LEAST secrets kept back uses the threshold of all shapes. Without LEAST secrets and LEAST
others to learn from there is no model and nothing is added.

The documents are read twice, for findings and to judge, without a shuffle of texts; the model, some
70 kB, is sent to every task.

Defined results: null and empty texts have no spans; positions are code points; spans of one kind do
not overlap, spans of different kinds may; the model's spans (kind MODEL) never touch a base span; every
row is judged by itself, whatever its doc_id or repeats; an empty table gives an empty result. Columns
but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .shared import table

# fixed values: the kinds of base spans in order, their patterns, and the least length of the group that counts
RULES = {
    "assign": (re.compile(rb"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(rb"[0-9a-f]{32,}"), 0, 32),
}
#: A text without any of these, A-Z lower-cased, has no span of the kind.
_NEEDED = {"assign": (b"password", b"passwd", b"secret", b"token", b"api"), "access": (b"akia",)}
MODEL = "model"
SECRET_SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST_SIGNS = 8
#: Words that make a candidate behind them doubtful, so that it is not learnt as harmless.
UNSURE = re.compile(rb"(?i:passw|pwd|secret|token|key|auth|bearer|credential|private)")
BEFORE, VALUE, AFTER = 32, 64, 8
STRIDE = 48
LENGTH = BEFORE + VALUE + AFTER
#: The most findings of each label that the network learns from.
SAMPLE = 3_000
LEAST = 12
RECALL = 0.99
FOLDS, HELD_OUT = 5, 0
EPOCHS, BATCH, RATE = 10, 64, 0.01
EMBED, FILTERS, WIDTH, HIDDEN = 8, 24, 5, 16
#: Windows that the network takes at a time: 512 need some 10 MB.
STEP = 512

_SECRET = np.zeros(256, dtype=bool)
_SECRET[list(SECRET_SIGNS)] = True
_DIGIT, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# signs as numbers: 0 nothing, 1 beyond ASCII, 2 control signs, then the printable ones
_CODE = np.full(256, 1, dtype=np.uint8)
_CODE[:128] = 2
_CODE[32:127] = np.arange(3, 98)
_CODES = 98
SHAPES = ("hex", "other")
_HEX = np.zeros(256, dtype=bool)
_HEX[list(_CODE[list(b"0123456789abcdefABCDEF")])] = True


# --- what a slice of texts holds ---


@dataclass
class Slice:
    """Texts as signs: one byte each, the first of its UTF-8 form."""

    signs: np.ndarray
    offs: np.ndarray  #: where each text begins, with the end of the last
    base: list[list[tuple[int, int, str]]]  #: start, end and kind of each text's base spans, in order
    starts: np.ndarray  #: candidates
    ends: np.ndarray
    text: np.ndarray
    base_touched: np.ndarray


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Start, end (in bytes) and kind of what the rules find, by start and then kind as listed."""
    low, found = raw.lower(), []
    for nth, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        if kind not in _NEEDED or any(w in low for w in _NEEDED[kind]):
            found += [(m.start(), nth, m.end(), kind) for m in pattern.finditer(raw) if m.end(group) - m.start(group) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def take_apart(column: pa.Array) -> Slice:
    data, byte_offs = wordhash.text_bytes(column)
    lead = (data & 0xC0) != 0x80
    place = np.r_[0, np.cumsum(lead)]  # code points before each byte
    signs, offs = data[lead], place[byte_offs]
    raw, base = data.tobytes(), []
    for a, b in zip(byte_offs[:-1].tolist(), byte_offs[1:].tolist()):
        base.append([(int(place[a + s] - place[a]), int(place[a + e] - place[a]), kind) for s, e, kind in base_spans(raw[a:b])])
    starts, ends = _runs(_SECRET[signs], offs)
    sums = [np.r_[0, np.cumsum(kind[signs])] for kind in (_DIGIT, _LETTER)]
    touched = np.zeros(len(signs) + 1, dtype=np.int32)
    for at, spans in zip(offs.tolist(), base):
        for s, e, _ in spans:
            touched[at + s] += 1
            touched[at + e] -= 1
    covered = np.r_[0, np.cumsum(np.cumsum(touched)[:-1] > 0)]
    own = covered[ends] > covered[starts]
    keep = (ends - starts >= LEAST_SIGNS) & (own | ((sums[0][ends] > sums[0][starts]) & (sums[1][ends] > sums[1][starts])))
    starts, ends = starts[keep], ends[keep]
    return Slice(signs, offs, base, starts, ends, np.searchsorted(offs, starts, side="right") - 1, own[keep])


def _runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked signs, which end where a text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first, last = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]] - 1
    begins[first], stops[last] = inside[first], inside[last]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def windows(s: Slice, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """STEP windows at a time: the candidates (as places in `which`), the codes of signs, and which signs lie in the candidate."""
    starts, ends = s.starts[which], s.ends[which]
    count = np.maximum(0, -(-(ends - starts - VALUE) // STRIDE)) + 1
    first = np.r_[0, np.cumsum(count)]
    for a in range(0, int(first[-1]), STEP):
        n = np.arange(a, min(a + STEP, int(first[-1])))
        own = np.searchsorted(first, n, side="right") - 1
        at = starts[own] + (n - first[own]) * STRIDE
        places = at[:, None] + np.arange(-BEFORE, VALUE + AFTER)
        text = s.text[which][own]
        stop = np.minimum(at + VALUE, ends[own])
        real = (places >= s.offs[text][:, None]) & (places < s.offs[text + 1][:, None]) & (places < (stop + AFTER)[:, None])
        codes = np.where(real, _CODE[s.signs[np.where(real, places, 0)]], 0).astype(np.uint8)
        yield own, codes, (places >= starts[own][:, None]) & (places < ends[own][:, None]) & real


# --- the network ---


class Network:
    """Signs -> embedding and flag -> convolution -> maxima inside and around -> dense -> logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / np.prod(shape[:-1]))).astype(np.float32)
        zero = lambda n: np.zeros(n, dtype=np.float32)
        self.weights = {"embed": rng.standard_normal((_CODES, EMBED)).astype(np.float32) / 2, "conv": make(WIDTH * (EMBED + 1), FILTERS), "conv0": zero(FILTERS),
                        "dense": make(2 * FILTERS, HIDDEN), "dense0": zero(HIDDEN), "out": make(HIDDEN, 1), "out0": zero(1)}
        self.weights["embed"][0] = 0

    def forward(self, codes: np.ndarray, inside: np.ndarray, held: dict | None = None) -> np.ndarray:
        w, half = self.weights, WIDTH // 2
        x = np.concatenate([w["embed"][codes], inside[..., None].astype(np.float32)], axis=2)
        padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
        taps = sliding_window_view(padded, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(*codes.shape, -1)  # window, place, tap x channel
        h = np.maximum(taps @ w["conv"] + w["conv0"], 0)
        pooled, at = [], []
        for mask in (inside, ~inside & (codes > 0)):
            seen = np.where(mask[..., None], h, np.float32(-1))
            at.append(seen.argmax(axis=1))
            pooled.append(np.maximum(np.take_along_axis(seen, at[-1][:, None], 1)[:, 0], 0))
        p = np.concatenate(pooled, axis=1)
        d = np.maximum(p @ w["dense"] + w["dense0"], 0)
        logit = (d @ w["out"] + w["out0"])[:, 0]
        if held is not None:
            held.update(codes=codes, taps=taps, at=np.concatenate(at, axis=1), p=p, d=d)
        return logit

    def backward(self, held: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from the slope of the loss by each logit."""
        w, half = self.weights, WIDTH // 2
        codes, n = held["codes"], len(slope)
        g = {"out": held["d"].T @ slope[:, None], "out0": slope.sum(keepdims=True)}
        dd = (slope[:, None] * w["out"].T) * (held["d"] > 0)
        g["dense"], g["dense0"] = held["p"].T @ dd, dd.sum(axis=0)
        dp = (dd @ w["dense"].T) * (held["p"] > 0)  # only the places of maxima pass it on
        taps = held["taps"][np.arange(n)[:, None], held["at"]]  # window, maximum, tap x channel
        g["conv"] = sum(np.einsum("bft,bf->tf", taps[:, k : k + FILTERS], dp[:, k : k + FILTERS]) for k in (0, FILTERS))
        g["conv0"] = (dp[:, :FILTERS] + dp[:, FILTERS:]).sum(axis=0)
        dt = (dp[:, :, None] * np.concatenate([w["conv"].T, w["conv"].T])[None]).reshape(n, 2 * FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        places = held["at"][:, :, None] + np.arange(-half, half + 1)
        real = (places >= 0) & (places < codes.shape[1])
        signs = np.where(real, codes[np.arange(n)[:, None, None], np.where(real, places, 0)], 0)
        g["embed"] = np.stack([np.bincount(signs.ravel(), weights=dt[..., e].ravel(), minlength=_CODES) for e in range(EMBED)], axis=1).astype(np.float32)
        g["embed"][0] = 0  # nothing stays nothing
        return g


def train(codes: np.ndarray, inside: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network by Adam on the weighted logistic loss; both labels weigh the same."""
    net, rng = Network(seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    weight, step = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            rows, held, step = order[a : a + BATCH], {}, step + 1
            p = 1 / (1 + np.exp(-np.clip(net.forward(codes[rows], inside[rows], held), -30, 30)))
            slope = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            for k, g in net.backward(held, slope).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.weights[k] -= (RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# --- calibration ---


def platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * logit + b))), by Newton steps on smoothed labels."""
    yes, no = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([logits, np.ones(len(logits))], axis=1).astype(np.float64)
    w = np.zeros(2)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + 1e-3 * w @ w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - target) + 2e-3 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    return float(w[0]), float(w[1])


def threshold(scores: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> float:
    """Of the thresholds that keep `recall` of the secrets, those of highest precision; of these the middle of the widest margin."""
    secrets = np.sort(scores[labels == 1])
    most = secrets[int(np.floor((1 - recall) * len(secrets) + 1e-9))]  # the highest that keeps enough
    edges = np.unique(np.r_[scores[scores <= most], most])
    precision = [(labels[scores >= t] == 1).mean() for t in edges]
    best = [t for t, p in zip(edges, precision) if p >= max(precision) - 1e-12]
    below = [max(np.r_[scores[scores < t], min(0.0, t)]) for t in best]
    margin = int(np.argmax([t - b for t, b in zip(best, below)]))
    return float((best[margin] + below[margin]) / 2)


@dataclass
class Judge:
    """A network with its calibration and a threshold for each shape of value."""

    network: Network
    a: float
    b: float
    thresholds: tuple[float, ...]

    def probability(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.network.forward(codes, inside).astype(np.float64) + self.b, -35, 35)))

    def scores(self, s: Slice, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated score of each of these candidates, and whether it is at or above the threshold of its shape."""
        score, hexed = np.zeros(len(which)), np.ones(len(which), dtype=bool)
        for own, codes, inside in windows(s, which):
            np.maximum.at(score, own, self.probability(codes, inside))
            np.logical_and.at(hexed, own, shapes(codes, inside) == 0)
        return score, score >= np.where(hexed, *self.thresholds)


def shapes(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """0 where all signs inside are hexadecimal digits, else 1."""
    return (inside & ~_HEX[codes]).any(axis=1).astype(int)


def _packed(codes: np.ndarray, inside: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in (codes | inside.astype(np.uint8) << 7)]


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), LENGTH)
    return flat & 127, flat >> 7 == 1


def _fold(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest()) >> 1


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> labelled windows outside the held-out fold: window, place, label."""
    for whole in batches:
        for batch in wordhash.slices(whole, "text"):
            s = take_apart(batch.column("text"))
            raw = s.signs.tobytes()
            digits = np.r_[0, np.cumsum(_DIGIT[s.signs])]
            size = s.ends - s.starts
            unsure = (size >= 20) & (5 * (digits[s.ends] - digits[s.starts]) >= size)
            for i in np.flatnonzero(~s.base_touched & ~unsure).tolist():
                unsure[i] = UNSURE.search(raw, max(int(s.offs[s.text[i]]), int(s.starts[i]) - BEFORE), int(s.starts[i])) is not None
            which = np.flatnonzero(s.base_touched | ~unsure)
            for own, codes, inside in windows(s, which):
                rows = _packed(codes, inside)
                places = [_fold(r) for r in rows]
                keep = [i for i, p in enumerate(places) if p % FOLDS != HELD_OUT]
                labels = s.base_touched[which[own]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([rows[i] for i in keep], pa.binary()), pa.array([places[i] for i in keep], pa.int64()), pa.array(labels[keep], pa.int32())], names=["window", "place", "label"])


def _variants(codes: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The findings, those of hexadecimal values and the harmless ones once more without context, and hexadecimal ones in capitals."""
    hexed = (shapes(codes, inside) == 0) & (labels == 1)
    alone = hexed | (labels == 0)
    capitals = codes[hexed]
    low = (capitals >= _CODE[ord("a")]) & (capitals <= _CODE[ord("z")]) & inside[hexed]
    sets = [(codes, inside, labels), (np.where(inside[alone], codes[alone], 0).astype(np.uint8), inside[alone], labels[alone]), (np.where(low, capitals - 32, capitals).astype(np.uint8), inside[hexed], labels[hexed])]
    return tuple(np.concatenate(x) for x in zip(*sets))


def fit_windows(windows_: list[bytes], labels: np.ndarray, places: np.ndarray) -> Judge | None:
    """A judge from labelled windows; a fourth of them, by place, is kept back for calibration."""
    if not len(labels):
        return None
    codes, inside = _unpacked(windows_)
    kept_back = (places // FOLDS) % 4 == 0
    if min(((labels == k) & fold).sum() for k in (0, 1) for fold in (kept_back, ~kept_back)) < LEAST:
        return None
    net = train(*_variants(codes[~kept_back], inside[~kept_back], labels[~kept_back]))
    rest, given = np.flatnonzero(kept_back), labels[kept_back]
    logits = np.concatenate([net.forward(codes[rest[a : a + STEP]], inside[rest[a : a + STEP]]) for a in range(0, len(rest), STEP)]).astype(np.float64)
    judge = Judge(net, *platt(logits, given), ())
    scores = 1 / (1 + np.exp(-np.clip(judge.a * logits + judge.b, -35, 35)))
    of_all, shape = threshold(scores, given), shapes(codes[rest], inside[rest])
    few = lambda k: ((shape == k) & (given == 1)).sum() < LEAST
    judge.thresholds = tuple(of_all if few(k) else threshold(scores[shape == k], given[shape == k]) for k in range(len(SHAPES)))
    return judge


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample in order of place -> the judge's numbers."""
    rows, places, labels = [], [], []
    for batch in batches:
        rows += batch.column("window").to_pylist()
        places += batch.column("place").to_pylist()
        labels += batch.column("label").to_pylist()
    judge = fit_windows(rows, np.array(labels, dtype=int), np.array(places, dtype=np.int64))
    if judge:
        values = judge.network.weights | {"calibration": np.array([judge.a, judge.b]), "thresholds": np.array(judge.thresholds)}
        yield pa.RecordBatch.from_arrays([pa.array(list(values)), pa.array([v.ravel().astype(np.float64).tolist() for v in values.values()], pa.list_(pa.float64()))], names=["name", "numbers"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Judge | None:
    """A judge learnt from the labelled findings of docs; None where there are too few."""
    found = docs.select("text").mapInArrow(_findings, "window binary, place long, label int").groupBy("window").agg(F.min("place").alias("place"), F.max("label").alias("label"))
    by_label = [found.where(F.col("label") == k).orderBy("place", "window").limit(sample) for k in (0, 1)]
    chosen = by_label[0].unionByName(by_label[1]).repartition(1).sortWithinPartitions("place", "window")
    values = {r["name"]: np.array(r["numbers"]) for r in chosen.mapInArrow(_learn, "name string, numbers array<double>").collect()}
    if not values:
        return None
    net = Network()
    net.weights = {k: values[k].astype(np.float32).reshape(v.shape) for k, v in net.weights.items()}
    return Judge(net, *values["calibration"].tolist(), tuple(values["thresholds"].tolist()))


# --- scanning ---

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())])


def spans_of(s: Slice, judge: Judge | None) -> list[list[tuple[int, int, str, float | None]]]:
    """start, end, kind and score of all spans of each text, by start and then kind as listed; base spans have the highest score of the candidates they touch."""
    scores, taken = judge.scores(s, np.arange(len(s.starts))) if judge else (np.zeros(len(s.starts)), np.zeros(len(s.starts), dtype=bool))
    out, first = [], np.searchsorted(s.starts, s.offs)
    order = [*RULES, MODEL]
    for t, base in enumerate(s.base):
        own = slice(first[t], first[t + 1])
        starts, ends = s.starts[own] - s.offs[t], s.ends[own] - s.offs[t]
        found = []
        for a, b, kind in base:
            near = scores[own][np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)]
            found.append((a, b, kind, float(near.max()) if judge and len(near) else None))
        for i in np.flatnonzero(taken[own] & ~s.base_touched[own]).tolist():
            found.append((int(starts[i]), int(ends[i]), MODEL, float(scores[own][i])))
        out.append(sorted(found, key=lambda x: (x[0], order.index(x[2]))))
    return out


def _scan(judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wordhash.slices(whole, "text"):
                found = spans_of(take_apart(batch.column("text")), judge.value)
                texts = batch.column("text")
                rows = []
                for i, spans in enumerate(found):
                    text = texts[i].as_py() if spans else ""
                    rows.append([{"kind": k, "start": a, "end": b, "text": text[a:b], "score": score} for a, b, k, score in spans])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return run


def find(docs: DataFrame, judge: Judge | None) -> DataFrame:
    """doc_id and `spans` of every row: kind, start, end, text and calibrated score. docs has doc_id and text."""
    schema = "doc_id long, spans array<struct<kind string, start long, end long, text string, score double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(judge)), schema)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, fit(docs)).select("doc_id", *map(of, RULES), F.sha2(line(F.filter("spans", lambda s: s["kind"] != MODEL)), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


#: A network is beyond SQL; tests compare with plain regular expressions and a plain network.
SQL: dict = {}
