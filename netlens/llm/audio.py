"""Audio features: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation.

Media are stored as one-channel 8-bit PCM in RIFF/WAVE form. Features come from the
samples that were read back from that form: the signal is resampled by a rational
factor with one short filter per phase, cut into overlapping windows, and each window
gives log energies of mel bands. Windows are pooled into ``SPANS`` equal time spans, so
a feature is a tensor of fixed shape [SPANS, BANDS] whose rows have known times.
Segments are found on window energy with two thresholds: one opens at the upper and
closes under the lower one.

Resampling, windows and bands are worked through in blocks of ``BLOCK`` samples, so a long
medium needs little more memory than its bytes and one energy for every window. Values
depend on the bytes alone: equal media give equal values.

Defined results for odd input: a null text is an empty payload, padded like any other; a
medium shorter than a window is filled up with silence; silence has no segments; a window
between the thresholds stays as the one before it, and is out of a segment at the beginning;
repeated rows give equal values; an empty table gives an empty result. Only id and text are
read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, tidied, utf8_view

RATE, UP, DOWN, TAPS = 12_000, 2, 3, 12
NEW_RATE = RATE * UP // DOWN
WINDOW, HOP, BANDS, SPANS = 256, 128, 16, 8
OPEN, CLOSE = 0.5, 0.25
#: Resampled values worked on at once.
BLOCK = 1 << 18


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, PCM, one channel, 8 bits."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def from_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not RIFF/WAVE")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> np.ndarray:
    """One windowed-sinc filter per output phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(t * cut) * cut * np.hamming(n) * UP
    return np.stack([h[p::UP] for p in range(UP)]).astype(np.float32)


def _resampled(x: np.ndarray) -> Iterator[np.ndarray]:
    """x at RATE to NEW_RATE, in blocks: output k is phase (k * DOWN) % UP of the filter at input (k * DOWN) // UP.

    Bytes are read as unsigned 8-bit samples.
    """
    n, before = -(-len(x) * UP // DOWN), TAPS // 2
    for a in range(0, n, BLOCK - BLOCK % UP):
        size = min(BLOCK - BLOCK % UP, n - a)
        lo = a * DOWN // UP - before
        hi = (a + size - 1) * DOWN // UP - before + TAPS
        own = x[max(0, lo) : max(0, hi)]
        own = (own.astype(np.float32) - 128) / 128 if own.dtype == np.uint8 else own.astype(np.float32)
        part = np.zeros(hi - lo, np.float32)
        part[max(0, -lo) : max(0, -lo) + len(own)] = own
        rows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
        out = np.empty(size, np.float32)
        for first in range(min(UP, size)):
            h = _phases()[first * DOWN % UP][::-1]
            count = -(-(size - first) // UP)
            view = rows[first * DOWN // UP :: DOWN][:count]
            total = np.zeros(count, np.float32)
            for i in range(TAPS):
                total += view[:, i] * h[i]
            out[first::UP] = total
        yield out


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE to NEW_RATE."""
    return np.concatenate([np.zeros(0, np.float32), *_resampled(x)])


@cache
def _mel() -> np.ndarray:
    """[WINDOW // 2 + 1, BANDS] triangular filters, evenly spaced in mel."""
    mel = np.linspace(0, 2595 * np.log10(1 + NEW_RATE / 2 / 700), BANDS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / NEW_RATE)[:, None]
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(blocks: Iterable[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Means over the windows of each time span [SPANS, BANDS], and energies of all windows, of a signal that comes in blocks."""
    n = 1 + max(0, length - WINDOW) // HOP
    shape, sums, energy = np.hanning(WINDOW).astype(np.float32), np.zeros((SPANS, BANDS)), np.empty(n, np.float32)
    span, at, rest = np.arange(n) * SPANS // n, 0, np.zeros(0, np.float32)

    def take(x: np.ndarray) -> None:
        nonlocal at
        frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
        for i in range(0, len(frames), BLOCK // WINDOW):
            part = frames[i : i + BLOCK // WINDOW]
            power = np.abs(np.fft.rfft(part * shape)) ** 2
            np.add.at(sums, span[at : at + len(part)], np.log(power @ _mel() + 1e-6))
            energy[at : at + len(part)] = np.sqrt((part * part).mean(1))
            at += len(part)

    for block in blocks:
        rest = np.concatenate([rest, block])
        if len(rest) >= WINDOW:
            take(rest)
            rest = rest[(1 + (len(rest) - WINDOW) // HOP) * HOP :]
    if not at:
        take(np.concatenate([rest, np.zeros(WINDOW - len(rest), np.float32)]))
    return sums / np.maximum(1, np.bincount(span, minlength=SPANS))[:, None], energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) windows of each stretch that rises over the upper and stays over the lower threshold."""
    top = float(energy.max(initial=0))
    if top <= 1e-4:
        return []
    state = np.where(energy >= OPEN * top, 1, np.where(energy < CLOSE * top, 0, -1))
    at = np.where(state >= 0, np.arange(len(state)), -1)
    np.maximum.accumulate(at, out=at)
    on = np.where(at >= 0, state[np.maximum(at, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], np.ndarray]:
    """Tensor [SPANS, BANDS], segments in seconds, and [SPANS, 2] times of the tensor's rows."""
    length = -(-len(samples) * UP // DOWN)
    tensor, energy = log_mel(_resampled(np.frombuffer(samples, np.uint8)), length)
    found = [(a * HOP / NEW_RATE, (b - 1) * HOP / NEW_RATE + WINDOW / NEW_RATE) for a, b in segments(energy)]
    edge = np.linspace(0, max(length, WINDOW) / NEW_RATE, SPANS + 1)
    return np.round(tensor, 3), found, np.stack([edge[:-1], edge[1:]], 1)


def digest(tensor: np.ndarray, found: list[tuple[float, float]]) -> str:
    """Short text of a feature: tensor in hundredths, then segments in milliseconds, hashed."""
    text = ",".join(map(str, np.rint(tensor.ravel() * 100).astype(int).tolist())) + "|" + ",".join(f"{round(a * 1000)}-{round(b * 1000)}" for a, b in found)
    return hashlib.sha256(text.encode()).hexdigest()


TENSOR = T.ArrayType(T.FloatType(), False)
_SCHEMA = [
    ("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()),
    ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()),
    ("feature", T.StringType(), pa.string()), ("n_segments", T.LongType(), pa.int64()),
]


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """One row per document: digests of payload and stored form, and features.

    ``feature`` is a digest of the features; these are ``log_mel`` (row-major, SPANS x BANDS
    numbers, its shape in the column's metadata), the ``spans`` of time of its rows, and the
    ``segments`` in seconds. With ``stored``, ``media`` has the stored bytes too.
    """
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pair = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
    schema = [kept.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in _SCHEMA)]
    schema += [T.StructField("log_mel", TENSOR, True, {"shape": [SPANS, BANDS]}), T.StructField("spans", pair), T.StructField("segments", pair)]
    schema += [T.StructField("media", T.BinaryType())] * stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        kinds = [t for *_, t in _SCHEMA] + [pa.list_(pa.float32()), times, times] + [pa.binary()] * stored
        for batch in by_bytes(batches, "text", 2 << 20):
            data, ends = utf8_view(batch.column(1))
            rows = []
            for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False):
                own = data[a:b].tobytes()
                kept_as = to_wave(own + b"\0" * (64 - len(own) % 64 if len(own) % 64 or not own else 0))
                payload, _ = from_wave(kept_as)
                tensor, found, spans = features(payload)
                row = [b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(kept_as), hashlib.sha256(kept_as).hexdigest()]
                row += [digest(tensor, found), len(found), tensor.ravel().astype(np.float32)]
                row += [[{"start": x, "end": y} for x, y in spans], [{"start": x, "end": y} for x, y in found]]
                rows.append(row + [kept_as] * stored)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.name for f in schema])

    return kept.mapInArrow(tidied(run), T.StructType(schema))


def tensor_array(values: pa.Array) -> pa.Array:
    """A ``log_mel`` column read with Arrow, as an array of fixed-shape tensors [SPANS, BANDS]."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), [SPANS, BANDS], dim_names=["span", "band"])
    return pa.ExtensionArray.from_storage(kind, values.cast(pa.list_(pa.float32(), SPANS * BANDS)))
