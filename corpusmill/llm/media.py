"""Audio media columns: lossless 8-bit storage and features over time spans.

``encode_wav`` stores payload bytes as the samples of a mono 8-bit PCM WAV
file; ``decode_wav`` gives them back.  ``audio_features`` reads the stored
bytes, resamples by a polyphase filter, takes overlapped frames to a log-mel
filterbank, segments by energy with hysteresis (a segment begins above the
upper and ends below the lower threshold), and pools each segment's frames into
a tensor of fixed shape with the segment's time span.  ``write_tensors`` stores
them as Arrow files with a fixed-shape tensor column.

Every medium is computed alone, in blocks of frames that depend on its own
length only, so equal bytes give equal features and memory is bounded by the
longest medium.  No shuffle.

Edge cases: a null or empty payload is one unit of padding; silence gives one
segment over the whole; a null id stays null; repeated rows are computed again;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import scratch

RATE, UP, DOWN, TAPS = 16000, 1, 2, 24
FRAME, HOP, FFT, MELS, BINS = 200, 100, 256, 32, 4
SHAPE = (BINS, MELS)
UNIT = 192
_BLOCK = 2048


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM; a chunk of odd length is padded as RIFF asks."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def decode_wav(data: bytes) -> tuple[bytes, int]:
    """(samples, rate)"""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is supported")
        elif name == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass at the lower of the two rates, by phases: [up, taps]."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: output n is a filter phase's product with the input around n * down / up; no zero-stuffed samples are computed."""
    phases = _filter(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1 - taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... have one phase, and inputs down apart
        phase, at = first * down % up, first * down // up
        count = len(range(first, n, up))
        total = np.zeros(count, np.float32)
        # the inputs down apart are themselves polyphase components: one short filter for each residue
        for r in range(min(down, taps)):
            part = phases[phase][::-1][r::down]
            series = padded[at + r :: down][: count + len(part) - 1]
            total += np.convolve(series, part[::-1], "valid")[:count]
        out[first::up] = total
    return out


@lru_cache
def _mel_bank(rate: float, fft: int, mels: int) -> np.ndarray:
    """Triangular filters [fft // 2 + 1, mels], evenly spaced in mel."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(to_mel(20), to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1)[:, None] * rate / fft
    up = (f - points[:-2]) / (points[1:-1] - points[:-2])
    down = (points[2:] - f) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """[frames, MELS]; frames of FRAME samples every HOP, the last one padded."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME + 2)[1:-1].astype(np.float32), _mel_bank(rate, FFT, MELS)
    out = np.empty((n, MELS), np.float32)
    for a in range(0, n, _BLOCK):
        spectrum = np.fft.rfft(frames[a : a + _BLOCK] * window, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a : a + _BLOCK] = np.log(power @ bank + np.float32(1e-6))
    return out


def segment(energy: np.ndarray, enter: float = 0.25, leave: float = -0.25) -> list[tuple[int, int]]:
    """Frame ranges of high energy, in units of its deviation: one begins at enter and goes on until leave."""
    spread = float(energy.std())
    if spread < 1e-6:
        return [(0, len(energy))]
    z = (energy - energy.mean()) / spread
    # +1 where a segment would begin, -1 where one would end, else as before
    state = np.where(z >= enter, 1, np.where(z <= leave, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(z)), -1))
    inside = (last >= 0) & (state[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist())) or [(0, len(energy))]


def features(samples: bytes, rate: int, smooth: int = 25, least: int = 50) -> tuple[list[tuple[int, int]], np.ndarray, int]:
    """(time spans in ms, tensors [segments, BINS, MELS], frames); energy is smoothed over some frames, segments of fewer than least frames join the one before."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x), rate * UP / DOWN)
    energy = mel.mean(axis=1)
    if len(energy) > smooth:
        energy = np.convolve(energy, np.full(smooth, 1 / smooth, np.float32), "same")
    spans: list[tuple[int, int]] = []
    for a, b in segment(energy):
        if spans and b - a < least:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    edges = np.array([[a + (b - a) * i // BINS for i in range(BINS + 1)] for a, b in spans])
    # a bin without a frame takes the one at its begin
    lo = np.minimum(edges[:, :-1], len(mel) - 1)
    hi = np.maximum(edges[:, 1:], lo + 1)
    tensors = ((total[hi] - total[lo]) / (hi - lo)[..., None]).astype(np.float32)
    ms = 1000 * HOP * DOWN / (UP * rate)
    return [(round(a * ms), round(b * ms)) for a, b in spans], tensors, len(mel)


def _slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes in a column; a longer value is one alone."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def digest(tensors: bytes, steps: int = 16) -> str:
    """SHA-1 of features in whole steps of a sixteenth, so that the last bits of a machine's arithmetic don't show."""
    return hashlib.sha1(np.rint(np.frombuffer(tensors, "<f4") * steps).astype("<i2").tobytes()).hexdigest()


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded with spaces to a positive multiple of UNIT bytes, as a WAV file."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                raw = [x or b"" for x in part.column(1).to_pylist()]
                media = [encode_wav(x + b" " * (max(1, -(-len(x) // UNIT)) * UNIT - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """The columns of media (doc_id, n_bytes, media) but the last, and of what is stored there: payload and media sizes and checksums, spans (ms), tensors (float32 of SHAPE, little-endian, one after another), frames."""
    ship(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "spans", "tensors", "frames"]
    spans_type = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                rows = []
                for data in part.column(2).to_pylist():
                    payload, rate = decode_wav(data)
                    spans, tensors, frames = features(payload, rate)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), [{"start_ms": s, "end_ms": e} for s, e in spans], tensors.astype("<f4").tobytes(), frames))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), spans_type, pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, spans array<struct<start_ms:long,end_ms:long>>, tensors binary, frames long")


def _tensor_rows(found: DataFrame, folder: str) -> DataFrame:
    """The columns of found but spans and tensors, which go to Arrow files in folder, one a partition; instead path, first (the row of the first segment there) and segments."""
    ship(found.sparkSession)
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    kept = [f for f in found.schema.fields if f.name not in ("spans", "tensors")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (x for x in batches if x.num_rows)
        head = next(batches, None)
        if head is None:
            return
        path, rows = f"{folder}/part-{TaskContext.get().partitionId():06d}.arrow", 0
        schema = pa.schema([("doc_id", head.column("doc_id").type), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("tensor", kind)])
        with scratch.written_whole(path) as out, pa.ipc.new_stream(out, schema) as stream:
            for batch in (b for part in ([head], batches) for b in part):
                spans = batch.column("spans")
                of = pc.list_parent_indices(spans)
                flat = spans.flatten()
                tensors = np.frombuffer(b"".join(x or b"" for x in batch.column("tensors").to_pylist()), "<f4").astype(np.float32)
                store = pa.FixedSizeListArray.from_arrays(pa.array(tensors), SHAPE[0] * SHAPE[1])
                stream.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), flat.field(0), flat.field(1), pa.ExtensionArray.from_storage(kind, store)], schema=schema))
                segments = pc.list_value_length(spans).to_numpy().astype(np.int64)
                first = rows + np.cumsum(segments) - segments
                rows += len(flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([path] * batch.num_rows), pa.array(first), pa.array(segments)], [*names, "path", "first", "segments"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return scratch.stored(found.mapInArrow(run, fields + ", path string, first long, segments long"), "tensor-rows")


def write_tensors(found: DataFrame, folder: str) -> DataFrame:
    """Stores features as Arrow files of one row per segment (doc_id, start_ms, end_ms, tensor of SHAPE); returns path and rows of each."""
    return _tensor_rows(found.select("doc_id", "spans", "tensors"), folder).groupBy("path").agg(F.sum("segments").alias("rows"))


def read_tensors(uri: str) -> pa.Table:
    fs, path = scratch.open_fs(uri)
    with fs.open_input_stream(path) as f:
        return pa.ipc.open_stream(f).read_all()


class _Segments:
    """Rows of a file of tensors, batch by batch; a document's rows are in one batch."""

    def __init__(self, uri: str):
        fs, path = scratch.open_fs(uri)
        self.file = fs.open_input_stream(path)
        self.stream, self.uri, self.at, self.batch = pa.ipc.open_stream(self.file), uri, 0, None

    def rows(self, first: int, n: int) -> pa.RecordBatch:
        while self.batch is None or first >= self.at + self.batch.num_rows:
            self.at += self.batch.num_rows if self.batch else 0
            self.batch = self.stream.read_next_batch()
        return self.batch.slice(first - self.at, n)


def stored_features(found: DataFrame, folder: str) -> DataFrame:
    """found, its spans and tensors written to Arrow files in folder and read again from there, and digest: the SHA-1 of the tensors in steps."""
    rows = _tensor_rows(found, folder)
    kept = [f for f in rows.schema.fields if f.name not in ("path", "first", "segments")]
    names = [f.name for f in kept]
    spans_type = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in batches:
            spans, tensors, digests = [], [], []
            for doc_id, path, first, n in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "path", "first", "segments"))):
                if source is None or source.uri != path or first < source.at:
                    source = _Segments(path)
                part = source.rows(first, n)
                if part.num_rows != n or any(x != doc_id for x in part.column(0).to_pylist()):
                    raise ValueError(f"{path}: rows {first} to {first + n} aren't those of {doc_id}")
                spans.append([{"start_ms": a, "end_ms": b} for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist())])
                tensors.append(part.column(3).storage.flatten().to_numpy().astype("<f4").tobytes())
                digests.append(digest(tensors[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(spans, spans_type), pa.array(tensors, pa.binary()), pa.array(digests)], [*names, "spans", "tensors", "digest"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, fields + ", spans array<struct<start_ms:long,end_ms:long>>, tensors binary, digest string")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text stored as audio, read back, and its features, stored as tensors and read back, as a short string."""
    media = scratch.stored(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    found = stored_features(audio_features(media), scratch.folder(spark, "tensors"))
    last = F.try_element_at("spans", F.lit(-1))["end_ms"]
    feature = F.concat_ws(":", "frames", F.size("spans"), last, "digest")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
