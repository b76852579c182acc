"""Per-record media and model steps (M1-M6)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a batch's media that a task turns into Python values at a time.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: str):
    """A batch as slices of about PIECE_BYTES of a binary column, a row at least: what a step makes of a batch lives for one slice only."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_BYTES)) + 1
    for begin, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
        yield batch.slice(begin, end - begin)


def _split(batches, column: str, most: int):
    for batch in (x for whole in batches for x in pieces(whole, column)):
        mp4, idx, jpeg = [], [], []
        for name, stream in zip(batch.column("mp4").to_pylist(), batch.column(column).to_pylist(), strict=True):
            at = 0
            for k in range(most):
                begin = (stream or b"").find(b"\xff\xd8", at)
                end = stream.find(b"\xff\xd9", begin + 2) if begin >= 0 else -1
                if end < 0:
                    break
                at = end + 2
                mp4.append(name)
                idx.append(k)
                jpeg.append(stream[begin:at])
        yield pa.RecordBatch.from_arrays([pa.array(mp4, pa.string()), pa.array(idx, pa.int32()), pa.array(jpeg, pa.binary())], ["mp4", "frame_idx", "jpeg"])


def split_frames(df: DataFrame, most: int = 10) -> DataFrame:
    """M1: (mp4, frame_idx, jpeg) from (mp4, stream): FFD8 to the next FFD9, at most ``most``; an unterminated frame ends it."""
    return df.select("mp4", "stream").mapInArrow(lambda batches: _split(batches, "stream", most), "mp4 string, frame_idx int, jpeg binary")


def frames_step(decode: Callable, most: int = 10) -> tuple[Callable, str]:
    """M1 and the decoding of M4 as a step for the tasks that read media: (mp4, frame_idx, pixels) of batches (mp4, content), as split_frames and decode_frames give them.

    Content, pictures and pixels are one Python worker's, a slice of PIECE_BYTES at a time.
    """

    def run(batches):
        for batch in _split(batches, "content", most):
            pixels = pa.array([decode(x) for x in batch.column("jpeg").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pixels], ["mp4", "frame_idx", "pixels"]).filter(pixels.is_valid())

    return run, "mp4 string, frame_idx int, pixels array<float>"


def chunk_audio(df: DataFrame, seconds: int = 30, rate: int = 16000, most_seconds: int | None = 180, skip_seconds: int = 0) -> DataFrame:
    """M2: (mp4, chunk_idx, offset, duration, pcm) windows of (mp4, audio_pcm), 2 bytes a sample; the last may be short, none for empty audio."""
    pcm = F.col("audio_pcm") if not skip_seconds else F.substring("audio_pcm", skip_seconds * rate * 2 + 1, 2**31 - 1)
    if most_seconds is not None:
        pcm = F.substring(pcm, 1, most_seconds * rate * 2)
    step = seconds * rate * 2
    rows = df.select("mp4", pcm.alias("pcm")).withColumn("n", F.octet_length("pcm")).filter("n > 0")
    cut = rows.select("mp4", "pcm", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("chunk_idx", "at")).withColumn("piece", F.substring("pcm", F.col("at") + 1, F.lit(step)))
    return cut.select("mp4", "chunk_idx", (F.col("at") / (2 * rate)).alias("offset"), (F.octet_length("piece") / (2 * rate)).alias("duration"), F.col("piece").alias("pcm"))


def _floats(pcm: bytes | None) -> np.ndarray:
    """Samples in [-1, 1) of little-endian 16-bit pcm; an odd last byte is dropped."""
    pcm = pcm or b""
    return np.frombuffer(pcm, "<i2", len(pcm) // 2).astype(np.float32) / np.float32(32768)


def pcm_to_float(df: DataFrame) -> DataFrame:
    """M3: adds samples array<float> in [-1, 1) from little-endian 16-bit pcm; an odd last byte is dropped."""

    def run(batches):
        for batch in (x for whole in batches for x in pieces(whole, "pcm")):
            rows = [_floats(b) for b in batch.column("pcm").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], [*batch.schema.names, "samples"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType()))]))


def hashed_text_encoder(dims: int = 64) -> Callable:
    """A deterministic stand-in for a text model: signed hashed bag of words, unit length, zeros for no words."""

    def make():
        import zlib

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            for row, text in zip(out, texts, strict=True):
                for word in str(text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    row[h % dims] += 1.0 if h >> 16 & 1 else -1.0
                n = np.linalg.norm(row)
                if n:
                    row /= n
            return out

        return predict

    return make


def encode(df: DataFrame, column: str, make_fn: Callable, batch: int = 32, out: str = "vector", shapes: list | None = None) -> DataFrame:
    """M4, M5: adds the model's vector of a column, in batches; the model loads once a worker."""
    f = predict_batch_udf(make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=shapes)
    return df.withColumn(out, f(F.coalesce(F.col(column), F.lit("")) if dict(df.dtypes)[column] == "string" else F.col(column)))


def decode_bytes(side: int = 8) -> Callable:
    """A stand-in for an image decoder: the first side * side bytes of a picture as its pixels, zeros behind its end; None without a picture."""

    def decode(jpeg: bytes | None) -> np.ndarray | None:
        if jpeg is None or len(jpeg) < 4 or jpeg[:2] != b"\xff\xd8":
            return None
        pixels, own = np.zeros(side * side, np.float32), np.frombuffer(jpeg[: side * side], np.uint8)
        pixels[: len(own)] = own
        return pixels

    return decode


def decode_frames(df: DataFrame, decode: Callable, column: str = "jpeg") -> DataFrame:
    """Adds pixels array<float> of each picture, flattened; frames that can't be decoded are left out."""

    @F.pandas_udf("array<float>")
    def pixels(pictures: pd.Series) -> pd.Series:
        return pictures.map(decode)

    return df.withColumn("pixels", pixels(column)).filter("pixels is not null")


def row_sums(side: int = 8) -> Callable:
    """A stand-in for an image model: the sum of each row of an image tensor (side, side)."""

    def make():
        def predict(images: np.ndarray) -> np.ndarray:
            return images.reshape(-1, side, side).sum(2)

        return predict

    return make


def encode_frames(df: DataFrame, make_fn: Callable, shape: list[int], batch: int = 64, out: str = "v") -> DataFrame:
    """M4: adds the image model's vector (array<double>) of pixels. Batches of ``batch`` tensors hold frames of whichever creators come together."""
    f = predict_batch_udf(make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[shape])
    return df.withColumn(out, f("pixels").cast("array<double>"))


#: What a speech model says of a chunk: a value a segment, in order.
SEGMENTS = T.StructType(
    [T.StructField("text", T.ArrayType(T.StringType())), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("no_speech_prob", "avg_logprob", "compression_ratio"))]
)


def counting_speech(parts: int = 3) -> Callable:
    """A stand-in for a speech model: each of ``parts`` equal parts of the samples is a segment that says the sum of its 16-bit values."""

    def make():
        def predict(samples: np.ndarray) -> list[dict]:
            sums = np.abs(np.rint(samples.reshape(len(samples), parts, -1).astype(np.float64).sum(2) * 32768)).astype(np.int64)
            return [
                {"text": np.array([f"n{x}" if x else "" for x in row], object), "no_speech_prob": row % 100 / 100, "avg_logprob": -(row % 20) / 10, "compression_ratio": 1 + row % 30 / 10}
                for row in sums
            ]

        return predict

    return make


def _of_pcm(make_fn: Callable, length: int) -> Callable:
    """A model of samples as one of pcm: a batch is converted (M3) and padded when the model takes it."""

    def make():
        model = make_fn()

        def predict(chunks: np.ndarray):
            samples = np.zeros((len(chunks), length), np.float32)
            for row, pcm in zip(samples, chunks, strict=True):
                own = _floats(pcm)
                row[: len(own)] = own
            return model(samples)

        return predict

    return make


def transcribe(df: DataFrame, make_fn: Callable, length: int, batch: int = 16) -> DataFrame:
    """M4 for audio: (mp4, chunk_idx, seg_idx, text, no_speech_prob, avg_logprob, compression_ratio) of chunks (mp4, chunk_idx, samples), or pcm for samples.

    Samples are padded to ``length`` and go to the model in batches of ``batch`` chunks of whichever files come together; its
    struct of arrays becomes a row a segment, as F7 and A2 take them. Longer chunks fail: cut them first (M2). pcm becomes
    samples (M3) in the model's own process, a batch at a time, so a task has one Python worker and no table of floats.
    """
    longer = F.raise_error(F.lit("a chunk is longer than the model takes"))
    if "samples" in df.columns:
        f = predict_batch_udf(make_fn, return_type=SEGMENTS, batch_size=batch, input_tensor_shapes=[[length]])
        missing = F.lit(length) - F.size("samples")
        given = F.when(missing >= 0, F.concat("samples", F.array_repeat(F.lit(0.0).cast("float"), missing))).otherwise(longer.cast("array<float>"))
    else:
        f = predict_batch_udf(_of_pcm(make_fn, length), return_type=SEGMENTS, batch_size=batch)
        given = F.when(F.octet_length("pcm") > 2 * length + 1, longer.cast("binary")).otherwise(F.col("pcm"))
    said = df.select("mp4", "chunk_idx", given.alias("given")).select("mp4", "chunk_idx", f("given").alias("said"))
    zipped = F.arrays_zip(*(F.col(f"said.{c}").alias(c) for c in SEGMENTS.names))
    return said.select("mp4", "chunk_idx", F.posexplode(zipped).alias("seg_idx", "s")).select("mp4", "chunk_idx", "seg_idx", *(F.col(f"s.{c}").alias(c) for c in SEGMENTS.names))


def extract_report(df: DataFrame) -> DataFrame:
    """M6: (mp4, has_audio, n_frames) of (mp4, audio_pcm, frames); a failed extraction is empty, never an error."""
    return df.select("mp4", (F.coalesce(F.octet_length("audio_pcm"), F.lit(0)) > 0).alias("has_audio"), F.coalesce(F.when(F.size("frames") >= 0, F.size("frames")), F.lit(0)).alias("n_frames"))
