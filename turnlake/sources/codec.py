"""Audio files and arrays as rows: decoding is what no built-in function does, so it runs in Arrow batches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StructType, VariantType

ENERGY_BLOCK = 1920


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in [-1, 1]) of a 16-bit PCM file; streamed files with open lengths are read to their end."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate, channels, bits = 12, 0, 1, 16
    while at + 8 <= len(data):
        name, size = data[at:at + 4], int.from_bytes(data[at + 4:at + 8], "little")
        body = data[at + 8:at + 8 + size]
        if name == b"fmt ":
            channels, rate, bits = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little"), int.from_bytes(body[14:16], "little")
        elif name == b"data":
            if bits != 16:
                raise ValueError("only 16-bit PCM is read")
            whole = len(body) // (2 * channels) * 2 * channels
            return rate, np.frombuffer(body[:whole], "<i2").reshape(-1, channels).mean(1).astype(np.float32) / np.float32(32768)
        at += 8 + size + size % 2
    raise ValueError("no data in the file")


def block_energy(samples: np.ndarray, block: int = ENERGY_BLOCK) -> np.ndarray:
    """Log root mean square of each block; the last one is filled up with 0."""
    full = np.zeros(-(-len(samples) // block) * block, np.float64)
    full[:len(samples)] = samples
    return np.log(np.sqrt((full.reshape(-1, block) ** 2).mean(1) + 1e-9) + 1e-6)


def pitch(samples: np.ndarray, rate: int, low: float = 70.0, high: float = 400.0, least: float = 0.3) -> float:
    """The lag of the highest autocorrelation in the voice's range, as a frequency; 0 where it is weak."""
    x = samples - samples.mean()
    power = float((x * x).sum())
    first, last = int(rate / high), min(int(rate / low), len(x) - 1)
    if power <= 0 or last <= first:
        return 0.0
    spectrum = np.fft.rfft(x, 2 * len(x))
    correlation = np.fft.irfft(spectrum * np.conj(spectrum))[:len(x)]
    lag = first + int(np.argmax(correlation[first:last + 1]))
    return rate / lag if correlation[lag] / power > least else 0.0


def pitch_track(samples: np.ndarray, rate: int, hop: int, low: float = 70.0, high: float = 400.0, least: float = 0.3, rows: int = 4096) -> np.ndarray:
    """A pitch for each hop of the samples, the last filled up by nothing: the lag in the voice's range with the highest
    autocorrelation, as a frequency; 0 where that is weak, the hop too quiet or too short. Hops are transformed in blocks."""
    n = -(-len(samples) // hop)
    out = np.zeros(n)
    first, last = int(rate / high), int(rate / low)
    whole = len(samples) // hop

    def lags_of(x: np.ndarray) -> np.ndarray:
        loud = np.sqrt((x * x).mean(1) + 1e-9) >= 1e-3
        x = x - x.mean(1, keepdims=True)
        spectrum = np.fft.rfft(x, 2 * x.shape[1])
        correlation = np.fft.irfft(spectrum * np.conj(spectrum))[:, :x.shape[1]]
        lag = first + correlation[:, first:last].argmax(1)
        power = correlation[:, 0]
        strong = correlation[np.arange(len(x)), lag] > least * power
        return np.where(loud & (power > 0) & strong & (lag > 0), rate / np.maximum(lag, 1), 0.0)

    if first < last:
        if hop >= last:
            for i in range(0, whole, rows):
                block = np.asarray(samples[i * hop:min(i + rows, whole) * hop], np.float64).reshape(-1, hop)
                out[i:i + len(block)] = lags_of(block)
        if len(samples) - whole * hop >= last:
            out[whole] = lags_of(np.asarray(samples[whole * hop:], np.float64)[None])[0]
    return out


def audio_parts(value: Column, kind: DataType, rate: int) -> tuple[Column, Column, Column]:
    """(bytes, samples, rate) of an audio value of any shape: a file's bytes, a list of samples, a struct that holds either
    (bytes, or array with sampling_rate), or a variant of these. What isn't there is null."""
    none, samples, at = F.lit(None).cast("binary"), F.lit(None).cast("array<double>"), F.lit(None).cast("int")
    if isinstance(kind, BinaryType):
        return value, samples, at
    if isinstance(kind, ArrayType):
        return none, value.cast("array<double>"), F.lit(rate)
    if isinstance(kind, StructType):
        have = set(kind.names)
        listed = value["array"].cast("array<double>") if {"array", "sampling_rate"} <= have else samples
        return value["bytes"].cast("binary") if "bytes" in have else none, listed, value["sampling_rate"].cast("int") if "sampling_rate" in have else at
    if isinstance(kind, VariantType):
        get = F.try_variant_get
        own = get(value, "$", "array<double>")
        held = F.when(get(value, "$.sampling_rate", "int").isNotNull(), get(value, "$.array", "array<double>"))
        return F.coalesce(get(value, "$.bytes", "binary"), get(value, "$", "binary")), F.coalesce(own, held), F.when(own.isNotNull(), F.lit(rate)).otherwise(get(value, "$.sampling_rate", "int"))
    return none, samples, at


def _pitched(hop: int, low: float, high: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks, energies, rates = [], [], []
            for data, samples, rate in zip(*(batch.column(k) for k in (1, 2, 3))):
                try:
                    if samples.is_valid and rate.is_valid:
                        own, hz = samples.values.to_numpy(zero_copy_only=False), rate.as_py()
                    elif data.is_valid:
                        hz, own = decode_wav(data.as_py())
                    else:
                        raise ValueError("no audio")
                    if hz <= 0 or not np.isfinite(own).all():
                        raise ValueError("no rate, or samples that are no numbers")
                    tracks.append(pitch_track(own, hz, hop, low, high)), energies.append(block_energy(own, hop)), rates.append(hz)
                except (ValueError, ZeroDivisionError, TypeError):
                    tracks.append(None), energies.append(None), rates.append(None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(rates, pa.int32()), pa.array(tracks, pa.list_(pa.float64())), pa.array(energies, pa.list_(pa.float64()))], ["id", "rate", "f0", "energy"])

    return run


def pitch_tracks(clips: DataFrame, id_col: str, audio_col: str, hop: int = ENERGY_BLOCK, rate: int = 24_000, low: float = 70.0, high: float = 400.0) -> DataFrame:
    """(id_col, rate, f0, energy): a pitch and an energy a frame over whole clips, from audio values of any shape; nulls where
    a value is no audio. rate is that of bare lists of samples."""
    data, samples, hz = audio_parts(F.col(audio_col), clips.schema[audio_col].dataType, rate)
    rows = clips.select(F.col(id_col).cast("string").alias("id"), data.alias("data"), samples.alias("samples"), hz.cast("int").alias("rate"))
    return rows.mapInArrow(_pitched(hop, low, high), "id string, rate int, f0 array<double>, energy array<double>").withColumnRenamed("id", id_col)


def _wav_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rates, seconds, energies, errors = [], [], [], []
        for data in batch.column("content").to_pylist():
            try:
                rate, samples = decode_wav(data)
                rates.append(rate)
                seconds.append(len(samples) / rate)
                energies.append(block_energy(samples).tolist())
                errors.append(None)
            except (ValueError, ZeroDivisionError) as e:
                rates.append(None), seconds.append(None), energies.append(None), errors.append(str(e))
        yield pa.RecordBatch.from_arrays([
            batch.column("path"), pa.array(rates, pa.int32()), pa.array(seconds, pa.float64()), pa.array(energies, pa.list_(pa.float64())), pa.array(errors, pa.string())],
            ["path", "sample_rate", "duration_s", "energy", "error"])


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, duration_s, energy, error): a broken file is a row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInArrow(_wav_rows, "path string, sample_rate int, duration_s double, energy array<double>, error string")


def _npz_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, errors = [], []
        for data in batch.column("content").to_pylist():
            try:
                held = np.load(io.BytesIO(data))
                found.append({k: held[k].tolist() for k in ("cb0", "energy", "f0")})
                errors.append(None)
            except (ValueError, KeyError, OSError, zipfile.BadZipFile) as e:
                found.append({"cb0": None, "energy": None, "f0": None})
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([
            batch.column("path"), pa.array([f["cb0"] for f in found], pa.list_(pa.int64())),
            *[pa.array([f[k] for f in found], pa.list_(pa.float32())) for k in ("energy", "f0")], pa.array(errors, pa.string())], ["path", "cb0", "energy", "f0", "error"])


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(path, cb0, energy, f0, error) of encoded clips; a broken file is a row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(_npz_rows, "path string, cb0 array<bigint>, energy array<float>, f0 array<float>, error string")


def inventory(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """(name, bytes): the listing alone; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in columns), None)
