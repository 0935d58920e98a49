"""Sound files as tables: a scan over RIFF chunks, and samples brought to 16 kHz mono.

A file is a row, as Spark's ``binaryFile`` source reads it; what is taken from it is row-local.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

RATE = 16_000
# Fixed values of the format: sample kinds.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the filter on each side, at the lower of two rates.
_CROSSINGS = 16
_FOUND = StructType([StructField("rate", IntegerType()), StructField("channels", IntegerType()), StructField("bits", IntegerType()), StructField("frames", LongType()), StructField("seconds", DoubleType())])


@dataclass(frozen=True)
class Sound:
    kind: int
    rate: int
    channels: int
    bits: int
    frames: int
    data: memoryview

    @property
    def seconds(self) -> float:
        return round(self.frames / self.rate, 3)


def chunks(data: memoryview) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and stated size of each chunk; a chunk of odd size is padded by a byte."""
    at = 12
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def sound(content: bytes | None) -> Sound | None:
    """What a WAV file holds; None where it is no such file, or of another coding than plain samples.

    The number of frames is that which the file states, even if it ends before.
    """
    data = memoryview(content or b"")
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"WAVE":
        return None
    form = None
    for name, at, size in chunks(data):
        if name == b"fmt " and size >= 16 and at + 16 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            if kind == EXTENSIBLE and size >= 26 and at + 26 <= len(data):
                kind = struct.unpack_from("<H", data, at + 24)[0]
            form = kind, rate, channels, bits
        elif name == b"data" and form is not None:
            kind, rate, channels, bits = form
            width = (bits + 7) // 8
            if kind not in (PCM, FLOAT) or not rate or not channels or width not in ((1, 2, 3, 4) if kind == PCM else (4, 8)):
                return None
            return Sound(kind, rate, channels, bits, size // (width * channels), data[at : at + size])
    return None


def mono(found: Sound) -> np.ndarray:
    """Samples from -1 to 1, the mean of all channels."""
    width = (found.bits + 7) // 8
    frames = len(found.data) // (width * found.channels)
    raw = np.frombuffer(found.data[: frames * width * found.channels], np.uint8).reshape(-1, width)
    if found.kind == FLOAT:
        samples = raw.copy().view("<f4" if width == 4 else "<f8").ravel().astype(np.float64)
    elif width == 1:
        samples = (raw.ravel().astype(np.float64) - 128) / 128
    else:
        # Samples stand in the upper bytes of 32 bits, so that all widths have their sign.
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        samples = wide.view("<i4").ravel() / 2.0**31
    return samples.reshape(frames, found.channels).mean(axis=1) if frames else np.zeros(0)


def resampled(samples: np.ndarray, rate: int, wanted: int = RATE) -> np.ndarray:
    """Samples at another rate by a windowed sinc, cut off below half the lower rate; each fraction of a step has its own filter."""
    if rate == wanted or not len(samples):
        return samples
    g = math.gcd(rate, wanted)
    step, phases = rate // g, wanted // g
    count = (len(samples) * wanted + rate // 2) // rate
    cut = min(1.0, wanted / rate)
    half = math.ceil(_CROSSINGS / cut)
    padded = np.concatenate([np.zeros(half), samples, np.zeros(half + step + 1)])
    windows = sliding_window_view(padded, 2 * half)
    out = np.zeros(count)
    for phase in range(min(phases, count)):
        whole, part = divmod(phase * step, phases)
        distance = np.arange(-half + 1, half + 1) - part / phases
        taps = np.sinc(cut * distance) * (0.5 + 0.5 * np.cos(np.pi * distance / half))
        own = out[phase::phases]
        own[:] = windows[whole + 1 :: step][: len(own)] @ (taps / taps.sum())
    return out


def as_pcm(samples: np.ndarray) -> bytes:
    """Samples from -1 to 1 as 16-bit little-endian numbers."""
    return np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes()


@F.pandas_udf(_FOUND)
def scan_wav(content: pd.Series) -> pd.DataFrame:
    """Rate, channels, bits, frames and seconds of WAV bytes; null where they cannot be read."""
    found = [sound(c) for c in content]
    rows = [(s.rate, s.channels, s.bits, s.frames, s.seconds) if s else (None,) * 5 for s in found]
    return pd.DataFrame(rows, columns=["rate", "channels", "bits", "frames", "seconds"]).astype({"rate": "Int32", "channels": "Int32", "bits": "Int32", "frames": "Int64", "seconds": "Float64"})


@F.pandas_udf(BinaryType())
def mono_16k(content: pd.Series) -> pd.Series:
    """WAV bytes as 16-bit samples of one channel at 16 kHz; null where they cannot be read."""
    return pd.Series([None if (s := sound(c)) is None else as_pcm(resampled(mono(s), s.rate)) for c in content], dtype=object)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under ``path``, one a row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def wav(samples: Column, rate: Column, channels: Column, bits: Column) -> Column:
    """WAV bytes of plain samples."""

    def number(n: Column, width: int) -> Column:
        digits = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))

    size, block = F.octet_length(samples), F.floor(channels * bits / 8)
    text = lambda t: F.lit(t).cast("binary")
    pad = F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(text(""))
    return F.concat(
        text("RIFF"), number(size + size % 2 + 36, 4), text("WAVEfmt "), number(F.lit(16), 4), number(F.lit(PCM), 2), number(channels, 2), number(rate, 4), number(rate * block, 4),
        number(block, 2), number(bits, 2), text("data"), number(size, 4), samples, pad,
    )
