"""Perceptual hashes of pixel matrices and fingerprints of spectra, as Arrow-batched functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a grey image; each cell of the new size averages what it covers."""
    rows = np.linspace(0, pixels.shape[0], height + 1)
    columns = np.linspace(0, pixels.shape[1], width + 1)

    def along(a: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        whole = np.minimum(edges.astype(int), len(a) - 1)
        at = sums[whole] + (edges - whole)[:, None] * a[whole]
        return np.diff(at, axis=0) / np.diff(edges)[:, None]

    return along(along(pixels.astype(float), rows).T, columns).T


def difference_hash(pixels: np.ndarray, size: int = 16, vertical: bool = False) -> str:
    """One bit for each neighbour that is brighter than the cell before it, as hex digits."""
    small = np.round(resized(pixels, size + vertical, size + (not vertical)), 6)
    bits = (np.diff(small, axis=0 if vertical else 1) > 0).ravel()
    return np.packbits(bits).tobytes().hex()


def average_hash(pixels: np.ndarray, size: int = 16) -> str:
    """One bit for each cell that is brighter than the mean of all, as hex digits."""
    small = resized(pixels, size, size)
    return np.packbits((np.round(small - small.mean(), 9) > 0).ravel()).tobytes().hex()


#: The hashes of a picture by name.
HASHES = {"dhash_h": difference_hash, "dhash_v": lambda p, size: difference_hash(p, size, True), "ahash": average_hash}


def _picture(values, width) -> np.ndarray | None:
    """The pixels as a matrix, or None if they make none."""
    if values is None or len(values) == 0 or not width or width != width or len(values) % int(width):
        return None
    pixels = np.asarray(values, dtype=float)
    return pixels.reshape(-1, int(width)) if np.isfinite(pixels).all() else None


def with_hashes(images: DataFrame, pixels: str = "pixels", width: str = "width", size: int = 16, names: tuple[str, ...] = tuple(HASHES)) -> DataFrame:
    """Add the hashes by name; a picture that can't be read (null, empty, ragged, not finite) has null ones."""

    def hasher(make):
        @F.pandas_udf("string")
        def of(values: pd.Series, widths: pd.Series) -> pd.Series:
            return pd.Series([None if (p := _picture(v, w)) is None else make(p, size) for v, w in zip(values, widths, strict=True)], dtype=object)

        return of

    return images.withColumns({name: hasher(HASHES[name])(pixels, width) for name in names})


def gallery_hashes(galleries: DataFrame, ident: str = "id", pictures: str = "pictures", size: int = 16) -> DataFrame:
    """id, place, hash, hash_type_id: a row for each picture (pixels, width) of a gallery that can be read; others are skipped."""
    each = galleries.select(ident, F.posexplode(pictures).alias("place", "_p")).select(ident, "place", "_p.pixels", "_p.width")
    hashed = with_hashes(each, size=size, names=("dhash_h",)).where(F.col("dhash_h").isNotNull())
    return hashed.select(ident, "place", F.col("dhash_h").alias("hash"), F.lit(1).alias("hash_type_id"))


def power_spectrum(samples: np.ndarray, rate: int, window: int) -> np.ndarray:
    """Power densities by (frequency, time) over windows that overlap by half, one-sided, scaled by rate and window."""
    samples = np.concatenate([samples, np.zeros(max(0, window - len(samples)))])
    shape = np.hanning(window)
    frames = np.lib.stride_tricks.sliding_window_view(samples, window)[:: window // 2] * shape
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / (rate * (shape**2).sum())
    power[:, 1 : -1 if window % 2 == 0 else None] *= 2
    return power.T


def diamond_maxima(level: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within ``reach`` steps along the axes, by as many steps of a cross."""
    for _ in range(reach):
        wide = level.copy()
        np.maximum(wide[1:], level[:-1], out=wide[1:])
        np.maximum(wide[:-1], level[1:], out=wide[:-1])
        np.maximum(wide[:, 1:], level[:, :-1], out=wide[:, 1:])
        np.maximum(wide[:, :-1], level[:, 1:], out=wide[:, :-1])
        level = wide
    return level


def spectral_peaks(samples: np.ndarray, rate: int = 44_100, window: int = 4096, reach: int = 20, least: float = 10.0) -> list[tuple[int, int]]:
    """(time, frequency) of the spectrum's local maxima above ``least`` decibels, in that order; no power counts as 0."""
    if not len(samples):
        return []
    with np.errstate(divide="ignore"):
        level = 10 * np.log10(power_spectrum(samples, rate, window))
    level[np.isneginf(level)] = 0
    frequency, time = np.nonzero((level == diamond_maxima(level, reach)) & (level > least))
    return sorted(zip(time.tolist(), frequency.tolist(), strict=True))


def fingerprints_of(samples: np.ndarray, rate: int, fan: int, apart: int) -> set[tuple[str, int]]:
    """(hash, time) of each peak paired with each of the next ``fan`` that are at most ``apart`` later."""
    peaks = spectral_peaks(samples, rate)
    return {
        (hashlib.sha1(f"{f1}|{f2}|{t2 - t1}".encode()).hexdigest()[:20], t1)
        for k, (t1, f1) in enumerate(peaks) for t2, f2 in peaks[k + 1 : k + 1 + fan] if t2 - t1 <= apart
    }


def audio_fingerprints(clips: DataFrame, ident: str = "id", channels: str = "channels", rate: int = 44_100, fan: int = 14, apart: int = 200) -> DataFrame:
    """One row (id, ``hash``, ``offset``) for each fingerprint that any channel of a clip has; null clips and channels add none."""

    def of(batches):
        for pdf in batches:
            out = []
            for ident_, clip in zip(pdf[ident], pdf[channels], strict=True):
                found = set()
                for channel in clip if clip is not None else []:
                    if channel is not None:
                        found |= fingerprints_of(np.asarray(channel, dtype=float), rate, fan, apart)
                out += [(ident_, h, t) for h, t in sorted(found)]
            yield pd.DataFrame(out, columns=[ident, "hash", "offset"])

    return clips.select(ident, channels).mapInPandas(of, f"{ident} {clips.schema[ident].dataType.simpleString()}, hash string, offset bigint")
