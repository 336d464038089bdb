"""Features of audio signals with numpy alone, and their distributed extraction."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME, HOP, STEP, WINDOW_SECONDS = 2048, 512, 0.5, 45.0
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Krumhansl's key profiles, from the tonic.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
BANDS = {"low": (20, 250), "mid": (250, 4000), "high": (4000, 20000)}


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Samples (channels, n) between -1 and 1, and the rate, of PCM WAV bytes."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8) / 8388608
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).T, rate


def frames(x: np.ndarray) -> np.ndarray:
    x = np.pad(x, (FRAME // 2, FRAME // 2))
    n = 1 + max(0, len(x) - FRAME) // HOP
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, FRAME - len(x)))), FRAME)[:: HOP][:n]


def spectrum(x: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, bins)."""
    return np.abs(np.fft.rfft(frames(x) * np.hanning(FRAME + 1)[:-1], axis=1))


def densest_window(x: np.ndarray, rate: int, seconds: float = WINDOW_SECONDS) -> tuple[int, int]:
    """Bounds of the loudest `seconds`, in steps of half a second; the first of equals."""
    block = max(1, int(rate * STEP))
    k = int(seconds / STEP)
    e = np.array([float((x[i : i + block] ** 2).sum()) for i in range(0, len(x), block)])
    if len(e) <= k:
        return 0, len(x)
    total = np.convolve(e, np.ones(k), "valid")
    at = int(np.argmax(total)) * block
    return at, min(len(x), at + k * block)


def chroma(s: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the 12 pitch classes per frame."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    ok = (f >= 55) & (f <= 5000)
    pitch = np.round(12 * np.log2(np.maximum(f, 1e-9) / 440) + 69).astype(int) % 12
    out = np.zeros((len(s), 12))
    for c in range(12):
        out[:, c] = (s[:, ok & (pitch == c)] ** 2).sum(axis=1)
    return out / np.maximum(out.max(axis=1, keepdims=True), 1e-12)


def key_mode(profile: np.ndarray) -> tuple[str, str]:
    """The key whose profile, rotated to its tonic, correlates best with mean chroma."""
    if np.std(profile) < 1e-9:
        return "unknown", "unknown"
    best = max(((float(np.corrcoef(np.roll(profile, -r), t)[0, 1]), -r, m) for r in range(12) for m, t in (("major", MAJOR), ("minor", MINOR))))
    return NOTES[-best[1]], best[2]


def chords(ch: np.ndarray, per_block: int) -> list[tuple[int, str, float]]:
    """(root, quality, confidence) of runs of half-second blocks, by cosine with the 24 triads."""
    out: list[tuple[int, str, float]] = []
    for i in range(0, len(ch), max(1, per_block)):
        v = ch[i : i + per_block].mean(axis=0)
        n = np.linalg.norm(v)
        if n < 1e-9:
            continue
        conf, root, quality = max((float((v[r] + v[(r + third) % 12] + v[(r + 7) % 12]) / n / np.sqrt(3)), -r, q) for r in range(12) for q, third in (("maj", 4), ("min", 3)))
        if out and out[-1][:2] == (-root, quality):
            out[-1] = (-root, quality, max(out[-1][2], conf))
        else:
            out.append((-root, quality, conf))
    return out


def onsets(s: np.ndarray, rate: int) -> np.ndarray:
    """Times of local maxima of positive spectral change above its mean and deviation."""
    flux = np.concatenate(([0.0], np.maximum(0, np.diff(np.log1p(s), axis=0)).sum(axis=1)))
    top = (flux[1:-1] > flux[:-2]) & (flux[1:-1] >= flux[2:]) & (flux[1:-1] > flux.mean() + flux.std())
    return (np.flatnonzero(top) + 1) * HOP / rate


def tempo(s: np.ndarray, rate: int) -> float:
    """Beats a minute: the shortest strong lag of the autocorrelated onset strength."""
    flux = np.maximum(0, np.diff(np.log1p(s), axis=0)).sum(axis=1)
    flux = flux - flux.mean() if len(flux) else flux
    lags = np.arange(max(1, int(60 / 200 * rate / HOP)), int(60 / 50 * rate / HOP) + 1)
    lags = lags[lags < len(flux)]
    if not len(lags) or not flux.any():
        return 0.0
    ac = np.array([float((flux[k:] * flux[:-k]).sum()) for k in lags])
    strong = [i for i in range(len(ac)) if ac[i] >= 0.5 * ac.max() and ac[i] >= ac[max(0, i - 1)] and ac[i] >= ac[min(len(ac) - 1, i + 1)]]
    return float(60 * rate / HOP / lags[strong[0]]) if strong and ac.max() > 0 else 0.0


def grid_means(v: np.ndarray, rate: int, seconds: float) -> np.ndarray:
    """Means on the half-second grid, gaps linear, ends held."""
    n = max(1, int(np.ceil(seconds / STEP)))
    b = np.clip((np.arange(len(v)) * HOP / rate / STEP).astype(int), 0, n - 1)
    count = np.bincount(b, minlength=n)
    mean = np.bincount(b, v, minlength=n) / np.maximum(count, 1)
    good = np.flatnonzero(count)
    return np.interp(np.arange(n), good, mean[good])


def stereo(x: np.ndarray) -> dict:
    """Balance in dB, correlation and side share; unavailable for other than two channels."""
    if len(x) != 2 or x.shape[1] < FRAME:
        return {"status": "mono" if len(x) == 1 else "multichannel" if len(x) > 2 else "too_short"}
    l, r = x
    el, er = float((l**2).mean()), float((r**2).mean())
    if el + er < 1e-10:
        return {"status": "silent"}
    side = float((((l - r) / 2) ** 2).mean())
    mid = float((((l + r) / 2) ** 2).mean())
    corr = float(np.corrcoef(l, r)[0, 1]) if l.std() > 1e-9 and r.std() > 1e-9 else None
    return {"status": "ok", "balance_db": 10 * np.log10((er + 1e-12) / (el + 1e-12)), "correlation": corr, "side_ratio": side / max(side + mid, 1e-12)}


def boundaries(features: np.ndarray, distance: int = 8, prominence: float = 0.1, most: int = 12) -> list[int]:
    """Edges of sections: peaks of smoothed change between neighbouring rows; weakest interior ones go beyond `most` sections."""
    from lodestar.operators.series import find_peaks

    d = np.abs(np.diff(features, axis=0)).mean(axis=1) if len(features) > 1 else np.zeros(0)
    if len(d) < 3:
        return [0, len(features)]
    smooth = np.convolve(np.pad(d, 1, mode="edge"), np.ones(3) / 3, "valid")
    got = sorted(find_peaks(smooth, prominence * max(float(np.ptp(smooth)), 1e-9), distance), key=lambda p: (-smooth[p[0]], p[0]))[: most - 1]
    return [0, *sorted(p + 1 for p, _ in got), len(features)]


def repeat_groups(x: np.ndarray, threshold: float = 0.20) -> str:
    """Letters of average-linkage clusters of centred unit rows, cut at cosine distance 1 - threshold, by first appearance."""
    z = x - x.mean(axis=0)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    d = 1 - z @ z.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        gap, a, b = min((float(d[np.ix_(p, q)].mean()), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if gap > 1 - threshold:
            break
        groups[a] += groups.pop(b)
    label = {i: g for g, members in enumerate(sorted(groups, key=min)) for i in members}
    return "".join(chr(65 + label[i]) if label[i] < 26 else f"G{label[i]}" for i in range(len(x)))


def whole_track(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Loudness and chroma of every frame of the whole signal, some frames at a time."""
    view, rms, ch = frames(x), [], []
    for i in range(0, len(view), 1024):
        b = view[i : i + 1024]
        rms.append(np.sqrt((b**2).mean(axis=1)))
        ch.append(chroma(np.abs(np.fft.rfft(b * np.hanning(FRAME + 1)[:-1], axis=1)), rate))
    return np.concatenate(rms), np.concatenate(ch)


def sections(rms: np.ndarray, ch: np.ndarray, rate: int, seconds: float) -> tuple[list[float], str]:
    """Edges of sections in seconds, and the letters of their repeats, by chroma and loudness on the half-second grid."""
    grid = np.column_stack([grid_means(v, rate, seconds) for v in (*ch.T, rms / max(float(rms.max()), 1e-12))])
    at = boundaries(grid)
    means = np.stack([grid[i:j].mean(axis=0) for i, j in zip(at[:-1], at[1:], strict=True)])
    return [min(i * STEP, seconds) for i in at], repeat_groups(means)


def extract(content: bytes) -> dict:
    """Scalars, sequences and curves of one WAV file: loudness, dynamics and structure of the whole track, the rest of its loudest window."""
    x, rate = decode_wav(content)
    mono = x.mean(axis=0)
    lo, hi = densest_window(mono, rate)
    y = mono[lo:hi]
    s = spectrum(y)
    power = s**2
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    rms, whole = whole_track(mono, rate)
    edges, repeats = sections(rms, whole, rate, len(mono) / rate)
    total = np.maximum(power.sum(axis=1), 1e-12)
    mag = np.maximum(s.sum(axis=1), 1e-12)
    centroid = (s * f).sum(axis=1) / mag
    ch = chroma(s, rate)
    at = onsets(s, rate)
    gaps = np.diff(at)
    seq = chords(ch, round(STEP * rate / HOP))
    key, mode = key_mode(ch.mean(axis=0))
    p = np.percentile(rms, [5, 50, 95])
    seconds = len(y) / rate
    consistency = float(np.clip(1 - gaps.std() / (gaps.mean() + 1e-9), 0, 1)) if len(gaps) else 0.0
    density = len(at) / max(seconds, 1e-9)
    return {
        "seconds": len(mono) / rate, "rms_mean": float(rms.mean()), "rms_std": float(rms.std()), "dynamic_range": float(p[2] - p[0]), "crest": float(np.abs(mono).max(initial=0) / (rms.mean() + 1e-9)),
        "centroid": float(centroid.mean()), "bandwidth": float(np.sqrt((s * (f - centroid[:, None]) ** 2).sum(axis=1) / mag).mean()), "flatness": float((np.exp(np.log(power + 1e-12).mean(axis=1)) / (power.mean(axis=1) + 1e-12)).mean()),
        "zcr": float((np.diff(np.signbit(y)) != 0).mean()) if len(y) > 1 else 0.0, **{f"{b}_share": float((power[:, (f >= u) & (f < v)].sum(axis=1) / total).mean()) for b, (u, v) in BANDS.items()},
        "bpm": tempo(s, rate), "beat_consistency": consistency, "onset_density": density, "danceability": 0.6 * consistency + 0.4 * min(density / 10, 1.0),
        "key": key, "mode": mode, "chords": [f"{r}:{q}" for r, q, _ in seq], "energy_curve": grid_means(rms, rate, len(mono) / rate).tolist(), "sections": edges, "repeats": repeats, "stereo": stereo(x)["status"],
    }


SCHEMA = "path string, error string, " + ", ".join(f"{c} double" for c in ("seconds", "rms_mean", "rms_std", "dynamic_range", "crest", "centroid", "bandwidth", "flatness", "zcr", "low_share", "mid_share", "high_share", "bpm", "beat_consistency", "onset_density", "danceability")) + ", key string, mode string, chords array<string>, energy_curve array<double>, sections array<double>, repeats string, stereo string"


def extract_features(files: DataFrame) -> DataFrame:
    """Features of binary files (path, content); a file that can't be read gives its error and no features."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows.append({"path": path, "error": None, **extract(content)})
                except Exception as x:  # one bad file must not end the batch
                    rows.append({"path": path, "error": f"{type(x).__name__}: {x}"})
            yield pd.DataFrame([{c: r.get(c) for c in names} for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def synthesise(family: int, seed: int, seconds: float = 4.0, rate: int = 22050) -> bytes:
    """A WAV clip of one of four families of tones."""
    rng = np.random.default_rng([family, seed])
    t = np.arange(int(seconds * rate)) / rate
    base = (110, 220, 440, 880)[family % 4] * (1 + 0.01 * rng.standard_normal())
    y = sum(np.sin(2 * np.pi * base * k * t) / k for k in (1, 1.25, 1.5)) * (0.6 + 0.4 * np.sign(np.sin(2 * np.pi * (1 + family) * t)))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(y / 3, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()
