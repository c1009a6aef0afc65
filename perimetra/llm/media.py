"""Media columns: text bytes as 8-bit WAV samples, their short-time Fourier transform, and spectral-peak fingerprints.

A payload is stored without loss as mono 8-bit PCM by the wave module and read back by it. The spectrogram of the
stored samples gives peaks; each peak with some of those that follow makes a fingerprint of (bin, later bin, frames
between), kept with the frame at which it begins.

Edge cases: null counts as the empty text; every payload has 64 bytes at least, so every row has a file; texts of one
frame or of constant samples may have no peaks and give empty arrays; equal magnitudes are taken in order of frequency;
rows without a doc_id and repeated rows are kept; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from perimetra.llm.common import list_array, map_texts

RATE = 8000
FRAME = 256
HOP = 128
PEAKS_PER_FRAME = 3
FAN_OUT = 5
MAX_GAP = 15
#: Frames whose magnitudes are in memory at once.
BLOCK_FRAMES = 4096
_BINS = FRAME // 2 + 1
_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, filled with zeros to a positive multiple of 64, and their number before."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


class Frames:
    """Windows over the samples of several payloads, in order; `first` is the first frame of each (one more at the end)."""

    def __init__(self, payloads: list[bytes]) -> None:
        self.size = np.array([len(p) for p in payloads], np.int64)
        frames = np.maximum(1, -(-(self.size - FRAME) // HOP) + 1)
        self.first = np.concatenate(([0], np.cumsum(frames)))
        self.base = np.concatenate(([0], np.cumsum((frames - 1) * HOP + FRAME)))
        self.samples = np.full(int(self.base[-1]), 128, np.uint8)
        for p, at in zip(payloads, self.base, strict=False):
            self.samples[at : at + len(p)] = np.frombuffer(p, np.uint8)

    def magnitude(self, low: int, high: int) -> np.ndarray:
        """Magnitudes (frames x bins) of the frames in [low, high)."""
        if low >= high:
            return np.zeros((0, _BINS))
        at = np.arange(low, high)
        owner = np.searchsorted(self.first, at, "right") - 1
        start = self.base[owner] + (at - self.first[owner]) * HOP
        cut = np.lib.stride_tricks.sliding_window_view(self.samples, FRAME)[start].astype(np.float64) - 128
        return np.abs(np.fft.rfft(cut * _HANN, axis=1))


def spectrogram(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes (frames x bins) of all payloads in order, and the first frame of each (one more at the end)."""
    frames = Frames(payloads)
    return frames.magnitude(0, int(frames.first[-1])), frames.first


def all_peaks(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`peaks` of the payloads' spectrogram, and the first frame of each payload, from BLOCK_FRAMES frames at a time: a
    block sees one frame more on each side, which is all that a peak depends on."""
    frames = Frames(payloads)
    total, found, bins = int(frames.first[-1]), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, total, BLOCK_FRAMES):
        high = min(low + BLOCK_FRAMES, total)
        begin, end = max(low - 1, 0), min(high + 1, total)
        starts = frames.first[np.searchsorted(frames.first, begin) : np.searchsorted(frames.first, end)] - begin
        frame, at = peaks(frames.magnitude(begin, end), np.append(starts, end - begin))
        inside = (frame + begin >= low) & (frame + begin < high)
        found.append(frame[inside] + begin)
        bins.append(at[inside])
    return np.concatenate(found), np.concatenate(bins), frames.first


def peaks(magnitude: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the peaks: larger than their neighbours in frequency, not less than those in time, the largest few of a frame."""
    if not len(magnitude):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    magnitude = np.round(magnitude, 6)
    is_peak = np.zeros(magnitude.shape, np.bool_)
    inner = magnitude[:, 1:-1]
    is_peak[:, 1:-1] = (inner > magnitude[:, :-2]) & (inner >= magnitude[:, 2:]) & (inner > 1e-3)
    starts = np.zeros(len(magnitude), np.bool_)
    starts[first[:-1]] = True
    before = (magnitude[1:] >= magnitude[:-1]) | starts[1:, None]
    after = (magnitude[:-1] >= magnitude[1:]) | starts[1:, None]
    is_peak[1:] &= before
    is_peak[:-1] &= after
    frame, at = np.nonzero(is_peak)
    order = np.lexsort((at, -magnitude[frame, at], frame))
    frame, at = frame[order], at[order]
    begin = np.searchsorted(frame, frame)
    few = np.arange(len(frame)) - begin < PEAKS_PER_FRAME
    frame, at = frame[few], at[few]
    order = np.lexsort((at, frame))
    return frame[order], at[order]


def fingerprints(frame: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-coded pairs: (frame within the text << 32) | (bin << 20) | (later bin << 8) | frames between; text of each; sorted by text and code."""
    owner = np.searchsorted(first, frame, side="right") - 1
    codes, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, FAN_OUT + 1):
        gap = frame[k:] - frame[:-k]
        good = (owner[k:] == owner[:-k]) & (gap <= MAX_GAP)
        time = (frame[:-k] - first[owner[:-k]])[good]
        codes.append((time << 32) | (at[:-k][good] << 20) | (at[k:][good] << 8) | gap[good])
        owners.append(owner[:-k][good])
    code, who = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((code, who))
    return code[order], who[order], owner


def media_columns(docs: DataFrame, keep_codes: bool = True, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_peaks, feature; with keep_codes
    also fingerprints, with keep_media also media (the WAV file).

    The digests of the payload are those of the bytes read back from the file; feature is the number of fingerprints and
    the digest of all of them in order, as little-endian 64-bit numbers.
    """

    def work(texts: list[str | None]) -> dict[str, object]:
        made = [padded(t) for t in texts]
        media = [to_wav(p) for p, _ in made]
        back = [from_wav(m) for m in media]
        frame, at, first = all_peaks(back)
        codes, owner, peak_owner = fingerprints(frame, at, first)
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        return {
            "n_bytes": np.array([n for _, n in made], np.int64),
            "payload_bytes": np.array([len(b) for b in back], np.int64),
            "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            "tail_crc32": np.array([zlib.crc32(b[-64:]) for b in back], np.int64),
            "media_bytes": np.array([len(m) for m in media], np.int64),
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            "n_peaks": np.bincount(peak_owner, minlength=len(texts)).astype(np.int64),
            "feature": [f"{b - a}:{hashlib.sha256(codes[a:b].astype('<i8').tobytes()).hexdigest()}" for a, b in zip(begin[:-1], begin[1:], strict=True)],
            "fingerprints": list_array(codes, begin),
            "media": media,
        }

    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peaks long, feature string"
    return map_texts(docs, work, added + (", fingerprints array<long>" if keep_codes else "") + (", media binary" if keep_media else ""))
