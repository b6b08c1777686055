"""Zero-phase filters, for signals of any length.

Only the textbook pieces are used: an analogue prototype, the band transform,
the bilinear transform, second-order sections with steady-state starts, and odd
reflection at both ends. The recursion goes by blocks: what a block gives is linear in
its samples and in the few numbers that the sections remember, so a batch of signals is a few
matrix products, and memory is in proportion to the samples. The same map as one matrix, for short signals, is what tests and SQL go by.
"""

from __future__ import annotations

import numpy as np


def butterworth_bandpass(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections (rows b0 b1 b2 1 a1 a2), gain 1/sqrt(2) at both edges."""
    warped = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    poles = np.concatenate([half + root, half - root])
    digital = (2 * fs + poles) / (2 * fs - poles)
    upper = digital[digital.imag > 0]
    upper = upper[np.argsort(np.abs(upper))]
    middle = np.exp(2j * np.arctan(centre / (2 * fs)))
    sections = []
    for p in upper:
        a1, a2 = -2 * p.real, abs(p) ** 2
        gain = abs(middle**2 - 1) / abs(middle**2 + a1 * middle + a2)
        sections.append([1 / gain, 0, -1 / gain, 1, a1, a2])
    return np.array(sections)


def notch(freq: float, quality: float, fs: float) -> np.ndarray:
    """One second-order section that takes out a frequency; quality is frequency over bandwidth."""
    w = 2 * np.pi * freq / fs
    b = 1 / (1 + np.tan(w / quality / 2))
    return np.array([[b, -2 * b * np.cos(w), b, 1, -2 * b * np.cos(w), 2 * b - 1]])


def run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filters along the first axis, each section starting as if its first value had always been there."""
    for b0, b1, b2, _, a1, a2 in sections:
        rest = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2 = (rest - b0) * x[0], (b2 - a2 * rest) * x[0]
        out = np.empty_like(x)
        for i, v in enumerate(x):
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out[i] = y
        x = out
    return x


def steps(sections: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters along the first axis from the memory z (two rows for each section): what comes out, and the memory after it."""
    z = z.copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        out = np.empty_like(x)
        z1, z2 = z[2 * i], z[2 * i + 1]
        for t, v in enumerate(x):
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out[t] = y
        z[2 * i], z[2 * i + 1] = z1, z2
        x = out
    return x, z


class Recursion:
    """Second-order sections by blocks of samples: out = direct x + free z, and the next memory z = drive x + carry z."""

    def __init__(self, sections: np.ndarray, block: int = 128) -> None:
        self.block, size = block, 2 * len(sections)
        self.direct, self.drive = steps(sections, np.eye(block), np.zeros((size, block)))
        self.free, self.carry = steps(sections, np.zeros((block, size)), np.eye(size))
        level, start = 1.0, []
        for b0, b1, b2, _, a1, a2 in sections:  # the memory as if a first value of 1 had always been there
            rest = (b0 + b1 + b2) / (1 + a1 + a2)
            start += [(rest - b0) * level, (b2 - a2 * rest) * level]
            level *= rest
        self.start = np.array(start)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Filters each row, from the start's memory of its first value."""
        rows, n = x.shape
        blocks = -(-n // self.block)
        parts = np.zeros((rows, blocks * self.block))
        parts[:, :n] = x
        parts = parts.reshape(rows, blocks, self.block)
        driven = parts @ self.drive.T
        memory = np.empty_like(driven)
        z = x[:, :1] * self.start
        for i in range(blocks):
            memory[:, i] = z
            z = z @ self.carry.T + driven[:, i]
        out = parts @ self.direct.T
        out += memory @ self.free.T
        return out.reshape(rows, -1)[:, :n]

    def zero_phase(self, x: np.ndarray, pad: int = 27) -> np.ndarray:
        """Each row forward and backward, with `pad` samples of odd reflection."""
        if x.shape[1] <= pad:
            raise ValueError(f"a signal of {x.shape[1]} samples is too short: more than {pad} are needed")
        longer = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
        return self(self(longer)[:, ::-1])[:, ::-1][:, pad:-pad]


def zero_phase(sections: np.ndarray, x: np.ndarray, pad: int = 27) -> np.ndarray:
    """Forward and backward along the first axis, with `pad` samples of odd reflection."""
    if len(x) <= pad:
        raise ValueError(f"a signal of {len(x)} samples is too short: more than {pad} are needed")
    longer = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    back = run_sections(sections, run_sections(sections, longer)[::-1])[::-1]
    return back[pad:-pad]


def matrix(sections: np.ndarray, samples: int, pad: int = 27) -> np.ndarray:
    """M with M @ signal the filtered signal."""
    return zero_phase(sections, np.eye(samples), pad)


def bandpass_matrix(samples: int, fs: float = 250.0, low: float = 1.0, high: float = 40.0, order: int = 4) -> np.ndarray:
    return matrix(butterworth_bandpass(order, low, high, fs), samples)


def notch_matrix(samples: int, fs: float = 250.0, freq: float = 60.0, quality: float = 30.0) -> np.ndarray:
    return matrix(notch(freq, quality, fs), samples, pad=9)
