"""Pixels of images as arrays: low-bit statistics, transparency, fingerprints, and the verdict on them.

A table of images has a column ``rgba``, the bytes of all pixels, four a pixel, and ``width``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = ("RGB", "BGR", "RBG", "GBR", "RGBA", "ARGB", "A")
_CHANNELS = {"R": 0, "G": 1, "B": 2, "A": 3}


def byte_entropy(raw: bytes) -> float:
    if not raw:
        return 0.0
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / len(raw)
    return float(-(p * np.log2(p)).sum())


def channel(values: np.ndarray) -> dict[str, float]:
    """Share of ones, entropy and compression of a channel's lowest bits, and how far pairs of even and odd values are from balance."""
    bits = values & 1
    raw = [np.packbits(bits, bitorder=o)[: len(bits) // 8].tobytes() for o in ("big", "little")]
    counts = np.bincount(values, minlength=256).reshape(128, 2)
    pairs = counts.sum(axis=1)
    balance = float((np.abs(counts[:, 0] - counts[:, 1])[pairs > 0] / pairs[pairs > 0]).mean()) if (pairs > 0).any() else 0.0
    return {"ones": float(bits.mean()) if len(bits) else 0.0, "entropy": max(map(byte_entropy, raw)), "compression": len(zlib.compress(raw[0], 6)) / max(1, len(raw[0])) if raw[0] else 0.0, "pair_balance": balance}


def streams(pixels: np.ndarray, least: int = 8) -> list[str]:
    """Readable runs in the packed lowest and second-lowest bits of common channel orders, each with its order and bit."""
    import re

    out = []
    for order in ORDERS:
        values = pixels[:, [_CHANNELS[c] for c in order]].reshape(-1)
        for bit in (0, 1):
            bits = (values >> bit) & 1
            for way in ("big", "little"):
                raw = np.packbits(bits, bitorder=way)[: len(bits) // 8].tobytes()
                out += [f"{order}-bit{bit}: {m.decode()}" for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, raw)]
    return list(dict.fromkeys(out))


def row_bias(red: np.ndarray, width: int) -> tuple[float, int]:
    """Variance of the rows' share of ones in the lowest red bit, and the rows that are 0.18 or more from the mean."""
    rows = len(red) // width if width > 1 else 0
    if rows < 2:
        return 0.0, 0
    share = (red[: rows * width] & 1).reshape(rows, width).mean(axis=1)
    return float(share.var()), int((np.abs(share - share.mean()) >= 0.18).sum())


def transparency(pixels: np.ndarray) -> dict[str, float]:
    """Shares of transparent pixels, of those with colour and with vivid colour, and of pixels that are not opaque."""
    clear = pixels[:, 3] <= 5
    colour = pixels[:, :3].max(axis=1).astype(int)
    spread = colour - pixels[:, :3].min(axis=1)
    n, t = max(1, len(pixels)), max(1, int(clear.sum()))
    vivid = (spread >= 24) | (colour >= 48)
    return {"transparent": float(clear.sum()) / n, "coloured": float((clear & (colour >= 12)).sum()) / t, "vivid": float((clear & vivid).sum()) / t, "translucent": float((pixels[:, 3] < 255).sum()) / n}


def luma(pixels: np.ndarray, width: int, columns: int, rows: int) -> np.ndarray:
    """Mean brightness of a grid of cells."""
    height = max(1, len(pixels) // max(1, width))
    grey = (pixels[: height * width, :3].astype(float) @ np.array([0.299, 0.587, 0.114])).reshape(height, width)
    ys, xs = np.arange(rows) * height // rows, np.arange(columns) * width // columns
    out = np.empty((rows, columns))
    for i in range(rows):
        for j in range(columns):
            y2, x2 = (ys[i + 1] if i + 1 < rows else height), (xs[j + 1] if j + 1 < columns else width)
            out[i, j] = grey[ys[i] : max(y2, ys[i] + 1), xs[j] : max(x2, xs[j] + 1)].mean()
    return out


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def difference_hash(pixels: np.ndarray, width: int) -> str:
    """64 bits: whether each of 8 by 8 cells is darker than the one to its left, from a grid of 9 by 8."""
    g = luma(pixels, width, 9, 8)
    return _hex(g[:, :-1] > g[:, 1:])


def average_hash(pixels: np.ndarray, width: int) -> str:
    """64 bits: whether each of 8 by 8 cells is at least as bright as their mean."""
    g = luma(pixels, width, 8, 8)
    return _hex(g >= g.mean())


PROFILE = "ones_r double, ones_g double, ones_b double, entropy_r double, entropy_g double, entropy_b double, compression_r double, pair_balance_r double, row_variance double, spike_rows int, transparent double, coloured double, vivid double, translucent double, strings array<string>, dhash string, ahash string"


def profile(images: DataFrame) -> DataFrame:
    """``images(key..., rgba, width)`` without the pixels and with what :data:`PROFILE` names; no pixels give zeros."""
    kept = [c for c in images.columns if c not in ("rgba", "width")]
    names = [x.split()[0] for x in PROFILE.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for raw, width in zip(batch.column("rgba").to_pylist(), batch.column("width").to_pylist()):
                px = np.frombuffer(raw or b"", np.uint8)
                px = px[: len(px) // 4 * 4].reshape(-1, 4)
                width = min(max(1, width or 1), max(1, len(px)))
                c = [channel(px[:, k]) for k in range(3)]
                variance, spikes = row_bias(px[:, 0], width)
                t = transparency(px) if len(px) else dict.fromkeys(("transparent", "coloured", "vivid", "translucent"), 0.0)
                marks = (difference_hash(px, width), average_hash(px, width)) if len(px) else ("", "")
                rows.append((*(x["ones"] for x in c), *(x["entropy"] for x in c), c[0]["compression"], c[0]["pair_balance"], variance, spikes, *t.values(), streams(px), *marks))
            kinds = [pa.float64()] * 9 + [pa.int32()] + [pa.float64()] * 4 + [pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*kept, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in images.dtypes if c in kept)
    return images.mapInArrow(run, f"{schema}, {PROFILE}")


def pixel_verdict(strings: Column, alpha: Column, random_channels: Column, biased: Column, balanced: Column) -> tuple[Column, Column]:
    """Score and label of an image's pixels: readable text weighs most, then residue under transparency, then statistics."""
    score = F.when(F.size(strings) >= 3, 62).when(F.size(strings) == 2, 42).when(F.size(strings) == 1, 35).otherwise(0)
    score = F.least(F.lit(100), score + F.when(alpha, 28).otherwise(0) + F.when(random_channels >= 2, 14).otherwise(0) + F.when(biased, 8).otherwise(0) + F.when(balanced, 8).otherwise(0))
    return score, F.when(score >= 70, "strong").when(score >= 40, "review").when(score >= 15, "weak").otherwise("clear")


def colour_ratios(px: np.ndarray) -> dict[str, float]:
    """Shares of pixels of colours that tell maps, screens and photos apart."""
    r, g, b = (px[:, k].astype(int) for k in range(3))
    mean = (r + g + b) / 3
    spread = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    # The limits of each colour.
    masks = {
        "light": mean >= 190, "dark": mean <= 45, "saturated": spread >= 60, "green": (g >= 105) & (g >= r + 8) & (g >= b - 10), "sky": (b >= 145) & (g >= 110) & (r <= 155) & (b >= r + 20),
        "water": (b >= 95) & (g >= 70) & (r <= 105) & (b >= r + 25), "red": (r >= 155) & (r >= g + 35) & (r >= b + 35), "yellow": (r >= 170) & (g >= 145) & (b <= 100), "orange": (r >= 210) & (g >= 85) & (g <= 175) & (b <= 90),
        "route_blue": (b >= 155) & (r <= 95) & (g >= 85) & (g <= 190), "road_grey": (mean >= 82) & (mean <= 205) & (spread <= 22), "purple": (r >= 120) & (b >= 145) & (g <= 120) & (np.abs(r - b) <= 90),
        "skin": (r > 95) & (g > 55) & (b > 35) & (r > g) & (g > b) & (r - b >= 35), "white": (mean >= 232) & (spread <= 24), "black": (mean <= 28) & (spread <= 24), "alpha": px[:, 3] < 255,
    }
    return {name: round(float(m.sum()) / max(1, len(px)), 4) for name, m in masks.items()}


def edge_density(px: np.ndarray, width: int, limit: int = 24) -> float:
    """Share of neighbours, to the right and below, whose brightness differs by more than a limit."""
    height = len(px) // max(1, width)
    grey = px[: height * width, :3].mean(axis=1).reshape(height, width)
    across, down = np.abs(np.diff(grey, axis=1)) > limit, np.abs(np.diff(grey, axis=0)) > limit
    return float(across.sum() + down.sum()) / max(1, across.size + down.size)


def map_scores(ratios: dict[str, float], edges: float) -> tuple[int, int]:
    """How much an image looks like a map, and how much like one with a route; both at most 95."""
    rules = (
        (ratios["light"] >= 0.40, 26), (ratios["white"] >= 0.28, 10), (ratios["water"] >= 0.035, 15), (ratios["green"] >= 0.035, 14), (ratios["yellow"] >= 0.010 or ratios["orange"] >= 0.008, 10),
        (ratios["red"] >= 0.001, 6), (ratios["dark"] >= 0.35 and edges >= 0.055, 16),
    )
    line = ratios["route_blue"] + ratios["purple"]
    return min(95, sum(n for holds, n in rules if holds)), min(95, (54 if line >= 0.003 else 0) + (20 if line >= 0.008 else 0) + (8 if ratios["red"] >= 0.001 else 0))


def component_boxes(mask: np.ndarray, least: int = 2, diagonal: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(left, top, right, bottom, area) of the connected parts of a mask, from top to bottom, by joining the runs of its rows."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask.astype(bool)):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
        here, k = [], 0
        for a, e in edges:
            label = len(parent)
            parent.append(label)
            boxes.append([a, y, e, y + 1, e - a])
            reach = 1 if diagonal else 0
            while k < len(above) and above[k][1] <= a - reach:
                k += 1
            j = k
            while j < len(above) and above[j][0] < e + reach:
                one, other = find(label), find(above[j][2])
                if one != other:
                    low, high = min(one, other), max(one, other)
                    parent[high] = low
                    x, z = boxes[low], boxes[high]
                    boxes[low] = [min(x[0], z[0]), min(x[1], z[1]), max(x[2], z[2]), max(x[3], z[3]), x[4] + z[4]]
                j += 1
            here.append((a, e, label))
        above = here
    return sorted((tuple(boxes[k]) for k in range(len(parent)) if find(k) == k and boxes[k][4] >= least), key=lambda x: (x[1], x[0]))


def image_vector(px: np.ndarray, width: int) -> np.ndarray:
    """42 numbers of unit length: eight bins of each channel, four by four cells of brightness, edges and spread."""
    if not len(px):
        return np.zeros(42)
    bins = [np.bincount(px[:, k] >> 5, minlength=8) / len(px) for k in range(3)]
    v = np.concatenate([*bins, luma(px, width, 4, 4).reshape(-1) / 255, [edge_density(px, width), float(px[:, :3].std()) / 128]])
    return v / max(1e-12, float(np.linalg.norm(v)))


COLOURS = ("light", "dark", "saturated", "green", "sky", "water", "red", "yellow", "orange", "route_blue", "road_grey", "purple", "skin", "white", "black", "alpha")


def colours(images: DataFrame) -> DataFrame:
    """``images(key..., rgba, width)`` without the pixels, with :data:`COLOURS`, edges, map_score, route_score and vector."""
    kept = [c for c in images.columns if c not in ("rgba", "width")]

    def run(batches):
        for batch in batches:
            rows = []
            for raw, width in zip(batch.column("rgba").to_pylist(), batch.column("width").to_pylist()):
                px = np.frombuffer(raw or b"", np.uint8)
                px = px[: len(px) // 4 * 4].reshape(-1, 4)
                width = min(max(1, width or 1), max(1, len(px)))
                ratios, edges = colour_ratios(px), edge_density(px, width) if len(px) else 0.0
                rows.append((*ratios.values(), edges, *map_scores(ratios, edges), image_vector(px, width).tolist()))
            kinds = [pa.float64()] * 17 + [pa.int32()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*kept, *COLOURS, "edges", "map_score", "route_score", "vector"])

    schema = ", ".join(f"`{c}` {t}" for c, t in images.dtypes if c in kept)
    return images.mapInArrow(run, f"{schema}, " + ", ".join(f"{c} double" for c in (*COLOURS, "edges")) + ", map_score int, route_score int, vector array<double>")
