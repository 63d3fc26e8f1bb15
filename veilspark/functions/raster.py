"""Array kernels for images; Spark decides which images a task gets.

An image is an array (height, width, 4) of unsigned bytes.  A box is a tuple of
whole numbers (x, y, width, height) inside the image.  Kernels named by what they do to
an image or a part also take stacks of equal size (n, height, width, ...), so that a
batch of small images costs a few array operations, not as many for each image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from veilspark import fixed

LUMA = np.array([0.299, 0.587, 0.114])


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4).copy()


def stacks(sizes: np.ndarray, data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``data`` of the images of one size, and those images as one array; ``sizes`` is (n, 2), width and height."""
    for (width, height), at in equal_rows(sizes):
        yield at, np.frombuffer(b"".join([data[i] for i in at]), dtype=np.uint8).reshape(len(at), height, width, 4)


def equal_rows(table: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each distinct row of a table of whole numbers, and the places where it stands."""
    if len(table):
        kinds, which = np.unique(table, axis=0, return_inverse=True)
        order = np.argsort(which.reshape(-1), kind="stable")
        ends = np.cumsum(np.bincount(which.reshape(-1), minlength=len(kinds)))
        for kind, at in zip(kinds.tolist(), np.split(order, ends[:-1]), strict=True):
            yield tuple(kind), at


def skin(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    cb = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b
    cr = 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    in_cb = (cb >= fixed.SKIN_CB[0]) & (cb <= fixed.SKIN_CB[1])
    in_cr = (cr >= fixed.SKIN_CR[0]) & (cr <= fixed.SKIN_CR[1])
    return in_cb & in_cr & (r + g + b > fixed.SKIN_MIN_SUM)


def cell_mask(image: np.ndarray, cell: int = fixed.CELL_PX) -> np.ndarray:
    """Skin test at the centre pixel of each cell."""
    h, w = image.shape[-3:-1]
    ys = np.minimum(h - 1, np.arange(max(1, -(-h // cell))) * cell + cell // 2)
    xs = np.minimum(w - 1, np.arange(max(1, -(-w // cell))) * cell + cell // 2)
    return skin(image.take(ys, axis=-3).take(xs, axis=-2))


def padded(mask: np.ndarray) -> np.ndarray:
    """One cell more on each side."""
    return np.pad(mask, [(0, 0)] * (mask.ndim - 2) + [(1, 1), (1, 1)])


def dilate(mask: np.ndarray) -> np.ndarray:
    wide = padded(mask)
    rows = wide[..., :-2, :] | wide[..., 1:-1, :] | wide[..., 2:, :]
    return rows[..., :-2] | rows[..., 1:-1] | rows[..., 2:]


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least one that it is joined to over the edges a - b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while len(a) and (root[root] != root).any():
            root = root[root]
    return root


def labelled_stack(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-connected parts of each mask of a stack (n, height, width).

    parts: rows (mask, first x, first y, min x, min y, max x, max y, area), by mask and first cell; cells: rows (mask, y, x)
    of all set cells; part: the row of ``parts`` that each cell belongs to.
    """
    starts = masks.copy()
    starts[..., 1:] &= ~masks[..., :-1]
    run = np.cumsum(starts.reshape(-1)).reshape(masks.shape) - 1  # horizontal runs, numbered in reading order
    touch = masks[:, :-1] & masks[:, 1:]
    root = _lowest(int(starts.sum()), run[:, :-1][touch], run[:, 1:][touch])
    cells = np.argwhere(masks)
    firsts, part = np.unique(root[run[masks]], return_inverse=True)
    first = np.argwhere(starts)[firsts]
    parts = np.empty((len(firsts), 8), dtype=np.int64)
    parts[:, 0], parts[:, 1], parts[:, 2] = first[:, 0], first[:, 2], first[:, 1]
    parts[:, 3:5], parts[:, 5:7] = np.iinfo(np.int64).max, -1
    for column, of in ((3, 2), (4, 1)):
        np.minimum.at(parts[:, column], part, cells[:, of])
        np.maximum.at(parts[:, column + 2], part, cells[:, of])
    parts[:, 7] = np.bincount(part, minlength=len(firsts))
    return parts, cells, part


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(min x, min y, max x, max y, area) of each 4-connected part, by first cell."""
    return [tuple(c) for c in labelled_stack(mask[None])[0][:, 3:].tolist()]


def face_stack(
    images: np.ndarray, cell: int = fixed.CELL_PX, min_area_ratio: float = 0.0006, min_fill: float = 0.3
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the image in the stack, (x, y, width, height) and confidence of face-like skin regions, before deduplication."""
    masks = dilate(cell_mask(images, cell))
    least = max(24, int(masks[0].size * min_area_ratio)) if len(masks) else 24
    parts = labelled_stack(masks)[0]
    (x0, y0, x1, y1), area = parts[:, 3:7].T, parts[:, 7]
    w, h = x1 - x0 + 1, y1 - y0 + 1
    fill = area / (w * h)
    good = (area >= least) & (w / h >= 0.45) & (w / h <= 2.1) & (fill >= min_fill)
    return parts[good, 0], np.stack([x0, y0, w, h], axis=1)[good] * cell, np.minimum(0.92, 0.5 + fill[good] * 0.42)


def face_boxes(
    image: np.ndarray, cell: int = fixed.CELL_PX, min_area_ratio: float = 0.0006, min_fill: float = 0.3
) -> list[tuple[int, int, int, int, float]]:
    """(x, y, width, height, confidence) of face-like skin regions, before deduplication."""
    _, boxes, confidence = face_stack(image[None], cell, min_area_ratio, min_fill)
    return [(*b, c) for b, c in zip(boxes.tolist(), confidence.tolist(), strict=True)]


def parts(images: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, w: int, h: int) -> tuple[np.ndarray, ...]:
    """Index of a part of ``w`` x ``h`` pixels in each image ``at`` of a stack, whose corners are ``x`` and ``y``."""
    h, w = min(h, images.shape[1]), min(w, images.shape[2])
    return at[:, None, None], (y[:, None] + np.arange(h))[:, :, None], (x[:, None] + np.arange(w))[:, None, :]


def _pixelated(colour: np.ndarray, block: int) -> np.ndarray:
    h, w = colour.shape[-3:-1]
    ys, xs = np.arange(0, h, block), np.arange(0, w, block)
    sums = np.add.reduceat(np.add.reduceat(colour.astype(np.int64), ys, axis=-3), xs, axis=-2)
    rows, cols = np.minimum(block, h - ys), np.minimum(block, w - xs)
    mean = np.floor(sums / (rows[:, None] * cols[None, :])[..., None] + 0.5).astype(np.uint8)
    return np.repeat(np.repeat(mean, rows, axis=-3), cols, axis=-2)


def _sliding_mean(values: np.ndarray, radius: int, axis: int) -> np.ndarray:
    n, taps = values.shape[axis], 2 * radius + 1
    wide = values.astype(np.float64).take(np.clip(np.arange(-radius, n + radius), 0, n - 1), axis=axis)
    total = np.zeros(values.shape)
    for k in range(taps):
        total += wide[..., k:k + n, :, :] if axis == -3 else wide[..., k:k + n, :]
    return total / taps


def _blurred(colour: np.ndarray, radius: int, passes: int = 2) -> np.ndarray:
    for _ in range(passes):
        across = _sliding_mean(colour, radius, -2).astype(np.float32)
        colour = np.floor(_sliding_mean(across, radius, -3) + 0.5).astype(np.uint8)
    return colour


def destroyed(part: np.ndarray, mode: str, block: int | None, smear: bool = True) -> np.ndarray:
    """The part, or each of a stack, black and opaque, or pixelated: each block its rounded mean, then a separable
    mean with clamped edges inside the part."""
    out = np.zeros_like(part)
    out[..., 3] = 255
    if mode != "blackout":
        block = int(block)
        colour = _pixelated(part[..., :3], block)
        out[..., :3] = _blurred(colour, max(1, int(block / 8 + 0.5))) if smear else colour
    return out


def _inside(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = box
    return image[y:y + h, x:x + w]


def blackout(image: np.ndarray, box: tuple[int, int, int, int]) -> None:
    _inside(image, box)[:] = (0, 0, 0, 255)


def pixelate(image: np.ndarray, box: tuple[int, int, int, int], block: int) -> None:
    """Each block becomes its rounded mean."""
    part = _inside(image, box)
    part[..., :3], part[..., 3] = _pixelated(part[..., :3], block), 255


def blur(image: np.ndarray, box: tuple[int, int, int, int], radius: int, passes: int = 2) -> None:
    """Separable mean with clamped edges inside the box."""
    part = _inside(image, box)
    part[..., :3], part[..., 3] = _blurred(part[..., :3], radius, passes), 255


def destroy(image: np.ndarray, box: tuple[int, int, int, int], mode: str, block: int | None, smear: bool = True) -> None:
    part = _inside(image, box)
    part[:] = destroyed(part, mode, block, smear)


def all_destroyed(part: np.ndarray, mode: str, block: int | None, dark: float = fixed.DARK_MEAN,
                  flat: float = fixed.FLAT_VARIANCE, block_flat: float = fixed.BLOCK_VARIANCE) -> np.ndarray:
    """For each part of a stack. Blackout: mean below ``dark`` and variance below ``flat`` on a sample grid.  Blur: every
    pixelation block of a variance up to ``block_flat`` inside its smeared rim; a region without a sampled block fails."""
    h, w = part.shape[1:3]
    luma = part[..., :3] @ LUMA
    if mode == "blackout":
        step = max(1, min(w, h) // 8)
        sample = luma[:, ::step, ::step]
        return (sample.mean(axis=(1, 2)) < dark) & (sample.var(axis=(1, 2)) < flat)
    block = int(block or max(6, int(min(w, h) / 6 + 0.5)))
    rim = min(6, max(1, int(block / 4 + 0.5)))
    step = max(1, (block - rim) // 3)
    ok, checked = np.ones(len(part), dtype=bool), 0
    for by in range(0, h - rim, block):
        rows = luma[:, by + rim:by + block - rim:step]
        for bx in range(0, w - rim, block):
            sample = rows[:, :, bx + rim:bx + block - rim:step]
            if sample[0].size < 3:
                continue
            checked += 1
            ok &= ~(sample.var(axis=(1, 2)) > block_flat)
    return ok & (checked > 0)


def is_destroyed(image: np.ndarray, box: tuple[int, int, int, int], mode: str, block: int | None, dark: float = fixed.DARK_MEAN,
                 flat: float = fixed.FLAT_VARIANCE, block_flat: float = fixed.BLOCK_VARIANCE) -> bool:
    """``all_destroyed`` of one box of an image."""
    return bool(all_destroyed(_inside(image, box)[None], mode, block, dark, flat, block_flat)[0])


def _block_means(part: np.ndarray, grid: int) -> np.ndarray:
    h, w = part.shape[-3:-1]
    cut_y, cut_x = (sorted({-(-i * n // grid) for i in range(grid)} - {n}) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(part[..., :3].astype(np.int64), cut_y, axis=-3), cut_x, axis=-2)
    rows, cols = np.diff(np.append(cut_y, h)), np.diff(np.append(cut_x, w))
    means = sums / (rows[:, None] * cols[None, :])[..., None]
    return means.reshape(*part.shape[:-3], -1, 3)


def block_means(image: np.ndarray, box: tuple[int, int, int, int], grid: int) -> np.ndarray:
    """Mean colour of the cells of a grid laid over the box; (cells, 3)."""
    return _block_means(_inside(image, box), grid)


def mutations(before: np.ndarray, after: np.ndarray, grid: int = 16) -> np.ndarray:
    """Mean absolute colour change of each part of a stack, summed over channels."""
    change = np.abs(_block_means(before, grid) - _block_means(after, grid))
    return change.sum(axis=(1, 2)) / max(1, change.shape[1])


def mutation(before: np.ndarray, after: np.ndarray, box: tuple[int, int, int, int], grid: int = 16) -> float:
    """``mutations`` of one box of an image."""
    return float(mutations(_inside(before, box)[None], _inside(after, box)[None], grid)[0])


def black_shares(images: np.ndarray, scale: int = 8) -> np.ndarray:
    """Share of near-black pixels of each image at 1/scale size (plain block means)."""
    h, w = images.shape[1:3]
    part = images[:, : h // scale * scale, : w // scale * scale, :3].astype(np.uint32)
    sums = np.add.reduceat(np.add.reduceat(part, np.arange(0, part.shape[1], scale), axis=1), np.arange(0, part.shape[2], scale), axis=2)
    return (sums < 12 * scale * scale).all(axis=-1).mean(axis=(1, 2))


def black_share(image: np.ndarray, scale: int = 8) -> float:
    return float(black_shares(image[None], scale)[0])


def signatures(images: np.ndarray) -> np.ndarray:
    """Channel sums weighted by pixel position, a row for each image; equal images have equal values."""
    weight = np.arange(images.shape[1] * images.shape[2], dtype=np.int64) % 97 + 1
    return np.stack([images[..., c].reshape(len(images), -1).astype(np.int64) @ weight for c in range(3)], axis=1)


def signature(image: np.ndarray) -> tuple[int, int, int]:
    return tuple(signatures(image[None])[0].tolist())
