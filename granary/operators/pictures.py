"""Decoded pictures: tensors for models, tinted masks. A picture is its rows of blue, green and red bytes.

Decoding and encoding are outside; pixels come as ``width``, ``height`` and ``pixels`` (width x height x 3 bytes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from granary.operators.detections import bilinear, rle_decode

# The grey around a letterboxed picture, and how much a tint covers.
PAD = 114
TINT = 0.45
#: The colours by class number, blue first.
COLOURS = ((77, 255, 140), (0, 240, 199), (112, 255, 57), (91, 166, 79), (58, 122, 46), (161, 227, 111))


def resized(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, each colour by itself, rounded to bytes."""
    planes = [bilinear(picture[:, :, c].astype(np.float64), height, width) for c in range(3)]
    return np.rint(np.stack(planes, 2)).astype(np.uint8)


def letterboxed(picture: np.ndarray, size: int = 640) -> np.ndarray:
    """The picture fitted into a square of ``size``, grey around it; geometry as ``functions.geometry.letterbox``."""
    height, width = picture.shape[:2]
    scale = min(size / width, size / height)
    w, h = max(round(width * scale), 1), max(round(height * scale), 1)
    left, top = round((size - w) / 2 - 0.1), round((size - h) / 2 - 0.1)
    canvas = np.full((size, size, 3), PAD, np.uint8)
    canvas[top : top + h, left : left + w] = resized(picture, w, h)
    return canvas


def detector_tensor(picture: np.ndarray, size: int = 640) -> np.ndarray:
    """Letterboxed, red first, colours before rows, from 0 to 1."""
    return letterboxed(picture, size)[:, :, ::-1].transpose(2, 0, 1).astype(np.float32) / 255


def classifier_tensor(picture: np.ndarray, size: int = 640) -> np.ndarray:
    """Stretched to the square, red first, colours last, from 0 to 255."""
    return resized(picture, size, size)[:, :, ::-1].astype(np.float32)


def tinted(picture: np.ndarray, masks: list[np.ndarray], classes: list[int], alpha: float = TINT) -> np.ndarray:
    """A copy with the pixels of each mask mixed with its class's colour; later masks lie over earlier ones."""
    out = picture.copy()
    for mask, number in zip(masks, classes, strict=True):
        out[mask] = (out[mask] * (1 - alpha) + np.array(COLOURS[number % len(COLOURS)]) * alpha).astype(np.uint8)
    return out


def _picture(row) -> np.ndarray:  # noqa: ANN001
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3)


def tensors(images: DataFrame, make: Callable[[np.ndarray], np.ndarray] = detector_tensor, id_col: str = "image_index") -> DataFrame:
    """(id, shape, tensor) of pictures (id, width, height, pixels); nulls where a picture has no pixels, or not as many as
    its size says."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                fits = row.pixels is not None and len(row.pixels) > 0 and len(row.pixels) == row.width * row.height * 3
                made = make(_picture(row)) if fits else None
                rows.append((row[0], None, None) if made is None else (row[0], list(made.shape), made.ravel()))
            yield pd.DataFrame(rows, columns=[id_col, "shape", "tensor"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, "width", "height", "pixels").mapInPandas(pack, f"`{id_col}` {kind}, shape array<int>, tensor array<float>")


def overlays(images: DataFrame, masks: DataFrame, alpha: float = TINT) -> DataFrame:
    """(image_index, pixels) of pictures with their masks (image_index, det_id, class_id, size, counts) in the order of
    det_id; pictures without masks stay as they are, masks without picture give nothing."""

    def lay(one: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        over = over.sort_values("det_id")
        held = [rle_decode(list(s), list(c)) for s, c in zip(over["size"], over["counts"], strict=True)]
        rows = [(row.image_index, tinted(_picture(row), held, over["class_id"].tolist(), alpha).tobytes()) for row in one.itertuples(index=False)]
        return pd.DataFrame(rows, columns=["image_index", "pixels"])

    left = images.select("image_index", "width", "height", "pixels").groupBy("image_index")
    right = masks.select("image_index", "det_id", "class_id", "size", "counts").groupBy("image_index")
    return left.cogroup(right).applyInPandas(lay, "image_index int, pixels binary")


def inferred(rows: DataFrame, column: str, load: Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]], into: str = "output", length: int | None = None) -> DataFrame:
    """``rows`` with what a model makes of the tensors in ``column`` (array<float>): ``load`` makes the model once per task,
    such as a session of an ONNX runtime; it gets the tensors of a batch and gives one array for each. Nulls stay null;
    outputs of another ``length`` are an error."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            known = batch.notna().to_numpy()
            made = iter(model([np.asarray(x, np.float32) for x in batch[known]])) if known.any() else iter(())
            out = [np.asarray(next(made), np.float32).ravel() if k else None for k in known]
            if length is not None and any(x is not None and len(x) != length for x in out):
                raise ValueError(f"the model gave outputs of another length than {length}")
            yield pd.Series(out)

    return rows.withColumn(into, F.pandas_udf(run, "array<float>")(column))
