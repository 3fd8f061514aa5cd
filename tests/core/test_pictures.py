from __future__ import annotations

import numpy as np
import pytest

from granary.operators import pictures as P
from granary.operators.detections import rle_encode


def test_letterbox_keeps_the_picture_and_greys_the_rest():
    flat = np.full((20, 40, 3), (10, 20, 30), np.uint8)
    box = P.letterboxed(flat, 80)
    assert box.shape == (80, 80, 3) and (box[20:60] == (10, 20, 30)).all() and (box[:20] == P.PAD).all() and (box[60:] == P.PAD).all()
    tensor = P.detector_tensor(flat, 80)
    assert tensor.shape == (3, 80, 80) and np.allclose(tensor[:, 40, 40], np.array([30, 20, 10]) / 255)
    assert (P.classifier_tensor(flat, 16)[3, 5] == (30, 20, 10)).all()


def test_tensors_of_rows(spark):
    flat = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    rows = spark.createDataFrame([(1, 3, 2, flat.tobytes()), (2, 3, 2, b"abc"), (3, None, None, None)], "image_index int, width int, height int, pixels binary")
    out = {r["image_index"]: r for r in P.tensors(rows, lambda p: P.detector_tensor(p, 8)).collect()}
    assert out[1]["shape"] == [3, 8, 8] and np.allclose(np.array(out[1]["tensor"]).reshape(3, 8, 8), P.detector_tensor(flat, 8)) and out[2]["tensor"] is None and out[3]["shape"] is None

    def load():
        return lambda batch: [np.array([x.sum(), len(x)]) for x in batch]

    told = {r["image_index"]: r["output"] for r in P.inferred(P.tensors(rows, lambda p: P.detector_tensor(p, 8)), "tensor", load, length=2).collect()}
    assert told[1][1] == 192 and told[2] is None
    with pytest.raises(Exception, match="another length"):
        P.inferred(P.tensors(rows, lambda p: P.detector_tensor(p, 8)), "tensor", load, length=3).collect()


def test_overlays_tint_only_their_masks(spark):
    flat = np.full((4, 5, 3), 100, np.uint8)
    mask = np.zeros((4, 5), bool)
    mask[1:3, 2:4] = True
    coded = rle_encode(mask)
    images = spark.createDataFrame([(1, 5, 4, flat.tobytes()), (2, 5, 4, flat.tobytes())], "image_index int, width int, height int, pixels binary")
    masks = spark.createDataFrame([(1, 7, 1, coded["size"], coded["counts"]), (9, 8, 0, coded["size"], coded["counts"])], "image_index int, det_id int, class_id int, size array<int>, counts array<int>")
    out = {r["image_index"]: np.frombuffer(r["pixels"], np.uint8).reshape(4, 5, 3) for r in P.overlays(images, masks).collect()}
    assert set(out) == {1, 2} and (out[2] == 100).all() and (out[1][~mask] == 100).all()
    assert (out[1][mask] == (100 * 0.55 + np.array(P.COLOURS[1]) * 0.45).astype(np.uint8)).all()
