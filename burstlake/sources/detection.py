"""Detection exports: an image file and a label file a sample, with the class list, for box detectors."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of [h, w, 3] pixels."""
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[k].tobytes() for k in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def label_lines(yolo: str = "yolo"):
    """The label file's text: one line 'class cx cy w h' a component."""
    return F.array_join(F.transform(yolo, lambda b: F.format_string("%d %.6f %.6f %.6f %.6f", b["class_index"], b["cx"], b["cy"], b["w"], b["h"])), "\n")


def export(df: DataFrame, root: str, classes: list[str], split: str = "train") -> int:
    """Writes images/<split>/<id>.png, labels/<split>/<id>.txt and dataset.yaml; returns the number of samples.

    df: (sample_id, image struct<h, w, c, data>, yolo).  The folder must be shared by all executors;
    tasks write their own samples, a repeated task overwrites the same files.
    """
    for kind in ("images", "labels"):
        os.makedirs(f"{root}/{kind}/{split}", exist_ok=True)
    with open(f"{root}/dataset.yaml", "w") as f:
        f.write(f"path: {root}\ntrain: images/train\nval: images/val\nnames:\n" + "".join(f"  {k}: {n}\n" for k, n in enumerate(classes)))

    def save(batches):
        for pdf in batches:
            for k, im, text in zip(pdf["sample_id"], pdf["image"], pdf["text"]):
                with open(f"{root}/images/{split}/{k}.png", "wb") as f:
                    f.write(png(np.frombuffer(im["data"], np.uint8).reshape(im["h"], im["w"], im["c"])))
                with open(f"{root}/labels/{split}/{k}.txt", "w") as f:
                    f.write(text)
            yield pdf[["sample_id"]]

    return df.select("sample_id", "image", label_lines().alias("text")).mapInPandas(save, "sample_id bigint").count()
