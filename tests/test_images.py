"""Images of generated PNG and JPEG files: pixels, hashes and faults against plain versions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridica.operators import neardup
from veridica.sources import images


def png(x):
    """An 8-bit PNG of (height, width, 3) or (height, width)."""
    x = np.asarray(x, dtype=np.uint8)
    body = b"".join(b"\0" + row.tobytes() for row in x)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2 if x.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def plain_hash(x):
    """Pixel by pixel: luma, a triangle filter along rows, then along columns."""
    x = np.asarray(x, dtype=int)
    grey = x.tolist() if x.ndim == 2 else [[(r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 for r, g, b in row] for row in x.tolist()]

    def shrunk(line):
        scale, out = len(line) / 8, []
        reach = max(scale, 1.0)
        for k in range(8):
            c = (k + 0.5) * scale
            at = range(max(int(c - reach + 0.5), 0), min(int(c + reach + 0.5), len(line)))
            w = [max(0.0, 1 - abs((i - c + 0.5) / reach)) for i in at]
            out.append(min(255, max(0, (sum(line[i] * int(v / sum(w) * (1 << 22) + 0.5) for i, v in zip(at, w, strict=True)) + (1 << 21)) >> 22)))
        return out

    rows = [shrunk(line) for line in grey]
    small = [v for line in zip(*[shrunk(list(c)) for c in zip(*rows, strict=True)], strict=True) for v in line]
    h = int("".join(str(int(v * 64 > sum(small))) for v in small), 2)
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture
def folder(tmp_path):
    rng, made = np.random.default_rng(5), {}
    for name, shape in {"a/one.png": (8, 8, 3), "a/two.png": (40, 33, 3), "b/grey.png": (20, 64), "b/small one+1.png": (5, 3, 3)}.items():
        x = rng.integers(0, 256, shape)
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(png(x))
        made[name] = x
    (tmp_path / "b/broken.jpg").write_bytes(b"no image")
    (tmp_path / "b/notes.txt").write_text("no image either")
    return tmp_path, made


def test_hashes_of_png_files(spark, folder):
    root, made = folder
    got = {r.path: (r.h, r.fault) for r in images.image_hashes(images.read_images(spark, str(root))).collect()}
    assert got == {n: (plain_hash(x), None) for n, x in made.items()} | {"b/broken.jpg": (None, "undecodable")}


def test_a_jpeg_of_a_flat_picture(spark, tmp_path):
    x = np.zeros((64, 64), dtype=int)
    x[:32], x[32:, 32:] = 220, 120
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(64, 64, 10)
    for (i, j), v in np.ndenumerate(x):
        image.getRaster().setSample(int(j), int(i), 0, int(v))
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "flat.jpg")))
    assert [r.h for r in images.image_hashes(images.read_images(spark, str(tmp_path))).collect()] == [plain_hash(x)]


def test_hashes_feed_the_near_duplicate_join(spark, folder):
    root, made = folder
    (root / "a/copy.png").write_bytes((root / "a/two.png").read_bytes())
    rows = images.image_hashes(images.read_images(spark, str(root))).where("fault is null")
    assert [(r.a, r.b, r.distance) for r in neardup.hamming_pairs(rows, 4, "path").where("distance = 0").collect()] == [("a/copy.png", "a/two.png", 0)]


def test_labelled_images(spark, folder):
    root, made = folder
    rows = [("a/one.png", "tillering"), ("b/grey.png", "winter"), ("b/broken.jpg", "ripening"), ("gone.png", "ripening")]
    m = spark.createDataFrame(rows, "image_path string, macro_stage string")
    read = images.read_images(spark, str(root))
    got = {r.image_path: (r.label, r.width, r.fault) for r in images.labelled_images(m, read, strict=False).collect()}
    assert got == {"a/one.png": (1, 8, None), "b/grey.png": (None, 64, "unknown stage"), "b/broken.jpg": (5, None, "undecodable"), "gone.png": (5, None, "missing")}
    assert images.labelled_images(m.limit(1), read).count() == 1
    with pytest.raises(Exception, match="missing gone.png"):
        images.labelled_images(m.where(F.col("image_path") == "gone.png"), read).collect()
