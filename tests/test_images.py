import base64
import hashlib
import json
import struct
import zlib

import numpy as np

from riskweave.operators import images as im


def png(grey: np.ndarray, filter_: int = 0) -> bytes:
    rows, above = b"", np.zeros(grey.shape[1], int)
    for y in grey.astype(int):
        left = np.concatenate([[0], y[:-1]])
        line = {0: y, 1: y - left, 2: y - above, 3: y - (left + above) // 2}[filter_] & 255
        rows += bytes([filter_]) + line.astype(np.uint8).tobytes()
        above = y
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def hidden() -> np.ndarray:
    g = np.full((256, 256), 255)
    g[:, ::3] -= 6 * (np.arange(256)[:, None] % 20 < 12)
    return g


def test_pixels_and_screening():
    r = np.random.default_rng(0)
    scene = np.clip(np.linspace(0, 255, 256)[None, :] + r.normal(0, 6, (256, 256)), 0, 255).astype(int)
    for f in range(4):
        assert (im.pixels(png(scene[:20, :30], f))[:, :, 0] == scene[:20, :30]).all()
    assert [bool(im.screened(im.pixels(png(g)))[-1]) for g in (hidden(), scene, np.full((64, 64), 128))] == [True, False, False]
    assert im.pixels(b"<svg/>") is None and im.pixels(png(scene)[:60]) is None and im.screened(None)[0] is None


def test_refs_mirror_and_findings(spark, tmp_path):
    uri = "data:image/png;base64," + base64.b64encode(png(np.where(np.arange(64)[None, :] % 3 == 0, 249, 255) * np.ones((40, 1), int))).decode()
    url = "https://h.example/a/b.PNG?x=1"
    record = {"share_id": "s", "messages": [{"role": "assistant", "extra": {"z": [{"u": url}, url], "a": uri}, "fragments": "https://h.example/no.html"}], "content": {"messages": [{"role": "user", "platform_extra": ["https://h.example/c.jpg"]}]}}
    df = spark.createDataFrame([("s", "p", json.dumps(record)), ("t", "p", "{bad"), ("u", "p", None)], "record_id string, platform string, raw string")
    refs = im.structured_refs(df).collect()
    assert [(r.kind, r.path, r.message_index, r.role) for r in refs] == [("url", "messages[0].extra.z[0].u", 0, "ASSISTANT"), ("data_uri", "messages[0].extra.a", 0, "ASSISTANT"), ("url", "messages[1].platform_extra[0]", 1, "USER")]
    assert sorted(r.rule for r in im.image_findings(df).collect()) == ["G-1", "G-1", "G-1", "G-4"]
    name = hashlib.sha1(url.encode()).hexdigest()
    (tmp_path / f"{name}.jpg").write_bytes(b"jpg")
    (tmp_path / f"{name}.png").write_bytes(png(hidden()))
    got = im.forensics(im.mirror(spark, str(tmp_path), spark.createDataFrame([(url,), (url,), ("https://other",)], "url string"))).collect()
    assert [(r.url, r.width, r.verdict) for r in got] == [(url, 256, True)]
