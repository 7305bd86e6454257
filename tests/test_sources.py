import numpy as np
import pytest

from tessera.sources import codecs as C
from tessera.sources import images as S

RNG = np.random.default_rng(2)


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 2), (5, 7, 3), (5, 7, 4), (1, 1)])
def test_png(shape):
    a = RNG.integers(0, 256, shape)
    assert (C.decode_png(C.encode_png(a)) == a).all()


def test_pnm_pfm_flow_hdr():
    g, c = RNG.integers(0, 256, (4, 6)), RNG.integers(0, 256, (4, 6, 3))
    assert (C.decode_pnm(C.encode_pnm(g)) == g).all() and (C.decode_pnm(C.encode_pnm(c)) == c).all()
    f = RNG.normal(size=(4, 6, 3)).astype(np.float32)
    assert (C.decode_pfm(C.encode_pfm(f)) == f).all() and (C.decode_pfm(C.encode_pfm(f[..., 0])) == f[..., 0]).all()
    u, v = C.decode_flow(C.encode_flow(f[..., 0], f[..., 1]))
    assert (u == f[..., 0]).all() and (v == f[..., 1]).all()
    h = np.abs(f) * 10 + 0.01
    assert np.allclose(C.decode_hdr(C.encode_hdr(h)), h, atol=h.max(axis=2, keepdims=True) / 100)


def test_gif():
    pal = C.web_palette()
    frames = [pal[RNG.integers(0, 216, (40, 50))] for _ in range(3)]
    got = C.decode_gif(C.encode_gif(frames, [3, 5, 7]))
    assert [d for _, d in got] == [3, 5, 7] and all((a == b).all() for (a, _), b in zip(got, frames, strict=True))
    flat = [np.zeros((200, 200), dtype=int)]
    assert (C.decode_gif(C.encode_gif(flat, [1]))[0][0] == 0).all()


@pytest.mark.parametrize("binary", [False, True])
def test_ply(binary):
    p, n = RNG.normal(size=(9, 3)), RNG.normal(size=(9, 3))
    v = C.decode_ply(C.encode_ply(p, n, binary))
    assert np.array_equal(np.stack([v[k] for k in ("x", "y", "z")], 1), p) and np.array_equal(v["nz"], n[:, 2])


def test_tables(spark, tmp_path):
    S.register(spark)
    df = spark.createDataFrame([(f"i{k}", 2, 3, 1, [k, 1, 2, 3, 4, 5]) for k in range(5)], "name string, rows int, cols int, channels int, img array<int>")
    df.write.format("image_files").option("path", str(tmp_path / "png")).option("kind", "png").mode("append").save()
    got = {r.path.rsplit("/", 1)[1]: r.img for r in S.read_images(spark, str(tmp_path / "png")).collect()}
    assert got == {f"i{k}.png": [k, 1, 2, 3, 4, 5] for k in range(5)}
    assert [r.frame_no for r in S.read_frames(spark, str(tmp_path / "png")).orderBy("frame_no").collect()] == list(range(5))
    assert S.read_native_images(spark, str(tmp_path / "png")).count() == 5
    assert all(C.decode_png(r.content).shape == (2, 3) for r in S.encode_images(df).collect())
    clips = df.selectExpr("'c' AS clip", "int(substr(name, 2)) AS frame_no", "4 AS delay_cs", "rows", "cols", "channels", "img")
    (tmp_path / "gif").mkdir()
    (tmp_path / "gif" / "c.gif").write_bytes(S.gif_of_frames(clips).first().content)
    assert [(r.frame_no, r.start_cs) for r in S.read_gif(spark, str(tmp_path / "gif")).orderBy("frame_no").collect()] == [(k, 4 * k) for k in range(5)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.ply").write_bytes(C.encode_ply(RNG.normal(size=(4, 3))))
    (tmp_path / "p" / "a.pfm").write_bytes(C.encode_pfm(RNG.normal(size=(4, 3))))
    (tmp_path / "p" / "a.flo").write_bytes(C.encode_flow(RNG.normal(size=(4, 3)), RNG.normal(size=(4, 3))))
    assert (S.read_ply(spark, str(tmp_path / "p")).count(), S.read_pfm(spark, str(tmp_path / "p")).count(), S.read_flow(spark, str(tmp_path / "p")).count()) == (4, 1, 1)
