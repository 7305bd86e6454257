"""Neighbourhood, morphological and geometric queries on packed images."""

from __future__ import annotations

from tessera.operators import raster as R
from tessera.plans.common import IMG, SIDE, images, offsets_of, stencil_sql, u8
from tessera.plans.registry import register

N = SIDE


def _q(name: str, value, sql: str | None) -> None:
    register(name, lambda s, d: R.to_pixels(R.map_images(images(s, d), value, shape=(N, N))), sql)


def _weighted(name: str, kernel, agg: str, value) -> None:
    _q(name, value, stencil_sql(agg, offsets_of(kernel)))


_SUM = "sum(CAST(q.v AS DOUBLE) * k.w)"
_BOX3, _BOX5 = [[1] * 3] * 3, [[1] * 5] * 5
_weighted("box_blur", _BOX3, u8(f"{_SUM} / 9"), lambda c: R.box_blur(c, 3))
_weighted("box_blur5", _BOX5, u8(f"{_SUM} / 25"), lambda c: R.box_blur(c, 5))
_weighted("gaussian_blur", [[a * b for b in R.GAUSS5] for a in R.GAUSS5], u8(f"{_SUM} / 256"), lambda c: R.binomial_blur(c))
_weighted("gaussian_blur3", [[a * b for b in R.GAUSS3] for a in R.GAUSS3], u8(f"{_SUM} / 16"), lambda c: R.binomial_blur(c, R.GAUSS3))
_weighted("sobel_x", R.SOBEL_X, f"CAST({_SUM} AS INT)", lambda c: R.correlate(c, R.SOBEL_X))
_weighted("sobel_y", R.transposed(R.SOBEL_X), f"CAST({_SUM} AS INT)", lambda c: R.correlate(c, R.transposed(R.SOBEL_X)))
_weighted("scharr_x", R.SCHARR_X, f"CAST({_SUM} AS INT)", lambda c: R.correlate(c, R.SCHARR_X))
_weighted("prewitt_x", R.PREWITT_X, f"CAST({_SUM} AS INT)", lambda c: R.correlate(c, R.PREWITT_X))
_weighted("laplacian", R.LAPLACE_4, f"CAST({_SUM} AS INT)", lambda c: R.correlate(c, R.LAPLACE_4))
_weighted("filter2d_sharpen", R.SHARPEN, u8(_SUM), lambda c: R.filter2d(c, R.SHARPEN))
_S3 = [(dy, dx, 1) for dy, dx in R.square(3)]
_X3 = [(dy, dx, 1) for dy, dx in R.cross(3)]
_q("median_blur", lambda c: R.median_blur(c, 3), stencil_sql("list_sort(list(q.v))[5]", _S3))
_q("median_blur5", lambda c: R.median_blur(c, 5), stencil_sql("list_sort(list(q.v))[13]", [(a, b, 1) for a, b in R.square(5)]))
_q("rank_filter_q1", lambda c: R.rank_filter(c, R.square(3), 2), stencil_sql("list_sort(list(q.v))[3]", _S3))
_q("erode", lambda c: R.erode(c), stencil_sql("min(q.v)", _S3))
_q("dilate", lambda c: R.dilate(c), stencil_sql("max(q.v)", _S3))
_q("erode_cross", lambda c: R.erode(c, R.cross(3)), stencil_sql("min(q.v)", _X3))
_q("dilate_cross", lambda c: R.dilate(c, R.cross(3)), stencil_sql("max(q.v)", _X3))
_q("morph_gradient", R.morph_gradient, stencil_sql("max(q.v) - min(q.v)", _S3))
_q("adaptive_threshold", lambda c: R.adaptive_threshold(c, 3, 2.0), stencil_sql("CASE WHEN max(p.v) > sum(q.v) / CAST(9 AS DOUBLE) - 2 THEN 255 ELSE 0 END", _S3))
_q("sauvola", lambda c: R.sauvola(c, 5, 0.2), stencil_sql("CASE WHEN max(p.v) > (sum(q.v) / 25.0::DOUBLE) * (1 + 0.2 * (sqrt(greatest(0, sum(q.v * q.v) / 25.0::DOUBLE - (sum(q.v) / 25.0::DOUBLE) * (sum(q.v) / 25.0::DOUBLE))) / 128.0 - 1)) THEN 255 ELSE 0 END", [(a, b, 1) for a, b in R.square(5)]))
_q("niblack", lambda c: R.niblack(c, 5, -0.2), stencil_sql("CASE WHEN max(p.v) > sum(q.v) / 25.0::DOUBLE + (-0.2) * sqrt(greatest(0, sum(q.v * q.v) / 25.0::DOUBLE - (sum(q.v) / 25.0::DOUBLE) * (sum(q.v) / 25.0::DOUBLE))) THEN 255 ELSE 0 END", [(a, b, 1) for a, b in R.square(5)]))
_LBP = [(-1, -1, 128), (-1, 0, 64), (-1, 1, 32), (0, 1, 16), (1, 1, 8), (1, 0, 4), (1, -1, 2), (0, -1, 1)]
_q("lbp", lambda c: R.local_binary_pattern(c), stencil_sql("CAST(sum(CASE WHEN q.v >= p.v THEN k.w ELSE 0 END) AS INT)", _LBP))


def _twice(first: str, second: str) -> str:
    rows = ", ".join(f"({a}, {b})" for a, b in R.square(3))
    near = "JOIN {0} q ON q.img_id = p.img_id AND q.y = greatest(0, least(7, p.y + k.dy)) AND q.x = greatest(0, least(7, p.x + k.dx)) GROUP BY p.img_id, p.y, p.x"
    return (
        f"WITH {IMG}, k(dy, dx) AS (VALUES {rows}), one AS (SELECT p.img_id, p.y, p.x, {first}(q.v) AS v FROM img p CROSS JOIN k {near.format('img')}), "
        f"two AS (SELECT p.img_id, p.y, p.x, {second}(q.v) AS v FROM one p CROSS JOIN k {near.format('one')}) "
    )


_q("morph_open", R.opening, _twice("min", "max") + "SELECT * FROM two")
_q("morph_close", R.closing, _twice("max", "min") + "SELECT * FROM two")
_q("tophat", R.tophat, _twice("min", "max") + "SELECT img_id, y, x, img.v - two.v AS v FROM img JOIN two USING (img_id, y, x)")
_q("blackhat", R.blackhat, _twice("max", "min") + "SELECT img_id, y, x, two.v - img.v AS v FROM img JOIN two USING (img_id, y, x)")
_q("unsharp", lambda c: R.unsharp(c, 1.0), stencil_sql(u8(f"max(p.v) + (max(p.v) - {u8('sum(CAST(q.v AS DOUBLE) * k.w) / 256')}) * 1.0"), offsets_of([[a * b for b in R.GAUSS5] for a in R.GAUSS5])))
_q("gradient_magnitude", lambda c: R.gradient_magnitude(c), f"WITH {IMG}, k(dy, dx, a, b) AS (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) SELECT p.img_id, p.y, p.x, {u8('sqrt(CAST(sum(q.v*a)*sum(q.v*a)+sum(q.v*b)*sum(q.v*b) AS DOUBLE))')} AS v FROM img p CROSS JOIN k JOIN img q ON q.img_id=p.img_id AND q.y=greatest(0,least(7,p.y+k.dy)) AND q.x=greatest(0,least(7,p.x+k.dx)) GROUP BY p.img_id, p.y, p.x")


def _moved(y: str, x: str) -> str:
    return f"WITH {IMG} SELECT img_id, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, v FROM img"


_q("flip_horizontal", lambda c: R.flip(c, horizontal=True), _moved("y", "7 - x"))
_q("flip_vertical", lambda c: R.flip(c, vertical=True), _moved("7 - y", "x"))
_q("rotate90", lambda c: R.rotate90(c), _moved("x", "7 - y"))
_q("transpose", lambda c: R.transpose(c), _moved("x", "y"))
_grid = lambda r, c: f"grid AS (SELECT CAST(a.range AS INT) AS gy, CAST(b.range AS INT) AS gx FROM range({r}) a, range({c}) b)"
_q("resize_nearest", lambda c: R.resize_nearest(c, 5, 11), f"WITH {IMG}, {_grid(5, 11)} SELECT img_id, gy AS y, gx AS x, v FROM grid JOIN img ON y = CAST(floor((gy + 0.5) * 1.6::DOUBLE) AS INT) AND x = CAST(floor((gx + 0.5) * (8 / 11.0::DOUBLE)) AS INT)")
_q(
    "resize_bilinear",
    lambda c: R.resize_bilinear(c, 16, 4),
    f"""WITH {IMG}, {_grid(16, 4)},
    g AS (SELECT gy, gx, (gy + 0.5) * 0.5::DOUBLE - 0.5 AS fy, (gx + 0.5) * 2.0::DOUBLE - 0.5 AS fx FROM grid),
    h AS (SELECT *, CAST(floor(fy) AS INT) AS y0, CAST(floor(fx) AS INT) AS x0 FROM g)
    SELECT a.img_id, gy AS y, gx AS x, {u8('(a.v * (1 - (fx - x0)) + b.v * (fx - x0)) * (1 - (fy - y0)) + (c.v * (1 - (fx - x0)) + d.v * (fx - x0)) * (fy - y0)')} AS v
    FROM h JOIN img a ON a.y = greatest(0, least(7, y0)) AND a.x = greatest(0, least(7, x0))
    JOIN img b ON b.img_id = a.img_id AND b.y = a.y AND b.x = greatest(0, least(7, x0 + 1))
    JOIN img c ON c.img_id = a.img_id AND c.y = greatest(0, least(7, y0 + 1)) AND c.x = a.x
    JOIN img d ON d.img_id = a.img_id AND d.y = c.y AND d.x = b.x""",
)
_q("warp_affine", lambda c: R.warp_affine(c, [[0.8, 0.2, 0.3], [-0.25, 0.9, 1.1]]), f"WITH {IMG}, {_grid(8, 8)} SELECT ids.img_id, gy AS y, gx AS x, coalesce(v, 0) AS v FROM grid CROSS JOIN (SELECT DISTINCT img_id FROM img) ids LEFT JOIN img ON img.img_id = ids.img_id AND img.y = CAST(floor((-0.25) * gx + 0.9 * gy + 1.1 + 0.5) AS INT) AND img.x = CAST(floor(0.8 * gx + 0.2 * gy + 0.3 + 0.5) AS INT)")
_q("warp_perspective", lambda c: R.warp_perspective(c, [[1.0, 0.125, 0.25], [0.0, 1.0, 0.5], [0.0, 0.0625, 1.0]]), f"WITH {IMG}, {_grid(8, 8)} SELECT ids.img_id, gy AS y, gx AS x, coalesce(v, 0) AS v FROM grid CROSS JOIN (SELECT DISTINCT img_id FROM img) ids LEFT JOIN img ON img.img_id = ids.img_id AND img.y = CAST(floor((gy + 0.5) / (gy * 0.0625::DOUBLE + 1.0) + 0.5) AS INT) AND img.x = CAST(floor((gx + gy * 0.125 + 0.25) / (gy * 0.0625::DOUBLE + 1.0) + 0.5) AS INT)")
_q("copy_border_reflect101", lambda c: R.copy_border(c, 2, 1, 3, 0, "reflect101"), f"WITH {IMG}, {_grid(11, 11)}, m AS (SELECT gy, gx, CASE WHEN gy < 2 THEN 2 - gy WHEN gy > 9 THEN 14 - (gy - 2) ELSE gy - 2 END AS sy, CASE WHEN gx < 3 THEN 3 - gx ELSE gx - 3 END AS sx FROM grid) SELECT img_id, gy AS y, gx AS x, v FROM m JOIN img ON y = sy AND x = sx")
_q("copy_border_wrap", lambda c: R.copy_border(c, 1, 1, 1, 1, "wrap"), f"WITH {IMG}, {_grid(10, 10)} SELECT img_id, gy AS y, gx AS x, v FROM grid JOIN img ON y = (gy + 7) % 8 AND x = (gx + 7) % 8")
_q("integral_image", lambda c: R.integral(c), f"WITH {IMG}, {_grid(9, 9)} SELECT ids.img_id, gy AS y, gx AS x, CAST(coalesce(sum(v), 0) AS INT) AS v FROM grid CROSS JOIN (SELECT DISTINCT img_id FROM img) ids LEFT JOIN img ON img.img_id = ids.img_id AND img.y < gy AND img.x < gx GROUP BY ids.img_id, gy, gx")
_q("pyr_down", R.pyr_down, f"SELECT img_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, v FROM ({stencil_sql(u8(_SUM + ' / 256'), offsets_of([[a * b for b in R.GAUSS5] for a in R.GAUSS5]))}) t WHERE y % 2 = 0 AND x % 2 = 0")
