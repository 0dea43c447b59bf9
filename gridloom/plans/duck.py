"""SQL text of the check statements: views over the given tables and grid arithmetic."""

from __future__ import annotations

from gridloom.functions import geohash, isea4h, mgrs

VIEWS = {
    "obs": """
        SELECT CAST(event_id % 9500 AS VARCHAR) AS observation_id,
               CASE WHEN event_type IN ('view','click') THEN 'OCO2' ELSE 'TanSat' END AS satellite,
               'xco2' AS product_type, ts AS acq_time,
               CAST((event_id * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
               CAST((event_id * 104729) % 17800 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(89 AS DOUBLE) AS lat,
               CAST(240 AS DOUBLE) + value AS xco2,
               CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 3 AS VARCHAR) END AS quality_flag,
               's3://bucket/obs/' || event_type || '.nc4' AS source_uri, event_id AS source_index
        FROM events""",
    "scenes": """
        SELECT 'S' || o_orderkey AS scene_id, 'D' || (o_custkey % 50) AS dataset_id, 'A' || o_orderkey AS asset_id,
               o_orderdate AS acq_time,
               CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'P' THEN 'failed' ELSE 'loaded' END AS status,
               CAST((o_orderkey * 37) % 3400 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(170 AS DOUBLE) AS min_lon,
               CAST((o_orderkey * 53) % 1600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(80 AS DOUBLE) AS min_lat,
               CAST((o_orderkey * 37) % 3400 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(170 AS DOUBLE) + CAST(2 AS DOUBLE) AS max_lon,
               CAST((o_orderkey * 53) % 1600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(80 AS DOUBLE) + CAST(1.5 AS DOUBLE) AS max_lat,
               o_orderpriority AS priority, o_orderkey AS pos
        FROM orders""",
    "bands": """
        SELECT 'A' || l_orderkey AS asset_id, 'b' || l_linenumber AS band_code,
               CASE l_returnflag WHEN 'A' THEN 'spectral' WHEN 'N' THEN 'polarization' ELSE 'variable' END AS band_type,
               l_linenumber AS display_order, l_shipdate AS time_start, l_quantity AS sample_mean,
               l_partkey * 100000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS pos
        FROM lineitem""",
    "pixels": """
        SELECT 'A' || (l_orderkey % 500) AS asset_path, 'b' || l_linenumber AS band, l_partkey % 64 AS col,
               l_suppkey % 64 AS row, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS value,
               l_tax > 0 AS is_valid, l_orderkey AS order_key, l_extendedprice AS tie
        FROM lineitem""",
}

ALPHABET = geohash.ALPHABET


def geohash_index(lon: str, lat: str, level: int) -> tuple[str, str]:
    nx, ny = geohash.columns_at(level), geohash.rows_at(level)
    x = f"CAST(floor((CASE WHEN {lon} = 180 THEN -180 ELSE {lon} END + 180) / CAST(360 AS DOUBLE) * {nx}) AS BIGINT)"
    y = f"least(CAST(floor(({lat} + 90) / CAST(180 AS DOUBLE) * {ny}) AS BIGINT), {ny - 1})"
    return x, y


def geohash_code(x: str, y: str, level: int) -> str:
    """Code built bit by bit from column and row."""
    nx, ny = geohash.lon_bits(level), geohash.lat_bits(level)
    chars = []
    for k in range(level):
        bits = []
        for b in range(5):
            m = 5 * k + b
            source, shift = (x, nx - 1 - m // 2) if m % 2 == 0 else (y, ny - 1 - m // 2)
            bits.append(f"((({source}) >> {shift}) & 1) * {16 >> b}")
        chars.append(f"substr('{ALPHABET}', CAST({' + '.join(bits)} + 1 AS BIGINT), 1)")
    return " || ".join(chars)


def geohash_cells(source: str, lon: str, lat: str, level: int, out: str = "space_code") -> str:
    """Statement that adds a geohash code to every row of ``source``."""
    x, y = geohash_index(lon, lat, level)
    return (
        f"SELECT * EXCLUDE (gx, gy), {geohash_code('gx', 'gy', level)} AS {out} "
        f"FROM (SELECT *, {x} AS gx, {y} AS gy FROM {source})"
    )


def geohash_cover(source: str, level: int, mode: str = "intersect", keep: str = "*") -> str:
    """Statement with one row per source box and cell (gx, gy, space_code, cell box)."""
    w, h = geohash.cell_width(level), geohash.cell_height(level)
    nx, ny = geohash.columns_at(level), geohash.rows_at(level)
    wd, hd = f"CAST({w!r} AS DOUBLE)", f"CAST({h!r} AS DOUBLE)"
    if mode == "contain":
        i0, i1 = f"ceil((min_lon + 180) / {wd})", f"floor((max_lon + 180) / {wd}) - 1"
        j0, j1 = f"ceil((min_lat + 90) / {hd})", f"floor((max_lat + 90) / {hd}) - 1"
    else:
        i0, i1 = f"floor((min_lon + 180) / {wd})", f"ceil((max_lon + 180) / {wd}) - 1"
        j0, j1 = f"floor((min_lat + 90) / {hd})", f"ceil((max_lat + 90) / {hd}) - 1"
    return f"""
        SELECT *, {geohash_code('gx', 'gy', level)} AS space_code,
               gx * {wd} - 180 AS cell_min_lon, gy * {hd} - 90 AS cell_min_lat,
               (gx + 1) * {wd} - 180 AS cell_max_lon, (gy + 1) * {hd} - 90 AS cell_max_lat
        FROM (SELECT *, unnest(generate_series(greatest(CAST({j0} AS BIGINT), 0), least(CAST({j1} AS BIGINT), {ny - 1}))) AS gy
              FROM (SELECT {keep}, unnest(generate_series(greatest(CAST({i0} AS BIGINT), 0), least(CAST({i1} AS BIGINT), {nx - 1}))) AS gx
                    FROM {source}))"""


def utm_zone(lon: str, lat: str) -> str:
    cases = " ".join(
        f"WHEN {lat} >= {s} AND {lat} < {n} AND {lon} >= {w} AND {lon} < {e} THEN {z}"
        for w, e, s, n, z in mgrs.WIDE_ZONES
    )
    return f"CASE {cases} ELSE CAST(floor(({lon} + 180) / 6) AS INTEGER) % 60 + 1 END"


def mgrs_cells(source: str, lon: str, lat: str, precision: int, out: str = "space_code") -> str:
    """Statement that adds an MGRS reference to every row of ``source``."""
    d = "CAST({!r} AS DOUBLE)".format
    north = " + ".join(f"{d(a)} * sin(xi * {2 * j}) * cosh(eta * {2 * j})" for j, a in enumerate(mgrs.ALPHA, 1))
    east = " + ".join(f"{d(a)} * cos(xi * {2 * j}) * sinh(eta * {2 * j})" for j, a in enumerate(mgrs.ALPHA, 1))
    scale = d(mgrs.UTM_SCALE * mgrs.RECTIFYING)
    ecc = d(mgrs.ECC)
    step = 10 ** (5 - precision)
    digits = lambda v: (
        "''" if precision == 0 else
        f"lpad(CAST(CAST(floor(({v} - floor({v} / 100000) * 100000) / {step}) AS BIGINT) AS VARCHAR), {precision}, '0')"
    )
    sets = mgrs.COLUMN_LETTERS
    return f"""
      SELECT * EXCLUDE (wl, la, zz, polar, tt, cc, ss, xi, eta, rho, ee, nn),
        CASE WHEN polar THEN
          (CASE WHEN la >= 0 THEN CASE WHEN ee < 2000000 THEN 'Y' ELSE 'Z' END
                ELSE CASE WHEN ee < 2000000 THEN 'A' ELSE 'B' END END) ||
          (CASE WHEN ee < 2000000 THEN substr('{mgrs.UPS_WEST_COLUMNS}', CAST(floor((ee - 800000) / 100000) AS BIGINT) + 1, 1)
                ELSE substr('{mgrs.UPS_EAST_COLUMNS}', CAST(floor((ee - 2000000) / 100000) AS BIGINT) + 1, 1) END) ||
          substr('{mgrs.UPS_ROWS}', CAST(floor((nn - CASE WHEN la >= 0 THEN 1300000 ELSE 800000 END) / 100000) AS BIGINT) + 1, 1)
        ELSE
          lpad(CAST(zz AS VARCHAR), 2, '0') ||
          substr('{mgrs.BANDS}', CAST(least(floor((la + 80) / 8), 19) AS BIGINT) + 1, 1) ||
          substr(CASE zz % 3 WHEN 1 THEN '{sets[0]}' WHEN 2 THEN '{sets[1]}' ELSE '{sets[2]}' END, CAST(floor(ee / 100000) AS BIGINT), 1) ||
          substr('{mgrs.ROW_LETTERS}', (CAST(floor(nn / 100000) AS BIGINT) + CASE WHEN zz % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1)
        END || {digits('ee')} || {digits('nn')} AS {out}
      FROM (SELECT *,
        CASE WHEN polar THEN 2000000 + rho * sin(radians(wl)) ELSE 500000 + {scale} * (eta + {east}) END AS ee,
        CASE WHEN polar THEN 2000000 + rho * cos(radians(wl)) * CASE WHEN la >= 0 THEN -1 ELSE 1 END
             ELSE {scale} * (xi + {north}) + CASE WHEN la < 0 THEN 10000000 ELSE 0 END END AS nn
      FROM (SELECT *, atan2(tt, cc) AS xi, asinh(ss / sqrt(tt * tt + cc * cc)) AS eta
      FROM (SELECT *, sinh(atanh(sin(radians(la))) - {ecc} * atanh({ecc} * sin(radians(la)))) AS tt,
             cos(radians(wl - (zz * 6 - 183))) AS cc, sin(radians(wl - (zz * 6 - 183))) AS ss,
             {d(mgrs.UPS_RADIUS)} * tan({d(0.7853981633974483)} - radians(abs(la)) / 2)
               / pow((1 - {ecc} * sin(radians(abs(la)))) / (1 + {ecc} * sin(radians(abs(la)))), {ecc} / 2) AS rho
      FROM (SELECT *, {utm_zone('wl', 'la')} AS zz, la >= 84 OR la <= -80 AS polar
      FROM (SELECT *, CASE WHEN {lon} = 180 THEN -180 ELSE {lon} END AS wl, {lat} AS la FROM {source})))))"""


def isea4h_cells(source: str, lon: str, lat: str, level: int, out: str = "space_code") -> str:
    """Statement that adds an ISEA4H sequence number (as text) to every row of ``source``.

    The nearest lattice point is found by comparing the four around the point,
    not by rounding, so the check does not share the rounding rule.
    """
    d = "CAST({!r} AS DOUBLE)".format
    fr = isea4h.FRAMES
    dots = [f"(px * {d(f['x'])} + py * {d(f['y'])} + pz * {d(f['z'])})" for f in fr]
    face = "list_position([" + ", ".join(dots) + "], list_max([" + ", ".join(dots) + "])) - 1"
    table = lambda key: "[" + ", ".join(d(f[key]) for f in fr) + "][face + 1]"
    from math import cos, pi, sin

    third = d(2 * pi / 3)
    n = 1 << level
    sg, cg = d(sin(isea4h.THETA_G) * isea4h.COS_FACE), d(cos(isea4h.THETA_G))
    squared = d(isea4h.R_PRIME**2 * isea4h.TAN_FACE**2)
    cot, tanf = d(isea4h.COT30), d(isea4h.TAN_FACE)
    s60 = d(isea4h.SIN60)
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    dist = [f"pow(uu - (fu + {a}), 2) - (uu - (fu + {a})) * (vv - (fv + {b})) + pow(vv - (fv + {b}), 2)" for a, b in corners]
    best = "list_position([" + ", ".join(dist) + "], list_min([" + ", ".join(dist) + "])) - 1"
    return f"""
      SELECT * EXCLUDE (phi, lam, px, py, pz, face, clat, dlon, turn, dist, az0, sector, az, reach, ag, plane, rho, tx, ty, qd, uu, vv, fu, fv, bb, ii, jj),
        CAST(CASE
          WHEN qd <= 5 AND ii = 0 AND jj = {n} THEN 1
          WHEN qd > 5 AND ii = {n} AND jj = 0 THEN {isea4h.cell_count(level)}
          WHEN qd <= 5 AND jj = {n} THEN 2 + (qd % 5) * {n * n} + ({n} - ii)
          WHEN qd <= 5 AND ii = {n} THEN 2 + (qd + 4) * {n * n} + jj
          WHEN qd > 5 AND ii = {n} THEN 2 + ((qd - 5) % 5 + 5) * {n * n} + ({n} - jj) * {n}
          WHEN qd > 5 AND jj = {n} THEN 2 + ((qd - 5) % 5) * {n * n} + ii * {n}
          ELSE 2 + (qd - 1) * {n * n} + ii * {n} + jj END AS VARCHAR) AS {out}
      FROM (SELECT *, CAST(fu + bb % 2 AS BIGINT) AS ii, CAST(fv + bb // 2 AS BIGINT) AS jj
      FROM (SELECT *, {best} AS bb
      FROM (SELECT *, floor(uu) AS fu, floor(vv) AS fv
      FROM (SELECT *, hx + vv / 2 AS uu
      FROM (SELECT * EXCLUDE (hy), hy / {s60} AS vv
      FROM (SELECT *, CAST(face % 5 + CASE WHEN face < 10 THEN 1 ELSE 6 END AS BIGINT) AS qd,
          {d(float(n))} * CASE WHEN face % 10 < 5 THEN tx * 0.5 - ty * {s60} ELSE 0.5 - (tx * 0.5 - ty * {s60}) END AS hx,
          {d(float(n))} * CASE WHEN face % 10 < 5 THEN tx * {s60} + ty * 0.5 ELSE {s60} - (tx * {s60} + ty * 0.5) END AS hy
      FROM (SELECT *, (rho * sin(plane + sector) + {d(isea4h.ORIGIN_X)}) / {d(isea4h.EDGE)} AS tx,
          (rho * cos(plane + sector) + {d(isea4h.ORIGIN_Y)}) / {d(isea4h.EDGE)} AS ty
      FROM (SELECT *, {d(2 * isea4h.R_PRIME)} * {tanf} / ((cos(plane) + {cot} * sin(plane)) * 2 * sin(reach / 2)) * sin(dist / 2) AS rho
      FROM (SELECT *, atan2(2 * ag, {squared} - 2 * ag * {cot}) AS plane
      FROM (SELECT *, atan2({tanf}, cos(az) + {cot} * sin(az)) AS reach,
          az + {d(isea4h.THETA_G)} + acos(sin(az) * {sg} - cos(az) * {cg}) - {d(pi)} AS ag
      FROM (SELECT *, az0 - sector AS az
      FROM (SELECT *, CASE WHEN az0 < {third} THEN 0 WHEN az0 <= {d(4 * pi / 3)} THEN {third} ELSE {d(4 * pi / 3)} END AS sector
      FROM (SELECT *, acos(greatest(-1, least(1, sin(clat) * sin(phi) + cos(clat) * cos(phi) * cos(dlon)))) AS dist,
          CASE WHEN az1 < 0 THEN az1 + {d(2 * pi)} ELSE az1 END AS az0
      FROM (SELECT *, atan2(cos(phi) * sin(dlon), cos(clat) * sin(phi) - sin(clat) * cos(phi) * cos(dlon)) - turn AS az1
      FROM (SELECT *, {table('lat')} AS clat, lam - {table('lon')} AS dlon, {table('turn')} AS turn
      FROM (SELECT *, {face} AS face
      FROM (SELECT *, cos(phi) * cos(lam) AS px, cos(phi) * sin(lam) AS py, sin(phi) AS pz
      FROM (SELECT *, radians({lat}) AS phi, radians({lon}) AS lam FROM {source}))))))))))))))))))""".replace(
        "uu, vv, fu", "hx, uu, vv, fu"
    ).replace("az0, sector, az,", "az0, az1, sector, az,")


def isea4h_triple(seq: str, level: int) -> tuple[str, str, str]:
    n = 1 << level
    last = isea4h.cell_count(level)
    quad = f"CASE WHEN {seq} = 1 THEN 0 WHEN {seq} = {last} THEN 11 ELSE ({seq} - 2) // {n * n} + 1 END"
    pole = f"{seq} IN (1, {last})"
    i = f"CASE WHEN {pole} THEN 0 ELSE (({seq} - 2) % {n * n}) // {n} END"
    j = f"CASE WHEN {pole} THEN 0 ELSE (({seq} - 2) % {n * n}) % {n} END"
    return quad, i, j


def isea4h_folded(q: str, i: str, j: str, level: int) -> str:
    """Sequence number of an address at most one cell off its diamond."""
    n = 1 << level
    at = lambda quad, a, b: f"2 + (({quad}) - 1) * {n * n} + ({a}) * {n} + ({b})"
    ring = lambda base, step: f"({base} + ({q} - {base} + {step}) % 5)"
    return f"""CAST(CASE
        WHEN {q} <= 5 AND {i} = 0 AND {j} = {n} THEN 1
        WHEN {q} >= 6 AND {i} = {n} AND {j} = 0 THEN {isea4h.cell_count(level)}
        WHEN {q} <= 5 AND {j} = {n} THEN {at(ring(1, 1), '0', f'{n} - {i}')}
        WHEN {q} <= 5 AND {i} = {n} THEN {at(f'{q} + 5', '0', j)}
        WHEN {q} <= 5 AND {i} < 0 THEN {at(ring(1, 4), f'{n} - {j} + {i}', f'{n} + {i}')}
        WHEN {q} <= 5 AND {j} < 0 THEN {at(f'({ring(1, 4)} + 5)', i, f'{n} + {j}')}
        WHEN {q} <= 5 THEN {at(q, i, j)}
        WHEN {i} = {n} THEN {at(ring(6, 1), f'{n} - {j}', '0')}
        WHEN {j} = {n} THEN {at(f'({ring(6, 1)} - 5)', i, '0')}
        WHEN {i} < 0 THEN {at(f'{q} - 5', f'{n} + {i}', j)}
        WHEN {j} < 0 THEN {at(ring(6, 4), f'{n} + {j}', f'{n} - {i} + {j}')}
        ELSE {at(q, i, j)} END AS BIGINT)"""


def isea4h_around(source: str, level: int, keep: str) -> str:
    """One row per neighbour of each ``seq`` of ``source`` (columns ``keep`` and ``number``)."""
    n = 1 << level
    q, i, j = isea4h_triple("seq", level)
    offsets = ", ".join(f"({a}, {b})" for a, b in isea4h.DIRECTIONS)
    caps = (
        f"SELECT {keep}, 2 + (k - 1) * {n * n} + {n - 1} AS number FROM {source}, range(1, 6) t(k) WHERE seq = 1 UNION ALL "
        f"SELECT {keep}, 2 + (k - 1) * {n * n} + {(n - 1) * n} FROM {source}, range(6, 11) t(k) WHERE seq = {isea4h.cell_count(level)}"
    )
    return f"""
        SELECT DISTINCT {keep}, {isea4h_folded('q', '(i + di)', '(j + dj)', level)} AS number
        FROM (SELECT *, {q} AS q, {i} AS i, {j} AS j FROM {source}) , (VALUES {offsets}) o(di, dj)
        WHERE q BETWEEN 1 AND 10 AND NOT (i = 0 AND j = 0 AND di = -1 AND dj = -1)
        UNION ALL SELECT * FROM ({caps})"""


def mgrs_parent(code: str) -> str:
    """MGRS text without the last digit of each half."""
    head = f"CASE WHEN substr({code}, 1, 1) IN ('A', 'B', 'Y', 'Z') THEN 3 ELSE 5 END"
    pairs = f"((length({code}) - {head}) // 2)"
    return (
        f"substr({code}, 1, {head}) || substr({code}, {head} + 1, {pairs} - 1) || "
        f"substr({code}, {head} + 1 + {pairs}, {pairs} - 1)"
    )


def geohash_box(code: str, level: int) -> dict[str, str]:
    """Box of a code, its digits added up bit by bit."""
    nx, ny = geohash.lon_bits(level), geohash.lat_bits(level)
    xs, ys = [], []
    for k in range(level):
        digit = f"(position(substr({code}, {k + 1}, 1) IN '{ALPHABET}') - 1)"
        for b in range(5):
            m = 5 * k + b
            bit = f"(({digit} >> {4 - b}) & 1)"
            if m % 2 == 0:
                xs.append(f"{bit} * {1 << (nx - 1 - m // 2)}")
            else:
                ys.append(f"{bit} * {1 << (ny - 1 - m // 2)}")
    w, h = f"CAST({geohash.cell_width(level)!r} AS DOUBLE)", f"CAST({geohash.cell_height(level)!r} AS DOUBLE)"
    x, y = f"({' + '.join(xs)})", f"({' + '.join(ys)})"
    return {
        "min_lon": f"{x} * {w} - 180",
        "min_lat": f"{y} * {h} - 90",
        "max_lon": f"({x} + 1) * {w} - 180",
        "max_lat": f"({y} + 1) * {h} - 90",
    }


def time_bucket(ts: str, granularity: str) -> str:
    patterns = {
        "year": "%Y", "month": "%Y%m", "day": "%Y%m%d", "hour": "%Y%m%d%H", "minute": "%Y%m%d%H%M", "second": "%Y%m%d%H%M%S",
    }
    return f"strftime({ts}, '{patterns[granularity]}')"


# Index rows of scene boxes at geohash level 3; chosen rows are broken on purpose.
VIEWS["index_rows"] = f"""
    SELECT dataset_id, 'v1' AS output_version, scene_id || ':' || space_code AS output_id, asset_id AS source_asset_id, scene_id,
           'b' || (pos % 7 + 1) AS band_code, 'geohash' AS grid_type, CASE WHEN pos % 61 = 0 THEN 4 ELSE 3 END AS grid_level, space_code,
           acq_time AS acquisition_time,
           CASE WHEN pos % 178 = 0 THEN '' WHEN pos % 89 = 0 THEN '19700101' ELSE strftime(acq_time, '%Y%m%d') END AS time_bucket,
           CASE WHEN pos % 97 = 0 THEN NULL ELSE 'gh:3:' || space_code || ':' || strftime(acq_time, '%Y%m%d') END AS st_code,
           'T' || scene_id || ':' || space_code AS tile_output_id,
           pos % 50 AS window_col_off, pos % 40 AS window_row_off, CASE WHEN pos % 73 = 0 THEN 60 ELSE 14 END AS window_width, 10 AS window_height,
           cell_min_lon, cell_min_lat, cell_max_lon, cell_max_lat, pos
    FROM ({geohash_cover('scenes', 3)})"""
VIEWS["tile_rows"] = """
    SELECT dataset_id, output_version, tile_output_id AS output_id, 'geohash' AS grid_type, CASE WHEN pos % 67 = 0 THEN 4 ELSE 3 END AS grid_level,
           CASE WHEN pos % 71 = 0 THEN 'entity_file' ELSE 'logical_reference' END AS tile_kind, 64 AS width, 64 AS height, space_code, pos
    FROM index_rows WHERE pos % 79 <> 0"""
VIEWS["cell_rows"] = """
    SELECT dataset_id, 'v1' AS output_version, dataset_id || ':' || space_code AS output_id, 'geohash' AS grid_type, 3 AS grid_level, space_code,
           CASE WHEN min(pos) % 83 = 0 THEN max(cell_max_lon) ELSE max(cell_min_lon) END AS west, max(cell_min_lat) AS south,
           CASE WHEN min(pos) % 83 = 0 THEN max(cell_min_lon) ELSE max(cell_max_lon) END AS east, max(cell_max_lat) AS north
    FROM index_rows GROUP BY dataset_id, space_code"""
VIEWS["asset_rows"] = """
    SELECT dataset_id, asset_id AS source_asset_id, CASE CAST(substr(dataset_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'optical' WHEN 1 THEN 'radar' ELSE 'carbon' END AS data_type,
           CASE WHEN pos % 53 = 0 THEN 'http://x/' || asset_id ELSE 's3://bucket/' || asset_id || CASE WHEN CAST(substr(dataset_id, 2) AS INTEGER) % 3 = 2 THEN '.nc4' ELSE '.tif' END END AS source_uri,
           CASE WHEN CAST(substr(dataset_id, 2) AS INTEGER) % 3 = 2 THEN 'netcdf' WHEN pos % 59 = 0 THEN 'tif' ELSE 'cog' END AS source_format,
           CASE WHEN pos % 47 = 0 THEN 'zz' ELSE sha256(asset_id) END AS checksum,
           CASE WHEN pos % 41 = 0 THEN '' WHEN pos % 43 = 0 THEN 'nonsense' WHEN pos % 2 = 0 THEN 'epsg:4326' ELSE 'EPSG:32650' END AS crs,
           CASE WHEN pos % 37 = 0 THEN 'EPSG:3857' WHEN pos % 2 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32650' END AS actual_crs, pos % 101 <> 0 AS readable, pos
    FROM scenes"""
VIEWS["version_rows"] = """
    SELECT i.dataset_id, 'v1' AS output_version, CASE CAST(substr(i.dataset_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'optical' WHEN 1 THEN 'radar' ELSE 'carbon' END AS data_type,
           (SELECT count(*) FROM tile_rows t WHERE t.dataset_id = i.dataset_id) + CASE WHEN CAST(substr(i.dataset_id, 2) AS INTEGER) % 10 = 3 THEN 1 ELSE 0 END AS tile_count,
           count(*) AS index_count, count(DISTINCT space_code) AS grid_cell_count
    FROM index_rows i WHERE i.dataset_id <> 'D7' GROUP BY i.dataset_id"""
VIEWS["carbon_rows"] = """
    SELECT 'DC' AS dataset_id, 'v1' AS output_version, CAST(source_index AS VARCHAR) AS output_id, source_uri AS source_asset_id, source_index,
           CASE WHEN source_index % 31 = 0 THEN lon + 200 ELSE lon END AS lon, lat, CASE WHEN source_index % 29 = 0 THEN xco2 + 900 ELSE xco2 END AS xco2,
           quality_flag, source_index % 23 = 0 AS no_flag_key, source_index % 19 = 0 AS old_names FROM obs"""

# Status of band units per grid, several rows per unit, and runs over scenes.
VIEWS["unit_rows"] = """
    SELECT 'A' || l_orderkey || ':b' || l_linenumber AS band_unit_id, 'A' || l_orderkey AS asset_id, 'S' || l_orderkey AS scene_id, 'b' || l_linenumber AS band_code,
           'R' || (l_orderkey % 200) AS partition_run_id, 'D' || (l_orderkey % 50) AS dataset_id,
           CASE l_suppkey % 3 WHEN 0 THEN 'geohash' WHEN 1 THEN 'mgrs' ELSE 'isea4h' END AS grid_type, 3 + l_partkey % 2 AS grid_level,
           CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'failed' ELSE 'queued' END AS partition_status,
           CASE WHEN l_tax > 0.06 THEN 'warn' WHEN l_linestatus = 'O' THEN 'pass' ELSE 'fail' END AS quality_status,
           CASE WHEN l_discount > 0.05 THEN 'completed' WHEN l_discount < 0.02 THEN 'failed' ELSE 'pending' END AS ingest_status,
           l_shipdate AS created_at, l_partkey * 100000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS pos FROM lineitem"""
VIEWS["run_rows"] = """
    SELECT 'R' || (o_orderkey % 200) AS partition_run_id, 'S' || o_orderkey AS scene_id, 'D' || (o_orderkey % 50) AS dataset_id, 'L' || (o_custkey % 97) AS load_batch_id,
           CASE WHEN o_orderkey % 200 < 40 THEN 'completed' WHEN o_orderkey % 200 < 60 THEN 'failed' WHEN o_orderkey % 200 < 70 THEN 'cancelled'
                ELSE CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN CASE WHEN o_orderkey % 200 < 130 THEN 'running' ELSE 'failed' END ELSE 'queued' END END AS status,
           o_orderdate AS created_at, o_orderkey AS pos, CASE WHEN o_orderkey % 4 > 0 THEN 'v' || (o_orderkey % 4) END AS output_version, o_totalprice AS price FROM orders"""


def isea4h_corners(level: int) -> str:
    """Statement (seq, k, lon, lat) of the corners of all hexagons of a level, in order around each, longitudes in -180..180.

    The inverse of the equal-area projection: Newton's method on the spherical excess.
    """
    from math import cos, pi, sin

    d = "CAST({!r} AS DOUBLE)".format
    n = 1 << level
    q, i, j = isea4h_triple("seq", level)
    fr = isea4h.FRAMES
    table = lambda key: "[" + ", ".join(d(f[key]) for f in fr) + "][face + 1]"
    sg, cg = d(sin(isea4h.THETA_G)), d(cos(isea4h.THETA_G))
    cosf, cot, tanf, theta = d(isea4h.COS_FACE), d(isea4h.COT30), d(isea4h.TAN_FACE), d(isea4h.THETA_G)
    spots = ", ".join(f"{{'k': {k}, 'cu': {d(a)}, 'cv': {d(b)}}}" for k, (a, b) in enumerate([(1 / 3, 2 / 3), (-1 / 3, 1 / 3), (-2 / 3, -1 / 3), (-1 / 3, -2 / 3), (1 / 3, -1 / 3), (2 / 3, 1 / 3)]))
    cap = lambda seq, order, u, v: f"SELECT {seq} AS seq, unnest(range(5)) AS k, unnest({list(order)}) AS q, {d(u)} AS u, {d(v)} AS v"
    third = d(2 * pi / 3)

    def folded(source: str) -> str:
        down, left = "(v < 0 AND (q <= 5 OR u >= 0))", "(u < 0 AND NOT (v < 0 AND (q <= 5 OR u >= 0)))"
        return f"""SELECT seq, k,
            CASE WHEN {down} THEN CASE WHEN q <= 5 THEN (q + 3) % 5 + 6 ELSE (q - 2) % 5 + 6 END WHEN {left} THEN CASE WHEN q <= 5 THEN (q + 3) % 5 + 1 ELSE q - 5 END ELSE q END AS q,
            CASE WHEN {down} THEN CASE WHEN q <= 5 THEN u ELSE 1 + v END WHEN {left} THEN CASE WHEN q <= 5 THEN 1 - v + u ELSE 1 + u END ELSE u END AS u,
            CASE WHEN {down} THEN CASE WHEN q <= 5 THEN 1 + v ELSE 1 - u + v END WHEN {left} THEN CASE WHEN q <= 5 THEN 1 + u ELSE v END ELSE v END AS v
            FROM ({source})"""

    spread = f"""SELECT seq, c.k AS k, q, (i + c.cu) / {d(float(n))} AS u, (j + c.cv) / {d(float(n))} AS v
        FROM (SELECT seq, {q} AS q, {i} AS i, {j} AS j, unnest([{spots}]) AS c FROM (SELECT unnest(range(2, {isea4h.cell_count(level)})) AS seq))
        WHERE NOT (i = 0 AND j = 0 AND c.k = CASE WHEN q <= 5 THEN 2 ELSE 3 END)
        UNION ALL {cap(1, (2, 3, 4, 5, 1), 1 / 3 / n, (n - 1 / 3) / n)} UNION ALL {cap(isea4h.cell_count(level), (8, 7, 6, 10, 9), (n - 1 / 3) / n, 1 / 3 / n)}"""
    h = f"acos(greatest(-1, least(1, sin(a) * {sg} * {cosf} - cos(a) * {cg})))"
    step = f"a - (goal - a - {theta} - {h} + {d(pi)}) / ((cos(a) * {sg} * {cosf} + sin(a) * {cg}) / sin({h}) - 1)"
    return f"""
      SELECT seq, k, (degrees(clon + atan2(sin(fullaz) * sin(z) * cos(clat), cos(z) - sin(clat) * slat)) + 540) % 360 - 180 AS lon, degrees(asin(slat)) AS lat
      FROM (SELECT *, greatest(-1, least(1, sin(clat) * cos(z) + cos(clat) * sin(z) * cos(fullaz))) AS slat
      FROM (SELECT *, az + sector + {table('turn')} AS fullaz, {table('lat')} AS clat, {table('lon')} AS clon,
          2 * asin(least(1, rho / (2 * {d(isea4h.R_PRIME)} * {tanf} / (2 * (cos(plane) + {cot} * sin(plane)) * sin(atan2({tanf}, cos(az) + {cot} * sin(az)) / 2))))) AS z
      FROM (SELECT *, list_reduce(list_prepend(plane, list_transform(range(12), lambda x: CAST(x AS DOUBLE))), lambda a, x: {step}) AS az
      FROM (SELECT *, {d((isea4h.R_PRIME * isea4h.TAN_FACE) ** 2)} / (2 * (1 / tan(plane) + {cot})) AS goal
      FROM (SELECT * EXCLUDE (turned), greatest(turned - sector, 1e-15) AS plane
      FROM (SELECT *, least(floor(turned / {third}), 2) * {third} AS sector
      FROM (SELECT *, CASE WHEN atan2(px, py) < 0 THEN atan2(px, py) + {d(2 * pi)} ELSE atan2(px, py) END AS turned, sqrt(px * px + py * py) AS rho
      FROM (SELECT seq, k, face, (dx * 0.5 + dy * {d(isea4h.SIN60)}) * {d(isea4h.EDGE)} - {d(isea4h.ORIGIN_X)} AS px, (dy * 0.5 - dx * {d(isea4h.SIN60)}) * {d(isea4h.EDGE)} - {d(isea4h.ORIGIN_Y)} AS py
      FROM (SELECT seq, k, (q - 1) % 5 + CASE WHEN v >= u AND q <= 5 THEN 0 WHEN v >= u THEN 10 WHEN q <= 5 THEN 5 ELSE 15 END AS face,
          CASE WHEN v >= u THEN u - v / 2 ELSE 0.5 - (u - v / 2) END AS dx, CASE WHEN v >= u THEN v * {d(isea4h.SIN60)} ELSE {d(isea4h.SIN60)} - v * {d(isea4h.SIN60)} END AS dy
      FROM ({folded(folded(spread))}))))))))))"""


def isea4h_rings(level: int) -> str:
    """Statement (seq, ring, w, s, e, n) of hexagons away from the poles: rings are lists of {x, y}, in order.

    Longitudes of a ring are continuous; one that crosses the dateline comes once on each side.
    """
    corners = f"SELECT *, first_value(lon) OVER (PARTITION BY seq ORDER BY k) AS lon0 FROM ({isea4h_corners(level)})"
    near = "CASE WHEN lon - lon0 > 180 THEN lon - 360 WHEN lon - lon0 < -180 THEN lon + 360 ELSE lon END"
    rings = f"SELECT seq, list({{'x': x, 'y': lat}} ORDER BY k) AS ring, min(x) AS w, min(lat) AS s, max(x) AS e, max(lat) AS n FROM (SELECT seq, k, lat, {near} AS x FROM ({corners})) GROUP BY seq"
    moved = "SELECT seq, list_transform(ring, lambda p: {{'x': p.x {by}, 'y': p.y}}) AS ring, w {by} AS w, s, e {by} AS e, n FROM hexagons WHERE {where}"
    return f"WITH hexagons AS MATERIALIZED ({rings}) SELECT * FROM hexagons UNION ALL {moved.format(by='- 360', where='e > 180')} UNION ALL {moved.format(by='+ 360', where='w < -180')}"


def clip_left(ring: str, side: str) -> str:
    """Part of a ring where ``side`` (of a point p) is not negative."""
    p, q = f"{ring}[i]", f"{ring}[i % len({ring}) + 1]"
    at = lambda v: "(" + side.replace("p.x", f"{v}.x").replace("p.y", f"{v}.y") + ")"
    a, b = at(p), at(q)
    point = f"{{'x': {p}.x + {a} / ({a} - {b}) * ({q}.x - {p}.x), 'y': {p}.y + {a} / ({a} - {b}) * ({q}.y - {p}.y)}}"
    return f"flatten(list_transform(range(1, len({ring}) + 1), lambda i: CASE WHEN {a} >= 0 AND {b} < 0 THEN [{p}, {point}] WHEN {a} >= 0 THEN [{p}] WHEN {b} >= 0 THEN [{point}] ELSE [] END))"


def ring_area(ring: str) -> str:
    p, q = f"{ring}[i]", f"{ring}[i % len({ring}) + 1]"
    o = f"{ring}[1]"
    return f"abs(coalesce(list_sum(list_transform(range(1, len({ring}) + 1), lambda i: ({p}.x - {o}.x) * ({q}.y - {o}.y) - ({q}.x - {o}.x) * ({p}.y - {o}.y))), 0)) / 2"


def clipped(source: str, sides: list[str], out: str, ring: str = "ring") -> str:
    """``source`` with ``out``, the area of its ``ring`` on the left of all sides."""
    steps = [f"cut0 AS MATERIALIZED (SELECT *, {ring} AS cut FROM ({source}))"]
    for k, side in enumerate(sides):  # materialized, or each step would be written out several times in the next
        steps.append(f"cut{k + 1} AS MATERIALIZED (SELECT * REPLACE ({clip_left('cut', side)} AS cut) FROM cut{k})")
    return f"WITH {', '.join(steps)} SELECT * EXCLUDE (cut), {ring_area('cut')} AS {out} FROM cut{len(sides)}"


def isea4h_box_pairs(areas: str, level: int, box: tuple[str, str, str, str] = ("min_lon", "min_lat", "max_lon", "max_lat")) -> str:
    """Pairs of areas and hexagons whose boxes meet, with the hexagon's ring and area ``whole`` and the area ``inside`` the box."""
    w, s, e, n = box
    near = f"""SELECT a.*, h.seq, h.ring FROM (SELECT *, unnest(range(CAST(floor({s} / 2) AS BIGINT), CAST(floor({n} / 2) AS BIGINT) + 1)) AS band FROM ({areas})) a
        JOIN (SELECT *, unnest(range(CAST(floor(s / 2) AS BIGINT), CAST(floor(n / 2) AS BIGINT) + 1)) AS hband FROM ({isea4h_rings(level)})) h ON a.band = h.hband
        AND h.w < a.{e} AND h.e > a.{w} AND h.s < a.{n} AND h.n > a.{s} AND a.band = greatest(CAST(floor(a.{s} / 2) AS BIGINT), CAST(floor(h.s / 2) AS BIGINT))"""
    return clipped(f"SELECT *, {ring_area('ring')} AS whole FROM ({near})", [f"p.x - {w}", f"p.y - {s}", f"{e} - p.x", f"{n} - p.y"], "inside")
