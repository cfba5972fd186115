"""The same queries as DuckDB SQL over the relational tables, written from definitions and without the engine's plans."""

from __future__ import annotations

ATOM_NAMES = ("O", "H1", "H2")
RESIDUE_NAMES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "LEU", "LYS", "WAT")
#: A skewed cell: vectors a, b and c.
SKEWED = (60, 0, 0, 20, 55, 0, 10, 15, 50)

_ATOMS = """
li AS MATERIALIZED (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS atype FROM lineitem),
a AS MATERIALIZED (SELECT 1 + o_orderkey % 20 AS frame, o_orderkey AS mol, atype, o_orderkey * 3 + atype - 1 AS atom,
  ((o_orderkey * 7919) % 6000)::DOUBLE / 100.0::DOUBLE + (l_partkey % 41 - 20)::DOUBLE / 20.0::DOUBLE AS x,
  ((o_orderkey * 104729) % 6000)::DOUBLE / 100.0::DOUBLE + (l_suppkey % 37 - 18)::DOUBLE / 18.0::DOUBLE AS y,
  ((o_custkey * 15485863 + o_orderkey * 31) % 6000)::DOUBLE / 100.0::DOUBLE + ((l_partkey + atype) % 43 - 21)::DOUBLE / 21.0::DOUBLE AS z,
  o_orderpriority AS priority
  FROM li JOIN orders ON l_orderkey = o_orderkey WHERE atype <= 3 AND l_orderkey IN (SELECT l_orderkey FROM li WHERE atype = 3)),
sol AS MATERIALIZED (SELECT frame, mol AS smol, dense_rank() OVER (PARTITION BY frame ORDER BY mol) AS sidx, atype AS satype, atom AS satom, x AS sx, y AS sy, z AS sz FROM a WHERE mol % 97 < 3),
slv AS MATERIALIZED (SELECT frame, mol AS vmol, dense_rank() OVER (PARTITION BY frame ORDER BY mol) AS vidx, atype AS vatype, atom AS vatom, x AS vx, y AS vy, z AS vz FROM a WHERE mol % 97 >= 3),
fr AS (SELECT i AS frame, (1 + i % 4) / 4.0::DOUBLE AS w FROM (SELECT DISTINCT 1 + o_orderkey % 20 AS i FROM orders)),
nn AS (SELECT (SELECT count(DISTINCT smol) FROM sol) / 20.0::DOUBLE AS ns, (SELECT count(DISTINCT vmol) FROM slv) / 20.0::DOUBLE AS nv)"""

_MI = "({e}) - 60.0::DOUBLE * floor(({e}) / 60.0::DOUBLE + 0.5::DOUBLE)"


def _d2(a: str, b: str) -> str:
    parts = [_MI.format(e=f"{b}{c} - {a}{c}") for c in "xyz"]
    return " + ".join(f"({p}) * ({p})" for p in parts)


def _pairs(name: str, left: str, right: str, on: str, cutoff: float = 10.0, extra: str = "") -> str:
    return f"{name} AS (SELECT * FROM (SELECT l.frame AS frame{extra}, smol, sidx, satype, satom, vmol, vidx, vatype, vatom, {_d2('l.s', 'r.v')} AS d2 FROM {left} l JOIN {right} r ON {on}) WHERE d2 <= {cutoff * cutoff}::DOUBLE)"


def _argmin(name: str, pairs: str, keys: str = "frame") -> str:
    return f"""{name}_0 AS MATERIALIZED (SELECT *, sqrt(d2) AS d FROM {pairs}),
{name} AS MATERIALIZED (SELECT p.*, q.d_ref FROM (SELECT {keys}, smol, sidx, vmol, vidx, d, satom AS i, vatom AS j, satype, vatype FROM {name}_0 QUALIFY row_number() OVER (PARTITION BY {keys}, sidx, vidx ORDER BY d, satom, vatom) = 1) p
  JOIN (SELECT {keys}, sidx, vidx, min(d) FILTER (WHERE vatype = 1) AS d_ref FROM {name}_0 GROUP BY ALL) q USING ({keys}, sidx, vidx))"""


_MD = _ATOMS + ",\n" + _pairs("pr", "sol", "slv", "l.frame = r.frame") + ",\n" + _argmin("md", "pr")
_SELF = (
    _ATOMS
    + ",\nslf AS (SELECT frame, smol AS vmol, sidx AS vidx, satype AS vatype, satom AS vatom, sx AS vx, sy AS vy, sz AS vz FROM sol),\n"
    + _pairs("pr", "sol", "slf", "l.frame = r.frame AND l.sidx <> r.vidx")
    + ",\n"
    + _argmin("md", "pr")
)


def _bin(d: str) -> str:
    return f"greatest(1, ceil({d} / 0.1::DOUBLE))::BIGINT"


def _u(c: int, *key: str, seed: int = 321) -> str:
    text = "concat_ws(':', " + ", ".join([f"'{seed}'", *key]) + ")"
    return f"(('0x' || substr(md5({text}), {8 * c + 1}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(c: int, tag: str = "pick") -> str:
    return _u(c, "frame", f"'{tag}'", "k", "slot")


def _euler(b: str, g: str, t: str) -> list[list[str]]:
    cb, sb, cg, sg, ct, st = (f"{f}({x})" for x in (b, g, t) for f in ("cos", "sin"))
    return [
        [f"{cg}*{ct}", f"-{cg}*{st}", sg],
        [f"{cb}*{st}+{sb}*{sg}*{ct}", f"{cb}*{ct}-{sb}*{sg}*{st}", f"-{sb}*{cg}"],
        [f"{sb}*{st}-{cb}*{sg}*{ct}", f"{sb}*{ct}+{cb}*{sg}*{st}", f"{cb}*{cg}"],
    ]


_TURN = _euler("beta", "gamma", "theta")
_RANDOM = (
    _MD
    + f""",
refs AS MATERIALIZED (SELECT frame, k, floor({_u(0, "frame", "'ref'", "k")} * n)::BIGINT + 1 AS sidx FROM (SELECT frame, max(sidx) AS n FROM sol GROUP BY frame), generate_series(1, 2) t(k)),
mols AS (SELECT DISTINCT frame, vidx FROM slv),
bulk_0 AS (SELECT frame, k, vidx FROM refs JOIN md USING (frame, sidx) WHERE d > 8),
bulk_1 AS (SELECT * FROM bulk_0 UNION ALL SELECT frame, k, vidx FROM refs JOIN mols USING (frame) WHERE NOT EXISTS (SELECT 1 FROM bulk_0 b WHERE b.frame = refs.frame AND b.k = refs.k)),
bulk AS MATERIALIZED (SELECT frame, k, vidx, row_number() OVER (PARTITION BY frame, k ORDER BY vidx) AS rn, count(*) OVER (PARTITION BY frame, k) AS nb FROM bulk_1),
slot_0 AS (SELECT frame, k, slot, nb FROM (SELECT frame, k, max(nb) AS nb FROM bulk GROUP BY ALL) JOIN (SELECT frame, max(vidx) AS n FROM slv GROUP BY frame) USING (frame), LATERAL (SELECT unnest(generate_series(1, n)) AS slot)),
slot_1 AS (SELECT frame, k, slot, floor({_pick(0)} * nb)::BIGINT + 1 AS rn, {_pick(1)} AS fx, {_pick(2)} AS fy, {_pick(3)} AS fz, 6.283185307179586::DOUBLE * {_pick(0, "turn")} AS beta, 6.283185307179586::DOUBLE * {_pick(1, "turn")} AS gamma, 6.283185307179586::DOUBLE * {_pick(2, "turn")} AS theta FROM slot_0),
slots AS MATERIALIZED (SELECT s.*, vidx FROM slot_1 s JOIN bulk USING (frame, k, rn)),
loc_0 AS (SELECT s.frame, s.vidx, s.vatype, s.vatom, {", ".join(_MI.format(e=f"s.v{c} - r.v{c}") + f" AS u{c}" for c in "xyz")} FROM slv s JOIN slv r ON s.frame = r.frame AND s.vidx = r.vidx AND r.vatype = 1),
loc AS MATERIALIZED (SELECT frame, vidx, vatype, vatom, {", ".join(f"u{c} - avg(u{c}) OVER (PARTITION BY frame, vidx) AS u{c}" for c in "xyz")} FROM loc_0),
rp AS MATERIALIZED (SELECT frame, k, slot AS vidx, slot AS vmol, vatype, vatom, {", ".join(f"({_TURN[t][0]})*ux+({_TURN[t][1]})*uy+({_TURN[t][2]})*uz+f{c}*60.0::DOUBLE AS v{c}" for t, c in enumerate("xyz"))} FROM slots JOIN loc USING (frame, vidx)),
rsol AS MATERIALIZED (SELECT frame, k, smol, sidx, satype, satom, sx, sy, sz FROM sol JOIN refs USING (frame, sidx)),
"""
    + _pairs("rpr", "rsol", "rp", "l.frame = r.frame AND l.k = r.k", extra=", l.k AS k")
    + ",\n"
    + _argmin("rmd", "rpr", "frame, k")
)
_RESULT = (
    _RANDOM
    + f""",
c_md AS (SELECT {_bin("d")} AS bin, count(*)::DOUBLE AS n FROM md GROUP BY 1), c_rdf AS (SELECT {_bin("d_ref")} AS bin, count(*)::DOUBLE AS n FROM md WHERE d_ref IS NOT NULL GROUP BY 1),
c_rmd AS (SELECT {_bin("d")} AS bin, count(*)::DOUBLE AS n FROM rmd GROUP BY 1), c_rrdf AS (SELECT {_bin("d_ref")} AS bin, count(*)::DOUBLE AS n FROM rmd WHERE d_ref IS NOT NULL GROUP BY 1),
b0 AS (SELECT i AS bin, cbrt(0.5::DOUBLE * (i * 0.1::DOUBLE * i * 0.1::DOUBLE * i * 0.1::DOUBLE + (i - 1) * 0.1::DOUBLE * (i - 1) * 0.1::DOUBLE * (i - 1) * 0.1::DOUBLE)) AS d FROM generate_series(1, 100) t(i)),
b1 AS (SELECT b0.bin, d, coalesce(c_md.n, 0) / (ns * 20) AS md_count, coalesce(c_rdf.n, 0) / (ns * 20) AS rdf_count, coalesce(c_rmd.n, 0) / 40.0::DOUBLE AS md_raw, coalesce(c_rrdf.n, 0) / 40.0::DOUBLE AS rdf_raw, ns, nv FROM b0 CROSS JOIN nn LEFT JOIN c_md USING (bin) LEFT JOIN c_rdf USING (bin) LEFT JOIN c_rmd USING (bin) LEFT JOIN c_rrdf USING (bin)),
b2 AS (SELECT *, 216000.0::DOUBLE * rdf_raw / nv AS shell_volume FROM b1),
sc AS MATERIALIZED (SELECT 216000.0::DOUBLE AS volume_total, sum(shell_volume) FILTER (WHERE bin < 81) AS volume_domain, sum(shell_volume) FILTER (WHERE bin >= 81) AS volume_bulk, any_value(nv) / 216000.0::DOUBLE AS density_solvent, any_value(ns) / 216000.0::DOUBLE AS density_solute, CASE WHEN sum(shell_volume) FILTER (WHERE bin >= 81) <> 0 THEN sum(rdf_count) FILTER (WHERE bin >= 81) / sum(shell_volume) FILTER (WHERE bin >= 81) WHEN sum(rdf_count) FILTER (WHERE bin >= 81) > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS density_solvent_bulk, any_value(nv) AS nv, any_value(ns) AS ns FROM b2),
b3 AS (SELECT bin, d, md_count, rdf_count, shell_volume, md_raw * density_solvent_bulk / density_solvent AS md_count_random, rdf_raw * density_solvent_bulk / density_solvent AS rdf_count_random, density_solvent_bulk FROM b2 CROSS JOIN sc),
b4 AS (SELECT *, sum(md_count) OVER w AS coordination_number, sum(md_count_random) OVER w AS coordination_number_random, sum(rdf_count) OVER w AS sum_rdf_count, sum(rdf_count_random) OVER w AS sum_rdf_count_random FROM b3 WINDOW w AS (ORDER BY bin)),
bins AS MATERIALIZED (SELECT *, CASE WHEN md_count_random > 0 THEN md_count / md_count_random ELSE 0 END AS mddf, CASE WHEN rdf_count_random > 0 THEN rdf_count / rdf_count_random ELSE 0 END AS rdf, 0.6022140857::DOUBLE / density_solvent_bulk * (coordination_number - coordination_number_random) AS kb, 0.6022140857::DOUBLE / density_solvent_bulk * (sum_rdf_count - sum_rdf_count_random) AS kb_rdf FROM b4)"""
)


def _groups(of: str) -> str:
    """Group rows of md and rmd; of: an expression of the atom and its type."""
    side = lambda t: f"SELECT 'solute' AS side, {of.format(atom='i', atype='satype')} AS group_id, {_bin('d')} AS bin FROM {t} UNION ALL SELECT 'solvent', {of.format(atom='j', atype='vatype')}, {_bin('d')} FROM {t}"
    return f""",
g_md AS (SELECT side, group_id, bin, count(*) / (SELECT ns * 20 FROM nn) AS n FROM ({side("md")}) GROUP BY ALL),
g_rmd AS (SELECT side, group_id, bin, count(*) / 40.0::DOUBLE * (SELECT density_solvent_bulk / density_solvent FROM sc) AS n_random FROM ({side("rmd")}) GROUP BY ALL),
gr AS MATERIALIZED (SELECT side, group_id, bin, coalesce(n, 0) AS n, coalesce(n_random, 0) AS n_random FROM g_md FULL JOIN g_rmd USING (side, group_id, bin))"""


_BY_TYPE = _RESULT + _groups("{atype}")
_BY_PRIORITY = _RESULT + _groups("(SELECT substr(priority, 1, 1)::INT FROM a a2 WHERE a2.atom = {atom} LIMIT 1)")
_BY_RESIDUE = _RESULT + _groups("(1 + (({atom} // 3) % 7))")


def _numbers(names: str) -> str:
    """Columns of a select: name:i as bigint, name:r as a rounded double, name as it is."""
    out = []
    for x in names.split():
        name, _, kind = x.partition(":")
        out.append({"i": f"CAST({name} AS BIGINT) AS {name}", "r": f"round(CAST({name} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"}.get(kind, name))
    return ", ".join(out)


def _sql(ctes: str, columns: str, source: str) -> str:
    return f"WITH {ctes.strip()}\nSELECT {_numbers(columns)} FROM {source}" if ctes else f"SELECT {_numbers(columns)} FROM {source}"


def _contribution(ctes: str, where: str, kind: str, share: str = "1") -> str:
    value = {"mddf": "CASE WHEN md_count_random > 0 THEN n / md_count_random ELSE 0 END", "md_count": "n", "coordination_number": "sum(n) OVER (ORDER BY bin)", "kbi": "0.6022140857::DOUBLE / density_solvent_bulk * (sum(n) OVER (ORDER BY bin) - sum(n_random) OVER (ORDER BY bin))"}[kind]
    own = f"(SELECT bin, sum(n) / {share} AS n, sum(n_random) / {share} AS n_random FROM gr WHERE {where} GROUP BY bin)"
    rows = f"(SELECT bin, d, md_count_random, density_solvent_bulk, coalesce(n, 0) AS n, coalesce(n_random, 0) AS n_random FROM bins LEFT JOIN {own} USING (bin))"
    return _sql(ctes, "bin:i d:r value:r", f"(SELECT bin, d, {value} AS value FROM {rows})")


_MAP = (
    _BY_RESIDUE
    + f""",
res AS (SELECT i AS residue_pos, 100 + i AS resnum, [{", ".join(f"'{x}'" for x in ("A", "R", "N", "D", "C", "Q", "E"))}][i] || (100 + i) AS label FROM generate_series(1, 7) t(i)),
m0 AS (SELECT residue_pos, resnum, label, bin, d, coalesce(n, 0) AS n FROM res CROSS JOIN bins LEFT JOIN (SELECT * FROM gr WHERE side = 'solute') g ON g.group_id = residue_pos AND g.bin = bins.bin),
m1 AS (SELECT residue_pos, resnum, label, bin, d, n AS md_count, sum(n) OVER (PARTITION BY residue_pos ORDER BY bin) AS cn FROM (SELECT residue_pos, resnum, label, bin, d, n FROM m0)),
mp AS MATERIALIZED (SELECT * FROM m1 WHERE bin >= (SELECT min(bin) FROM bins WHERE d > 2) AND bin <= (SELECT min(bin) FROM bins WHERE d > 7))"""
).replace("residue_pos, resnum, label, bin, d, coalesce(n, 0) AS n FROM res CROSS JOIN bins", "residue_pos, resnum, label, bins.bin AS bin, d, coalesce(n, 0) AS n FROM res CROSS JOIN bins")
_RC = "residue_pos:i resnum:i label bin:i d:r value:r"


def _rc(value: str, where: str = "true") -> str:
    return _sql(_MAP, _RC, f"(SELECT residue_pos, resnum, label, bin, d, {value} AS value FROM mp WHERE {where})")


def _labelled() -> str:
    names = "[" + ", ".join(f"'{x}'" for x in ATOM_NAMES) + "]"
    residues = "[" + ", ".join(f"'{x}'" for x in RESIDUE_NAMES) + "]"
    return _ATOMS + f",\nlb AS (SELECT atom AS atom_index, {names}[atype] AS name, {residues}[mol % {len(RESIDUE_NAMES)} + 1] AS resname, mol % 1000 AS resnum, substr('ABCDE', (mol % 5 + 1)::INT, 1) AS chain FROM a)"


def _fraction(row: tuple[float, float, float], *e: str) -> str:
    return " + ".join(f"({x}::DOUBLE) * ({y})" for x, y in zip(row, e, strict=True))


def _cells() -> str:
    rad = "pi() / 180"
    rows = "(SELECT i AS cell, 30.0::DOUBLE + i % 7 AS a, 40.0::DOUBLE + i % 5 AS b, 50.0::DOUBLE + i % 3 AS c, 90.0::DOUBLE AS alpha, 90.0::DOUBLE + i % 4 * 5.0::DOUBLE AS beta, 90.0::DOUBLE + i % 4 * 7.5::DOUBLE AS gamma FROM (SELECT vec_id + 1 AS i FROM embeddings))"
    return f"(SELECT cell, a * b * c * sqrt(1 - cos(alpha * {rad}) * cos(alpha * {rad}) - cos(beta * {rad}) * cos(beta * {rad}) - cos(gamma * {rad}) * cos(gamma * {rad}) + 2 * cos(alpha * {rad}) * cos(beta * {rad}) * cos(gamma * {rad})) AS volume, CASE WHEN beta = 90 AND gamma = 90 THEN 1 ELSE 0 END AS is_ortho FROM {rows})"


def _merge() -> str:
    half = f"""
q AS (SELECT sum(w) FILTER (WHERE frame <= 8) AS q1, 12.0::DOUBLE AS q2 FROM fr),
h AS (SELECT {_bin("d")} AS bin, sum(CASE WHEN frame <= 8 THEN w ELSE 1 END) AS n FROM md JOIN fr USING (frame) GROUP BY 1),
hr AS (SELECT {_bin("d_ref")} AS bin, sum(CASE WHEN frame <= 8 THEN w ELSE 1 END) AS n FROM md JOIN fr USING (frame) WHERE d_ref IS NOT NULL GROUP BY 1),
b0 AS (SELECT i AS bin, cbrt(0.5::DOUBLE * (power(i * 0.1::DOUBLE, 3) + power((i - 1) * 0.1::DOUBLE, 3))) AS d FROM generate_series(1, 100) t(i)),
mg AS (SELECT bin, d, coalesce(h.n, 0) / (ns * (q1 + q2)) AS md_count, coalesce(hr.n, 0) / (ns * (q1 + q2)) AS rdf_count FROM b0 CROSS JOIN nn CROSS JOIN q LEFT JOIN h USING (bin) LEFT JOIN hr USING (bin))"""
    return _sql(_MD + "," + half, "bin:i d:r md_count:r rdf_count:r coordination_number:r", "(SELECT *, sum(md_count) OVER (ORDER BY bin) AS coordination_number FROM mg)")


def _grid() -> str:
    more = """,
atm AS MATERIALIZED (SELECT satom, sx, sy, sz, satype FROM sol WHERE frame = 1),
bx AS (SELECT min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1, min(sz) AS z0, max(sz) AS z1 FROM atm),
pt AS (SELECT ix, iy, iz, x0 - 4 + 2.0::DOUBLE * (ix - 1) AS gx, y0 - 4 + 2.0::DOUBLE * (iy - 1) AS gy, z0 - 4 + 2.0::DOUBLE * (iz - 1) AS gz FROM bx, LATERAL (SELECT unnest(generate_series(1, ceil((x1 - x0 + 8) / 2.0::DOUBLE + 1)::BIGINT)) AS ix), LATERAL (SELECT unnest(generate_series(1, ceil((y1 - y0 + 8) / 2.0::DOUBLE + 1)::BIGINT)) AS iy), LATERAL (SELECT unnest(generate_series(1, ceil((z1 - z0 + 8) / 2.0::DOUBLE + 1)::BIGINT)) AS iz)),
nr AS (SELECT *, sqrt((sx - gx) * (sx - gx) + (sy - gy) * (sy - gy) + (sz - gz) * (sz - gz)) AS r FROM pt, atm),
cl AS MATERIALIZED (SELECT ix, iy, iz, gx, gy, gz, satom AS atom, satype, r FROM nr WHERE r <= 4 QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY r, satom) = 1),
cv AS (SELECT g.satype, bins.bin, d, sum(coalesce(n, 0)) OVER (PARTITION BY g.satype ORDER BY bins.bin) AS v FROM (SELECT DISTINCT group_id AS satype FROM gr WHERE side = 'solute') g CROSS JOIN bins LEFT JOIN (SELECT * FROM gr WHERE side = 'solute') o ON o.group_id = g.satype AND o.bin = bins.bin),
st AS (SELECT satype, d, v, lag(d) OVER w AS d0, lag(v) OVER w AS v0 FROM cv WINDOW w AS (PARTITION BY satype ORDER BY bin)),
gp AS (SELECT cl.*, v0 + (v - v0) / (d - d0) * (r - d0) AS c FROM cl JOIN st ON cl.satype = st.satype AND d0 <= r AND r < d WHERE r > 1.5 AND r < 4),
gs AS (SELECT *, CASE WHEN max(c) OVER () > min(c) OVER () THEN (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) ELSE 0 END AS value FROM gp WHERE c > 0)"""
    return _sql(_BY_TYPE + more, "ix:i iy:i iz:i gx:r gy:r gz:r atom:i r:r value:r", "gs")


#: A line is open, and begins where no segment ends, or closed.  Closed ones need a walk: each point takes the least that it reaches.
_COUNTED = """(SELECT level, count(*) AS segments, (SELECT count(DISTINCT least) FROM comp WHERE comp.level = seg.level) AS lines FROM seg GROUP BY level)"""


def _contours(columns: str, source: str) -> str:
    """Marching squares over the map with five levels; ``comp``: the least point of each point's line."""
    cases = "(1,'BL'),(2,'RB'),(3,'RL'),(4,'TR'),(6,'TB'),(7,'TL'),(8,'LT'),(9,'BT'),(11,'RT'),(12,'LR'),(13,'BR'),(14,'LB'),(21,'BR'),(21,'TL'),(5,'BL'),(5,'TR'),(26,'LB'),(26,'RT'),(10,'RB'),(10,'LT')"
    key = lambda s: f"CASE {s} WHEN 'B' THEN 'h:' || i || ':' || b WHEN 'T' THEN 'h:' || i || ':' || b + 1 WHEN 'L' THEN 'v:' || i || ':' || b ELSE 'v:' || i + 1 || ':' || b END"
    x = lambda s: f"CASE {s} WHEN 'B' THEN i + (lv - v1) / (v2 - v1) WHEN 'T' THEN i + (lv - v8) / (v4 - v8) WHEN 'L' THEN i ELSE i + 1 END"
    y = lambda s: f"CASE {s} WHEN 'B' THEN d WHEN 'T' THEN e WHEN 'L' THEN d + (e - d) * (lv - v1) / (v8 - v1) ELSE d + (e - d) * (lv - v2) / (v4 - v2) END"
    more = f""",
lim AS (SELECT min(cn) AS lo, max(cn) AS hi FROM mp),
lvl AS (SELECT k AS level, lo + (hi - lo) * (k - 0.5::DOUBLE) / 5 AS lv FROM lim, generate_series(1, 5) t(k) WHERE hi > lo),
cel AS (SELECT p.residue_pos AS i, p.bin AS b, p.d AS d, s.d AS e, p.cn AS v1, q.cn AS v2, r.cn AS v4, s.cn AS v8, level, lv
  FROM mp p JOIN mp q ON q.residue_pos = p.residue_pos + 1 AND q.bin = p.bin JOIN mp r ON r.residue_pos = p.residue_pos + 1 AND r.bin = p.bin + 1
  JOIN mp s ON s.residue_pos = p.residue_pos AND s.bin = p.bin + 1, lvl),
num AS (SELECT *, (v1 >= lv)::INT + 2 * (v2 >= lv)::INT + 4 * (v4 >= lv)::INT + 8 * (v8 >= lv)::INT AS c, (v1 + v2 + v4 + v8) / 4 >= lv AS m FROM cel),
seg AS MATERIALIZED (SELECT level, {key("w[1]")} AS a, {key("w[2]")} AS b, {x("w[1]")} AS x0, {y("w[1]")} AS d0, {x("w[2]")} AS x1, {y("w[2]")} AS d1
  FROM num JOIN (VALUES {cases}) t(n, w) ON n = CASE WHEN c IN (5, 10) AND m THEN c + 16 ELSE c END),
lnk AS MATERIALIZED (SELECT level, a AS p, b AS q FROM seg UNION SELECT level, b, a FROM seg UNION SELECT level, a, a FROM seg UNION SELECT level, b, b FROM seg),
reach AS (SELECT level, p, q FROM lnk UNION SELECT r.level, r.p, l.q FROM reach r JOIN lnk l ON l.level = r.level AND l.p = r.q),
comp AS MATERIALIZED (SELECT level, p, min(q) AS least FROM reach GROUP BY level, p)"""
    # The walk over all pairs of a line's points is for the count alone.
    text = _sql(_MAP + (more if source == _COUNTED else more[: more.index(",\nlnk AS")]), columns, source)
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if source == _COUNTED else text


def _skewed_pairs(cutoff: float) -> str:
    """Pairs in the skewed cell: of the 27 images around the rounded difference at most one is in range."""
    m = SKEWED
    v = m[0] * m[4] * m[8]  # the cell is lower triangular
    fz = f"dz / {m[8]}.0::DOUBLE"
    fy = f"(dy - ({fz}) * {m[7]}) / {m[4]}.0::DOUBLE"
    fx = f"(dx - ({fy}) * {m[3]} - ({fz}) * {m[6]}) / {m[0]}.0::DOUBLE"
    assert v > 0 and not any(m[k] for k in (1, 2, 5))
    part = lambda t: f"(a + i) * {m[t]} + (b + j) * {m[3 + t]} + (c + k) * {m[6 + t]}"
    differences = "SELECT l.frame AS frame, satom, vatom, vx - sx AS dx, vy - sy AS dy, vz - sz AS dz FROM sol l JOIN slv r ON l.frame = r.frame"
    rounded = f"SELECT frame, satom, vatom, f1 - floor(f1 + 0.5) AS a, f2 - floor(f2 + 0.5) AS b, f3 - floor(f3 + 0.5) AS c FROM (SELECT *, {fx} AS f1, {fy} AS f2, {fz} AS f3 FROM ({differences}))"
    images = "(SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)"
    d2 = " + ".join(f"({part(t)}) * ({part(t)})" for t in range(3))
    return _sql(_ATOMS, "frame:i satom:i vatom:i d:r", f"(SELECT frame, satom, vatom, sqrt(d2) AS d FROM (SELECT frame, satom, vatom, {d2} AS d2 FROM ({rounded}), {images}) WHERE d2 <= {cutoff * cutoff})")


def _scanned(kind: str, parts: int, chosen: str) -> str:
    """Coordinates that a file holds as ``kind``, in whole parts of an Å, and the cells' volumes."""
    at = lambda k: f"round((embedding[atom_index * 3 - {k}]::DOUBLE * 10.0)::{kind}::DOUBLE * {parts})::BIGINT"
    return (
        f"SELECT frame, atom_index, {at(2)} AS x, {at(1)} AS y, {at(0)} AS z, round(((30 + frame % 7) * (30 + frame % 5) * (30 + label))::DOUBLE, 2) AS volume"
        f" FROM (SELECT vec_id + 1 AS frame, embedding, label, unnest(range(1, 22)) AS atom_index FROM embeddings) WHERE {chosen}"
    )


def all_sql() -> dict[str, str]:
    lb, deg = _labelled(), "pi() / 180"
    group = lambda ctes, of, cols="side group_id:i bin:i n:r": _sql(ctes, cols, f"(SELECT side, group_id, bin, sum(w) AS n FROM (SELECT 'solute' AS side, {of.format(atom='i', atype='satype')} AS group_id, {_bin('d')} AS bin, 1.0::DOUBLE AS w FROM md UNION ALL SELECT 'solvent', {of.format(atom='j', atype='vatype')}, {_bin('d')}, 1.0 FROM md) GROUP BY ALL)")
    q: dict[str, str] = {}
    q["sel_name"] = _sql(lb, "atom_index:i name", "lb WHERE name IN ('O', 'H2')")
    q["sel_resname"] = _sql(lb, "atom_index:i resname", "lb WHERE resname IN ('ALA', 'WAT', 'ASP', 'GLU')")
    q["sel_range"] = _sql(lb, "atom_index:i resnum:i chain", "lb WHERE resnum BETWEEN 100 AND 249 AND chain IN ('A', 'B')")
    q["sel_bool"] = _sql(lb, "atom_index:i name resname resnum:i", "lb WHERE resname NOT IN ('WAT', 'ALA', 'LEU') AND (name = 'H1' OR atom_index <= 30000) AND resnum NOT IN (7, 8, 9)")
    q["molecule_index"] = _sql(_ATOMS, "atom_index:i pos:i mol:i atype:i", "(SELECT atom AS atom_index, pos, (pos - 1) // 3 + 1 AS mol, (pos - 1) % 3 + 1 AS atype FROM (SELECT atom, row_number() OVER (ORDER BY atom) AS pos FROM a))")
    q["atom_group"] = _sql(_ATOMS, "group_id:i atom:i", "(SELECT 2 AS group_id, atom FROM a WHERE priority = '2-HIGH' AND mol % 97 < 3)")
    q["atom_group_names"] = _sql(_ATOMS, "group_id:i group_name", "(SELECT DISTINCT substr(priority, 1, 1) AS group_id, priority AS group_name FROM a WHERE mol % 97 >= 3)")
    q["pruned_scan"] = _sql(_ATOMS, "frame:i satom:i sx:r sy:r sz:r", "sol WHERE frame BETWEEN 3 AND 5")
    q["frame_stride"] = _sql(_ATOMS, "frame:i n_atoms:i", "(SELECT frame, count(*) AS n_atoms FROM slv WHERE frame IN (2, 7, 12, 17) GROUP BY frame)")
    q["frame_weights"] = _sql(_ATOMS, "frame:i w:r", "fr WHERE frame <> 4")
    q["irefatom"] = _sql(_ATOMS, "vmol:i irefatom:i", "(SELECT vmol, arg_min(vatype, round(r, 9) * 10 + vatype * 1e-10) AS irefatom FROM (SELECT vmol, vatype, power(vx - avg(vx) OVER (), 2) + power(vy - avg(vy) OVER (), 2) + power(vz - avg(vz) OVER (), 2) AS r FROM slv WHERE frame = 1 AND vidx = 1) GROUP BY vmol)")
    q["cell_volume"] = _sql("", "cell:i volume:r", _cells())
    q["cell_kind"] = _sql("", "cell:i is_ortho:i", _cells())
    q["avg_volume"] = _sql(_ATOMS, "q:r volume:r n_frames:i", "(SELECT sum(w) AS q, sum(w * 216000) / sum(w) AS volume, count(*) AS n_frames FROM fr)")
    q["range_join"] = _sql(_ATOMS + ",\n" + _pairs("pr", "sol", "slv", "l.frame = r.frame", 4.0), "frame:i satom:i vatom:i d:r", "(SELECT *, sqrt(d2) AS d FROM pr)")
    q["min_distance"] = _sql(_MD, "frame:i smol:i vmol:i d:r i:i j:i", "md")
    q["ref_atom_distance"] = _sql(_MD, "frame:i smol:i vmol:i d_ref:r", "md WHERE d_ref IS NOT NULL")
    q["mddf_self"] = _sql(_SELF, "frame:i smol:i vmol:i d:r i:i j:i", "md")
    q["histogram"] = _sql(_MD, "bin:i n:r", f"(SELECT {_bin('d')} AS bin, sum(w) AS n FROM md JOIN fr USING (frame) GROUP BY 1)")
    q["md_count"] = _sql(_RESULT, "bin:i md_count:r", "bins")
    q["rdf_count"] = _sql(_RESULT, "bin:i rdf_count:r", "bins")
    q["md_count_random"] = _sql(_RANDOM, "bin:i md_count_random:r rdf_count_random:r", f"(SELECT bin, sum(x) AS md_count_random, sum(y) AS rdf_count_random FROM (SELECT {_bin('d')} AS bin, 1 AS x, 0 AS y FROM rmd UNION ALL SELECT {_bin('d_ref')}, 0, 1 FROM rmd WHERE d_ref IS NOT NULL) GROUP BY bin)")
    q["group_counts_atom"] = group(_MD, "{atype}")
    q["group_counts_custom"] = group(_MD, "(SELECT substr(priority, 1, 1)::INT FROM a a2 WHERE a2.atom = {atom} LIMIT 1)")
    q["group_counts_self"] = _sql(_SELF, "side group_id:i bin:i n:r", f"(SELECT side, group_id, bin, n FROM (SELECT group_id, bin, count(*) / 2.0::DOUBLE AS n FROM (SELECT satype AS group_id, {_bin('d')} AS bin FROM md UNION ALL SELECT vatype, {_bin('d')} FROM md) GROUP BY ALL), (VALUES ('solute'), ('solvent')) s(side))")
    q["coordination_number"] = _sql(_RESULT, "bin:i d:r md_count:r coordination_number:r sum_rdf_count:r", "bins")
    q["range_join_lcell"] = q["range_join"]
    q["range_join_triclinic"] = _skewed_pairs(4.0)
    q["uniforms"] = _sql("", "key:i u0:r u1:r u2:r u3:r", "(SELECT key, " + ", ".join(f"{_u(c, 'key', repr('test'))} AS u{c}" for c in range(4)) + " FROM (SELECT o_orderkey AS key FROM orders))")
    q["ref_solutes"] = _sql(_RANDOM, "frame:i k:i sidx:i", "refs")
    q["bulk_molecules"] = _sql(_RANDOM, "frame:i k:i vidx:i rn:i nb:i", "bulk")
    q["bulk_resample"] = _sql(_RANDOM, "frame:i k:i slot:i vidx:i", "slots")
    q["unwrap"] = _sql(_RANDOM, "frame:i vatom:i ux:r uy:r uz:r", "loc")
    q["random_move"] = _sql(_RANDOM, "frame:i k:i slot:i vatype:i vx:r vy:r vz:r", "(SELECT *, vidx AS slot FROM rp)")
    e = _euler("b", "g", "t")
    q["eulermat"] = _sql("", "key:i " + " ".join(f"a{i}{j}:r" for i in (1, 2, 3) for j in (1, 2, 3)), "(SELECT key, " + ", ".join(f"{e[i][j]} AS a{i + 1}{j + 1}" for i in range(3) for j in range(3)) + " FROM (SELECT key, " + ", ".join(f"{_u(c, 'key', seed=7)} * 360 * {deg} AS {n}" for c, n in enumerate("bgt")) + " FROM (SELECT p_partkey AS key FROM part)))")
    q["shell_volume"] = _sql("", "bin:i shell_volume:r", "(SELECT i AS bin, 4 * pi() / 3 * (power(i * 0.1::DOUBLE, 3) - power((i - 1) * 0.1::DOUBLE, 3)) AS shell_volume FROM generate_series(1, 100) t(i))")
    q["shell_radius"] = _sql("", "bin:i shell_radius:r", "(SELECT i AS bin, cbrt(0.5::DOUBLE * (power(i * 0.1::DOUBLE, 3) + power((i - 1) * 0.1::DOUBLE, 3))) AS shell_radius FROM generate_series(1, 100) t(i))")
    q["report_format"] = _sql("", "key:i text", "(SELECT key, CASE WHEN abs(x) < 998 THEN printf('%12.7f', x) ELSE printf('%12.5e', x) END AS text FROM (SELECT o_orderkey AS key, (o_totalprice - 150000.0::DOUBLE) / (sqrt(2.0::DOUBLE) * (1 + o_orderkey % 1000)) AS x FROM orders))")
    code = "CASE resname " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in zip(RESIDUE_NAMES, "ARNDCQEGHLK", strict=False)) + " ELSE resname END"
    q["residue_labels"] = _sql(lb, "resname resnum:i label", f"(SELECT DISTINCT resname, resnum, {code} || resnum AS label FROM lb)")
    for key, columns in {"mddf": "mddf:r coordination_number:r", "rdf": "rdf:r sum_rdf_count:r", "kb": "kb:r coordination_number_random:r", "kb_rdf": "kb_rdf:r sum_rdf_count_random:r", "shell_volumes_mc": "shell_volume:r"}.items():
        q[key] = _sql(_RESULT, f"bin:i d:r {columns}", "bins")
    q["volumes"] = _sql(_RESULT, "volume_total:r volume_domain:r volume_bulk:r", "sc")
    q["densities"] = _sql(_RESULT, "density_solvent:r density_solute:r density_solvent_bulk:r", "sc")
    q["gr"] = _sql(_RESULT, "bin:i d:r gr:r kb:r", "(SELECT *, 0.6022140857::DOUBLE * sum(4 * pi() * (gr - 1) * d * d * 0.1::DOUBLE) OVER (ORDER BY bin) AS kb FROM (SELECT bin, d, rdf_count / (4 * pi() / 3 * (power(bin * 0.1::DOUBLE, 3) - power((bin - 1) * 0.1::DOUBLE, 3))) / density_solvent_bulk AS gr FROM bins))")
    q["tail_stats"] = _sql(_RESULT, "mddf_mean:r mddf_std:r rdf_mean:r rdf_std:r", "(SELECT avg(mddf) AS mddf_mean, stddev_samp(mddf) AS mddf_std, avg(rdf) AS rdf_mean, stddev_samp(rdf) AS rdf_std FROM bins WHERE bin >= 90)")
    per_l = "1e27 / 6.022140857e23"
    q["overview"] = _sql(_RESULT, "solute_mol_per_l:r solvent_mol_per_l:r solvent_bulk_mol_per_l:r solvent_molar_volume:r solvent_molar_volume_bulk:r solute_molar_volume:r domain_molar_volume:r", f"(SELECT density_solute * {per_l} AS solute_mol_per_l, density_solvent * {per_l} AS solvent_mol_per_l, density_solvent_bulk * {per_l} AS solvent_bulk_mol_per_l, 1000 / (density_solvent * {per_l}) AS solvent_molar_volume, 1000 / (density_solvent_bulk * {per_l}) AS solvent_molar_volume_bulk, 0.6022140857::DOUBLE * (density_solvent_bulk * volume_total - nv) / density_solvent_bulk AS solute_molar_volume, volume_domain * 0.6022140857::DOUBLE AS domain_molar_volume FROM sc)")
    q["smooth"] = _sql(_RESULT, "bin:i d:r md_count:r md_count_smooth:r", "(SELECT *, avg(md_count) OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS md_count_smooth FROM bins)")
    q["renormalize"] = _sql(_RESULT, "bin:i mddf:r kb:r rdf:r", "(SELECT bin, CASE WHEN x > 0 THEN md_count / x ELSE 0 END AS mddf, CASE WHEN y > 0 THEN rdf_count / y ELSE 0 END AS rdf, 0.6022140857::DOUBLE / density_solvent_bulk * (coordination_number - sum(x) OVER (ORDER BY bin)) AS kb FROM (SELECT *, md_count_random * (5 * 6.022140857e23 / 1e27) / density_solvent_bulk AS x, rdf_count_random * (5 * 6.022140857e23 / 1e27) / density_solvent_bulk AS y FROM bins))")
    q["merge"] = _merge()
    q["merge_weights"] = _sql("", "file n_frames:i weight:r", "(SELECT file, n_frames, n_frames / sum(n_frames) OVER () AS weight FROM (SELECT o_orderpriority AS file, count(*) AS n_frames FROM orders GROUP BY 1))")
    q["contrib_mddf"] = _contribution(_BY_TYPE, "side = 'solute' AND group_id IN (1, 2)", "mddf")
    q["contrib_md_count"] = _contribution(_BY_TYPE, "side = 'solvent' AND group_id = 2", "md_count")
    q["contrib_cn"] = _contribution(_BY_TYPE, "side = 'solvent' AND group_id IN (1, 3)", "coordination_number")
    q["contrib_kbi"] = _contribution(_BY_TYPE, "side = 'solute' AND group_id = 3", "kbi")
    q["contrib_group"] = _contribution(_BY_PRIORITY, "side = 'solute' AND group_id = 2", "md_count")
    q["contrib_atoms"] = _contribution(_BY_TYPE, "side = 'solvent' AND group_id IN (1, 2)", "coordination_number", "(SELECT count(DISTINCT vmol) FROM slv)")
    q["contrib_names"] = _contribution(_BY_TYPE, "side = 'solvent' AND group_id IN (2, 3)", "mddf")
    q["residue_map"] = _rc("md_count")
    q["rc_add"] = _rc("md_count + cn")
    q["rc_sub"] = _rc("cn - md_count")
    q["rc_mul"] = _rc("cn * md_count")
    q["rc_div"] = _rc("CASE WHEN cn <> 0 THEN md_count / cn ELSE 0 END")
    q["rc_scale"] = _rc("2 * md_count / 5")
    q["rc_slice"] = _rc("cn", "residue_pos IN (1, 3, 5)")
    q["rc_findmax"] = _sql(_MAP, "residue_pos:i value:r bin:i", "(SELECT residue_pos, md_count AS value, bin FROM mp QUALIFY row_number() OVER (PARTITION BY residue_pos ORDER BY md_count DESC, bin) = 1)")
    q["rc_extrema"] = _sql(_MAP, "least:r largest:r", "(SELECT min(cn) AS least, max(cn) AS largest FROM mp)")
    q["rc_plot_data"] = _sql(_MAP, _RC + " tick", "(SELECT residue_pos, resnum, label, bin, d, cn AS value, CASE WHEN residue_pos % 4 = 1 THEN label END AS tick FROM mp WHERE residue_pos % 2 = 1)")
    q["rc_contours"] = _contours("level:i a b x0:r d0:r x1:r d1:r", "seg")
    q["rc_contour_lines"] = _contours("level:i lines:i segments:i", _COUNTED)
    q["grid3d"] = _grid()
    printed = ", ".join(f"round(CASE WHEN abs({c}) < 998 THEN printf('%.7f', {c})::DOUBLE ELSE printf('%.5e', {c})::DOUBLE END, 5) AS {c}" for c in ("d", "mddf", "kb", "md_count", "md_count_random", "coordination_number", "coordination_number_random", "shell_volume"))
    q["report_main"] = _sql(_RESULT, "bin:i d:r mddf:r kb:r md_count:r md_count_random:r coordination_number:r coordination_number_random:r shell_volume:r", f"(SELECT bin, {printed} FROM bins)")
    for key, kind, parts, chosen in (
        ("xtc_scan", "DOUBLE", 100, "true"), ("xtc_stride", "DOUBLE", 100, "frame BETWEEN 3 AND 150 AND frame % 7 = 3 AND atom_index <= 5"),
        ("dcd_scan", "FLOAT", 100, "true"), ("dcd_stride", "FLOAT", 100, "frame BETWEEN 2 AND 140 AND frame % 5 = 2 AND atom_index <= 4"), ("pdb_scan", "DOUBLE", 1000, "true"),
    ):
        q[key] = _scanned(kind, parts, chosen)
    kept = "(SELECT side, group_id, bin, n, n_random FROM (SELECT side, group_id, bin, coalesce(n, 0) AS n, coalesce(n_random, 0) AS n_random FROM gr) WHERE n <> 0 OR n_random <> 0)"
    q["load_groups"] = _sql(_BY_PRIORITY, "side group_id:i bin:i n:r n_random:r", kept)
    own = "(SELECT bins.bin, d, coalesce(n, 0) AS value, mddf, kb_rdf, volume_bulk FROM bins CROSS JOIN sc LEFT JOIN (SELECT bin, n FROM gr WHERE side = 'solute' AND group_id = 2) g ON g.bin = bins.bin)"
    q["load_legacy"] = _sql(_BY_PRIORITY, "bin:i d:r value:r mddf:r kb_rdf:r volume_bulk:r", own)
    q["report_groups"] = _sql(_BY_TYPE, "bin:i d:r group_1:r group_2:r group_3:r", "(SELECT bins.bin, any_value(d) AS d, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE group_id = {k}), 0) AS group_{k}" for k in (1, 2, 3)) + " FROM bins LEFT JOIN (SELECT * FROM gr WHERE side = 'solvent') g ON g.bin = bins.bin GROUP BY bins.bin)")
    return q
