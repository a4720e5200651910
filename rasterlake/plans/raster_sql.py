"""SQL fragments for neighbourhoods, shared by the raster oracles."""

from __future__ import annotations


def nb(src: str, out: str, cols: list[str], clamp: bool = True, key: str = "image_id") -> str:
    """CTE ``out``: all columns of ``src`` and ``{dir}_{col}`` neighbours."""
    own = (lambda e, c: f"coalesce({e}, {c})") if clamp else (lambda e, c: e)
    wr, wc = f"(PARTITION BY {key}, y ORDER BY x)", f"(PARTITION BY {key}, x ORDER BY y)"
    h = ", ".join(f"{own(f'lag({c}) OVER {wr}', c)} AS w_{c}, {own(f'lead({c}) OVER {wr}', c)} AS e_{c}" for c in cols)
    parts = []
    for c in cols:
        for d, fn in (("n", "lag"), ("s", "lead")):
            parts += [f"{own(f'{fn}({c}) OVER {wc}', c)} AS {d}_{c}"]
            parts += [f"{own(f'{fn}({s}_{c}) OVER {wc}', f'{s}_{c}')} AS {d}{s}_{c}" for s in ("w", "e")]
    return f"{out}_h AS (SELECT *, {h} FROM {src}), {out} AS (SELECT *, {', '.join(parts)} FROM {out}_h)"


EIGHT = ("e", "w", "s", "n", "se", "sw", "ne", "nw")
FOUR = EIGHT[:4]

LINE = "(CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def obs_sql(src: str = "rgba8") -> str:
    """CTE ``ob``: encoded observation vector and cells of ``rgba8``."""
    c = 1 / 255
    step = f"{c!r}::DOUBLE"
    val = lambda ch: f"({ch} * {step})"
    cols = [f"{val(ch)} * (a * {step}) AS p{ch}" for ch in "rgb"] + [f"a * {step} AS pa"]
    st = lambda ch: f"greatest(abs({val(ch)} - {val(f'greatest({ch} - 1, 0)')}), abs({val(f'least({ch} + 1, 255)')} - {val(ch)}))"
    cols += [f"{st(ch)} * 0.5 * (a * {step}) + {val(ch)} * {0.5 * c!r}::DOUBLE AS q{ch}" for ch in "rgb"] + [f"{0.5 * c!r}::DOUBLE AS qa"]
    return f"ob AS (SELECT *, {', '.join(cols)} FROM {src})"


def norm(parts: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


P = ["pr", "pg", "pb", "pa"]


def interior_sql(src: str = "rgba8") -> str:
    """CTE ``it`` with gradient, spread, alpha_variation, mixed, weight."""
    unit = f"greatest({norm(['qr', 'qg', 'qb', 'qa'])}, {0.5 / 255!r}::DOUBLE)"
    gx, gy = norm([f"e_{p} - w_{p}" for p in P]), norm([f"s_{p} - n_{p}" for p in P])
    spread = "greatest(" + ", ".join(norm([f"{d}_{p} - {p}" for p in P]) for d in EIGHT) + ")"
    var = "greatest(" + ", ".join(f"abs({d}_pa - pa)" for d in EIGHT) + ") * 255"
    near = lambda ds: " OR ".join(f"coalesce({d}_mixed, false)" for d in ds)
    soft = lambda x, s: f"(1 / (1 + pow({x} / {s}, 2)))"
    return f"""{obs_sql(src)}, {nb('ob', 'nb1', P)},
    i1 AS (SELECT image_id, x, y, r, g, b, a, pr, pg, pb, pa, qr, qg, qb, qa, sqrt(pow({gx}, 2) + pow({gy}, 2)) * 0.5 / {unit} AS gradient, {spread} / {unit} AS spread, {var} AS alpha_variation FROM nb1),
    i2 AS (SELECT *, (pa > {1 / 255!r}::DOUBLE AND pa < 1 - {1 / 255!r}::DOUBLE) OR gradient > 8 AS mixed FROM i1), {nb('i2', 'nb2', ['mixed'], clamp=False)},
    i3 AS (SELECT *, CASE WHEN mixed THEN 0.0 WHEN {near(FOUR)} THEN 1.0 WHEN {near(EIGHT[4:])} THEN sqrt(2.0::DOUBLE) ELSE 1.5 END::DOUBLE AS edge_distance, pa > {1 / 255!r}::DOUBLE AS gives_rgb FROM nb2),
    it AS (SELECT *, {soft('gradient', 8)} * {soft('spread', 12)} * {soft('alpha_variation', 8)} * least(1.0, edge_distance / 1.5) AS weight FROM i3)"""
