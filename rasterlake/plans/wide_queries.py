"""Raster operators once more over rasters of several tiles, which also grow with the tables."""

from __future__ import annotations

from rasterlake.plans import contour_queries, evidence_queries, field_queries, gradient_queries, region_queries  # noqa: F401 - they register first
from rasterlake.registry import QUERIES, Query
from rasterlake.sources.fixture_sql import widened, with_fixtures
from rasterlake.sources.fixtures import WideLake

NAMES = [
    "j01_neighbour_join", "p01_p02_p03_interior", "p05_binomial_denoise", "p06_detail_preserving", "p07_gaussian_kernel", "p07_triangle_kernel",
    "p09_saddle_labelling", "r02_contour_segments", "r02_contour_length", "a28_euler_curve", "a15_linear_direction",
    "a16_radial_profile", "a19_radial_centre",
]

for _name in NAMES:
    _small = QUERIES[_name]
    _build = lambda lake, small=_small: small.build(WideLake(lake.spark, lake.dir))
    QUERIES[f"{_name}_wide"] = Query(f"{_name}_wide", _build, widened(_small.sql))

_interiors = widened(with_fixtures(["rgba8"], evidence_queries.interior_sql("rgba8")))
QUERIES["a62_semi_transparent_wide"] = Query("a62_semi_transparent_wide", lambda lake: evidence_queries.interiors(WideLake(lake.spark, lake.dir).rgba8()), _interiors)
