"""Schemas of the engine's tables."""

from __future__ import annotations

CRATERS = "crater_id bigint, image_id bigint, cx double, cy double, r double"
ANNOTATIONS = "image string, cx double, cy double, r double, label int, source string, scale double"
CRATER_CSV = "id int, cx double, cy double, a double, b double, angle_deg double, r double, cx_orig double, cy_orig double, r_orig double, confidence double, source string, rim_strength double"
PATTERNS = "id string, name string, image string, scale double, anchor array<double>, members array<array<double>>, quality double, ambiguous boolean"
GRID_COLUMNS = ("Longitude", "Latitude", "Pixel", "Scan")
