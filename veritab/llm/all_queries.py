"""Importing this module registers every query of the package."""

from . import op10_suffix_dedup, op11_collocations, op12_sharding, op13_whitening, op1_mixing, op2_decontamination, op3_substring_dedup, op4_suffix_tree, op5_line_dedup, op6_license_scan, op7_simhash, op8_html_text, op9_quality  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
