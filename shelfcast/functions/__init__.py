"""Reusable column expressions: engine-independent rounding, calendar codes, inventory formulas."""
