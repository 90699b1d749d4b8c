"""Composition: the lazy warehouse graph, registered queries and their DuckDB oracles, the nightly run."""
