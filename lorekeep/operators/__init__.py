"""Operators over DataFrames: retrieval, lifecycle, graph, profiles, episodes, identity."""
