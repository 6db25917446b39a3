"""Relational, text, span, matching, graph and statistics operators over DataFrames."""
