"""Operators over source files and over the facts parsed from them."""
