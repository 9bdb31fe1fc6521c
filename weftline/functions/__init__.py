"""Compact parameter notation: parsers and column builders."""
