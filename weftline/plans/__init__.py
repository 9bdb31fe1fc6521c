"""Dataflow documents: parsing, validation, compilation."""
