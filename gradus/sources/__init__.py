"""Strict record loaders, and views of base tables as the records that operators take."""
