"""Readers: how tables, caches, feeds, sitemaps and listings become DataFrames."""
