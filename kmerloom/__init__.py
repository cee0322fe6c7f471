"""Kmerloom: linked, multi-colour de Bruijn graph analytics on Spark DataFrames."""
