"""Kotomill: readability analytics over text corpora, expressed as Spark DataFrame transformations."""
