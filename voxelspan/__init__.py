"""Footprint, raster-sample and catalogue analytics as Spark DataFrame functions."""
