"""Spark jobs for pushbroom-sensor tables: calibration, correction, packets, quality and inventory."""
