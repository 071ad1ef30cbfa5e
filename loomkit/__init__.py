"""Spark jobs over tables of images, text, settings and events."""
