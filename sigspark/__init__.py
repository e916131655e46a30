"""Labelled signal tables on Spark: planning, cleaning, marking, spectra, replay."""

__version__ = "0.1.0"
