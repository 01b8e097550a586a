"""Variability analytics over tables of conditionally compiled source code."""
