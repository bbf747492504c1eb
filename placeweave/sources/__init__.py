"""Inputs: coastlines from GeoJSON, recorded model answers, and a grammar for plain phrases."""
