"""Readers for recordings, clips and model files."""
