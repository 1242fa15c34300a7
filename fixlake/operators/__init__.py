"""Analyses over messages."""
