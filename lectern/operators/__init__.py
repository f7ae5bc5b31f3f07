"""Queries over documents and pages as DataFrame functions."""
