"""Batch operators, frame to frame."""
