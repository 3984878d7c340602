"""Readers and writers of notes, graphs and projections."""
