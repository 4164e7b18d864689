"""Whole plans: exposure analysis of source files, its reports, and the same operators on ordinary tables."""
