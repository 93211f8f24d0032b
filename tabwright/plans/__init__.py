"""Compositions of operators into whole tasks."""
