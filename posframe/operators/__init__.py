"""Operators on ordered tables, by family: position, project, join, aggregate, window, sort, sets, iterate."""
