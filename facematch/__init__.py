"""Finds which photos of an archive hold a given person, as DataFrame plans."""
