"""Mappings from the given tables to library inputs, and one registered query per operator."""
