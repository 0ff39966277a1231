"""Pipelines and registered queries composed of the operators."""
