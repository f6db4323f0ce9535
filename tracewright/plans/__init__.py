"""Whole jobs built from the operators, and their inputs."""
