"""Scoring of unbounded inputs."""
