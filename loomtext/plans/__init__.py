"""Prompts, model calls and the registered queries."""
