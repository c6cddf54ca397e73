"""Stored tables that change in versions."""
