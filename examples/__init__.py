"""Runs on published example families."""
