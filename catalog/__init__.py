"""Registered queries, each with its oracle SQL where SQL can express it."""
