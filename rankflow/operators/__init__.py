"""Operators on matches, players and candidates, as DataFrame plans."""
