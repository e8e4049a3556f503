"""Marlstone operators."""
