"""Registered queries with their SQL."""

from . import corpus, folders, sessions, streams
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "corpus", "folders", "sessions", "streams"]
