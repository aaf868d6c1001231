"""Mainframe-style data work and migration checks as ordinary Spark jobs."""

from zonedeck.layout import Field, Layout
from zonedeck.session import build_session, shared_dir

__all__ = ["Field", "Layout", "build_session", "shared_dir"]
