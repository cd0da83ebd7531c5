"""Vocabularies and product rules that ship with the lead schema, as JSON files: configuration with fixed values."""

from __future__ import annotations

import json
import pkgutil


def load(name: str):
    """The content of a file of this folder, also from within an archive on an executor."""
    return json.loads(pkgutil.get_data(__name__, f"{name}.json"))
