"""Puts the tests' own modules on the path."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture
def rng():
    return random.Random(7)
