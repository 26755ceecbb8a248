from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fixture  # noqa: E402


@pytest.fixture(scope="session")
def odd(tmp_path_factory) -> str:
    return fixture.write(tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="session")
def empty(tmp_path_factory) -> str:
    return fixture.write(tmp_path_factory.mktemp("empty"), empty=True)
