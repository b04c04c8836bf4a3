import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import small  # noqa: E402


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    return small.write(str(tmp_path_factory.mktemp("awkward")), documents=small.documents())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return small.write(str(tmp_path_factory.mktemp("empty")))
