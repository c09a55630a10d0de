"""A helper that a later one of the same name replaces would serve queries it was not written for."""

from __future__ import annotations

import ast
import glob
import os
from collections import Counter

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("path", sorted(glob.glob(f"{HERE}/pulsegrid/**/*.py", recursive=True)), ids=lambda p: os.path.relpath(p, HERE))
def test_names_are_given_once(path):
    with open(path) as f:
        body = ast.parse(f.read()).body
    names = Counter(n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef))
    names += Counter(t.id for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name))
    assert [n for n, times in names.items() if times > 1] == []
