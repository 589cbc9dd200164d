"""Names that a function uses are defined: such an error shows only once it is called."""

from __future__ import annotations

import builtins
import symtable
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
FILES = sorted(str(p.relative_to(ROOT)) for p in [*ROOT.glob("*.py"), *(ROOT / "pulsegrid").rglob("*.py")])


def _used(table):
    for inner in table.get_children():
        yield from (s.get_name() for s in inner.get_symbols() if s.is_global() and s.is_referenced())
        yield from _used(inner)


@pytest.mark.parametrize("file", FILES)
def test_every_name_is_defined(file):
    top = symtable.symtable((ROOT / file).read_text(), file, "exec")
    known = {s.get_name() for s in top.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()}
    assert not set(_used(top)) - known - set(dir(builtins)) - {"__file__", "__name__"}
