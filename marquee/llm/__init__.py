"""Operators of a training-data pipeline: one module of queries per operator, named opN_<name>."""

from __future__ import annotations

import importlib
import pkgutil
import re


def _modules():
    for m in pkgutil.iter_modules(__path__):
        if re.match(r"op\d+_", m.name):
            yield m.name, importlib.import_module(f"{__name__}.{m.name}")


def queries() -> dict:
    return {name: m.query for name, m in sorted(_modules(), key=lambda x: int(re.search(r"\d+", x[0])[0]))}


def oracle_sql() -> dict:
    return {name: m.ORACLE for name, m in _modules() if hasattr(m, "ORACLE")}
