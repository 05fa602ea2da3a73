"""Column names: standard forms, repairs and suggestions. Names are changed by position, so duplicates are no trouble."""

from __future__ import annotations

import re

# Abbreviations in column names.
ABBREVIATIONS = {
    "cust": "customer", "nm": "name", "amt": "amount", "qty": "quantity", "pct": "percentage", "val": "value", "num": "number", "cd": "code",
    "desc": "description", "cat": "category", "addr": "address", "tel": "phone", "dob": "date_of_birth",
}


def snake_case(name: str) -> str:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    plain = re.sub(r"[^a-zA-Z0-9_]+", "", re.sub(r"[\s\-/\\]+", "_", spaced))
    return re.sub(r"_+", "_", plain).strip("_").lower() or "column"


def standard_name(name: str, strategies: list[str]) -> str:
    """One name by strategies: snake_case alone, or the others in a fixed order."""
    if "snake_case" in strategies:
        return snake_case(name)
    steps = {
        "remove_whitespace": str.strip,
        "replace_spaces": lambda s: re.sub(r"\s+", "_", s),
        "remove_special_chars": lambda s: re.sub(r"[^a-zA-Z0-9\s_]", "", s),
        "normalize_underscores": lambda s: re.sub(r"_+", "_", s).strip("_"),
        "lowercase": str.lower,
    }
    for key, step in steps.items():
        if key in strategies:
            name = step(name)
    return name.strip() or "column"


def unique(names: list[str], first: int = 1) -> list[str]:
    """Later bearers of a name get _first, _first + 1 and so on, skipping names that are taken."""
    taken, out = set(names), []
    seen: set[str] = set()
    for name in names:
        new, k = name, first
        while new in seen or (new != name and new in taken):
            new, k = f"{name}_{k}", k + 1
        seen.add(new)
        out.append(new)
    return out


def is_unnamed(name: str) -> bool:
    return name.strip() == "" or name.startswith("Unnamed:") or name.strip().lower() == "nan"


def fixed(names: list[str]) -> list[str]:
    """Trimmed and unique names, with unnamed_k for those that have none."""
    out, k = [], 0
    for name in names:
        if is_unnamed(name):
            out.append(f"unnamed_{k}")
            k += 1
        else:
            out.append(name.strip())
    return unique(out)


def suggested(name: str) -> str:
    return "_".join(ABBREVIATIONS.get(part, part) for part in snake_case(name).split("_"))


def export_names(names: list[str]) -> list[str]:
    return unique([f"col_{i + 1}" if is_unnamed(n) else n.strip() for i, n in enumerate(names)])
