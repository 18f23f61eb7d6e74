"""A generated book of prompts, and a check that it is up to date."""

from __future__ import annotations

import os


def book(prompts: dict[str, str]) -> str:
    """All prompts under their names, in order."""
    return "\n".join(f"== {name} ==\n{text.rstrip()}\n" for name, text in sorted(prompts.items()))


def write(prompts: dict[str, str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(book(prompts))


def is_current(prompts: dict[str, str], path: str) -> bool:
    """Whether the file is what would be written now."""
    if not os.path.exists(path):
        return False
    with open(path, encoding="utf-8") as f:
        return f.read() == book(prompts)
